"""Operator 8: identity of rows, confirmation of passages, memory-bounded shards."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import substrings
from quire.llm.q_substrings import op8_substrings


def plain_left(texts, window=35):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        drop = {j for i in range(len(w) - window + 1) if seen[tuple(w[i:i + window])] > 1 for j in range(i, i + window)}
        out.append([x for j, x in enumerate(w) if j not in drop])
    return words, out


def corpus(rng):
    word = lambda: "w%d" % rng.randrange(4000)
    passages = [[word() for _ in range(rng.randint(35, 90))] for _ in range(6)]
    texts = []
    for _ in range(90):
        parts = [word() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            at = rng.randint(0, 20)
            parts += p[at:] + [word() for _ in range(rng.randint(0, 30))]
        texts.append(" ".join(parts))
    return texts + [texts[3], texts[3].replace(" ", "\n"), "same " * 80, None, "", "x " * 34]


def test_recurring_windows_equal_a_plain_count():
    rng = random.Random(2)
    for _ in range(60):
        window = rng.choice([2, 5, 8, 35])
        texts = [np.array([rng.randrange(3) for _ in range(rng.randint(0, 70))], dtype="int32") for _ in range(rng.randint(1, 6))]
        counts = np.array([rng.choice([1, 1, 2]) for _ in texts])
        lengths = np.array([len(t) for t in texts])
        got = substrings.recurring(np.concatenate(texts), lengths, counts, window)
        seen = Counter()
        for t, n in zip(texts, counts):
            for i in range(len(t) - window + 1):
                seen[tuple(t[i:i + window])] += n
        want = [i + window <= len(t) and seen[tuple(t[i:i + window])] > 1 for t in texts for i in range(len(t))]
        assert got.tolist() == want


def test_the_automaton_gives_the_places():
    rng = random.Random(6)
    texts = [tuple(rng.randrange(3) for _ in range(60)) for _ in range(20)]
    passages = [texts[0][5:15], texts[1][20:32], texts[0][5:11]]
    for t, spans in zip(texts, substrings.locate(texts, passages)):
        covered = {j for p in passages for i in range(len(t) - len(p) + 1) if t[i:i + len(p)] == p for j in range(i, i + len(p))}
        assert {j for a, b in spans for j in range(a, b)} == covered
    assert list(substrings.locate(texts, [])) == [[]] * len(texts)


def test_places_come_from_the_automaton_alone(spark, monkeypatch, tmp_dir):
    monkeypatch.setattr(substrings, "locate", lambda texts, passages: ([] for _ in texts))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(corpus(random.Random(3)))], "doc_id long, text string")
    _, removals = substrings.repeated_passages(docs)
    assert removals.count() == 0


@pytest.mark.parametrize("shard_bytes", [substrings.SHARD_BYTES, 2000])
def test_rows_with_equal_or_missing_ids(spark, tmp_dir, shard_bytes):
    rng = random.Random(4)
    texts = corpus(rng)
    ids = [rng.choice([1, 2, 3, None, 10 + i]) for i in range(len(texts))]
    docs = (spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").withColumn("row", F.monotonically_increasing_id())
            .withColumn("__id", F.lit(1)).withColumn("__left", F.lit("x")).withColumn("__changeleft", F.lit("y")).withColumn("key", F.lit(2))
            .withColumn("t1", F.lit(3)).withColumn("gone", F.lit(True)).withColumn("n_chars", F.length("text").cast("long")))
    docs.write.parquet(tmp_dir + "/documents.parquet")
    docs = spark.read.parquet(tmp_dir + "/documents.parquet")
    words, left = plain_left(texts)
    got = {r["row"]: r for r in substrings.remove_repeated(docs, shard_bytes=shard_bytes).collect()}
    assert len(got) == len(texts) and set(got) == {r["row"] for r in docs.collect()}
    for r in docs.collect():
        i = [k for k, t in enumerate(texts) if t == r["text"] and ids[k] == r["doc_id"]][0]
        want = texts[i] if len(left[i]) == len(words[i]) else b" ".join(left[i]).decode()
        assert got[r["row"]]["text"] == want and got[r["row"]]["__left"] == "x" and got[r["row"]]["key"] == 2
        assert got[r["row"]]["n_chars"] == (None if want is None else len(want))
    rows = op8_substrings(spark, tmp_dir).collect()
    want = sorted((str(ids[i]), len(words[i]), len(words[i]) - len(left[i]), substrings.sha256_of(left[i])) for i in range(len(texts)))
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows) == want


def test_without_a_character_count(spark):
    docs = spark.createDataFrame([(1, "a " * 40), (2, "a " * 40)], "doc_id int, text string")
    assert [tuple(r) for r in substrings.remove_repeated(docs).orderBy("doc_id").collect()] == [(1, ""), (2, "")]


def test_words_of_equal_segments_are_cut_and_shuffled_once(spark):
    """Two texts with one long passage in common: its segments are counted by hash, their words come from one place."""
    common = " ".join(f"w{i}" for i in range(80))
    held = spark.createDataFrame([(b"a", "x y " + common, [(7, 2, 2, 40)]), (b"b", common, [(7, 2, 0, 38)])],
                                 "doc binary, text string, runs array<struct<h long, n long, a long, b long>>")
    segments = substrings.cut_segments(held, 35, 4096)
    assert "words" not in segments.columns
    rows = segments.collect()
    assert {(bytes(r["doc"]), r["start"], r["size"]) for r in rows} == {(b"a", 2, 73), (b"b", 0, 73)}
    assert len({bytes(r["key"]) for r in rows}) == 1 and {r["bytes"] for r in rows} == {len(" ".join(common.split()[:73]))}
    got = substrings.different_segments(segments, held).collect()
    assert [(r["shard"], r["n"], bytes(r["words"]).decode()) for r in got] == [(7, 2, " ".join(common.split()[:73]))]
    hot = substrings.different_segments(substrings.cut_segments(held, 35, 1), held).collect()  # window by window
    assert len(hot) == 39 and {r["n"] for r in hot} == {2} and {len(r["words"].split()) for r in hot} == {35}
