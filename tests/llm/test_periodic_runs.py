"""Operator 11 against a plain search over all periods."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quire.llm.periodic_runs import Catchers, collapsed, periodic_runs, runs_of
from quire.llm.q_periodic_runs import op11_periodic_runs


def plain_runs(words, shortest=24, times=3):
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(shortest, times * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((a, size, q) for (a, size), q in found.items()), key=lambda r: (r[0], r[2]))


def planted(words, doc_id):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def plain_row(doc_id, text):
    words = planted((text or "").encode().split(), doc_id)
    runs = plain_runs(words)
    drop = {i for a, size, q in runs for i in range(a + q, a + size)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join(f"{a},{size},{q}\n" for a, size, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in drop)).hexdigest())


def random_words(rng):
    words = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randint(0, 150))]
    for _ in range(rng.randint(0, 3)):
        if words:
            a, q = rng.randrange(len(words)), rng.randint(1, 25)
            for i in range(a + q, min(len(words), a + q * rng.randint(2, 9) + rng.randrange(5))):
                words[i] = words[i - q]
    return words


@pytest.mark.parametrize("piece", [1, 7, 64, 1 << 16])
def test_runs_equal_the_plain_search_however_words_are_appended(piece):
    rng = random.Random(piece)
    for _ in range(250):
        words = random_words(rng)
        for shortest, times in ((24, 3), (5, 3), (1, 4)):
            assert runs_of(words, shortest, times, piece) == plain_runs(words, shortest, times)


def test_catchers_report_runs_of_what_was_appended_so_far():
    import numpy as np
    catchers, x = Catchers(), [1, 2, 3] * 12 + [9] * 30
    for i, v in enumerate(x):
        catchers.append(np.array([v]))
        if i in (22, 23, 35, 50, 65):
            assert catchers.runs() == plain_runs(x[:i + 1])


def test_a_fingerprint_collision_does_not_decide(monkeypatch):
    import quire.llm.periodic_runs as module
    real = module.mixed
    seen = []

    def colliding(x):
        seen.append(1)
        return real(x) if len(seen) > 6 else x * 0  # all fingerprints of the first try are equal
    monkeypatch.setattr(module, "mixed", colliding)
    words = [b"%d" % i for i in range(40)] + [b"a"] * 30
    assert runs_of(words) == [(40, 30, 1)]


def test_long_periods_and_one_word_texts():
    rng = random.Random(5)
    base = [b"%d" % rng.randrange(10 ** 6) for _ in range(3001)]
    assert runs_of([b"x"] + base * 3 + [b"y"]) == [(1, 9003, 3001)]
    assert runs_of(base * 2 + base[:-1]) == []  # one word short of three periods
    assert runs_of([b"w"] * 100_000) == [(0, 100_000, 1)]
    assert collapsed([b"w"] * 100, [(0, 100, 1)]) == [b"w"]
    assert runs_of([]) == [] and runs_of([b"a"] * 23) == []


def test_query_against_the_plain_version(spark, tmp_dir):
    rng = random.Random(11)
    rows = [(i, " ".join(w.decode() for w in random_words(rng)) + rng.choice(["", "\t", " \n "])) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " \t "), (503, "x " * 4000), (504, "ä b " * 30), (7, rows[7][1]), (7, "other " * 24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("clash")).withColumn("n_words", F.lit(-1))
    docs.write.parquet(tmp_dir + "/documents.parquet")
    got = op11_periodic_runs(spark, tmp_dir).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()
    assert sorted(map(tuple, got), key=str) == sorted((plain_row(*r) for r in rows), key=str)


def test_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a " * 30)], "doc_id long, text string")
    assert [tuple(r) for r in periodic_runs(docs).select("doc_id", "n_words", F.size("runs"), "text").collect()] == [(None, 30, 1, "a")]
    assert periodic_runs(docs.limit(0)).count() == 0
