"""Removal of repeated passages with sharded Aho-Corasick automata (operator 8).

A window is ``window`` consecutive words; every word under a window whose word
sequence also starts elsewhere is removed.

1. Copies of a whole word sequence are one class.  If it has a window, all its
   members lose all words; one member stands for it below.
2. Each window is represented by its anchor, the ``GRAM``-word sequence of
   least hash in it.  Equal windows have equal anchors at equal places, so only
   windows whose anchor occurs twice can repeat.  Neighbouring windows share
   anchors; a document yields some seven anchors per hundred words.
3. The windows under a repeated anchor form a segment, which goes to the shard
   of its anchor.  Equal segments are counted by their hashes first and their words travel once, with the count.  An anchor
   with over ``hot`` occurrences is dealt out window by window instead, by the
   window's own hash, so no shard gathers a common passage's surroundings.
4. A shard confirms which of its windows recur (by fingerprints in arrays, equal ones
   compared word by word), joins them into passages, compiles these into an automaton
   (over word numbers) and streams all segments routed to it through the automaton, which gives
   every place of a passage.  Shards hold about ``SHARD_BYTES`` of text each.
5. The found places return to the documents by segment, and words are removed.

Documents without a repeated anchor hold no passage, so no text of theirs is
streamed.  All comparison that decides is on words; hashes only route.
A text is known by two hashes of itself, never by its doc_id.

Defined cases: a null text has no words; texts shorter than a window lose
nothing; rows that repeat (doc_id included) are copies of each other; rows of one
doc_id with different texts, and rows without a doc_id, are each judged by their own text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import release_memory, stage, tidy, words_of

GRAM = 8
SHARD_BYTES = 4 << 20


def sha256_of(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def anchors(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, last window) of the runs of windows that share an anchor."""
    if len(words) < window:
        return np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0, "int64")
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype="uint64", count=len(words))
    n = len(words) - GRAM + 1
    grams = np.zeros(n, dtype="uint64")
    for i in range(GRAM):
        grams = (grams ^ h[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
        grams ^= grams >> np.uint64(29)
    inside = window - GRAM + 1
    place = np.lib.stride_tricks.sliding_window_view(grams, inside).argmin(axis=1) + np.arange(n - inside + 1)
    first = np.concatenate([[0], np.nonzero(np.diff(place))[0] + 1])
    last = np.concatenate([first[1:] - 1, [len(place) - 1]])
    return grams[place[first]].view("int64"), first, last


def named(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and two hashes ``t1, t2`` that stand for the text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t1"),
                       F.xxhash64(F.lit("second"), "text").alias("t2"))


def outline(docs: DataFrame, window: int) -> DataFrame:
    """One row per row of ``named``: class key, word count, digest of all words, and its anchors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for text in part.column("text"):
                    words = words_of(text.as_py(), lower=False)
                    found = anchors(words, window)
                    rows.append((xxhash.xxh3_128_digest(b" ".join(words)), len(words), sha256_of(words), *found))
                key, n, sha, h, a, b = zip(*rows)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("t1"), part.column("t2"), pa.array(key, pa.binary()), pa.array(n, pa.int64()),
                    pa.array(sha), pa.array(h, pa.list_(pa.int64())), pa.array(a, pa.list_(pa.int64())),
                    pa.array(b, pa.list_(pa.int64()))], names=["doc_id", "t1", "t2", "key", "n_words", "sha", "h", "a", "b"])

    return docs.mapInArrow(tidy(run), "doc_id long, t1 long, t2 long, key binary, n_words long, sha string, "
                                "h array<long>, a array<long>, b array<long>")


def cut_segments(held: DataFrame, window: int, hot: int) -> DataFrame:
    """``shard, key, doc, start, size, bytes`` of the segments that ``held(doc, text, runs)`` names, ``size`` words from
    word ``start`` on; ``doc`` is a class key."""
    columns = ["shard", "key", "doc", "start", "size", "bytes"]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text, runs in zip(pdf["doc"], pdf["text"], pdf["runs"]):
                words = words_of(text, lower=False)
                for r in runs:
                    h, n, a, b = r["h"], r["n"], r["a"], r["b"]
                    if n <= hot:
                        piece = b" ".join(words[a:b + window])
                        rows.append((h, xxhash.xxh3_128_digest(piece), doc, a, b + window - a, len(piece)))
                    else:
                        for s in range(a, b + 1):
                            piece = b" ".join(words[s:s + window])
                            rows.append((xxhash.xxh3_64_intdigest(piece) - (1 << 63), xxhash.xxh3_128_digest(piece), doc, s,
                                         window, len(piece)))
                if len(rows) >= 20_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    return held.select("doc", "text", "runs").mapInPandas(
        tidy(run), "shard long, key binary, doc binary, start long, size long, bytes long")


def different_segments(segments: DataFrame, held: DataFrame) -> DataFrame:
    """``shard, key, n, words`` of the different segments, each cut out of the text of its first place once its
    ``n`` places are counted, so that words are shuffled once and not for each place."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, parts in zip(pdf["text"], pdf["parts"]):
                words = words_of(text, lower=False)
                rows += [(p["shard"], p["key"], p["n"], b" ".join(words[p["start"]:p["start"] + p["size"]])) for p in parts]
                if len(rows) >= 20_000:
                    yield pd.DataFrame(rows, columns=["shard", "key", "n", "words"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["shard", "key", "n", "words"])

    first = segments.groupBy("shard", "key").agg(F.min(F.struct("doc", "start", "size")).alias("at"), F.count(F.lit(1)).alias("n"))
    parts = first.groupBy("at.doc").agg(F.collect_list(F.struct("shard", "key", "n", "at.start", "at.size")).alias("parts"))
    # Rows that repeat hold one text.
    texts = held.select("doc", "text").dropDuplicates(["doc"])
    return parts.join(texts, "doc").select("text", "parts").mapInPandas(
        tidy(run), "shard long, key binary, n long, words binary")


def recurring(flat: np.ndarray, lengths: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """For each place of ``flat`` (texts of word numbers, one after the other) whether a window starts there that occurs
    more than once, text ``i`` standing for ``counts[i]`` equal ones."""
    out = np.zeros(len(flat), dtype=bool)
    ends = np.repeat(np.cumsum(lengths), lengths)
    starts = np.flatnonzero(np.arange(len(flat)) + window <= ends)
    if not len(starts):
        return out
    weight = np.repeat(counts, lengths)[starts]
    for seed in range(1, 100):
        h, size = (flat.astype("uint64") + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15), 1
        h ^= h >> np.uint64(32)
        while size < window:  # fingerprints of 2, 4, 8 .. words, then of the window as two that overlap
            step = min(size, window - size)
            h = h[:len(h) - step] * np.uint64(0xD6E8FEB86659FD93) + h[step:]
            h ^= h >> np.uint64(31)
            h *= np.uint64(0x94D049BB133111EB)
            size += step
        _, first, group = np.unique(h[starts], return_index=True, return_inverse=True)
        several = (np.bincount(group, weights=weight) > 1)[group]
        here, there = starts[several], starts[first[group[several]]]
        if all(np.array_equal(flat[here + i], flat[there + i]) for i in range(window)):
            out[here] = True
            return out
    raise ArithmeticError("different windows kept equal fingerprints")


def passages_of(flat: np.ndarray, lengths: np.ndarray, counts: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """The different stretches of recurring windows in texts, each occurring ``counts`` times."""
    again = recurring(flat, lengths, counts, window)
    # A window that starts in one text ends in it, so at least window - 1 places part the runs of two texts.
    edge = np.diff(np.concatenate([[False], again, [False]]).astype("int8"))
    firsts, afters = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    distinct = {flat[a:b - 1 + window].tobytes() for a, b in zip(firsts.tolist(), afters.tolist())}
    return [tuple(np.frombuffer(x, dtype=flat.dtype).tolist()) for x in distinct]


def locate(texts: Iterable[tuple[int, ...]], passages: list[tuple[int, ...]]) -> Iterator[list[tuple[int, int]]]:
    """For each text the places (first word, word after) that passages cover, found by one automaton."""
    import ahocorasick

    if not passages:
        yield from ([] for _ in texts)
        return
    machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for p in passages:
        machine.add_word(p, len(p))
    machine.make_automaton()
    for t in texts:
        spans: list[tuple[int, int]] = []
        for end, size in machine.iter(t):
            first, after = end - size + 1, end + 1
            while spans and spans[-1][1] >= first:
                first = min(first, spans.pop()[0])
            spans.append((first, after))
        yield spans


def search_shards(segments: DataFrame, held: DataFrame, window: int, shard_bytes: int) -> DataFrame:
    """``key, spans`` of the segments in which repeated passages lie."""
    distinct = different_segments(segments, held)
    spark = segments.sparkSession
    size = segments.agg(F.sum("bytes")).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // shard_bytes + 1)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        numbers: dict[bytes, int] = {}
        number, parts = numbers.setdefault, []
        for words in pdf["words"]:
            cut = words.split(b" ")
            parts.append(np.fromiter((number(w, len(numbers)) for w in cut), dtype="int32", count=len(cut)))
        lengths = np.array([len(x) for x in parts], dtype="int64")
        flat = np.concatenate(parts)
        passages = passages_of(flat, lengths, pdf["n"].to_numpy(), window)
        keys, spans = [], []
        for key, found in zip(pdf["key"], locate((tuple(x.tolist()) for x in parts), passages)):
            if found:
                keys.append(key)
                spans.append([list(x) for x in found])
        del numbers, number, parts, flat, passages
        release_memory()
        return pd.DataFrame({"key": keys, "spans": spans}, dtype=object)

    return (distinct.withColumn("__s", F.pmod(F.xxhash64("shard"), F.lit(shards))).groupBy("__s")
            .applyInPandas(search, "key binary, spans array<array<long>>"))


def without(words: list[bytes], spans: Iterable[tuple[int, int]]) -> list[bytes]:
    keep = np.ones(len(words), dtype=bool)
    for a, b in spans:
        keep[a:b] = False
    return [w for w, k in zip(words, keep) if k]


def repeated_passages(docs: DataFrame, *, window: int = 35, hot: int = 4096,
                      shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """(outline, removals) of ``docs(doc_id, text)``.

    The outline has one row per input row with ``doc_id, t1, t2, key, n_words, sha, gone``
    (whether all its words go); removals are ``doc_id, key, t1, t2, text, spans`` for the texts that
    lose some of their words, each one row of the outline.
    """
    docs = named(docs)
    rows = stage(outline(docs, window), "outline")
    classes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("rep"))
    small = stage(rows.select("doc_id", "t1", "t2", "key", "n_words", "sha").join(classes.select("key", "copies"), "key").withColumn(
        "gone", (F.col("copies") > 1) & (F.col("n_words") >= window)).drop("copies"), "classes")
    # One row of each class, also where an id repeats.
    standing = stage(rows.where(F.size("h") > 0).select("doc_id", "t1", "t2", "key", "h", "a", "b")
                     .join(classes.select("key", "copies", "rep"), "key").where(F.col("doc_id").eqNullSafe(F.col("rep")))
                     .dropDuplicates(["key"]), "standing")
    # A class is known by its key alone while its anchors meet; its text's names come back afterwards.
    runs = standing.select("key", F.explode(F.arrays_zip("h", "a", "b")).alias("r")).select("key", "r.*")
    # A table of its own, so that the join's two sides are plain shuffles and a very common anchor can be split.
    several = stage(runs.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "several")
    found = (runs.join(several, "h").groupBy("key").agg(F.collect_list(F.struct("h", "n", "a", "b")).alias("runs"))
             .join(standing.select("doc_id", "t1", "t2", "key", (F.col("copies") > 1).alias("gone")), "key")
             .withColumnRenamed("key", "doc"))
    texts = docs.select(F.col("doc_id").alias("__d"), F.col("t1").alias("__1"), F.col("t2").alias("__2"), "text")
    held = stage(found.join(texts, (F.col("t1") == F.col("__1")) & (F.col("t2") == F.col("__2")) & F.col("doc_id").eqNullSafe(F.col("__d")))
                 .drop("__d", "__1", "__2"), "held")
    segments = stage(cut_segments(held, window, hot), "segments")
    spans = search_shards(segments, held, window, shard_bytes)
    place = F.transform("spans", lambda s: F.struct((s[0] + F.col("start")).alias("a"), (s[1] + F.col("start")).alias("b")))
    removed = (segments.select("doc", "key", "start").join(spans, "key").select("doc", place.alias("s"))
               .groupBy("doc").agg(F.flatten(F.collect_list("s")).alias("spans")))
    # A class of several rows is gone as a whole; any other with a window is one row.
    left = held.where(~F.col("gone")).select("doc_id", "doc", "t1", "t2", "text").join(removed, "doc")
    return small, left.withColumnRenamed("doc", "key")


def digest_removals(removals: DataFrame) -> DataFrame:
    """``doc_id, key, n_removed, kept_sha256`` of removals(doc_id, key, text, spans)."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, key, text, spans in zip(pdf["doc_id"], pdf["key"], pdf["text"], pdf["spans"]):
                words = words_of(text, lower=False)
                kept = without(words, [(s["a"], s["b"]) for s in spans])
                rows.append((None if pd.isna(doc) else int(doc), key, len(words) - len(kept), sha256_of(kept)))
            yield pd.DataFrame(rows, columns=["doc_id", "key", "n_removed", "kept_sha256"]).astype({"doc_id": "Int64"})

    return removals.select("doc_id", "key", "text", "spans").mapInPandas(
        run, "doc_id long, key binary, n_removed long, kept_sha256 string")


def remove_repeated(docs: DataFrame, *, window: int = 35, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with the words of repeated windows taken out of ``text`` (and ``n_chars``, if there is one, recounted).

    Texts that lose words become the words left, joined by single spaces;
    others stay as they are.  No row is dropped or repeated.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            left = [b" ".join(without(words_of(t, lower=False), [(s["a"], s["b"]) for s in spans])).decode("utf-8")
                    for t, spans in zip(pdf["text"], pdf["spans"])]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "t1": pdf["t1"], "t2": pdf["t2"], "left": left})

    small, removals = repeated_passages(docs, window=window, shard_bytes=shard_bytes)
    changed = removals.select("doc_id", "t1", "t2", "text", "spans").mapInPandas(tidy(run), "doc_id long, t1 long, t2 long, left string").unionByName(
        small.where("gone").select("doc_id", "t1", "t2", F.lit("").alias("left"))).dropDuplicates(["doc_id", "t1", "t2"])
    free = "__change"
    while any(c.startswith(free) for c in docs.columns):
        free += "_"
    changed = changed.select(*[F.col(c).alias(free + c) for c in ("doc_id", "t1", "t2", "left")])
    left = F.col(f"{free}left")
    joined = docs.join(changed, (F.xxhash64(docs["text"]) == F.col(f"{free}t1"))
                       & (F.xxhash64(F.lit("second"), docs["text"]) == F.col(f"{free}t2"))
                       & docs["doc_id"].cast("long").eqNullSafe(F.col(f"{free}doc_id")), "left")
    columns = {"text": F.coalesce(left, docs["text"])}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.coalesce(F.length(left).cast("long"), docs["n_chars"])
    return joined.select(*[columns[c].alias(c) if c in columns else docs[c] for c in docs.columns])
