"""MinHash near-duplicates by a signature-coordinate inverted join (operator 4).

A document's set of word shingles gets a signature of ``COORDS`` minima.
Every (coordinate, value) pair is a token.  Linked documents agree on at least
``MATCHES`` coordinates (at the threshold itself all but about two in a
million do), so under any common order of tokens they share one of their first
``COORDS - MATCHES + 1``: only those are posted.  The order is by how common a
token is, from a count sketch of fixed size, so frequent values stay out of
the prefixes.  Lists of one document are skipped.

No pair of documents becomes a row before it is known to agree.  The members of a list
travel with a tag (the low four bits of each minimum) and are compared in
blocks of ``BLOCK`` documents; a document yields one row, with the least document
that agrees with it on ``MATCHES`` coordinates and the least of all it is joined with there:

- the latter make clusters.  Lists of several blocks whose documents are in several clusters are
  compared again: every document outside a list's main cluster with all other documents
  of that list, again by tags in blocks and one row for each cluster that a document agrees with;
- the former, confirmed on the full texts, make components;
- inside a cluster of several components, the documents outside its main
  component are compared with all of the cluster, as sets in blocks.
  A block yields a row for each component that a document links to.

After that no pair of different components is left untested, so the components
are those of all links.

Documents with equal sets are one class from the start and linked to its
least id.

Defined cases: a null or empty text has an empty set and no links; a text of
one word is one shingle; repeated doc_ids are one node of the graph and one
output row each; rows without a doc_id are linked by equal sets only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import components, release_memory, stage, tidy, words_of

COORDS, MATCHES, CELLS, BLOCK = 64, 36, 1 << 18, 512
#: Rows of lists that a task compares at a time, and pairs of them it holds at once.
BUCKET_ROWS, PAIRS = 20_000, 200_000
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(1, 1 << 63, COORDS, dtype="uint64") | np.uint64(1)
_B = _RNG.integers(0, 1 << 63, COORDS, dtype="uint64")


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finisher of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles of ``size`` lower-cased words."""
    words = words_of(text)
    if not words:
        return np.zeros(0, dtype="uint64")
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], dtype="uint64")
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype="uint64", count=len(words))
    n, out = len(words) - size + 1, np.zeros(len(words) - size + 1, dtype="uint64")
    for i in range(size):
        out = mix(out + h[i:i + n])
    return np.unique(out)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), COORDS) minima as uint32; every set has members."""
    flat, out = np.concatenate(sets), np.empty((len(sets), COORDS), dtype="uint32")
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    for k in range(COORDS):
        out[:, k] = np.minimum.reduceat(((flat * _A[k] + _B[k]) >> np.uint64(32)).astype("uint32"), starts)
    return out


def sketch_sets(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, n_shingles, set_key, sig`` of ``docs(doc_id, text)``; no key and signature without shingles."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t.as_py(), size) for t in part.column("text")]
                full = [s for s in sets if len(s)]
                sigs = iter(signatures(full) if full else ())
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(sigs).tobytes() if len(s) else None for s in sets], pa.binary())],
                    names=["doc_id", "n_shingles", "set_key", "sig"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_shingles long, set_key binary, sig binary")


def _tokens(sigs: Iterable[bytes]) -> np.ndarray:
    sig = np.stack([np.frombuffer(s, "uint32") for s in sigs]).astype("uint64")
    return mix(sig | (np.arange(COORDS, dtype="uint64") << np.uint64(32)))


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros(CELLS, dtype="int64")
    for pdf in batches:
        if len(pdf):
            counts += np.bincount((_tokens(pdf["sig"]) % np.uint64(CELLS)).astype("int64").ravel(), minlength=CELLS)
    at = np.nonzero(counts)[0]
    yield pd.DataFrame({"cell": at, "n": counts[at]})


def postings(reps: DataFrame) -> DataFrame:
    """``token, doc_id`` for the prefix tokens of ``reps(doc_id, sig)``."""
    spark = reps.sparkSession
    # A table of CELLS counters, whatever the corpus.
    cells = reps.select("sig").mapInPandas(_cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    common = np.zeros(CELLS, dtype="int64")
    common[cells["cell"]] = cells["n"]
    shared = spark.sparkContext.broadcast(common)

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            tokens = _tokens(pdf["sig"])
            rank = np.lexsort((tokens, shared.value[(tokens % np.uint64(CELLS)).astype("int64")]), axis=1)
            first = np.take_along_axis(tokens, rank[:, :COORDS - MATCHES + 1], axis=1)
            yield pd.DataFrame({"token": first.ravel().view("int64"),
                                "doc_id": np.repeat(pdf["doc_id"].to_numpy(), first.shape[1])})

    return reps.select("doc_id", "sig").mapInPandas(tidy(post), "token long, doc_id long")


def tagged(reps: DataFrame) -> DataFrame:
    """``doc_id, n, tag`` of ``reps(doc_id, n_shingles, sig)``; the tag has half a byte for each coordinate."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            low = np.frombuffer(b"".join(pdf["sig"]), "uint32").reshape(-1, COORDS).astype("uint8") & 15
            tags = low[:, ::2] | (low[:, 1::2] << 4)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n": pdf["n_shingles"], "tag": [t.tobytes() for t in tags]})

    return reps.select("doc_id", "n_shingles", "sig").mapInPandas(run, "doc_id long, n int, tag binary")


def tag_matrix(tags: Iterable[bytes]) -> np.ndarray:
    """A row for each tag, a column for each coordinate (their order does not matter)."""
    both = np.frombuffer(b"".join(tags), dtype="uint8").reshape(-1, COORDS // 2)
    return np.hstack([both & 15, both >> 4])


def agree(tags: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether rows ``i`` and ``j`` agree often enough and have sizes that allow a link."""
    out = 100 * np.minimum(sizes[i], sizes[j]) >= percent * np.maximum(sizes[i], sizes[j])
    at = np.flatnonzero(out)
    for lo in range(0, len(at), PAIRS):
        part = at[lo:lo + PAIRS]
        out[part] = (tags[i[part]] == tags[j[part]]).sum(axis=1) >= MATCHES
    return out


def agreeing_within(units: np.ndarray, tags: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All agreeing pairs of rows of one unit; ``units`` is sorted."""
    first = np.flatnonzero(np.concatenate([[True], units[1:] != units[:-1]]))
    after = np.repeat(np.append(first[1:], len(units)), np.diff(np.append(first, len(units))))
    left, right, at, step = [], [], np.arange(len(units)), 1
    while True:
        at = at[at + step < after[at]]
        if not len(at):
            break
        hit = at[agree(tags, sizes, at, at + step, percent)]
        left.append(hit)
        right.append(hit + step)
        step += 1
    none = np.zeros(0, dtype="int64")
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def bucketed(rows: DataFrame, n: int, *unit: str) -> DataFrame:
    """``rows``, ``n`` of them, with a ``bucket`` that holds whole units and about ``BUCKET_ROWS`` rows."""
    spark = rows.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // BUCKET_ROWS + 1)
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*unit), F.lit(buckets)))


def list_groups(lists: DataFrame, tags: DataFrame, percent: int) -> DataFrame:
    """``doc_id, near, low`` from ``lists(token, docs, doc_id)`` and ``tags(doc_id, n, tag)``: for each document
    with an agreeing one in its block of a list the least such, and the least document that agreements there
    join it with.  Tags join the lists on their way to the blocks and are not written with them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["unit", "doc_id"])
        ids = pdf["doc_id"].to_numpy()
        i, j = agreeing_within(pdf["unit"].to_numpy(), tag_matrix(pdf["tag"]), pdf["n"].to_numpy(), percent)
        near = np.full(len(ids), np.iinfo("int64").max)
        np.minimum.at(near, i, ids[j])
        np.minimum.at(near, j, ids[i])
        low = np.arange(len(ids))  # rows of a unit are in the order of their ids
        while len(i):
            new = low.copy()
            np.minimum.at(new, i, low[j])
            np.minimum.at(new, j, low[i])
            new = new[new]
            if np.array_equal(new, low):
                break
            low = new
        hit = np.unique(np.concatenate([i, j]))
        release_memory()
        return pd.DataFrame({"doc_id": ids[hit], "near": near[hit], "low": ids[low[hit]]})

    block = F.pmod(F.xxhash64("doc_id", "token"), F.ceil(F.col("docs") / BLOCK))
    units = lists.select(F.xxhash64("token", block).alias("unit"), "doc_id").join(tags, "doc_id")
    units = bucketed(units, lists.count(), "unit")
    return units.groupBy("bucket").applyInPandas(run, "doc_id long, near long, low long").distinct()


def crossing_groups(lists: DataFrame, tags: DataFrame, clusters: DataFrame, percent: int) -> DataFrame:
    """``src, dst``: documents of lists of several blocks and, for each other cluster in a list, one that agrees with them there."""
    wide = lists.where(F.col("docs") > BLOCK)
    named = wide.join(clusters, wide["doc_id"] == clusters["node"], "left").withColumn("comp", F.coalesce("component", "doc_id"))
    sizes = named.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("token").agg(F.max(F.struct("size", "comp")).alias("m"), F.count(F.lit(1)).alias("comps"),
                                      F.sum("size").alias("members")).where("comps > 1").select(
        F.col("token"), F.col("m.comp").alias("main"), F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"),
        F.ceil((F.col("members") - F.col("m.size")) / BLOCK).cast("int").alias("outer_blocks"))
    mixed = stage(named.select("token", "doc_id", "comp").join(main, "token").join(tags, "doc_id"), "mixed")
    part = lambda n: F.pmod(F.xxhash64("doc_id", "token"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["token", "block", "outer_block", "doc_id", "n", "tag", "comp", "outside"]
    inner = (mixed.withColumn("outside", F.lit(False)).withColumn("block", part("blocks"))
             .withColumn("outer_block", every("outer_blocks")).select(*columns))
    outer = (mixed.where("comp <> main").withColumn("outside", F.lit(True)).withColumn("outer_block", part("outer_blocks"))
             .withColumn("block", every("blocks")).select(*columns))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        src, dst = [], []
        for _, unit in pdf.groupby(["token", "block", "outer_block"]):
            x, y = unit[unit["outside"]], unit[~unit["outside"]]
            tags, sizes = tag_matrix([*x["tag"], *y["tag"]]), np.concatenate([x["n"], y["n"]])
            i, j = np.divmod(np.arange(len(x) * len(y)), max(1, len(y)))
            cx, cy = x["comp"].to_numpy(), y["comp"].to_numpy()
            keep = cx[i] != cy[j]
            i, j = i[keep], j[keep]
            hit = agree(tags, sizes, i, j + len(x), percent)
            found = pd.DataFrame({"src": x["doc_id"].to_numpy()[i[hit]], "comp": cy[j[hit]], "dst": y["doc_id"].to_numpy()[j[hit]]})
            found = found.groupby(["src", "comp"], as_index=False)["dst"].min()
            src.append(found["src"])
            dst.append(found["dst"])
        return pd.DataFrame({"src": pd.concat(src).astype("int64"), "dst": pd.concat(dst).astype("int64")})

    rows = inner.unionByName(outer)
    rows = bucketed(rows, rows.select("token").count(), "token", "block", "outer_block")
    return rows.groupBy("bucket").applyInPandas(run, "src long, dst long").distinct()


def linked(a: Column, b: Column, size: int, percent: int) -> Column:
    """Whether ``100 * intersection >= percent * union`` holds for the full sets of two texts."""

    @F.pandas_udf("boolean")
    def test(x: pd.Series, y: pd.Series) -> pd.Series:
        out, seen = [], {}
        for s, t in zip(x, y):
            if s not in seen:
                seen = {s: shingle_set(s, size)}  # pairs of one document come together
            u, v = seen[s], shingle_set(t, size)
            both = len(np.intersect1d(u, v, assume_unique=True))
            out.append(100 * both >= percent * (len(u) + len(v) - both))
        return pd.Series(out, dtype="bool")

    return test(a, b)


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Of ``pairs(a, b)`` the linked ones, as ``src, dst``; ``texts(doc_id, text)`` has one row for each id."""
    right = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = right.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.where(linked(F.col("text_a"), F.col("text_b"), size, percent)).select(
        F.col("a").alias("src"), F.col("b").alias("dst"))


def block_links(pdf: pd.DataFrame, size: int, percent: int) -> pd.DataFrame:
    """Links from the ``outside`` rows of a block to its other rows: one for each component that a document links to."""
    inner = pdf[~pdf["outside"]]
    sets = [shingle_set(t, size) for t in inner["text"]]
    ids, comps = inner["doc_id"].to_numpy(), inner["comp"].to_numpy()
    sizes = np.array([len(x) for x in sets])
    # Which members hold each shingle, ordered by shingle.
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    src, dst = [], []
    outer = pdf[pdf["outside"]]
    for doc, comp, text in zip(outer["doc_id"], outer["comp"], outer["text"]):
        mine = shingle_set(text, size)
        first, after = np.searchsorted(flat, mine, "left"), np.searchsorted(flat, mine, "right")
        n = after - first
        at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(sets))
        hit = (100 * both >= percent * (len(mine) + sizes - both)) & (comps != comp)
        for c in np.unique(comps[hit]):
            src.append(doc)
            dst.append(ids[hit & (comps == c)].min())
    return pd.DataFrame({"src": np.array(src, dtype="int64"), "dst": np.array(dst, dtype="int64")})


def cluster_links(clusters: DataFrame, found: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between different components of one cluster, as ``src, dst``."""
    named = clusters.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")).join(
        found.select(F.col("node").alias("doc_id"), F.col("component").alias("comp")), "doc_id", "left").withColumn(
        "comp", F.coalesce("comp", "doc_id"))
    sizes = named.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("cluster").agg(
        F.max(F.struct("n", "comp")).alias("m"), F.count(F.lit(1)).alias("comps"), F.sum("n").alias("members")).where(
        "comps > 1").select("cluster", F.col("m.comp").alias("main"), F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"),
                            F.ceil((F.col("members") - F.col("m.n")) / BLOCK).cast("int").alias("outer_blocks"))
    mixed = stage(docs.join(named.join(main, "cluster"), "doc_id").select(
        "cluster", "blocks", "outer_blocks", "doc_id", "comp", "text", (F.col("comp") != F.col("main")).alias("outside")), "clusters")
    # Every block of the cluster meets every block of its outside documents.
    part = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["cluster", "block", "outer_block", "doc_id", "comp", "text", "outside"]
    inner = (mixed.withColumn("outside", F.lit(False)).withColumn("block", part("blocks"))
             .withColumn("outer_block", every("outer_blocks")).select(*columns))
    outer = (mixed.where("outside").withColumn("outer_block", part("outer_blocks"))
             .withColumn("block", every("blocks")).select(*columns))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["outside"].all():
            return pd.DataFrame({"src": [], "dst": []}, dtype="int64")
        return block_links(pdf, size, percent)

    return inner.unionByName(outer).groupBy("cluster", "block", "outer_block").applyInPandas(compare, "src long, dst long")


def near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = stage(sketch_sets(docs, size), "minhash")
    classes = sets.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    keyed = stage(sets.join(classes, "set_key", "left").select("doc_id", "n_shingles", "rep"), "classes")
    is_rep = keyed.where("rep = doc_id").select("doc_id").distinct()
    reps = stage(sets.where("set_key is not null").join(is_rep, "doc_id", "left_semi")
                 .dropDuplicates(["doc_id"]).select("doc_id", "n_shingles", "sig"), "reps")
    posted = stage(postings(reps), "postings")
    several = posted.groupBy("token").agg(F.count(F.lit(1)).cast("int").alias("docs")).where("docs > 1")
    lists, tags = stage(posted.join(several, "token"), "lists"), stage(tagged(reps), "tags")

    groups = stage(list_groups(lists, tags, percent), "groups")
    clusters = components(groups.select(F.col("doc_id").alias("src"), F.col("low").alias("dst")))
    crossing = crossing_groups(lists, tags, clusters, percent)
    clusters = components(clusters.select(F.col("node").alias("src"), F.col("component").alias("dst")).unionByName(crossing))

    first = stage(groups.select(F.least("doc_id", "near").alias("a"), F.greatest("doc_id", "near").alias("b")).distinct(), "pairs")
    used = first.select(F.col("a").alias("doc_id")).union(first.select(F.col("b").alias("doc_id"))).distinct()
    edges = stage(confirm(first, docs.join(used, "doc_id", "left_semi"), size, percent), "links")
    found = components(edges)
    inside = cluster_links(clusters, found, docs, size, percent)
    merged = found.select(F.col("node").alias("src"), F.col("component").alias("dst"))
    found = components(merged.unionByName(inside))
    rep_of = F.coalesce("component", "rep", "doc_id")
    return (keyed.join(found.withColumnRenamed("node", "rep"), "rep", "left")
            .select("doc_id", "n_shingles", rep_of.alias("component_id"), F.col("doc_id").eqNullSafe(rep_of).alias("kept")))
