"""Benchmark decontamination by SimHash over item-sized windows (operator 2).

Texts are lower-cased and stripped of everything but letters, digits and white
space; shingles are five words (all words of a shorter item).  A shingle weighs
its count times a whole-number inverse document frequency over the benchmark.

1. Document shingles that an item holds are found by one join on their hash; a
   pair whose shared shingles weigh under ``percent`` of the item cannot reach
   the similarity and is dropped.
2. Where a shared shingle stands as far from the window's start as in the item,
   a window of the item's length is laid (shifted inside the document at its
   ends).  Windows and items get 64-bit SimHash fingerprints.  A document may
   hold the item's parts in another order, so a window is also laid at every
   other start whose shared shingles, by a running sum over their positions,
   weigh ``percent`` of the item, or more than the best similarity that the
   windows above gave the pair: at no other start can more be reached.
3. Fingerprints are cut into ``RADIUS + 1`` blocks: two that differ in at most
   ``RADIUS`` bits are equal in one block at least, so the join on (item,
   block, value) finds all of them.
4. Pairs within the radius are verified by weighted Jaccard similarity on the
   shingles themselves.

Only DataFrame functions are used.  The benchmark's shingles are broadcast
after a count, up to ``BROADCAST_ROWS`` rows; larger ones are shuffled.  The
radius of 20 covers all but about one in ten thousand of pairs that just reach
0.8.  A window's weights are whole numbers, so fingerprints do not depend on
the order of addition.

Defined cases: null and empty texts, items included, match nothing; a document
shorter than an item is one window; repeated rows of a doc_id are one document
with several places; repeated items match each; rows without a doc_id match
nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import stage

SHINGLE, RADIUS, BROADCAST_ROWS = 5, 20, 1_000_000
WORDS = r"filter(split(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}\\s]+', ''), '\\s+'), w -> w <> '')"


def small(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if it is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def hashes(k: int) -> Column:
    """Hashes of all ``k``-word shingles in order, of the word hashes ``h``."""
    parts = ", ".join(f"h[i + {j}]" for j in range(k))
    return F.expr(f"if(size(h) < {k}, array(), transform(sequence(0, size(h) - {k}), i -> xxhash64({parts})))")


def shingles(words: str, k: str) -> Column:
    return F.expr(f"if(size({words}) < {k} or {k} = 0, array(), transform(sequence(1, size({words}) - {k} + 1), "
                  f"i -> array_join(slice({words}, i, {k}), ' ')))")


def fingerprint() -> Column:
    """SimHash of a group's ``gram`` strings with weights ``weight``."""
    bit = lambda j: F.when(F.getbit(F.xxhash64("gram"), F.lit(j)) == 1, F.col("weight")).otherwise(-F.col("weight"))
    out = F.lit(0).cast("long")
    for j in range(64):
        out = out.bitwiseOR(F.when(F.sum(bit(j)) > 0, F.shiftleft(F.lit(1).cast("long"), j)).otherwise(F.lit(0).cast("long")))
    return out


def blocks(fp: str) -> Column:
    """The fingerprint's ``RADIUS + 1`` blocks as (number, value)."""
    n = RADIUS + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return F.explode(F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, a).bitwiseAND(
        F.lit((1 << (b - a)) - 1)).alias("value")) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]))


def benchmark_shingles(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``item_id, size, k, words`` of usable items; ``item_id, k, gram, at[], n, weight`` of their shingles)."""
    usable = (items.select("item_id", F.expr(WORDS).alias("words")).where(F.size("words") > 0)
              .select("item_id", "words", F.size("words").alias("size"), F.least(F.size("words"), F.lit(SHINGLE)).alias("k")))
    grams = (usable.select("item_id", "size", "k", F.posexplode(shingles("words", "k")).alias("at", "gram"))
             .groupBy("item_id", "size", "k", "gram").agg(F.collect_list("at").alias("at"), F.count(F.lit(1)).alias("n")))
    total = usable.select("item_id").count()
    idf = grams.groupBy("gram").agg(F.round(1000 * F.log1p(F.lit(total) / F.count(F.lit(1)))).cast("long").alias("idf"))
    return usable, grams.join(idf, "gram").withColumn("weight", F.col("n") * F.col("idf"))


def heavy_starts(docs: DataFrame, pairs: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """``doc_id, item_id, size, start`` of all windows whose shared shingles weigh ``percent`` of the item.

    ``pairs(doc_id, item_id, size, whole, best)``; where ``best`` is given, of those
    that weigh more than this part of the item.  A shingle at ``pos`` lies in the
    windows from ``pos - (size - k)`` to ``pos``: its weight is added at the
    first and taken off behind the last, and the running sum is that of each start.
    """
    here = grams.select("item_id", "gram", "k", (F.col("weight") / F.col("n")).cast("long").alias("idf"))
    spots = (docs.join(pairs, "doc_id").withColumn("words", F.expr(WORDS)).withColumn("k", F.least("size", F.lit(SHINGLE)))
             .select("doc_id", "item_id", "size", "whole", "best", F.size("words").alias("len"), F.posexplode(shingles("words", "k")).alias("pos", "gram"))
             .join(small(here), ["item_id", "gram"]))
    steps = (spots.select("doc_id", "item_id", "size", "whole", "best", "len", F.explode(F.array(
        F.struct(F.greatest(F.lit(0), F.col("pos") - F.col("size") + F.col("k")).alias("at"), F.col("idf").alias("w")),
        F.struct((F.col("pos") + 1).alias("at"), (-F.col("idf")).alias("w")))).alias("e"))
        .groupBy("doc_id", "item_id", "size", "whole", "best", F.col("e.at").alias("at")).agg(F.sum("e.w").alias("w"), F.max("len").alias("len")))
    pair = Window.partitionBy("doc_id", "item_id")
    sums = steps.select("doc_id", "item_id", "size", "whole", "best", "at", F.sum("w").over(pair.orderBy("at")).alias("shared"),
                        F.lead("at").over(pair.orderBy("at")).alias("next"), F.max("len").over(pair).alias("len"))
    last = F.least(F.col("next") - 1, F.col("len") - F.col("size"))
    can = F.coalesce(F.col("shared") > F.col("best") * F.col("whole"), 100 * F.col("shared") >= percent * F.col("whole"))
    return (sums.withColumn("last", last).where(can & (F.col("at") <= F.col("last")))
            .select("doc_id", "item_id", "size", F.explode(F.sequence("at", "last")).alias("start")))


def contaminated(docs: DataFrame, items: DataFrame, *, percent: int = 80) -> DataFrame:
    """``doc_id, item_id, start, similarity``: the items of ``items(item_id, text)`` that documents hold.

    ``start`` is the first word (of the stripped text) of the first window that
    reaches the similarity, of those in place with a shared shingle if one of
    these does; ``similarity`` is the highest of all windows.
    """
    docs = docs.select("doc_id", "text")
    usable, grams = benchmark_shingles(items)
    grams = stage(grams, "benchmark")
    total = grams.groupBy("item_id").agg(F.sum("weight").alias("whole"))
    unseen = max(1, usable.select("item_id").count())

    # 1. Shared shingles, by hash of hashes on both sides.
    found = None
    for k in sorted(r["k"] for r in grams.select("k").distinct().collect()):
        hashed = docs.select("doc_id", F.expr(f"transform({WORDS}, w -> xxhash64(w))").alias("h"))
        mine = grams.where(F.col("k") == k)
        keys = mine.select("item_id", "size", "weight", "at", F.expr(
            "transform(split(gram, ' '), w -> xxhash64(w))").alias("h")).select(
            "item_id", "size", "weight", "at", hashes(k)[0].alias("g"))
        places = hashed.select("doc_id", F.size("h").alias("len"), F.posexplode(hashes(k)).alias("pos", "g"))
        hit = places.join(small(keys), "g").select("doc_id", "len", "item_id", "size", "weight", "g", "pos", F.explode("at").alias("off"))
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        return docs.sparkSession.createDataFrame(
            [], f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {dict(items.dtypes)['item_id']}, start long, similarity double")
    start = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("off"), F.col("len") - F.col("size")))
    enough = (found.groupBy("doc_id", "item_id", "size", "g")
              .agg(F.max("weight").alias("weight"), F.collect_set(start).alias("starts"))
              .groupBy("doc_id", "item_id", "size")
              .agg(F.sum("weight").alias("shared"), F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))
              .join(total, "item_id").where(100 * F.col("shared") >= percent * F.col("whole")))
    enough = stage(enough.select("doc_id", "item_id", "size", "whole", "starts"), "windows")
    placed = stage(similar(docs, enough.select("doc_id", "item_id", "size", F.explode("starts").alias("start")),
                           grams, usable, unseen, percent), "placed")
    # All starts that can reach more.
    best = placed.select("doc_id", "item_id", F.col("similarity").alias("best"))
    pairs = enough.drop("starts").join(best, ["doc_id", "item_id"], "left")
    laid = stage(heavy_starts(docs, pairs, grams, percent), "windows")
    more = similar(docs, laid, grams, usable, unseen, percent)
    return (placed.withColumn("placed", F.col("start")).unionByName(more.withColumn("placed", F.lit(None).cast("long")))
            .groupBy("doc_id", "item_id").agg(F.coalesce(F.min("placed"), F.min("start")).alias("start"), F.max("similarity").alias("similarity")))


def similar(docs: DataFrame, laid: DataFrame, grams: DataFrame, usable: DataFrame, unseen: int, percent: int) -> DataFrame:
    """``doc_id, item_id, start, similarity`` over the windows ``laid(doc_id, item_id, size, start)``."""
    # 2. Windows and their weighted shingles.
    lengths = usable.select("item_id", "k").distinct()
    idf = grams.select("gram", (F.col("weight") / F.col("n")).cast("long").alias("idf")).distinct()
    texts = docs.join(laid.join(lengths, "item_id"), "doc_id").withColumn(
        "words", F.expr(f"slice({WORDS}, start + 1, size)"))
    weighted = (texts.select("doc_id", "item_id", "start", F.explode(shingles("words", "least(k, size(words))")).alias("gram"))
                .groupBy("doc_id", "item_id", "start", "gram").agg(F.count(F.lit(1)).alias("n"))
                .join(small(idf), "gram", "left")
                .withColumn("weight", F.col("n") * F.coalesce("idf", F.round(1000 * F.log1p(F.lit(unseen))).cast("long"))))
    weighted = stage(weighted.select("doc_id", "item_id", "start", "gram", "weight"), "shingles")
    prints = weighted.groupBy("doc_id", "item_id", "start").agg(fingerprint().alias("fp"), F.sum("weight").alias("wd"))
    item_prints = grams.groupBy("item_id").agg(fingerprint().alias("ifp"), F.sum("weight").alias("wi"))

    # 3. Equal in one block, then within the radius.
    left = stage(prints, "fingerprints")
    near = (left.select("doc_id", "item_id", "start", "fp", "wd", blocks("fp").alias("b")).select("*", "b.*").drop("b")
            .join(item_prints.select("item_id", "ifp", "wi", blocks("ifp").alias("b")).select("*", "b.*").drop("b"),
                  ["item_id", "block", "value"])
            .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= RADIUS)
            .select("doc_id", "item_id", "start", "wd", "wi").distinct())

    # 4. Exact weighted similarity.
    common = (weighted.join(grams.select("item_id", "gram", F.col("weight").alias("w")), ["item_id", "gram"])
              .groupBy("doc_id", "item_id", "start").agg(F.sum(F.least("weight", "w")).alias("common")))
    union = F.col("wd") + F.col("wi") - F.col("common")
    return (near.join(common, ["doc_id", "item_id", "start"]).where(100 * F.col("common") >= percent * union)
            .groupBy("doc_id", "item_id").agg(F.min("start").cast("long").alias("start"),
                                              F.max(F.col("common") / union).alias("similarity")))
