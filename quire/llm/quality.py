"""Quality scores by random Fourier features, ridge regression and isotonic calibration (operator 13).

1. One pass over the whole texts measures each document (``MEASURES``: sizes,
   character classes, repetition, lines); the small rows are staged and the
   texts are not read again.
2. The measures, standardised over the training rows and clipped, go through
   ``features`` random cosines, whose inner products approximate a Gaussian kernel.
3. Each partition of the training rows sums its normal equations, fold by fold;
   the partitions' sums are added row by row of the matrix.  All sums less one
   fold's give the model that has not seen that fold, so the ridge is chosen
   by the squared error of rows left out, without another pass over the rows.
4. Training rows are scored by the model that has not seen them; pool-adjacent-violators
   over these scores (rounded to ``1 / CELLS``) gives the calibration.
   It is linear between the centres of its blocks, so unequal scores stay unequal there.
5. All documents are scored with the model of all training rows.

All labelled rows that ``trains`` names are used, without a sample.  The driver holds
``features ** 2`` sums a fold and at most ``3 * CELLS + 1`` calibration cells.

Defined cases: a null text is empty, and empty texts are measured and scored like
any other; a null label does not train, labels of one id count as their mean, and
rows that repeat (doc_id included) count and are scored each; rows without doc_id
are scored and never train; without any training row every score is 0.5.  Other
columns of either table are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import stage

CELLS = 1024
CLIP = 4.0
PART_ROWS = 20_000
RIDGES = tuple(10.0 ** k for k in range(-7, 1))

MEASURES = (
    "words", "chars", "word_length", "word_length_spread", "long_words", "upper", "digits", "beyond_ascii", "marks",
    "sentence_marks", "other_marks", "word_marks", "upper_words", "title_words", "numbers", "distinct_words", "commonest_word",
    "repeated_pairs", "lines", "line_words", "repeated_lines", "closed_lines", "entropy", "sentence_words", "doubled_marks", "short_lines")

_BYTE = np.arange(256)
_IS = {
    "upper": (_BYTE >= 65) & (_BYTE <= 90), "lower": (_BYTE >= 97) & (_BYTE <= 122), "digits": (_BYTE >= 48) & (_BYTE <= 57),
    "beyond": _BYTE >= 128, "blank": (_BYTE <= 32), "sentence": np.isin(_BYTE, [ord(c) for c in ".,;:?"]),
}
_IS["marks"] = ~(_IS["upper"] | _IS["lower"] | _IS["digits"] | _IS["beyond"] | _IS["blank"])
_IS["other"] = _IS["marks"] & ~_IS["sentence"]
_CLASSES = np.stack([_IS[k] for k in ("upper", "digits", "beyond", "marks", "sentence", "other")]).astype("float64")


def measures(text: str | None) -> list[float]:
    """The ``MEASURES`` of a whole text."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8"), dtype="uint8")
    counts = np.bincount(raw, minlength=256).astype("float64")
    size = max(1, len(raw))
    upper, digits, beyond, marks, sentence, other = (_CLASSES @ counts / size).tolist()
    some = counts[counts > 0] / size
    words = text.split()
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), dtype="float64", count=len(words)) if words else np.zeros(1)
    seen = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    in_lines = [x.count(" ") + 1 for x in lines]
    is_mark = _IS["marks"][raw]
    twice = float(np.count_nonzero(is_mark[1:] & (raw[1:] == raw[:-1]))) / size if len(raw) else 0.0
    stops = text.count(".") + text.count("?") + text.count("!")
    return [
        float(np.log1p(len(words))), float(np.log1p(len(text))), float(lengths.mean()), float(lengths.std()),
        float(np.count_nonzero(lengths > 14)) / n, upper, digits, beyond, marks, sentence, other,
        sum(not w[-1].isalnum() for w in words) / n, sum(map(str.isupper, words)) / n, sum(map(str.istitle, words)) / n,
        sum(map(str.isdigit, words)) / n, len(seen) / n, max(seen.values(), default=0) / n,
        1 - pairs / max(1, len(words) - 1) if len(words) > 1 else 0.0, float(np.log1p(len(lines))), float(np.log1p(n / max(1, len(lines)))),
        1 - len(set(lines)) / max(1, len(lines)) if lines else 0.0, sum(x[-1] in ".?!:;\"'" for x in lines) / max(1, len(lines)),
        float(-(some * np.log2(some)).sum()) if len(raw) else 0.0, float(np.log1p(n / max(1, stops))), twice,
        sum(x < 3 for x in in_lines) / max(1, len(lines))]


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, x``: the measures of every row of ``docs(doc_id, text)``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measures(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "x"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>")


@dataclass
class Kernel:
    """Standardisation and random cosines."""

    mean: np.ndarray
    scale: np.ndarray
    turns: np.ndarray
    shift: np.ndarray

    @classmethod
    def drawn(cls, mean: np.ndarray, scale: np.ndarray, features: int, bandwidth: float, seed: int) -> Kernel:
        rng = np.random.default_rng(seed)
        return cls(mean, scale, rng.normal(size=(len(mean), features)) / bandwidth, rng.uniform(0, 2 * np.pi, features))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Rows of cosines and a one."""
        z = np.clip((x - self.mean) / self.scale, -CLIP, CLIP)
        return np.hstack([np.sqrt(2 / len(self.shift)) * np.cos(z @ self.turns + self.shift), np.ones((len(z), 1))])


@dataclass
class Quality:
    """A fitted scorer: kernel, weights, calibration knots."""

    kernel: Kernel | None = None
    weights: np.ndarray | None = None
    at: np.ndarray | None = None
    value: np.ndarray | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        return np.interp(self.kernel(x) @ self.weights, self.at, self.value)


def stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()) if len(column) else np.zeros((0, len(MEASURES)))


def normal_equations(rows: DataFrame, kernel: Kernel) -> dict[int, np.ndarray]:
    """For each fold the sums of ``[z, y]' [z, y]`` over ``rows(fold, y, x)``, added up by partition."""

    def sums(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            z = np.hstack([kernel(stacked(pdf["x"])), pdf["y"].to_numpy(dtype="float64")[:, None]])
            for fold in pdf["fold"].unique().tolist():
                part = z[(pdf["fold"] == fold).to_numpy()]
                total[fold] = total.get(fold, 0) + part.T @ part
        for fold, m in total.items():
            yield pd.DataFrame({"fold": fold, "row": np.arange(len(m)), "sums": list(m)})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fold": pdf["fold"].iloc[:1], "row": pdf["row"].iloc[:1], "sums": [np.sum(np.stack(pdf["sums"].to_list()), axis=0)]})

    kind = "fold int, row int, sums array<double>"
    out: dict[int, dict[int, np.ndarray]] = {}
    for r in rows.mapInPandas(sums, kind).groupBy("fold", "row").applyInPandas(add, kind).collect():
        out.setdefault(r["fold"], {})[r["row"]] = np.array(r["sums"])
    return {fold: np.stack([m[i] for i in range(len(m))]) for fold, m in out.items()}


def ridge_fit(sums: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of cosines and intercept from ``[z, y]' [z, y]``; the intercept is not held back."""
    a, b = sums[:-1, :-1], sums[:-1, -1]
    hold = np.full(len(b), ridge * a[-1, -1])
    hold[-1] = 1e-9 * a[-1, -1]
    return np.linalg.solve(a + np.diag(hold), b)


def squared_error(sums: np.ndarray, w: np.ndarray) -> float:
    v = np.append(w, -1.0)
    return float(v @ sums @ v)


def pooled(cells: list[tuple[float, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators of (score, sum of y, rows): block centres and means."""
    blocks: list[list[float]] = []  # sum of score * rows, sum of y, rows
    for s, y, n in sorted(cells):
        blocks.append([s * n, y, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([min(1.0, max(0.0, b[1] / b[2])) for b in blocks])


def fit_quality(measured_rows: DataFrame, labels: DataFrame, fold: Column, trains: Column, *, features: int = 256,
                bandwidth: float | None = None, seed: int = 13) -> Quality:
    """Fit on ``measured_rows(doc_id, x)`` and ``labels(doc_id, label)`` with labels from 0 to 1.

    ``fold`` (an int) and ``trains`` (a boolean) are expressions of ``doc_id``;
    the kernel's ``bandwidth`` is half again the root of the number of measures if none is given.
    """
    known = (labels.where(trains).select("doc_id", F.col("label").cast("double").alias("label")).where("label is not null")
             .groupBy("doc_id").agg(F.avg("label").alias("y")))
    rows = stage(measured_rows.join(known, "doc_id").select(fold.cast("int").alias("fold"), "y", "x"), "quality")
    d = len(MEASURES)
    column = [F.col("x")[i] for i in range(d)]
    total = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(column)],
                     *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(column)]).first()
    if not total["n"]:
        return Quality()
    mean = np.array([total[f"m{i}"] for i in range(d)])
    spread = np.array([total[f"s{i}"] for i in range(d)])
    kernel = Kernel.drawn(mean, np.where(spread > 1e-12, spread, 1.0), features, bandwidth or 1.5 * float(np.sqrt(d)), seed)
    rows = rows.coalesce(max(1, -(-total["n"] // PART_ROWS)))
    sums = normal_equations(rows, kernel)
    everything = sum(sums.values())
    without = {f: everything - s if len(sums) > 1 else s for f, s in sums.items()}
    ridge = min(RIDGES, key=lambda r: sum(squared_error(s, ridge_fit(without[f], r)) for f, s in sums.items()))
    weights = {f: ridge_fit(s, ridge) for f, s in without.items()}

    def left_out(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            z, w = kernel(stacked(pdf["x"])), np.stack([weights[f] for f in pdf["fold"]]) if len(pdf) else np.zeros((0, features + 1))
            cell = np.rint(np.clip((z * w).sum(axis=1), -1, 2) * CELLS).astype("int64")
            yield pd.DataFrame({"cell": cell, "y": pdf["y"]})

    cells = (rows.mapInPandas(left_out, "cell long, y double").groupBy("cell")
             .agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")).collect())
    at, value = pooled([(c["cell"] / CELLS, c["y"], c["n"]) for c in cells])
    return Quality(kernel, ridge_fit(everything, ridge), at, value)


def scored(measured_rows: DataFrame, model: Quality) -> DataFrame:
    """``doc_id, score`` of every row of ``measured_rows(doc_id, x)``."""
    shared = measured_rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": shared.value.scores(stacked(pdf["x"]))})

    kind = measured_rows.schema["doc_id"].dataType.simpleString()
    return measured_rows.mapInPandas(run, f"doc_id {kind}, score double")
