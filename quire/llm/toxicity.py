"""Toxicity by a chain of linear classifiers (operator 3).

Categories are predicted one after the other.  Each is a logistic model over
word and word-prefix presence, a few measures of the text's style, and the
probabilities of the categories before it.  While training, those
probabilities are out-of-fold: row i's come from the model that did not see
fold(i), so a later model never learns from an earlier one's memory of its own
training rows.  The last category's cut-off maximises F1 on its out-of-fold
probabilities.

Training uses a bounded, hash-chosen sample of the labelled rows
(``train_rows``).  The fold models of a category are fitted side by side as
tasks of one grouped job; each holds the sample at most.  Scoring runs over
all documents, whole texts, in Arrow batches; the models (``terms`` weights
for each category) travel with the task.

Defined cases: a null text is empty; a text without words has probability 0; a null label leaves the row out of that
category's models; repeated rows count and are scored each; without labelled
rows of a category its probability is 0 and nothing is rejected.  Other
columns of either table are ignored or passed through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import release_memory, stage, tidy

WORDS = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
STYLE = 5


def terms_of(word: str) -> list[str]:
    """A word's features: itself and its first letters, marked as such."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


def style_of(text: str, words: list[str], distinct: int) -> list[float]:
    """Measures of the whole text: upper case, marks, digits, repetition, size."""
    n = max(1, len(text))
    letters = sum(map(len, words))
    upper = sum(map(str.isupper, text)) if text else 0
    digits = sum(map(text.count, "0123456789"))
    return [upper / n, (n - letters - text.count(" ") - digits) / n, digits / n,
            1 - distinct / max(1, len(words)), float(np.log1p(len(words)))]


@dataclass
class Chain:
    """A fitted chain: term index, and intercept and weights for each category."""

    categories: list[str]
    index: dict[str, int] = field(default_factory=dict)
    weights: list[np.ndarray | None] = field(default_factory=list)
    cutoff: float = 1.0


def minimise(loss, w: np.ndarray, rounds: int = 200, memory: int = 10) -> np.ndarray:
    """L-BFGS with backtracking for a smooth convex ``loss(w) -> (value, gradient)``."""
    value, grad = loss(w)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, kept = grad.copy(), []
        for s, y in reversed(steps):
            a = (s @ q) / (s @ y)
            kept.append(a)
            q -= a * y
        if steps:
            s, y = steps[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(kept)):
            q += (a - (y @ q) / (s @ y)) * s
        size, slope = 1.0, grad @ q
        while True:
            new_value, new_grad = loss(w - size * q)
            if new_value <= value - 1e-4 * size * slope or size < 1e-8:
                break
            size /= 2
        s, y = -size * q, new_grad - grad
        if value - new_value < 1e-9 * max(1.0, value):
            return w + s if new_value < value else w
        w, value, grad = w + s, new_value, new_grad
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-memory:]
    return w


def fit_logistic(rows: np.ndarray, cols: np.ndarray, dense: np.ndarray, y: np.ndarray, n_terms: int,
                 l2: float, style_l2: float) -> np.ndarray:
    """[intercept, term weights, dense weights] of a logistic model; ``rows, cols`` are the ones of its sparse part.

    The first ``STYLE`` dense columns are held back by ``style_l2``: words should decide where they can.
    """
    n = len(y)
    hold = np.full(1 + n_terms + dense.shape[1], l2)
    hold[0], hold[1 + n_terms:1 + n_terms + STYLE] = 0.0, style_l2
    mean, scale = dense.mean(axis=0), np.maximum(dense.std(axis=0), 1e-9)
    z = (dense - mean) / scale

    def loss(w):
        score = w[0] + np.bincount(rows, w[1 + cols], n) + z @ w[1 + n_terms:]
        p = 1 / (1 + np.exp(-np.clip(score, -35, 35)))
        value = np.mean(np.logaddexp(0, score) - y * score) + 0.5 * (hold @ (w * w))
        err = (p - y) / n
        grad = np.concatenate([[err.sum()], np.bincount(cols, err[rows], n_terms), z.T @ err])
        return value, grad + hold * w

    w = minimise(loss, np.zeros(1 + n_terms + dense.shape[1]))
    w[1 + n_terms:] /= scale
    w[0] -= w[1 + n_terms:] @ mean
    return w


def probability(w: np.ndarray | None, terms: list[int], dense: list[float]) -> float:
    if w is None or dense[STYLE - 1] == 0:  # no model, or no words
        return 0.0
    at = len(w) - len(dense)
    score = w[0] + w[[1 + t for t in terms]].sum() + w[at:] @ np.array(dense)
    return float(1 / (1 + np.exp(-np.clip(score, -35, 35))))


def featurise(texts: Iterable[str | None], index: dict[str, int], cache: dict) -> Iterator[tuple[list[int], list[float]]]:
    """(term numbers, style) of each text; ``cache`` maps words to theirs."""
    for text in texts:
        text = text or ""
        words = WORDS.findall(text.lower())
        distinct, found = set(words), set()
        for w in distinct:
            t = cache.get(w)
            if t is None:
                if len(cache) > 100_000:
                    cache.clear()
                cache[w] = t = tuple(index[x] for x in terms_of(w) if x in index)
            if t:
                found.update(t)
        yield sorted(found), style_of(text, words, len(distinct))


def choose_terms(sample: DataFrame, categories: Sequence[str], terms: int, least_docs: int) -> list[str]:
    """For each category the ``terms`` features that tell most about it (likelihood ratio of the document counts)."""
    k = len(categories)

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: dict[str, np.ndarray] = {}
            labels = pdf[list(categories)].to_numpy(dtype="float64")
            both = np.concatenate([labels == 1, labels == 0], axis=1).astype("int64")
            for text, row in zip(pdf["text"], both):
                for t in {x for w in set(WORDS.findall((text or "").lower())) for x in terms_of(w)}:
                    if t in seen:
                        seen[t] += row
                    else:
                        seen[t] = row.copy()
            while seen:  # in pieces, so that the batch's counts are not held twice
                part = [seen.popitem() for _ in range(min(len(seen), 20_000))]
                yield pd.DataFrame({"term": [t for t, _ in part], "n": [v.tolist() for _, v in part]})

    each = sample.select("text", *categories).mapInPandas(tidy(count), "term string, n array<long>")
    sums = (each.groupBy("term").agg(*[F.sum(F.col("n")[i]).alias(f"n{i}") for i in range(2 * k)])
            .where(sum(F.col(f"n{i}") for i in range(2 * k)) >= least_docs * k))
    totals = sample.agg(*[F.sum((F.col(c) == v).cast("long")).alias(f"t{i + k * (1 - v)}")
                          for i, c in enumerate(categories) for v in (1, 0)]).first()
    sums = stage(sums, "terms")
    chosen: set[str] = set()
    for i in range(k):
        a, b = F.col(f"n{i}").cast("double"), F.col(f"n{i + k}").cast("double")
        ta, tb = float(totals[f"t{i}"] or 0), float(totals[f"t{i + k}"] or 0)
        if not ta or not tb:
            continue
        cell = lambda seen, in_class, of: F.when(seen > 0, seen * F.log(seen * (ta + tb) / (in_class * of))).otherwise(0.0)  # noqa: B023, E731
        held, rest = a + b, ta + tb - a - b
        gain = cell(a, F.lit(ta), held) + cell(b, F.lit(tb), held) + cell(ta - a, F.lit(ta), rest) + cell(tb - b, F.lit(tb), rest)
        chosen |= {r["term"] for r in sums.select("term", gain.alias("gain")).orderBy(F.desc("gain"), "term").limit(terms).collect()}
    return sorted(chosen)


def fit_chain(docs: DataFrame, labels: DataFrame, categories: Sequence[str], *, train_rows: int = 20_000,
              terms: int = 1500, least_docs: int = 3, folds: int = 5, l2: float = 1e-4,
              style_l2: float = 1e-2) -> Chain:
    """Fit a chain on ``docs(doc_id, text)`` and ``labels(doc_id, <categories> 0/1 or null)``."""
    categories = list(categories)
    chain = Chain(categories)
    usable = labels.select("doc_id", *[F.col(c).cast("int").alias(c) for c in categories])
    total = usable.count()
    if not total:
        chain.weights = [None] * len(categories)
        return chain
    # Chosen by a hash of the id, so about train_rows rows whatever the corpus.
    part = min(1.0, train_rows / total)
    chosen = usable.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < part * (1 << 20))
    sample = stage(docs.select("doc_id", "text").join(chosen, "doc_id"), "labelled")
    names = choose_terms(sample, categories, terms, least_docs)
    chain.index = {t: i for i, t in enumerate(names)}

    def features(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict = {}
        for pdf in batches:
            found = list(featurise(pdf["text"], chain.index, cache))
            yield pd.DataFrame({"fold": pdf["fold"], "y": pdf["y"], "terms": [f[0] for f in found],
                                "dense": [f[1] for f in found]})

    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(folds)).cast("int").alias("fold")
    rows = stage(sample.select("text", fold, F.array(*[F.col(c).cast("double") for c in categories]).alias("y"))
                 .mapInPandas(tidy(features), "fold int, y array<double>, terms array<int>, dense array<double>"), "features")
    for number, _ in enumerate(categories):

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            known = [v[number] is not None and v[number] == v[number] for v in pdf["y"]]  # noqa: B023
            use = pdf[known]
            y = np.array([v[number] for v in use["y"]], dtype="float64")  # noqa: B023
            if not len(y):
                return pd.DataFrame({"model": [], "w": []})
            cols = np.concatenate([np.asarray(t, dtype="int64") for t in use["terms"]])
            at = np.repeat(np.arange(len(use)), [len(t) for t in use["terms"]])
            w = fit_logistic(at, cols, np.array([list(d) for d in use["dense"]]), y, len(names), l2, style_l2)
            return pd.DataFrame({"model": [int(pdf["model"].iloc[0])], "w": [w.tolist()]})

        # Model k leaves fold k out; the last one uses every row.
        models = rows.withColumn("model", F.explode(F.array(*[F.lit(i) for i in range(folds + 1)]))).where("model <> fold")
        fitted = {r["model"]: np.array(r["w"]) for r in models.groupBy("model").applyInPandas(
            fit, "model int, w array<double>").collect()}
        chain.weights.append(fitted.get(folds))

        def extend(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                p = [probability(fitted.get(f, fitted.get(folds)), list(t), list(d))  # noqa: B023
                     for f, t, d in zip(pdf["fold"], pdf["terms"], pdf["dense"])]
                yield pdf.assign(dense=[[*d, x] for d, x in zip(pdf["dense"], p)])

        rows = stage(rows.mapInPandas(extend, rows.schema), "chain")
    last = len(categories) - 1
    judged = (rows.select(F.col("y")[last].alias("y"), F.round(F.element_at("dense", -1), 3).alias("p"))
              .where("y is not null").groupBy("p").agg(F.sum("y").alias("hit"), F.count(F.lit(1)).alias("n")).collect())
    chain.cutoff = best_cutoff([(r["p"], r["hit"], r["n"]) for r in judged])
    return chain


def best_cutoff(cells: list[tuple[float, float, int]]) -> float:
    """Where rejecting has the best F1, over (p, toxic, rows) cells; 2 if nothing is toxic.

    Any cut between two neighbouring probabilities does the same there; 0.5 is
    taken if it lies between them, else their middle.
    """
    positives, hit, n, best, cutoff = sum(c[1] for c in cells), 0.0, 0, 0.0, 2.0
    cells = sorted(cells, reverse=True)
    for i, (p, h, m) in enumerate(cells):
        hit, n = hit + h, n + m
        f1 = 2 * hit / (n + positives) if positives else 0.0
        if f1 > best:
            lower = cells[i + 1][0] if i + 1 < len(cells) else 0.0
            best, cutoff = f1, 0.5 if lower < 0.5 <= p else (p + lower) / 2
    return cutoff


def with_chain(docs: DataFrame, chain: Chain, column: str) -> DataFrame:
    """``docs`` and a struct ``column`` of every category's probability."""
    names = [f"p_{c}" for c in chain.categories]
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model, cache = shared.value, {}
        try:
            for batch in texts:
                rows = []
                for found, dense in featurise(batch, model.index, cache):
                    for w in model.weights:
                        dense = [*dense, probability(w, found, dense)]
                    rows.append(dense[STYLE:])
                yield pd.DataFrame(rows, columns=names, dtype="float64")
        finally:
            cache.clear()
            release_memory()

    return docs.withColumn(column, F.pandas_udf(predict, ", ".join(f"{n} double" for n in names))("text"))


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """``doc_id``, ``p_<category>`` for each category and ``rejected`` for every row of ``docs(doc_id, text)``."""
    names = [f"p_{c}" for c in chain.categories]
    return (with_chain(docs.select("doc_id", "text"), chain, "chain").select("doc_id", *[f"chain.{n}" for n in names])
            .withColumn("rejected", F.col(names[-1]) >= chain.cutoff))


def without_rejected(docs: DataFrame, chain: Chain) -> DataFrame:
    """The rows of ``docs``, all columns, that the last category does not reject."""
    column = "__chain"
    while column in docs.columns:
        column += "_"
    last = F.col(column)[f"p_{chain.categories[-1]}"]
    return with_chain(docs, chain, column).where(last < chain.cutoff).select(*[F.col(f"`{c}`") for c in docs.columns])
