"""Operator 13 against dense computations and held-out labels."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm.q_quality import op13_quality
from quire.llm.quality import MEASURES, Kernel, fit_quality, measured, measures, normal_equations, pooled, ridge_fit, scored, squared_error


def test_measures_of_whole_texts():
    got = dict(zip(MEASURES, measures("Ab cd, CD 12\ncd, x!!\ncd, x!!")))
    assert got["upper"] == 3 / 28 and got["digits"] == 2 / 28 and got["marks"] == 7 / 28 and got["sentence_marks"] == 3 / 28
    assert got["distinct_words"] == 5 / 8 and got["commonest_word"] == 3 / 8 and got["repeated_lines"] == 1 - 2 / 3
    assert got["repeated_pairs"] == 1 - 6 / 7 and got["upper_words"] == 1 / 8 and got["doubled_marks"] == 2 / 28
    for text in (None, "", " \n\t", "x", "é" * 5, " ", "a" * 300_000, "\n" * 9):
        values = measures(text)
        assert len(values) == len(MEASURES) and np.isfinite(values).all()
    assert measures(None) == measures("")
    long = "word " * 5000
    assert measures(long + "tail!")[MEASURES.index("other_marks")] > 0  # nothing is cut off


def test_kernel_approximates_the_gaussian():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 5)) / 2
    z = Kernel.drawn(np.zeros(5), np.ones(5), 20_000, 2.0, 1)(x)[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * 2.0 ** 2))
    assert np.abs(z @ z.T - exact).max() < 0.04


def test_partition_sums_equal_the_dense_equations(spark):
    rng = np.random.default_rng(2)
    x, y, fold = rng.normal(size=(300, len(MEASURES))), rng.integers(0, 2, 300).astype(float), rng.integers(0, 3, 300)
    kernel = Kernel.drawn(x.mean(axis=0), x.std(axis=0), 16, 5.0, 3)
    rows = spark.createDataFrame([(int(f), float(b), a.tolist()) for f, b, a in zip(fold, y, x)], "fold int, y double, x array<double>")
    got = normal_equations(rows.repartition(7), kernel)
    z = np.hstack([kernel(x), y[:, None]])
    assert sorted(got) == [0, 1, 2]
    for f, m in got.items():
        assert np.allclose(m, z[fold == f].T @ z[fold == f])
    w, total = ridge_fit(sum(got.values()), 1e-3), sum(got.values())
    held = np.append(np.full(16, 1e-3 * 300), 1e-9 * 300)
    assert np.allclose(w, np.linalg.solve(z[:, :-1].T @ z[:, :-1] + np.diag(held), z[:, :-1].T @ y))
    assert squared_error(total, w) == pytest.approx(((z[:, :-1] @ w - y) ** 2).sum())


def test_pooling_is_isotonic_regression():
    rng = random.Random(4)
    for _ in range(50):
        cells = [(s, float(rng.randint(0, n)), n) for s in range(rng.randint(1, 12)) for n in [rng.randint(1, 5)]]
        y, w = [c[1] / c[2] for c in cells], [c[2] for c in cells]
        mean = lambda i, j: sum(a * b for a, b in zip(y[i:j + 1], w[i:j + 1])) / sum(w[i:j + 1])
        want = [max(min(mean(i, j) for j in range(k, len(y))) for i in range(k + 1)) for k in range(len(y))]
        at, value = pooled(cells)
        assert (np.diff(value) > 0).all() and (np.diff(at) > 0).all()
        assert np.allclose(sorted(set(np.round(want, 9))), np.round(value, 9))


def test_query_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    got = op13_quality(spark, folder).collect()
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [(truth[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 60 and sum(a == b for a, b in held) / len(held) > 0.95


def small_tables(spark, folder, flip=False):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.6
        words = [word() for _ in range(rng.randint(5, 80))]
        rows.append((i, " ".join(w if good else w.upper() + "$$!" for w in words) + ".", rng.choice(["en", "fr"])))
        held = zlib.crc32(str(i).encode()) % 4 == 2
        labels.append((i, int(good) if not (flip and held) else int(not good)))
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, " \n", None), (3, rows[3][1], "en"), (None, "No id here.", "en"), (1003, "Xy $$! " * 40_000, "de")]
    labels += [(5, None), (7, labels[7][1]), (None, 0), (99_999, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    if flip:  # what must not matter
        docs = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("s")).withColumn("score", F.lit(1)).withColumn("x", F.lit("clash"))
    docs.write.parquet(folder + "/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(folder + "/labels.parquet")
    return rows, labels


def test_held_out_labels_and_other_columns_do_not_matter(spark, tmp_dir):
    rows, labels = small_tables(spark, tmp_dir + "/a")
    small_tables(spark, tmp_dir + "/b", flip=True)
    a, b = (sorted(map(tuple, op13_quality(spark, f"{tmp_dir}/{k}").collect()), key=str) for k in "ab")
    assert len(a) == len(rows)
    for x, y in zip(a, b):
        assert x[:2] == y[:2] and abs(x[2] - y[2]) < 1e-9 and x[3] == y[3]
    truth, score = dict(labels[:400]), {r[0]: r for r in a}
    assert np.mean([truth[i] == score[i][3] for i in truth]) > 0.98
    assert score[1000][2] == score[1001][2] and score[None][1] is False and score[1003][3] == 0


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None)], "doc_id long, label int")
    model = fit_quality(measured(docs), labels, F.lit(0), F.lit(True))
    assert [r["score"] for r in scored(measured(docs), model).collect()] == [0.5, 0.5]
    assert scored(measured(docs.limit(0)), model).count() == 0
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, label int")  # one fold, one class
    model = fit_quality(measured(docs), one, F.lit(0), F.lit(True))
    assert [r["score"] for r in scored(measured(docs), model).collect()] == [1.0, 1.0]
