"""What keeps the survey jobs' cost in proportion to their rows: the parse, spread sources, compact training frames."""

from threading import Barrier

from pyspark.sql import functions as F

from quire.operators import train as TR
from quire.operators.answers import accepted, parse_answers, rejected
from quire.plans.jobs import feature_run
from quire.session import compact
from quire.sources import fixtures as FX
from quire.sources.survey import labelled_load
from quire.spec import FK_V1


def _raw(spark):
    item = "struct<`group`:string,questionNumber:string,choiceNumber:string>"
    good = [("fht" if q <= 8 else "set" if q <= 10 else "kmsi", str(q), "2") for q in range(1, 19)]
    rows = [(1, 1, good), (2, 0, good[:5]), (3, 1, None), (4, 0, good + [("fht", " 5 ", "3")])]
    return spark.createDataFrame(rows, f"user_id long, ust int, answer array<{item}>")


def test_a_filter_below_a_join_carries_the_parse_once(spark):
    raw = _raw(spark).join(spark.range(10).withColumnRenamed("id", "user_id"), "user_id")
    parsed = parse_answers(raw, FK_V1)
    for df in (accepted(parsed).select("user_id", *FK_V1.columns), rejected(parsed)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert 2 <= plan.count("RLIKE(") <= 6  # two in each copy of the parse
    got = {r["user_id"]: r for r in accepted(parsed).collect()}
    assert set(got) == {1, 4} and got[1]["fht5"] == 2 and got[4]["fht5"] == 3
    assert {r["user_id"]: r["reject_reason"] for r in rejected(parsed).collect()} == {
        2: "fewer than 18 items", 3: "answer is not a list"}


def test_answers_are_parsed_once_and_before_they_are_joined(spark):
    answers = _raw(spark).select("user_id", F.lit(1).alias("feature_id"), "answer")
    users = spark.range(10).withColumnRenamed("id", "user_id")
    statuses = spark.createDataFrame([(u, s, p) for u in range(1, 5) for s, p in (("npl", -1), ("healthy", 6))],
                                     "user_id long, loan_status string, payoff_score int")
    load = lambda **kw: labelled_load(users, answers, FX.features(spark), statuses, "fsk_v2.0", True, **kw)
    early, late = load(parse=lambda a: parse_answers(a, FK_V1)), parse_answers(load(), FK_V1)
    assert early.columns[:2] == ["user_id", "feature_id"] and set(early.columns) == set(late.columns)
    assert sorted(map(str, early.select(*late.columns).collect())) == sorted(map(str, late.collect()))
    for df in (accepted(early).select("user_id", *FK_V1.columns), rejected(early)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("RLIKE(") == 2 and plan.index("Join Inner") < plan.index("RLIKE(")


def test_features_are_computed_once(spark, tmp_dir):
    src = {"customer": spark.range(3000).select(F.col("id").alias("c_custkey")),
           "orders": spark.range(6000).select(
               F.col("id").alias("o_orderkey"), (F.col("id") % 3000).alias("o_custkey"),
               F.when(F.col("id") % 2 == 0, "F").otherwise("O").alias("o_orderstatus"))}
    for name, df in src.items():
        df.write.parquet(f"{tmp_dir}/{name}.parquet")
    got = feature_run(spark, tmp_dir).features
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "score_var" in plan and "POWER(" not in plan.upper() and got.count() > 0  # read back, not derived again


def test_one_key_file_is_built_by_many_tasks(spark, tmp_dir):
    spark.range(500).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(f"{tmp_dir}/customer.parquet")
    wide = FX.answers_wide(spark, tmp_dir)
    assert wide.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert sorted(r[0] for r in wide.select("user_id").collect()) == list(range(500))


def test_compact_takes_few_partitions_for_few_rows_and_more_for_many(spark):
    cores = spark.sparkContext.defaultParallelism
    df = spark.range(1000, numPartitions=20 * cores)
    assert compact(df, 1000).rdd.getNumPartitions() == 2 * cores
    assert compact(df, 250_000 * 5 * cores).rdd.getNumPartitions() == 5 * cores
    assert compact(df, 1000).agg(F.sum("id")).first()[0] == 999 * 500


def test_out_of_fold_rows_do_not_score_again(spark):
    df = spark.range(300, numPartitions=64).select(
        "id", (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 5).cast("int").alias("fold"),
        ((F.col("id") * 7) % 11 + F.col("id") % 2).cast("double").alias("x"), F.lit(1.0).alias("w"))
    oof = TR.out_of_fold(df, ["x"], "y", "fold", 5, {"n_trees": 3, "depth": 2})
    plan = oof._jdf.queryExecution().optimizedPlan().toString()
    assert "UDF" not in plan and "Union" not in plan  # written rows, not five models over the source
    assert sorted((r["id"], r["fold"]) for r in oof.collect()) == [(i, i % 5) for i in range(300)]
    assert all(0 <= r["p1"] <= 1 for r in oof.collect())


def test_fits_run_side_by_side_in_order():
    meet = Barrier(3, timeout=20)  # broken unless three are under way together

    def work(x):
        meet.wait()
        return x * x

    assert TR.side_by_side(work, [3, 1, 2]) == [9, 1, 4]


def test_out_of_fold_and_grid_fits_overlap(spark, monkeypatch):
    df = spark.range(300, numPartitions=4).select(
        "id", (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 3).cast("int").alias("fold"),
        ((F.col("id") * 7) % 11 + F.col("id") % 2).cast("double").alias("x"), F.lit(1.0).alias("w"))
    meet, rows = Barrier(3, timeout=60), []

    def estimator(part):
        rows.append(part.count())
        meet.wait()
        return TR.forest("y", 3, 2)

    oof = TR.out_of_fold(df, ["x"], "y", "fold", 3, estimator=estimator)
    assert rows == [200, 200, 200] and sorted((r["id"], r["fold"]) for r in oof.collect()) == [(i, i % 3) for i in range(300)]
    asked = []
    monkeypatch.setattr(TR, "side_by_side", lambda work, items, *a: asked.append(list(items)) or [work(x) for x in items])
    cfg = TR.ModelConfig(n_estimators=[3], max_depth=[2], min_samples_split=[2], n_folds=3)
    _, grid = TR.grid_search(df.drop("w"), ["x"], "y", cfg)
    assert asked == [["w_bal", "w_cost"]] and [p["weight"] for p, _ in grid] == ["w_bal", "w_cost"]
