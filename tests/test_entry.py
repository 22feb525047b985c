"""Driver contract and oracle agreement on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "loan_extravagance_interaction" in df.columns


def test_oracle_keys_subset():
    assert set(E.oracle_sql()) <= set(E.queries())


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


@pytest.mark.parametrize("name", ["s1_labelled_load", "p4_answer_pivot", "p5_reject_report",
                                  "w1_feature_export", "a1_a3_column_profile", "e4_roc_auc",
                                  "e5_pr_auc", "r1_stratified_split", "c1_screening", "p25_answer_select"])
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    sdf = E.queries()[name](spark, SF_SMALL)
    cur = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(sdf.columns) == sorted(dcols)
    order = sorted(dcols)
    s = sorted((tuple(_norm(r[c]) for c in order) for r in sdf.collect()), key=repr)
    d = sorted((tuple(_norm(row[dcols.index(c)]) for c in order) for row in cur.fetchall()), key=repr)
    assert s == d
