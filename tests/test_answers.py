"""Hand-made edge rows."""

from pyspark.sql import functions as F

from quire.operators.answers import (accepted, group_answers, parse_answers, payload_to_wide,
                                     rejected, select_answers, validate_payload, wide_to_groups)
from quire.spec import FK_V1

ITEM = "struct<group:string,questionNumber:string,choiceNumber:string>"
PAY = "array<struct<group:string,item:string,version:string,choiceNumber:int>>"


def _base(overrides=None, drop=(), extra=()):
    items = []
    for q in range(1, 19):
        g = "fht" if q <= 8 else ("set" if q <= 10 else "kmsi")
        items.append((g, str(q), str(1 + q % 3)))
    items = [it for it in items if it[1] not in drop]
    for q, val in (overrides or {}).items():
        items = [val if it[1] == str(q) else it for it in items]
    return items + list(extra)


def _frame(spark, rows):
    return spark.createDataFrame(rows, f"user_id long, ust int, answer array<{ITEM}>")


def test_parse_edge_rows(spark):
    rows = [
        (1, 0, _base()),                                            # valid
        (2, 0, None),                                               # not a list
        (3, 0, _base(drop=("18",))),                                # 17 items
        (4, 0, _base({4: ("fht", None, "2")})),                     # lacks questionNumber
        (5, 0, _base({6: ("fht", "x", "2")})),                      # 'x'
        (6, 0, _base({2: ("fht", "3.7", "2")})),                    # '3.7'
        (7, 1, _base({7: ("fht", " 7 ", "3")})),                    # ' 7 ' is valid
        (8, 1, _base(extra=[("fht", "5", "3")])),                   # duplicate: last wins
        (9, 1, _base({12: ("fht", "12", "1")})),                    # wrong group
        (10, 1, _base({15: ("kmsi", "19", "1")})),                  # missing q15
        (11, 1, _base({13: ("kmsi", "13", "4")})),                  # choice 4 accepted here
        (12, 1, _base({16: ("kmsi", "16", None)})),                 # choice NULL -> missing
        (13, 1, _base({9: (None, "9", "1")})),                      # unmapped item skipped
    ]
    parsed = parse_answers(_frame(spark, rows), FK_V1)
    got = {r["user_id"]: r for r in parsed.collect()}
    assert got[1]["reject_reason"] is None and got[1]["fht1"] == 2
    assert got[2]["reject_reason"] == "answer is not a list"
    assert got[3]["reject_reason"] == "fewer than 18 items"
    assert got[4]["reject_reason"] == "missing question 4"
    assert got[5]["reject_reason"] == "missing question 6"
    assert got[6]["reject_reason"] == "missing question 2"
    assert got[7]["reject_reason"] is None and got[7]["fht7"] == 3
    assert got[8]["reject_reason"] is None and got[8]["fht5"] == 3
    assert got[9]["reject_reason"] == "group mismatch at question 12"
    assert got[10]["reject_reason"] == "missing question 15"
    assert got[11]["reject_reason"] is None and got[11]["kmsi3"] == 4
    assert got[12]["reject_reason"] == "missing question 16"
    assert got[13]["reject_reason"] is None
    assert accepted(parsed).count() == 5
    assert rejected(parsed).count() == 8


def _payload():
    """A payload of our own: three groups in version 1, some items in later versions, out of order."""
    rows = [("kmsi", str(i), "1", 1 + i % 3) for i in range(16, 8, -1)]
    rows += [("fht", str(i), "1", 1 + (i * i) % 3) for i in range(1, 9)]
    rows += [("set", "3", "1", 3), ("set", "2", "1", 1), ("set", "1", "2", 2)]
    rows += [("kmsi", "13", "2", 3), ("kmsi", "12", "2", 2), ("fht", "2", "4", 2), ("fht", "3", "3", 1)]
    return rows


def test_select_answers(spark):
    df = spark.createDataFrame([(1, _payload())], f"resp_id long, answers {PAY}")
    fht, kmsi = [2, 2, 1, 2, 2, 1, 2, 2], [1, 2, 3, 1, 2, 3, 1, 2]
    cases = [
        ([{"group": "fht", "version": "1"}, {"group": "set", "version": "1"}, {"group": "kmsi", "version": "1"}],
         {"fht": fht, "set": [1, 3], "kmsi": kmsi}),
        ([{"group": "fht", "version": "1"}], {"fht": fht}),
        ([{"group": "xyz", "version": "1"}, {"group": "kmsi", "version": "99"}], {}),
        ([{"group": "fht", "version": "1"}, {"group": "kmsi", "version": "1"}, {"group": "set", "version": "2"}],
         {"fht": fht, "set": [2], "kmsi": kmsi}),
        ([], {}),
        # the last entry of a group that has items wins
        ([{"group": "set", "version": "1"}, {"group": "set", "version": "2"}, {"group": "set", "version": "9"}], {"set": [2]}),
    ]
    for sel, expected in cases:
        got = df.select(select_answers(F.col("answers"), sel).alias("m")).first()["m"]
        assert dict(got or {}) == expected, (sel, got)


def test_group_answers_sorts_numerically_and_stably(spark):
    items = [("fht", "10", "1", 3), ("fht", "2", "1", 1), ("fht", "x", "1", 2), ("", "1", "1", 1),
             ("kmsi", "1", "1", None)]
    df = spark.createDataFrame([(1, items)], f"resp_id long, answers {PAY}")
    got = {r["group"]: r["choices"] for r in group_answers(df).collect()}
    assert got == {"fht": [2, 1, 3], "kmsi": [0]}


def test_validate_wide_and_back(spark):
    df = spark.createDataFrame([(1, {"fht": [1, 2, 3, 1, 2, 3, 1, 2], "kmsi": [3] * 8}),
                                (2, {"fht": [1]})], "id long, g map<string,array<int>>")
    r = df.select("id", validate_payload(F.col("g"), ("fht", "kmsi")).alias("why"),
                  *payload_to_wide(F.col("g"), FK_V1)).orderBy("id").collect()
    assert r[0]["why"] is None and r[0]["fht3"] == 3 and r[0]["kmsi8"] == 3
    assert r[1]["why"] == "missing required key kmsi" and r[1]["fht2"] is None
    wide = df.where("id = 1").select(*payload_to_wide(F.col("g"), FK_V1))
    back = wide.select(wide_to_groups(FK_V1).alias("m")).first()["m"]
    assert back["fht"] == [1, 2, 3, 1, 2, 3, 1, 2] and back["kmsi"] == [3] * 8
