import pytest

from quillmesh.llm.score_fusion import fused_first, fused_ranking, fused_scores

D = {"a": 1, "b": 1, "c": -1}
SCHEMA = "q long, e long, a double, b double, c double, at long, fused string"
NAN = float("nan")
ROWS = [
    (1, 1, 1e9, 0.0, 5.0, 1, "x"), (1, 2, 10.0, 3.0, 1.0, 1, "x"), (1, 3, 9.0, 2.0, 2.0, 1, "x"), (1, 4, None, NAN, 9.0, 1, "x"),
    (2, 5, 1.0, 1.0, 1.0, 1, "x"), (2, 6, 1.0, 1.0, 1.0, 1, "x"),
    (3, 7, None, None, None, 1, "x"),
    (1, 1, 0.0, 0.0, 5.0, 0, "late"), (None, 8, 1.0, 1.0, 1.0, 1, "x"), (4, None, 1.0, 1.0, 1.0, 1, "x"),
]


def test_no_score_prevails_by_range(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    first = {r["q"]: r["e"] for r in fused_first(df, "q", "e", D, "at").collect()}
    assert first == {1: 2, 2: 5, 3: 7}  # ties go to the lower item; a group of unknowns still has a first


def test_hot_groups_rank_alike(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    plain = {(r["q"], r["e"]): (round(r["fused"], 9), r["position"]) for r in fused_ranking(df, "q", "e", D, "at").collect()}
    hot = {(r["q"], r["e"]): (round(r["fused"], 9), r["position"]) for r in fused_ranking(df, "q", "e", D, "at", hot_rows=1).collect()}
    assert plain == hot and len(plain) == 7


def test_monotone_transformations_change_nothing(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    other = df.selectExpr("q", "e", "CASE WHEN a IS NULL THEN NULL ELSE log1p(a) END AS a", "b * 1e6 AS b", "c - 100 AS c", "at")
    a = {(r["q"], r["e"]): r["fused"] for r in fused_scores(df, "q", "e", D, "at").collect()}
    b = {(r["q"], r["e"]): r["fused"] for r in fused_scores(other, "q", "e", D, "at").collect()}
    assert a == pytest.approx(b)


def test_empty_table(spark):
    assert fused_first(spark.createDataFrame([], SCHEMA), "q", "e", D, "at").count() == 0
