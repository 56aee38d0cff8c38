import pytest
from pyspark.sql import functions as F

from quillspan.operators.cascade import Reference, added_or_ignored, added_or_replaced, cleared_for_rebuild, deleted, in_order, triaged
from quillspan.versions import Pass, version


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_order():
    refs = [Reference("c", "b", {"b": "id"}), Reference("b", "a", {"a": "id"}), Reference("c", "a", {"a": "id"})]
    assert in_order(refs) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        in_order([*refs, Reference("a", "c", {"c": "id"})])
    with pytest.raises(ValueError):
        Reference("a", "b", {})


def test_cascade(spark):
    t = {
        "a": spark.createDataFrame([(1,), (2,), (3,)], "id int"),
        "b": spark.createDataFrame([(10, 1), (11, 2), (12, None), (10, 3)], "id int, a int"),
        "c": spark.createDataFrame([(100, 10, 3), (101, 11, 3), (102, 12, 3), (103, None, 1)], "id int, b int, a int"),
        "d": spark.createDataFrame([(7, 100), (8, 101), (9, None)], "id int, c int"),
        "e": spark.createDataFrame([(1,)], "id int"),
    }
    refs = [Reference("b", "a", {"a": "id"}), Reference("c", "b", {"b": "id"}), Reference("c", "a", {"a": "id"}), Reference("d", "c", {"c": "id"}, forget=True)]
    out = deleted(t, refs, {"a": t["a"].where("id = 1")})
    assert {n: rows(df) for n, df in out.items()} == {
        "a": [(2,), (3,)], "b": [(10, 3), (11, 2), (12, None)], "c": [(101, 11, 3), (102, 12, 3)], "d": [(7, None), (8, 101), (9, None)],
    }
    assert out["d"].columns == ["id", "c"]
    only = deleted(t, refs, {"c": spark.createDataFrame([(3,)], "a int")})
    assert set(only) == {"c", "d"} and rows(only["c"]) == [(103, None, 1)] and rows(only["d"]) == [(7, None), (8, None), (9, None)]
    assert deleted(t, refs, {"e": t["e"]})["e"].count() == 0


def test_merges(spark):
    old = spark.createDataFrame([(1, "old", 0), (2, "old", 0)], "k int, v string, at int")
    new = spark.createDataFrame([(2, "new", 1), (3, "b", 2), (3, "a", 1), (3, "c", 3)], "k int, v string, at int")
    assert rows(added_or_ignored(old, new, ["k"], [F.col("at")])) == [(1, "old", 0), (2, "old", 0), (3, "a", 1)]
    assert rows(added_or_replaced(old, new, ["k"], [F.col("at")])) == [(1, "old", 0), (2, "new", 1), (3, "c", 3)]


def test_negative_marks_take_proposals_with_them(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    with Pass(spark, root) as p:
        p.put("experiences", spark.createDataFrame([("a", None), ("b", "useful"), ("c", None)], "group_key string, review_status string"))
        p.put("evidence", spark.createDataFrame([("a", 1), ("b", 2)], "group_key string, occurrence_id int"))
        p.put("proposal_sets", spark.createDataFrame([("a",), ("b",), ("c",)], "group_key string"))
        p.put("proposals", spark.createDataFrame([(g, x) for g in "abc" for x in ("skill", "ignore")], "group_key string, placement string"))
        p.put("proposal_evidence", spark.createDataFrame([(g, x, 1) for g in "abc" for x in ("skill", "ignore")], "group_key string, placement string, occurrence_id int"))
    with Pass(spark, root) as p:
        triaged(p, spark.createDataFrame([("a", "false_positive", "no"), ("b", "needs_more_evidence", None), ("c", "useful", "yes"), ("x", "false_positive", "?")], "group_key string, review_status string, note string"))
    now = version(spark, root)
    assert rows(now["experiences"]) == [("a", "false_positive", "no"), ("b", "needs_more_evidence", None), ("c", "useful", "yes")]
    assert rows(now["proposal_sets"]) == [("c",)] and {r[0] for r in rows(now["proposals"])} == {r[0] for r in rows(now["proposal_evidence"])} == {"c"}
    assert now["evidence"].count() == 2
    with Pass(spark, root) as p:
        cleared_for_rebuild(p)
    end = version(spark, root)
    assert end["evidence"].count() == 0 and rows(end["experiences"]) == rows(now["experiences"])
