from pyspark.sql import functions as F

from quillspan.operators.evaluation import metrics_delta
from quillspan.operators.ledger import projects_after, sessions_after


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_projects(spark):
    schema = "project_id string, name string, root string, git_remote string, created_at string, last_seen_at string, status string"
    known = spark.createDataFrame([("a", "A", "/a", "ra", "t0", "t0", "active"), ("b", "B", "/b", "rb", "t0", "t0", "archived"), ("c", "C", "/c", None, "t0", "t0", "missing"), ("d", "D", "/d", None, "t0", "t0", "active")], schema)
    found = spark.createDataFrame([("a", "A2", "/a", None), ("b", "B2", "/b", "rb2"), ("x", "C2", "/c", "rc"), ("n", "N", "/n", None), ("n", "N2", "/m", None), ("y", "A3", "/a", "no")], "project_id string, name string, root string, git_remote string")
    assert rows(projects_after(known, found, F.lit("t1"))) == [
        ("a", "A2", "/a", "ra", "t0", "t1", "active"), ("b", "B2", "/b", "rb2", "t0", "t1", "archived"), ("c", "C2", "/c", "rc", "t0", "t1", "active"), ("d", "D", "/d", None, "t0", "t0", "active"), ("n", "N2", "/m", None, "t1", "t1", "active"),
    ]


def test_sessions(spark):
    known = spark.createDataFrame([("g", "1", "p", "h0", "t0", "t0"), ("g", "2", "p", "h0", "t0", None), ("g", "3", "p", "h0", "t0", "t0")], "agent string, session_id string, path string, content_hash string, first_seen_at string, last_imported_at string")
    found = spark.createDataFrame([("g", "1", "p", "h1", False), ("g", "2", "p", "h1", True), ("g", "4", "p", "h1", True), ("g", "5", "p", "h1", None)], "agent string, session_id string, path string, content_hash string, imported boolean")
    assert rows(sessions_after(known, found, F.lit("t1"))) == [
        ("g", "1", "p", "h1", "t0", "t0"), ("g", "2", "p", "h1", "t0", "t1"), ("g", "3", "p", "h0", "t0", "t0"), ("g", "4", "p", "h1", "t1", "t1"), ("g", "5", "p", "h1", "t1", None),
    ]


def test_metrics(spark):
    runs = spark.createDataFrame([(1, "baseline", 10, 5, 0), (1, "candidate", 4, None, 7), (2, "candidate", 4, 1, 3)], "pair int, condition string, duration_ms int, tokens int, policy_bytes int")
    assert rows(metrics_delta(runs)) == [(1, 10, 4, -6, 5, None, False, 7), (2, None, 4, None, None, 1, False, 3)]
