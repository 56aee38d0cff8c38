"""Paired evaluation, recommendations, lifecycle requests, merges, splits, ancestry."""

import pytest
from pyspark.sql import functions as F

from quillspan.operators import evaluation as E
from quillspan.operators import ledger
from quillspan.operators import lifecycle as L


@pytest.mark.parametrize(
    "base, cand, status, outcome, regressions",
    [
        ([("task", False)], [("task", True)], "completed", "improved", 0), ([("task", True)], [("task", True)], "completed", "unchanged", 0), ([("task", True)], [("task", False)], "completed", "regressed", 1),
        ([("task", False), ("suite", True)], [("task", True), ("suite", False)], "completed", "improved", 1), ([("task", True), ("suite", True)], [("task", True), ("suite", False)], "completed", "regressed", 1),
        ([("task", True)], [("task", True)], "failed", "invalid", 0), ([("task", True)], [("other", True)], "completed", "incomparable", 0), ([], [("task", True)], "completed", "invalid", 0),
    ],
)
def test_compared(spark, base, cand, status, outcome, regressions):
    runs = spark.createDataFrame([(1, "baseline", "completed", 10), (1, "candidate", status, 30)], "pair int, condition string, status string, duration_ms int")
    checks = [(1, c, i, n, p) for c, side in (("baseline", base), ("candidate", cand)) for i, (n, p) in enumerate(side)]
    r = E.compared(runs, spark.createDataFrame(checks, "pair int, condition string, id int, name string, passed boolean")).first()
    assert (r["outcome"], r["regression_count"], r["duration_delta_ms"]) == (outcome, regressions, 20)


@pytest.mark.parametrize(
    "placement, outcomes, operation",
    [
        ("project_rule", ["improved"] * 8 + ["unchanged"], "promote"), ("global_rule", ["improved"] * 9, "retain"), ("project_rule", ["improved"] * 2 + ["regressed"] * 6, "demote"),
        ("skill", ["improved"] * 2 + ["regressed"] * 6, "disable"), ("project_rule", [], "retain"), ("project_rule", ["invalid", "incomparable"], "retain"),
    ],
)
def test_recommendations(spark, placement, outcomes, operation):
    rows = [(i, "v1", o, 0, 1, i) for i, o in enumerate(outcomes)]
    c = spark.createDataFrame(rows, "id int, version_id string, outcome string, regression_count int, duration_delta_ms int, created_at int")
    v = spark.createDataFrame([("v1", "p", 1, placement)], "version_id string, policy_id string, version_number int, placement string")
    assert E.recommendations(v, E.version_evidence(c)).first()["operation"] == operation


def test_rollback_after_a_good_version(spark):
    rows = [(i, "v1", "improved", 0, 1, i) for i in range(4)] + [(9 + i, "v2", "regressed", 1, 1, i) for i in range(4)]
    c = spark.createDataFrame(rows, "id int, version_id string, outcome string, regression_count int, duration_delta_ms int, created_at int")
    v = spark.createDataFrame([("v1", "p", 1, "skill"), ("v2", "p", 2, "skill")], "version_id string, policy_id string, version_number int, placement string")
    got = {r["version_id"]: (r["operation"], r["rollback_to"]) for r in E.recommendations(v, E.version_evidence(c)).collect()}
    assert got["v2"] == ("rollback", "v1")


POLICIES, VERSIONS = "policy_id string, status string, current_version_id string", "version_id string, policy_id string, version_number int, content string, placement string, scope_type string, scope_value string, status string, review_id string, created_via string"
REQUESTS = "policy_id string, seq int, operation string, content string, target_placement string, target_number int, confirm_global boolean"


@pytest.fixture()
def tables(spark):
    p = spark.createDataFrame([("A", "active", "A2"), ("B", "disabled", "B1"), ("C", "active", "C1")], POLICIES)
    v = spark.createDataFrame(
        [
            ("A1", "A", 1, "old", "project_rule", "project", "x", "superseded", "r1", "adopt"), ("A2", "A", 2, "new", "project_rule", "project", "x", "active", None, "rewrite"),
            ("B1", "B", 1, "b", "global_rule", None, None, "active", None, "adopt"), ("C1", "C", 1, "c", "skill", "project", "x", "active", None, "adopt"),
        ], VERSIONS,
    )
    return p, v


def _error(spark, tables, *request):
    return L.decided(*tables, spark.createDataFrame([request], REQUESTS)).first()["error"]


def test_request_errors(spark, tables):
    cases = {
        ("Z", 1, "rewrite", "x", None, None, None): "unknown_policy", ("A", 1, "rewrite", " ", None, None, None): "empty_content", ("A", 1, "rewrite", "new", None, None, None): "same_content",
        ("B", 1, "rewrite", "x", None, None, None): "policy_not_active", ("A", 1, "promote", None, None, None, None): "needs_confirmation", ("C", 1, "promote", None, None, None, None): "no_such_target",
        ("A", 1, "demote", None, "global_rule", None, None): "no_such_target", ("A", 1, "rollback", None, None, 9, None): "no_such_version", ("A", 1, "rollback", None, None, 2, None): "is_current",
        ("B", 1, "disable", None, None, None, None): "not_active", ("A", 1, "enable", None, None, None, None): "not_disabled", ("A", 1, "dance", None, None, None, None): "unknown_operation",
    }
    for request, error in cases.items():
        assert _error(spark, tables, *request) == error, request


def test_rollback_and_states(spark, tables):
    p, v = tables
    d = L.decided(p, v, spark.createDataFrame([("A", 1, "rollback", None, None, 1, None), ("A", 2, "disable", None, None, None, None), ("B", 1, "enable", None, None, None, None)], REQUESTS))
    assert {(r["policy_id"], r["seq"]): r["error"] for r in d.collect()} == {("A", 1): None, ("A", 2): "not_first", ("B", 1): None}
    after = {r["version_id"]: r for r in L.versions_after(v, d).collect()}
    assert after["A2"]["status"] == "rolled_back" and (after["PVN-A-3"]["content"], after["PVN-A-3"]["review_id"], after["PVN-A-3"]["created_via"]) == ("old", "r1", "rollback")
    assert {r["policy_id"]: (r["status"], r["current_version_id"]) for r in L.policies_after(p, d).collect()} == {"A": ("active", "PVN-A-3"), "B": ("active", "B1"), "C": ("active", "C1")}
    assert [tuple(r) for r in L.lineage_of(d).collect()] == [("rollback_source", "A1", "PVN-A-3")]


def test_merge_and_split(spark, tables):
    p, v = tables
    pairs = spark.createDataFrame([("A", "C", False), ("A", "A", False), ("A", "B", True)], "policy_a string, policy_b string, allow_cross_scope boolean")
    got = {(r["policy_a"], r["policy_b"]): r for r in L.merges(p, v, pairs).collect()}
    assert got["A", "C"]["content"] == "new\n\nc" and got["A", "C"]["new_policy_id"].startswith("POL-")
    assert got["A", "A"]["error"] == "same_policy" and got["A", "B"]["error"] == "not_active"
    kids = spark.createDataFrame([("A", "one", None, None, None), ("A", "one", None, None, None), ("A", "", None, None, None)], "policy_id string, content string, placement string, scope_type string, scope_value string")
    rows = L.splits(p, v, kids).collect()
    assert len({r["new_policy_id"] for r in rows if r["error"] is None}) == 1 and [r["error"] for r in rows].count("empty_content") == 1


def test_ancestry_ends_on_cycles(spark):
    e = spark.createDataFrame([("rewrite", "a", "b"), ("rewrite", "b", "c"), ("rewrite", "c", "a"), ("merge", "x", "c")], "relation string, from_version string, to_version string")
    got = {(r["version"], r["ancestor"]): r["depth"] for r in L.ancestry(e).collect()}
    assert got["c", "b"] == 1 and got["c", "a"] == 2 and got["c", "x"] == 1 and got["b", "x"] == 3 and len(got) == 12


def test_ancestry_of_long_chains(spark):
    e = spark.createDataFrame([("rewrite", f"v{i}", f"v{i + 1}") for i in range(99)] + [("merge", "v0", "v70")], "relation string, from_version string, to_version string")
    got = {(r["version"], r["ancestor"]): r["depth"] for r in L.ancestry(e).collect()}
    short = lambda i, j: i - j if j or i < 70 else i - 69
    assert got == {(f"v{i}", f"v{j}"): short(i, j) for i in range(100) for j in range(i)}


def test_ledger_rules(spark):
    df = spark.createDataFrame([(1, 5), (1, -1), (2, None)], "k int, v int")
    assert {r["rule"]: r["n"] for r in ledger.violations(df, ["k"], {"v >= 0": F.col("v") >= 0}).collect()} == {"unique: k": 1, "v >= 0": 2}
    a = spark.createDataFrame([("r", 1, "accept", "f", None), ("r", 2, "edit", "f", "text"), ("r", 3, "accept", "old", None)], "review_id string, seq int, action string, fingerprint string, content string")
    s = ledger.review_states(a, spark.createDataFrame([("r", "f")], "review_id string, fingerprint string")).first()
    assert (s["status"], s["revision"], s["content"], s["stale"]) == ("unreviewed", 2, "text", True)
