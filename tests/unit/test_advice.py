import random

from pyspark.sql import functions as F

from quillspan.operators import advice as A

LEDGER = "recommendation_id string, policy_id string, version_id string, operation string, rollback_to string, at long, status string"
FOUND = LEDGER.removesuffix(", status string")


def one_by_one(ledger, found):
    """Recommendations taken in one after another, as a list."""
    rows = {r[0]: list(r) for r in ledger}
    for r in sorted(found, key=lambda r: (r[5], r[0])):
        if r[0] in rows:
            continue
        for x in rows.values():
            if x[1:3] == list(r[1:3]) and x[-1] == "open":
                x[-1] = "superseded"
        rows[r[0]] = [*r, "open"]
    return sorted(map(tuple, rows.values()))


def test_ledger_equals_one_by_one(spark):
    rng = random.Random(4)
    row = lambda i, p, at: (f"R{i}", f"p{p}", f"p{p}v{i % 2}", "retain", None, at)
    ledger = [(*row(i, i % 7, i), rng.choice(["open", "rejected", "accepted", "superseded"])) for i in range(40)]
    found = [row(i, i % 7, 100 + rng.randrange(50)) for i in (rng.randrange(20, 90) for _ in range(120))]
    got = A.ledger_after(spark.createDataFrame(ledger, LEDGER), spark.createDataFrame(found, FOUND))
    assert sorted(map(tuple, got.collect())) == one_by_one(ledger, found)
    again = A.ledger_after(got, spark.createDataFrame(found, FOUND))
    assert sorted(map(tuple, again.collect())) == one_by_one(ledger, found)
    assert A.ledger_after(spark.createDataFrame([], LEDGER), spark.createDataFrame([], FOUND)).count() == 0


def test_decisions(spark):
    policies = spark.createDataFrame([("p", "active", "v2"), ("q", "active", "w1"), ("d", "disabled", "x1")], "policy_id string, status string, current_version_id string")
    versions = [("v1", "p", 1, "old", "project_rule"), ("v2", "p", 2, "new", "project_rule"), ("w1", "q", 1, "c", "project_rule"), ("x1", "d", 1, "c", "skill")]
    versions = spark.createDataFrame([(*v, "project", "1", "active", "r", "initial") for v in versions], "version_id string, policy_id string, version_number int, content string, placement string, scope_type string, scope_value string, status string, review_id string, created_via string")
    ledger = [
        ("back", "p", "v2", "rollback", "v1"), ("lost", "q", "w1", "rollback", None), ("wide", "q", "w1", "promote", None), ("keep", "q", "w1", "retain", None), ("odd", "q", "w1", "merge", None), ("off", "d", "x1", "disable", None), ("done", "p", "v2", "retain", None), ("no", "q", "w1", "demote", None),
    ]
    ledger = spark.createDataFrame([(*r, 1, "accepted" if r[0] == "done" else "open") for r in ledger], LEDGER)
    actions = [("back", "accept"), ("back", "reject"), ("lost", "accept"), ("wide", "accept"), ("keep", "accept"), ("odd", "accept"), ("off", "accept"), ("done", "reject"), ("none", "accept"), ("no", "defer"), ("keep", "what")]
    actions = spark.createDataFrame([(r, i, a, None, False) for i, (r, a) in enumerate(actions)], "recommendation_id string, seq int, action string, target_placement string, confirm_global boolean")
    found = A.decisions(ledger, actions, policies, versions)
    got = {(r["recommendation_id"], r["action"]): (r["error"], r["status"]) for r in found.collect()}
    assert got == {
        ("back", "accept"): (None, "accepted"), ("back", "reject"): ("not_first", None), ("lost", "accept"): ("no_such_version", None), ("wide", "accept"): ("needs_confirmation", None), ("keep", "accept"): (None, "accepted"),
        ("odd", "accept"): ("cannot_be_carried_out", None), ("off", "accept"): ("not_active", None), ("done", "reject"): ("not_open", None), ("none", "accept"): ("unknown_recommendation", None), ("no", "defer"): (None, "deferred"), ("keep", "what"): ("unknown_action", None),
    }
    assert [(r["policy_id"], r["operation"], r["target_number"]) for r in A.requests_of(found).collect()] == [("p", "rollback", 1)]
    after = {r["recommendation_id"]: r["status"] for r in A.decided_ledger(ledger, found).collect()}
    assert after == {"back": "accepted", "lost": "open", "wide": "open", "keep": "accepted", "odd": "open", "off": "open", "done": "accepted", "no": "deferred"}
    assert {(r["recommendation_id"], r["action"]) for r in A.recorded(found).collect()} == {("back", "recommendation_accepted"), ("keep", "recommendation_accepted"), ("no", "recommendation_deferred")}


def test_evidence_is_linked_once(spark):
    versions = spark.createDataFrame([("v1", "r1"), ("v2", None)], "version_id string, review_id string")
    comparisons = spark.createDataFrame([(1, "e1"), (2, "e1"), (3, "e2"), (4, "e9")], "comparison_id int, evaluation_id string")
    specs = spark.createDataFrame([("e1", "r1"), ("e2", "r2")], "evaluation_id string, review_id string")
    links = spark.createDataFrame([("v1", 1), ("v2", 3)], "version_id string, comparison_id int")
    one = A.linked_evidence(links, versions, comparisons, specs)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, A.linked_evidence(one, versions, comparisons, specs).collect())) == [("v1", 1), ("v1", 2), ("v2", 3)]


def test_adoption(spark):
    reviews = [("a", "accepted", False), ("a", "accepted", False), ("b", "rejected", False), ("c", "applied", True), ("d", "unreviewed", False), ("e", "test_first", None), ("f", "accepted", False)]
    reviews = spark.createDataFrame([(*r, "x", "text", "skill", "project", "1") for r in reviews], "review_id string, status string, stale boolean, experience_id string, content string, placement string, scope_type string, scope_value string")
    none = spark.createDataFrame([("POL-own", "f")], "policy_id string, origin_review_id string")
    got = {r["review_id"]: r["outcome"] for r in A.adoptions(reviews, none).collect()}
    assert got == {"a": "adopted", "b": "not_eligible", "c": "stale", "d": "not_reviewed", "e": "adopted", "f": "existing"}
    policies, versions, actions = A.adopted(reviews, none)
    ids = {r["origin_review_id"]: r["policy_id"] for r in policies.collect()}
    assert set(ids) == {"a", "e"} and {r["policy_id"] for r in versions.collect()} == {r["policy_id"] for r in actions.collect()} == set(ids.values())
    again = A.adoptions(reviews, none.unionByName(policies.select("policy_id", "origin_review_id")))
    assert {r["review_id"]: r["policy_id"] for r in again.where("outcome = 'existing'").collect()} == {**ids, "f": "POL-own"}


def test_survivors_of_long_chains_branches_and_circles(spark):
    edges = [(i, i + 1, i) for i in range(100)] + [(200, 100, 500), (200, 7, 1), (300, 301, 1), (301, 302, 1), (302, 300, 1), (400, 301, 1), (600, 600, 1)]
    df = spark.createDataFrame([("merged_from", a, b, i) for a, b, i in edges] + [("split_from", 100, 999, 1)], "relation string, from_version long, to_version long, lineage_id long")
    got = {r["version"]: (r["survivor"], r["steps"]) for r in A.survivors(df).collect()}
    assert all(got[i] == (100, 100 - i) for i in range(100)) and got[200] == (100, 1)
    assert all(got[i] == (None, None) for i in (300, 301, 302, 400, 600)) and len(got) == 106
    assert A.survivors(df.where("relation = 'none'")).count() == 0


def test_stale_signals(spark):
    versions = spark.createDataFrame([(1, "skill", "p"), (2, "project_rule", "gone"), (3, "scoped_rule", "lost"), (4, "global_rule", "gone"), (5, "skill", None)], "version_id long, placement string, scope_value string")
    projects = spark.createDataFrame([("p", False), ("lost", True)], "project_id string, root_missing boolean")
    lineage = spark.createDataFrame([("merged_from", 5, 2), ("merged_from", 1, 5)], "relation string, from_version long, to_version long")
    got = sorted(map(tuple, A.stale_signals(versions, projects, lineage).collect()), key=repr)
    assert got == [(1, "superseded_by_merge", 2), (2, "target_project_not_registered", None), (3, "target_repository_missing", None), (5, "superseded_by_merge", 2)]
