"""The ledger of recommendations: made once for one state of the evidence, superseded by the next, decided by people.

A recommendation's id is a digest of its version, operation and counts, so the same evidence gives the same row and what
has been rejected stays rejected. A batch of any size is taken in at once: an ordered window for each version decides which
row is open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillspan.functions.text import short_id
from quillspan.operators import lifecycle
from quillspan.operators.cascade import added_or_ignored
from quillspan.tables import snapshot

# What a decision makes of a recommendation, which operations can be carried out, who can be adopted.
DECISIONS = {"accept": "accepted", "reject": "rejected", "defer": "deferred"}
CARRIED_OUT = ("rollback", "promote", "demote", "disable", "prune")
ADOPTABLE = ("accepted", "test_first", "applied")
SCOPED = ("project_rule", "scoped_rule", "skill")
LEDGER = ["recommendation_id", "policy_id", "version_id", "operation", "rollback_to", "at", "status"]


def ledger_after(ledger: DataFrame, found: DataFrame) -> DataFrame:
    """ledger (LEDGER) with the recommendations of found (LEDGER without status) that it hasn't.

    The same as taking found's rows one after another by (at, recommendation_id): a known id changes nothing, whatever its
    status; a new one is open and supersedes what is open for its policy and version.
    """
    own = W.partitionBy("recommendation_id").orderBy("at")
    new = found.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n").join(ledger.select("recommendation_id"), "recommendation_id", "left_anti")
    latest = W.partitionBy("policy_id", "version_id").orderBy(F.desc("at"), F.desc("recommendation_id"))
    new = new.withColumn("status", F.when(F.row_number().over(latest) == 1, "open").otherwise("superseded"))
    renewed = new.select("policy_id", "version_id", F.lit(True).alias("_r")).distinct()
    old = ledger.join(renewed, ["policy_id", "version_id"], "left")
    old = old.withColumn("status", F.when(F.col("_r") & (F.col("status") == "open"), "superseded").otherwise(F.col("status")))
    return old.select(*LEDGER).unionByName(new.select(*LEDGER))


def decisions(ledger: DataFrame, actions: DataFrame, policies: DataFrame, versions: DataFrame) -> DataFrame:
    """What becomes of actions (recommendation_id, seq, action, target_placement, confirm_global) on recommendations.

    Returns seq, recommendation_id, action, error, status (null with an error), and the request for lifecycle.decided():
    policy_id, version_id, operation, target_number, target_placement, confirm_global. Only an open recommendation is decided, by its
    first action. Accepting one carries it out: if its operation can't be, as lifecycle.decided() judges it, or is none of
    CARRIED_OUT, there is an error and the recommendation stays open; retaining needs nothing.
    """
    turn = F.row_number().over(W.partitionBy("recommendation_id").orderBy("seq"))
    one = actions.withColumn("turn", turn).join(ledger.select("recommendation_id", "policy_id", "version_id", "operation", "rollback_to", F.col("status").alias("_s")), "recommendation_id", "left")
    back = versions.select(F.col("version_id").alias("rollback_to"), F.col("version_number").alias("target_number"))
    one = one.join(back, "rollback_to", "left")
    op, accepts = F.col("operation"), F.col("action") == "accept"
    error = (
        F.when(F.col("_s").isNull(), "unknown_recommendation").when(~F.col("action").isin(*DECISIONS), "unknown_action").when(F.col("_s") != "open", "not_open").when(F.col("turn") > 1, "not_first")
        .when(accepts & (op == "rollback") & F.col("target_number").isNull(), "no_such_version").when(accepts & ~op.isin("retain", *CARRIED_OUT), "cannot_be_carried_out")
    )
    one = snapshot(one.withColumn("error", error), "decisions")
    ran = lifecycle.decided(policies, versions, requests_of(one.withColumn("status", F.when(F.col("error").isNull(), F.lit("accepted")))))
    failed = ran.where("error is not null").select("policy_id", "seq", F.col("error").alias("_e"))
    out = one.join(failed, ["policy_id", "seq"], "left").withColumn("error", F.coalesce("error", F.when(accepts, F.col("_e"))))
    status = F.when(F.col("error").isNull(), F.get(F.array(F.create_map(*[F.lit(x) for kv in DECISIONS.items() for x in kv])[F.col("action")]), 0))
    return out.select("seq", "recommendation_id", "action", "error", status.alias("status"), "policy_id", "version_id", "operation", F.when(op == "rollback", F.col("target_number")).alias("target_number"), "target_placement", "confirm_global")


def requests_of(decided: DataFrame) -> DataFrame:
    """The lifecycle requests of accepted recommendations, in the columns of lifecycle.decided()."""
    go = decided.where((F.col("status") == "accepted") & (F.col("action") == "accept") & F.col("operation").isin(*CARRIED_OUT))
    return go.select("policy_id", "seq", "operation", F.lit(None).cast("string").alias("content"), "target_placement", "target_number", "confirm_global")


def decided_ledger(ledger: DataFrame, decided: DataFrame) -> DataFrame:
    """ledger with the status that decisions give."""
    new = decided.where("status is not null").select("recommendation_id", F.col("status").alias("_s"))
    return ledger.join(new, "recommendation_id", "left").withColumn("status", F.coalesce("_s", "status")).select(*LEDGER)


def recorded(decided: DataFrame) -> DataFrame:
    """(policy_id, version_id, action, recommendation_id, operation): the trail that decisions leave."""
    return decided.where("status is not null").select("policy_id", "version_id", F.concat(F.lit("recommendation_"), "status").alias("action"), "recommendation_id", "operation")


def linked_evidence(links: DataFrame, versions: DataFrame, comparisons: DataFrame, specs: DataFrame) -> DataFrame:
    """links (version_id, comparison_id) with those of all comparisons of a version's own review; known links stay as they are.

    comparisons have comparison_id and evaluation_id, specs evaluation_id and review_id, versions version_id and review_id.
    """
    found = comparisons.join(specs.select("evaluation_id", "review_id"), "evaluation_id").join(versions.where("review_id is not null").select("version_id", "review_id"), "review_id")
    return added_or_ignored(links.select("version_id", "comparison_id"), found.select("version_id", "comparison_id"), ["version_id", "comparison_id"], [F.col("comparison_id")])


def adoptions(reviews: DataFrame, policies: DataFrame) -> DataFrame:
    """(review_id, policy_id, outcome) of reviews that are to become policies: `existing`, `adopted`, or why not.

    reviews have review_id (repeats count once), status and stale; policies have policy_id and origin_review_id. The id is
    a digest of the review's, so adopting twice gives one policy. A stale review and one that isn't in an ADOPTABLE state
    have no policy_id.
    """
    have = policies.where("origin_review_id is not null").groupBy(F.col("origin_review_id").alias("review_id")).agg(F.min("policy_id").alias("_p"))
    one = reviews.select("review_id", "status", "stale").dropDuplicates(["review_id"]).join(have, "review_id", "left")
    outcome = (
        F.when(F.col("_p").isNotNull(), "existing").when(F.col("status").isNull() | (F.col("status") == "unreviewed"), "not_reviewed").when(F.coalesce("stale", F.lit(False)), "stale")
        .when(~F.col("status").isin(*ADOPTABLE), "not_eligible").otherwise("adopted")
    )
    new = F.when(outcome == "adopted", short_id("POL-", F.col("review_id")))
    return one.select("review_id", F.coalesce("_p", new).alias("policy_id"), outcome.alias("outcome"))


def adopted(reviews: DataFrame, policies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(policies, versions, actions) that adoption adds. reviews also have experience_id, content, placement, scope_type and scope_value.

    A policy starts active with version 1, whose id is its own with the number, and one `adopt` action.
    """
    new = adoptions(reviews, policies).where("outcome = 'adopted'").select("review_id", "policy_id").join(reviews.dropDuplicates(["review_id"]), "review_id")
    first = F.concat(F.lit("PVN-"), F.col("policy_id"), F.lit("-1"))
    made = new.select("policy_id", F.lit("active").alias("status"), first.alias("current_version_id"), F.col("review_id").alias("origin_review_id"), "experience_id")
    versions = new.select(first.alias("version_id"), "policy_id", F.lit(1).alias("version_number"), "content", "placement", "scope_type", "scope_value", F.lit("active").alias("status"), "review_id", F.lit("initial").alias("created_via"))
    return made, versions, new.select("policy_id", first.alias("version_id"), F.lit("adopt").alias("action"), "review_id")


def survivors(lineage: DataFrame, relation: str = "merged_from") -> DataFrame:
    """(version, survivor, steps) of versions that were merged away: where the chain of merges behind each ends.

    lineage has relation, from_version, to_version and, if it has one, lineage_id; of several merges of one version the
    latest counts. Each round lets every version jump to where its target points, so steps double and a chain of n merges
    takes log2(n) rounds of one join over as many rows as there are merged versions. Versions whose chain goes round in a
    circle have no survivor.
    """
    last = F.struct("lineage_id", "to_version") if "lineage_id" in lineage.columns else F.col("to_version")
    edges = lineage.where(F.col("relation") == relation).where("from_version is not null and to_version is not null")
    at = snapshot(edges.groupBy(F.col("from_version").alias("version")).agg(F.max_by("to_version", last).alias("survivor"), F.lit(1).cast("long").alias("steps")), "survivors")
    n, reach = at.count(), 1
    while True:
        onward = at.select(F.col("version").alias("survivor"), F.col("survivor").alias("_to"), F.col("steps").alias("_more"))
        met = at.join(onward, "survivor", "left")
        moved = met.select("version", F.coalesce("_to", "survivor").alias("survivor"), (F.col("steps") + F.coalesce("_more", F.lit(0))).alias("steps"), F.col("_to").isNotNull().alias("_on"))
        moved = snapshot(moved, "survivors")
        going = not moved.where("_on").isEmpty()
        if not going or reach > n:
            # Beyond as many steps as there are versions only circles go on.
            return moved.select("version", F.when(~F.col("_on"), F.col("survivor")).alias("survivor"), F.when(~F.col("_on"), F.col("steps")).alias("steps"))
        at, reach = moved.drop("_on"), reach * 2


def stale_signals(versions: DataFrame, projects: DataFrame, lineage: DataFrame) -> DataFrame:
    """(version_id, reason, survivor): why a version may have outlived its use; a reason a row, none for sound versions.

    versions have version_id, placement and scope_value, which is looked up as a project; projects have project_id and
    root_missing.
    """
    known = projects.select(F.col("project_id").cast("string").alias("scope_value"), F.coalesce("root_missing", F.lit(False)).alias("_m"))
    at = versions.where(F.col("placement").isin(*SCOPED) & (F.coalesce("scope_value", F.lit("")) != "")).select("version_id", "scope_value").join(known, "scope_value", "left")
    gone = at.select("version_id", F.when(F.col("_m").isNull(), "target_project_not_registered").when(F.col("_m"), "target_repository_missing").alias("reason"), F.lit(None).cast(lineage.schema["to_version"].dataType).alias("survivor")).where("reason is not null")
    merged = versions.select("version_id").join(survivors(lineage).select(F.col("version").alias("version_id"), "survivor"), "version_id")
    return gone.unionByName(merged.select("version_id", F.lit("superseded_by_merge").alias("reason"), "survivor"))
