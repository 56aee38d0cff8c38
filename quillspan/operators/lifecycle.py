"""Policy lifecycle as set operations: requests against policies and versions give new versions, lineage edges and states.

Tables: policies (policy_id, status, current_version_id); versions (version_id, policy_id, version_number, content,
placement, scope_type, scope_value, status, review_id, created_via); lineage (relation, from_version, to_version).
Nothing is changed in place: each step returns the next snapshot, and every join is on a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillspan.functions.text import short_id
from quillspan.operators.evaluation import DEMOTE, PROMOTE
from quillspan.tables import snapshot

VERSION = ["version_id", "policy_id", "version_number", "content", "placement", "scope_type", "scope_value", "status", "review_id", "created_via"]
#: Operations that make a version, what becomes of the version before, the lineage relation.
MAKES_VERSION = {"rewrite": ("superseded", "rewrite"), "promote": ("superseded", "promote"), "demote": ("superseded", "demote"), "rollback": ("rolled_back", "rollback_source")}
STATES = {"disable": ("active", "disabled"), "enable": ("disabled", "active"), "prune": (None, "pruned")}
PLACES = {"promote": {"scoped_rule": ("project_rule", "global_rule"), "project_rule": ("global_rule",)}, "demote": {"global_rule": ("project_rule", "scoped_rule"), "project_rule": ("scoped_rule",)}}


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.get(F.array(F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]), F.lit(0))


def decided(policies: DataFrame, versions: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (policy_id, seq, operation, content, target_placement, target_number, confirm_global) with error, null where
    the operation is carried out, and what it makes: from_version, new_version_id, new_number and the version's new columns.

    Of several requests for one policy the first counts in a step, the others get the error 'not_first'. A global promotion
    needs confirm_global; a promotion or demotion goes to target_placement or, without one, to the next placement.
    """
    r = requests.withColumn("turn", F.row_number().over(W.partitionBy("policy_id").orderBy("seq")))
    r = r.join(policies.select("policy_id", F.col("status").alias("policy_status"), "current_version_id"), "policy_id", "left")
    now = versions.select(F.col("version_id").alias("current_version_id"), *[F.col(c).alias(f"now_{c}") for c in ("content", "placement", "scope_type", "scope_value")])
    back = versions.select("policy_id", F.col("version_number").alias("target_number"), *[F.col(c).alias(f"back_{c}") for c in ("version_id", "content", "placement", "scope_type", "scope_value", "review_id")])
    top = versions.groupBy("policy_id").agg(F.max("version_number").alias("top"))
    r = r.join(now, "current_version_id", "left").join(back, ["policy_id", "target_number"], "left").join(top, "policy_id", "left")
    op = F.col("operation")
    allowed = F.lit(None).cast("array<string>")
    for name, places in PLACES.items():
        for place, targets in places.items():
            allowed = F.when((op == name) & (F.col("now_placement") == place), F.array(*map(F.lit, targets))).otherwise(allowed)
    first = F.when(op == "promote", _lookup(PROMOTE, F.col("now_placement"))).when(op == "demote", _lookup(DEMOTE, F.col("now_placement")))
    target = F.coalesce("target_placement", first)
    makes = op.isin(*MAKES_VERSION)
    error = (
        F.when(F.col("policy_status").isNull(), "unknown_policy").when(F.col("turn") > 1, "not_first")
        .when(~op.isin(*MAKES_VERSION, *STATES), "unknown_operation")
        .when(makes & (F.col("policy_status") != "active"), "policy_not_active").when(makes & F.col("now_content").isNull(), "no_current_version")
        .when((op == "rewrite") & (F.trim(F.coalesce("content", F.lit(""))) == ""), "empty_content").when((op == "rewrite") & (F.col("content") == F.col("now_content")), "same_content")
        .when(op.isin("promote", "demote") & ~F.coalesce(F.array_contains(allowed, target), F.lit(False)), "no_such_target")
        .when((op == "promote") & (target == "global_rule") & ~F.coalesce("confirm_global", F.lit(False)), "needs_confirmation")
        .when((op == "rollback") & F.col("back_version_id").isNull(), "no_such_version").when((op == "rollback") & (F.col("back_version_id") == F.col("current_version_id")), "is_current")
        .when((op == "disable") & (F.col("policy_status") != "active"), "not_active").when((op == "enable") & (F.col("policy_status") != "disabled"), "not_disabled")
        .when((op == "prune") & (F.col("policy_status") == "pruned"), "already_pruned")
    )
    of = lambda c: F.when(op == "rollback", F.col(f"back_{c}")).otherwise(F.col(f"now_{c}"))
    scope = lambda c: F.when(op.isin("promote", "demote") & (target == "global_rule"), None).otherwise(of(c))
    done = error.isNull() & makes
    number = F.when(done, F.col("top") + 1)
    return r.withColumn("error", error).select(
        "policy_id", "seq", "operation", "error", "policy_status", "current_version_id",
        F.when(done, F.when(op == "rollback", F.col("back_version_id")).otherwise(F.col("current_version_id"))).alias("from_version"),
        number.alias("new_number"), F.when(done, F.concat(F.lit("PVN-"), F.col("policy_id").cast("string"), F.lit("-"), number.cast("string"))).alias("new_version_id"),
        F.when(done, F.when(op == "rewrite", F.col("content")).otherwise(of("content"))).alias("new_content"),
        F.when(done, F.when(op.isin("promote", "demote"), target).otherwise(of("placement"))).alias("new_placement"),
        F.when(done, scope("scope_type")).alias("new_scope_type"), F.when(done, scope("scope_value")).alias("new_scope_value"), F.when(done & (op == "rollback"), F.col("back_review_id")).alias("new_review_id"),
    )


def versions_after(versions: DataFrame, decisions: DataFrame) -> DataFrame:
    """versions with the states of those that were replaced, and the new ones."""
    made = decisions.where("new_version_id is not null")
    old = made.select(F.col("current_version_id").alias("version_id"), _lookup({k: v[0] for k, v in MAKES_VERSION.items()}, F.col("operation")).alias("_s"))
    kept = versions.join(old, "version_id", "left").withColumn("status", F.coalesce("_s", "status")).select(*VERSION)
    new = made.select(
        F.col("new_version_id").alias("version_id"), "policy_id", F.col("new_number").alias("version_number"), F.col("new_content").alias("content"), F.col("new_placement").alias("placement"),
        F.col("new_scope_type").alias("scope_type"), F.col("new_scope_value").alias("scope_value"), F.lit("active").alias("status"), F.col("new_review_id").alias("review_id"), F.col("operation").alias("created_via"),
    )
    return kept.unionByName(new)


def policies_after(policies: DataFrame, decisions: DataFrame) -> DataFrame:
    """policies with the states and current versions that the decisions give them."""
    done = decisions.where("error is null").select("policy_id", "new_version_id", _lookup({k: v[1] for k, v in STATES.items()}, F.col("operation")).alias("_s"))
    out = policies.join(done, "policy_id", "left")
    return out.select("policy_id", F.coalesce("_s", "status").alias("status"), F.coalesce("new_version_id", "current_version_id").alias("current_version_id"))


def lineage_of(decisions: DataFrame) -> DataFrame:
    """(relation, from_version, to_version) of the versions that decisions make."""
    relation = _lookup({k: v[1] for k, v in MAKES_VERSION.items()}, F.col("operation"))
    return decisions.where("new_version_id is not null").select(relation.alias("relation"), "from_version", F.col("new_version_id").alias("to_version"))


def merges(policies: DataFrame, versions: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (policy_a, policy_b, allow_cross_scope) with error or new_policy_id, content and both parents' versions.

    The id follows from the parents' versions and the content, so a merge that is asked for again gives the same policy.
    """
    live = policies.where("status = 'active'").join(versions.withColumnRenamed("version_id", "current_version_id").drop("policy_id", "status"), "current_version_id")
    side = lambda x: live.select(F.col("policy_id").alias(f"policy_{x}"), F.col("current_version_id").alias(f"version_{x}"), F.col("content").alias(f"content_{x}"), F.struct("scope_type", "scope_value").alias(f"scope_{x}"), F.col("placement").alias(f"placement_{x}"))
    both = pairs.join(side("a"), "policy_a", "left").join(side("b"), "policy_b", "left")
    error = (
        F.when(F.col("policy_a") == F.col("policy_b"), "same_policy").when(F.col("version_a").isNull() | F.col("version_b").isNull(), "not_active")
        .when(~F.coalesce("allow_cross_scope", F.lit(False)) & ~F.col("scope_a").eqNullSafe(F.col("scope_b")), "different_scopes")
    )
    content = F.concat("content_a", F.lit("\n\n"), "content_b")
    new = short_id("POL-", F.lit("merge"), F.col("version_a"), F.col("version_b"), F.sha2(content, 256))
    return both.withColumn("error", error).select(
        "policy_a", "policy_b", "error", "version_a", "version_b", *[F.when(F.col("error").isNull(), c).alias(n) for n, c in (("content", content), ("placement", F.col("placement_a")), ("new_policy_id", new))]
    )


def splits(policies: DataFrame, versions: DataFrame, children: DataFrame) -> DataFrame:
    """children (policy_id, content, placement, scope_type, scope_value) with error or new_policy_id; a child starts disabled.

    Equal children of one version get one id; a missing placement is the source's.
    """
    live = policies.where("status = 'active'").join(versions.select(F.col("version_id").alias("current_version_id"), F.col("placement").alias("_p")), "current_version_id").select("policy_id", "current_version_id", "_p")
    c = children.join(live, "policy_id", "left").withColumn("placement", F.coalesce("placement", "_p")).drop("_p")
    error = F.when(F.col("current_version_id").isNull(), "not_active").when(F.trim(F.coalesce("content", F.lit(""))) == "", "empty_content")
    new = short_id("POL-", F.lit("split"), F.col("current_version_id"), F.sha2("content", 256), F.col("placement"), F.col("scope_type"), F.col("scope_value"))
    return c.withColumn("error", error).withColumn("new_policy_id", F.when(F.col("error").isNull(), new)).withColumn("status", F.when(F.col("error").isNull(), "disabled"))


def ancestry(lineage: DataFrame) -> DataFrame:
    """(version, ancestor, depth): each pair once with its shortest way; cycles end by themselves.

    A round joins all ways of up to `reach` generations with the longest of them, so their length doubles and a chain of n
    versions takes log2(n) rounds. Each round is written, and they end when one finds no new pair.
    """
    edges = lineage.select(F.col("to_version").alias("version"), F.col("from_version").alias("ancestor")).where("version is not null and ancestor is not null").distinct()
    known = snapshot(edges.withColumn("depth", F.lit(1)), "ancestry")
    reach = 1
    while True:
        longest = known.where(F.col("depth") == reach).select("version", F.col("ancestor").alias("middle"), "depth")
        onward = known.select(F.col("version").alias("middle"), "ancestor", F.col("depth").alias("more"))
        found = longest.join(onward, "middle").groupBy("version", "ancestor").agg(F.min(F.col("depth") + F.col("more")).alias("depth"))
        front = snapshot(found.join(known, ["version", "ancestor"], "left_anti"), "ancestry")
        if front.isEmpty():
            return known
        known = known.unionByName(front)
        reach *= 2


def provenance(versions: DataFrame, links: DataFrame, comparisons: DataFrame, specs: DataFrame, reviews: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each version's way back: comparisons, evaluations, reviews, experiences and the trajectories behind them.

    links: version_id, comparison_id; comparisons: comparison_id, evaluation_id, outcome; specs: evaluation_id, review_id;
    reviews: review_id, experience_id; evidence: experience_id, occurrence_id, trajectory_id. Missing steps leave nulls.
    """
    out = versions.select("version_id", "policy_id", F.col("review_id").alias("own_review_id")).join(links, "version_id", "left").join(comparisons, "comparison_id", "left").join(specs, "evaluation_id", "left")
    out = out.withColumn("review_id", F.coalesce("review_id", "own_review_id")).drop("own_review_id")
    return out.join(reviews, "review_id", "left").join(evidence, "experience_id", "left")
