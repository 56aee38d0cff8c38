"""Paired runs and what follows for policies: comparison, evidence, recommendation, duplicates, staleness, lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillspan.functions import values as V
from quillspan.functions.text import short_id

PROMOTE = {"scoped_rule": "project_rule", "project_rule": "global_rule"}
DEMOTE = {"global_rule": "project_rule", "project_rule": "scoped_rule"}


def compared(runs: DataFrame, checks: DataFrame) -> DataFrame:
    """Outcome of each pair. runs: pair, condition (baseline, candidate), status, duration_ms; checks: pair, condition, id, name, passed.

    A pair with an incomplete or unchecked side is invalid, with different names incomparable; the first baseline check
    decides, and any check that fails only in the candidate is a regression. Of equal names the last check counts.
    """
    side = lambda c, x: F.max(F.when(F.col("condition") == c, F.col(x)))
    pairs = runs.groupBy("pair").agg(*[side(c, x).alias(f"{c}_{x}") for c in ("baseline", "candidate") for x in ("status", "duration_ms")])
    last = checks.groupBy("pair", "condition", "name").agg(F.max_by("passed", "id").alias("passed"), F.min("id").alias("first_id"))
    base, cand = (last.where(F.col("condition") == c).select("pair", "name", F.col("passed").alias(c), F.col("first_id").alias(f"{c}_id")) for c in ("baseline", "candidate"))
    both = base.join(cand, ["pair", "name"], "full_outer")
    found = both.groupBy("pair").agg(
        F.count("baseline_id").alias("n_baseline"), F.count("candidate_id").alias("n_candidate"),
        F.count_if(F.col("baseline_id").isNull() | F.col("candidate_id").isNull()).alias("unmatched"),
        F.count_if(F.col("baseline") & ~F.col("candidate")).alias("regression_count"),
        F.min_by(F.struct("baseline", "candidate"), "baseline_id").alias("primary"),
        F.array_sort(F.collect_list(F.when(F.col("baseline") != F.col("candidate"), F.col("name")))).alias("changed_checks"),
    )
    out = pairs.join(found, "pair", "left")
    done = F.coalesce((F.col("baseline_status") == "completed") & (F.col("candidate_status") == "completed"), F.lit(False))
    checked = (F.coalesce("n_baseline", F.lit(0)) > 0) & (F.coalesce("n_candidate", F.lit(0)) > 0)
    first, second = F.col("primary.baseline"), F.col("primary.candidate")
    outcome = (
        F.when(~done | ~checked, "invalid").when(F.col("unmatched") > 0, "incomparable").when(first & ~second, "regressed").when(~first & second, "improved")
        .when(F.col("regression_count") > 0, "regressed").otherwise("unchanged")
    )
    usable = F.col("outcome").isin("regressed", "improved", "unchanged")
    out = out.withColumn("outcome", outcome)
    word = lambda x: F.when(x, "pass").otherwise("fail")
    return out.select(
        "pair", "outcome", F.when(usable, F.concat(word(first), F.lit("->"), word(second))).alias("task_success_delta"),
        F.when(usable, F.col("regression_count")).otherwise(F.lit(0)).alias("regression_count"),
        F.when(usable, F.col("changed_checks")).otherwise(F.array().cast("array<string>")).alias("changed_checks"),
        (F.col("candidate_duration_ms") - F.col("baseline_duration_ms")).alias("duration_delta_ms"),
    )


def version_evidence(comparisons: DataFrame, key: str = "version_id") -> DataFrame:
    """Counts, ratios over valid outcomes, mean duration change and latest outcome of each version; comparisons have id, outcome, regression_count, duration_delta_ms, created_at."""
    n = lambda x: F.count_if(F.col("outcome") == x).alias(x)
    out = comparisons.groupBy(key).agg(
        F.count("*").alias("total"), *[n(x) for x in ("improved", "unchanged", "regressed", "invalid", "incomparable")],
        F.sum("regression_count").alias("regression_checks"), F.avg("duration_delta_ms").alias("avg_duration_delta_ms"),
        F.max_by("outcome", F.struct("created_at", "id")).alias("latest_outcome"),
    )
    valid = F.col("improved") + F.col("unchanged") + F.col("regressed")
    ratio = lambda x: F.when(F.col("valid") > 0, F.col(x) / F.col("valid"))
    return out.withColumn("valid", valid).withColumns({"improved_ratio": ratio("improved"), "regressed_ratio": ratio("regressed")})


def recommendations(versions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Operation, strength and reason for each version (version_id, policy_id, version_number, placement), by evidence of it and of the version before."""
    order = W.partitionBy("policy_id").orderBy("version_number")
    x = versions.join(evidence, "version_id", "left").fillna(0, ["total", "improved", "unchanged", "regressed", "invalid", "incomparable", "valid"])
    x = x.withColumns({"good": F.coalesce("improved_ratio", F.lit(0.0)), "bad": F.coalesce("regressed_ratio", F.lit(0.0))})
    before = F.lag("version_number").over(order) == F.col("version_number") - 1
    x = x.withColumns({
        "was_valid": F.when(before, F.lag("valid").over(order)), "was_good": F.when(before, F.lag("good").over(order)),
        "rollback_to": F.when(before, F.lag("version_id").over(order)),
    })
    can = lambda t: F.col("placement").isin(*t)
    enough = F.col("valid") >= V.SIGNAL
    rollback = F.coalesce(enough & (F.col("bad") >= V.REGRESSED) & (F.col("was_valid") >= V.SIGNAL) & (F.col("was_good") >= V.IMPROVED), F.lit(False))
    steady = (F.col("good") >= V.IMPROVED) & (F.col("regressed") == 0)
    say = lambda operation, strength, reason: F.struct(F.lit(operation).alias("operation"), F.lit(strength).alias("strength"), F.lit(reason).alias("reason"))
    rule = (
        F.when(rollback, say("rollback", "strong", "NEW_VERSION_REGRESSION")).when(~enough, say("retain", "informational", "INSUFFICIENT_EVIDENCE"))
        .when((F.col("bad") >= V.REGRESSED) & can(DEMOTE), say("demote", "strong", "REPEATED_REGRESSION"))
        .when(F.col("bad") >= V.REGRESSED, say("disable", "strong", "REPEATED_REGRESSION"))
        .when((F.col("bad") >= V.MIXED) & (F.col("good") > 0) & can(DEMOTE), say("demote", "moderate", "HIGH_WRONG_SCOPE_COST"))
        .when(steady & can(PROMOTE), say("promote", "strong", "CONSISTENT_CROSS_SCOPE_BENEFIT")).when(steady, say("retain", "moderate", "CONSISTENT_CROSS_SCOPE_BENEFIT"))
        .otherwise(say("retain", "informational", None))
    )
    x = x.withColumn("r", rule)
    prints = F.sha2(F.concat_ws("|", "version_id", "r.operation", "total", "improved", "regressed", "unchanged", "invalid", "incomparable"), 256)
    rec = short_id("REC-", F.col("policy_id"), F.col("version_id"), F.col("r.operation"), prints, length=16)
    return x.select("policy_id", "version_id", "r.operation", "r.strength", "r.reason", F.when(F.col("r.operation") == "rollback", F.col("rollback_to")).alias("rollback_to"), rec.alias("recommendation_id"))


def duplicate_policies(policies: DataFrame) -> DataFrame:
    """(content_hash, policy_ids) of active policies that share their content."""
    same = policies.where("status = 'active'").groupBy("content_hash").agg(F.array_sort(F.collect_list("policy_id")).alias("policy_ids"))
    return same.where(F.size("policy_ids") >= 2)


def stale_policies(policies: DataFrame, projects: DataFrame) -> DataFrame:
    """Policies whose target is gone: an unknown project, or one whose root is missing."""
    p = projects.select(F.col("project_id").alias("scope_value"), "root_missing")
    at = policies.where("scope_type = 'project'").join(p, "scope_value", "left")
    reason = F.when(F.col("root_missing").isNull(), "target_project_not_registered").when(F.col("root_missing"), "target_project_root_missing")
    return at.withColumn("reason", reason).where("reason is not null").select("policy_id", "scope_value", "reason")


def merge_parents(lineage: DataFrame) -> DataFrame:
    """(child, parent_a, parent_b) of merges: two edges into one version."""
    a = lineage.where("relation = 'merged_from'").select(F.col("to_version").alias("child"), F.col("from_version").alias("parent_a"))
    return a.join(a.withColumnRenamed("parent_a", "parent_b"), "child").where("parent_a < parent_b")


def metrics_delta(runs: DataFrame) -> DataFrame:
    """What each pair's two runs took: duration and tokens of both, the change where both are known, and the policy's size.

    runs: pair, condition (baseline, candidate), duration_ms, tokens, policy_bytes; of a condition that a pair has twice,
    the greatest values count.
    """
    side = lambda c, x: F.max(F.when(F.col("condition") == c, F.col(x))).alias(f"{c}_{x}")
    both = runs.groupBy("pair").agg(*(side(c, x) for c in ("baseline", "candidate") for x in ("duration_ms", "tokens")), side("candidate", "policy_bytes"))
    return both.select(
        "pair", "baseline_duration_ms", "candidate_duration_ms", (F.col("candidate_duration_ms") - F.col("baseline_duration_ms")).alias("duration_delta_ms"), "baseline_tokens", "candidate_tokens",
        (F.col("baseline_tokens").isNotNull() & F.col("candidate_tokens").isNotNull()).alias("tokens_available"), F.col("candidate_policy_bytes").alias("policy_bytes"),
    )
