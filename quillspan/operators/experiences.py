"""Groups of occurrences across trajectories: counts, contradictions, gates, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions import values as V
from quillspan.functions.scores import confidence, recency

PATTERN_RANK = ("failure_repair", "human_correction_repair", "file_change_pattern", "repeated_failure")


def _positives(occurrences: DataFrame) -> DataFrame:
    return occurrences.where(F.col("classification").isin("support", "ambiguous"))


def contradictions(occurrences: DataFrame, profiles: DataFrame, least: int = 3) -> DataFrame:
    """Trajectories that edited what comes before a repair and passed its check cleanly without touching the repaired context.

    Only repair groups of a known context and family with max(2, least - 1) positives have any. A group is exploded into
    its antecedents and a profile into its clean families and edited contexts, and the two meet in an equi-join; there
    are at most as many group rows as contexts x families x contexts.
    """
    groups = _positives(occurrences).groupBy("group_key").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("classification") == "support").alias("n_support"),
        F.array_distinct(F.flatten(F.collect_set(F.coalesce("antecedents", F.array().cast("array<string>"))))).alias("antecedents"),
    )
    parts = F.split("group_key", "::")
    groups = groups.where((F.get(parts, F.lit(0)) == "fr") & (F.col("n") >= max(2, least - 1)) & (F.col("n_support") > 0))
    groups = groups.select("group_key", F.get(parts, F.lit(1)).alias("context"), F.get(parts, F.lit(2)).alias("family"), F.explode("antecedents").alias("edited"))
    groups = groups.where(F.col("family").isin(*V.FAMILIES) & ~F.col("context").isin("other", "mixed", "-") & ~F.col("edited").isin("", "other", "mixed"))
    wide = profiles.select("trajectory_id", "project_id", "edit_contexts", "max_sequence", F.explode("clean_passes").alias("family"))
    wide = wide.withColumn("edited", F.explode("edit_contexts"))
    met = wide.join(groups, ["family", "edited"]).where(~F.array_contains("edit_contexts", F.col("context")))
    met = met.join(_positives(occurrences).select("group_key", "trajectory_id").distinct(), ["group_key", "trajectory_id"], "left_anti")
    return met.select(
        "trajectory_id", "project_id", "group_key", F.lit("contradiction").alias("classification"), F.lit(1).alias("start_sequence"),
        F.greatest(F.lit(1), "max_sequence").alias("end_sequence"), "family", "context",
    ).distinct()


def experiences(occurrences: DataFrame, profiles: DataFrame, now: Column, least: int = 3, least_projects: int = 1) -> DataFrame:
    """One row for each group with support and at least `least` - 1 positives, with counts, contexts, confidence and status.

    profiles may carry last_activity, a timestamp, which gives first and last seen.
    """
    positive = _positives(occurrences)
    against = contradictions(occurrences, profiles, least)
    columns = ["group_key", "trajectory_id", "project_id", "classification"]
    evidence = positive.select(*columns).unionByName(against.select(*columns))
    if "last_activity" in profiles.columns:
        evidence = evidence.join(profiles.select("trajectory_id", "last_activity"), "trajectory_id", "left")
    else:
        evidence = evidence.withColumn("last_activity", F.lit(None).cast("timestamp"))
    is_ = lambda x: F.col("classification") == x
    counts = evidence.groupBy("group_key").agg(
        F.count_if(is_("support")).alias("support_count"), F.count_if(is_("ambiguous")).alias("ambiguous_count"),
        F.count_if(is_("contradiction")).alias("contradiction_count"), F.count("*").alias("occurrence_count"),
        F.count_distinct("project_id").alias("project_count"), F.count_distinct(F.when(is_("support"), F.col("project_id"))).alias("support_projects"),
        F.min("last_activity").alias("first_seen"), F.max("last_activity").alias("last_seen"),
    )
    rank = F.array_position(F.array(*map(F.lit, PATTERN_RANK)), F.col("pattern"))
    ante = F.coalesce("antecedents", F.array().cast("array<string>"))
    # The sample is that of the first occurrence by its id, where occurrences have one.
    first = F.struct("occurrence_id") if "occurrence_id" in occurrences.columns else F.struct("trajectory_id", "start_sequence")
    named = positive.groupBy("group_key").agg(
        F.min_by("pattern", rank).alias("pattern"),
        F.array_sort(F.array_remove(F.array_remove(F.array_union(F.collect_set("repair_context"), F.array_distinct(F.flatten(F.collect_set(ante)))), "other"), "")).alias("contexts"),
        F.min_by("detail", F.when((F.col("pattern") == "human_correction_repair") & (F.coalesce("detail", F.lit("")) != ""), first)).alias("sample_correction"),
    )
    out = counts.join(named, "group_key").withColumn("positive", F.col("support_count") + F.col("ambiguous_count"))
    out = out.where((F.col("support_count") > 0) & (F.col("positive") >= least - 1))
    score = confidence(F.col("support_count"), F.col("contradiction_count"), F.col("positive"), F.col("support_projects"), recency(F.col("last_seen"), now))
    status = F.when((F.col("positive") >= least) & (F.col("project_count") >= least_projects), "candidate").otherwise("needs_more_evidence")
    return out.withColumns({"confidence": score, "status": status}).drop("positive")


def summaries(found: DataFrame) -> DataFrame:
    """experiences() with title and lesson from fixed templates."""
    parts = F.split("group_key", "::")
    ctx, fam = F.get(parts, F.lit(1)), F.coalesce(F.get(parts, F.lit(2)), F.lit("-"))
    title = (
        F.when(F.col("pattern") == "failure_repair", F.format_string("A failing %s run is repaired in %s", fam, ctx))
        .when(F.col("pattern") == "human_correction_repair", F.format_string("A correction leads to work in %s until %s passes", ctx, fam))
        .when(F.col("pattern") == "file_change_pattern", F.format_string("Changes that end in %s before %s passes", ctx, fam))
        .otherwise(F.format_string("A failure keeps coming back: %s", ctx))
    )
    lesson = F.format_string("%s. Seen %d times in %d projects, contradicted %d times.", title, "occurrence_count", "project_count", "contradiction_count")
    return found.withColumns({"title": title, "lesson": lesson})
