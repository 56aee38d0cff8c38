"""The generation pass: proposals are made anew where what they rest on has changed, checked as whole sets, and replaced as sets.

A set is the five placements of one experience. It stands while its experience, evidence and events have the fingerprint it
was made from and the generator is the same; so a pass over unchanged tables plans nothing and writes nothing.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.operators.imports import replaced
from quillspan.operators.placement import diagnostics, eligible, features, proposals, public_content, source_fingerprints
from quillspan.tables import snapshot
from quillspan.versions import Pass

PLACEMENTS = ("ignore", "global_rule", "project_rule", "scoped_rule", "skill")
EXPERIENCE_KEYS = ("title", "lesson", "pattern", "confidence", "recency", "support_count", "contradiction_count", "ambiguous_count", "occurrence_count", "project_count", "status", "review_status")
EVIDENCE_KEYS = ("occurrence_id", "trajectory_id", "project_id", "classification", "start_sequence", "end_sequence", "repair_context", "antecedents")
EVENT_KEYS = ("sequence", "type", "path", "command")


def planned(experiences: DataFrame, fingerprints: DataFrame, sets: DataFrame, made: DataFrame, version: str) -> DataFrame:
    """(group_key, fingerprint, action) of eligible experiences: unchanged, if their set has this fingerprint and version and
    all five proposals in `made` (group_key, placement), else regenerate."""
    n = made.groupBy("group_key").agg(F.count("*").alias("n"))
    have = sets.select("group_key", F.col("fingerprint").alias("_f"), F.col("version").alias("_v")).join(n, "group_key", "left")
    same = (F.col("_f") == F.col("fingerprint")) & (F.col("_v") == version) & (F.col("n") == len(PLACEMENTS))
    found = eligible(experiences).select("group_key").join(fingerprints, "group_key").join(have, "group_key", "left")
    return found.select("group_key", "fingerprint", F.when(same, "unchanged").otherwise("regenerate").alias("action"))


def set_violations(rows: DataFrame, links: DataFrame, evidence: DataFrame) -> DataFrame:
    """(group_key, rule) of sets that may not be stored; no rows if all may.

    rows: group_key, placement, rank, score, target_type, content. links: group_key, placement, occurrence_id. Rules: `types`
    (each placement once, no other), `ranks` (1 to 5, each once), `fields` (none null), `evidence` (what a proposal rests
    on is its experience's evidence), `orphan` (a link of no proposal).
    """
    # Dealt by set first, and told apart by bits: one small buffer a set, in the task that has the whole set. Distinct
    # counts of two columns would keep each row several times, and that in the few tasks that read a small file.
    place = F.lit(None).cast("long")
    for i, p in enumerate(PLACEMENTS):
        place = F.when(F.col("placement") == p, F.lit(1 << i).cast("long")).otherwise(place)
    rank = F.col("rank")
    low = (rank >= 1) & (rank <= 62) & (rank == F.floor(rank))
    ranks = F.bit_count(F.coalesce(F.bit_or(F.when(low, F.call_function("shiftleft", F.lit(1).cast("long"), rank.cast("int")))), F.lit(0).cast("long")))
    per = rows.repartition("group_key").groupBy("group_key").agg(
        ((F.count("*") == len(PLACEMENTS)) & (F.count(place) == len(PLACEMENTS)) & (F.bit_or(place) == (1 << len(PLACEMENTS)) - 1)).alias("types"),
        ((ranks + F.count_distinct(F.when(~low, rank)) == F.count("*")) & (F.min("rank") == 1) & (F.max("rank") == F.count("*"))).alias("ranks"),
        F.bool_and(F.col("placement").isNotNull() & F.col("rank").isNotNull() & F.col("score").isNotNull() & F.col("target_type").isNotNull() & F.col("content").isNotNull()).alias("fields"),
    )
    failed = F.filter(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(rule)) for rule in ("types", "ranks", "fields"))), lambda x: x.isNotNull())
    out = per.select("group_key", F.explode(failed).alias("rule"))
    foreign = links.join(evidence.select("group_key", "occurrence_id"), ["group_key", "occurrence_id"], "left_anti").select("group_key", F.lit("evidence").alias("rule"))
    orphan = links.join(rows.select("group_key", "placement"), ["group_key", "placement"], "left_anti").select("group_key", F.lit("orphan").alias("rule"))
    return out.unionByName(foreign).unionByName(orphan).distinct()


def generated(experiences: DataFrame, evidence: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(proposals, links) of the given experiences: five ranked rows each with content and notes, resting on all their evidence."""
    shaped = experiences.select("group_key", "pattern", F.struct(F.col("confidence").alias("score"), "recency").alias("confidence"))
    found = snapshot(features(evidence, shaped, events), "features")
    rows = proposals(found).join(experiences.select("group_key", public_content(F.col("lesson"), F.lit(""), F.col("title")).alias("content")), "group_key")
    notes = diagnostics(rows.select("group_key", "placement").join(found, "group_key")).groupBy("group_key", "placement")
    notes = notes.agg(F.array_sort(F.collect_list(F.struct("code", "polarity", "message", "value"))).alias("diagnostics"))
    rows = rows.join(notes, ["group_key", "placement"], "left")
    links = evidence.select("group_key", "occurrence_id", F.col("classification").alias("role")).distinct()
    return rows, links.withColumn("placement", F.explode(F.array(*(F.lit(p) for p in PLACEMENTS))))


@dataclass(frozen=True)
class Generation:
    """What a pass did; `rejected` sets broke a rule and kept what they had."""

    version: str
    eligible: int
    regenerated: int
    unchanged: int
    rejected: int


def generation_pass(store: Pass, version: str, make=generated) -> tuple[Generation, DataFrame | None]:
    """Brings the store's proposals up to date; (figures, violations of rejected sets).

    The base version has experiences, evidence and events (columns as the KEYS name them, with group_key and trajectory_id)
    and, from the second pass on, proposal_sets, proposals, proposal_evidence and placement_runs. These four are put as
    one with the rest of the pass; if nothing is to be made anew, nothing is put.
    """
    base = store.base
    x, ev, events = base["experiences"], base["evidence"], base["events"]
    prints = source_fingerprints(x, ev, version, list(EXPERIENCE_KEYS), list(EVIDENCE_KEYS), events, EVENT_KEYS)
    first = "proposal_sets" not in base.tables
    spark = x.sparkSession
    sets = spark.createDataFrame([], prints.schema.add("version", "string")) if first else base["proposal_sets"]
    made = spark.createDataFrame([], prints.schema.add("placement", "string")) if first else base["proposals"]
    plan = snapshot(planned(x, prints, sets, made, version), "plan")
    counts = {r["action"]: r["n"] for r in plan.groupBy("action").agg(F.count("*").alias("n")).collect()}  # two rows
    todo = plan.where("action = 'regenerate'")
    if not counts.get("regenerate"):
        return Generation(version, counts.get("unchanged", 0), 0, counts.get("unchanged", 0), 0), None
    only = lambda df: df.join(todo.select("group_key"), "group_key", "left_semi")
    own = snapshot(only(ev), "evidence")
    mine = events.join(own.select("trajectory_id").distinct(), "trajectory_id", "left_semi")
    rows, links = (snapshot(df, n) for df, n in zip(make(only(x), own, mine), ("proposals", "links")))
    bad = snapshot(set_violations(rows, links, own), "violations")
    n_bad = bad.select("group_key").distinct().count()
    good = lambda df: df.join(bad.select("group_key").distinct(), "group_key", "left_anti")
    new = {"proposal_sets": good(todo.select("group_key", "fingerprint", F.lit(version).alias("version"))), "proposals": good(rows), "proposal_evidence": good(links)}
    for name, df in new.items():
        store.put(name, df if first else replaced(base[name], df, ["group_key"]))
    figures = Generation(version, sum(counts.values()), counts["regenerate"] - n_bad, counts.get("unchanged", 0), n_bad)
    run = spark.createDataFrame([tuple(asdict(figures).values())], "version string, eligible long, regenerated long, unchanged long, rejected long")
    store.put("placement_runs", run if "placement_runs" not in base.tables else base["placement_runs"].unionByName(run))
    return figures, bad
