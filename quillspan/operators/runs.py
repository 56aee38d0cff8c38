"""The extraction run: detection over what has changed, groups over all, one version and one record of what was done.

The store has trajectories (trajectory_id, project_id, content_hash, last_activity) and events. A run puts occurrences and
profiles (rows of changed trajectories replaced), extraction_state, clusters, evidence, experiences and a row of
experience_runs, as one version. Figures are observed by the writes themselves, so no table is read again to be counted.
"""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass, fields
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quillspan.functions.text import short_id
from quillspan.operators.cascade import cleared_for_rebuild
from quillspan.operators.experiences import contradictions, experiences, summaries
from quillspan.operators.imports import extraction_changes, numbered_groups
from quillspan.operators.sequences import final_status, occurrences, profiles
from quillspan.tables import snapshot
from quillspan.versions import Pass


@dataclass(frozen=True)
class Config:
    """Limits of a run, all 1 or more; checked when it is made and never changed."""

    min_occurrences: int = 3
    min_projects: int = 1
    max_event_gap: int = 20
    correction_min_words: int = 3

    def __post_init__(self):
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(value, bool) or not isinstance(value, int) or value < 1:
                raise ValueError(f"{f.name} must be a whole number of 1 or more, not {value!r}")


@dataclass(frozen=True)
class Run:
    """What a run did."""

    rebuild: bool
    project: str | None
    trajectories_considered: int
    trajectories_analyzed: int
    occurrences_found: int
    clusters_formed: int
    candidates: int
    needs_more_evidence: int
    seconds: float


RUNS = "started_at string, rebuild boolean, project string, trajectories_considered long, trajectories_analyzed long, occurrences_found long, clusters_formed long, candidates long, needs_more_evidence long, seconds double"


def dedupe_key() -> Column:
    """An occurrence's identity as one text."""
    return F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("trajectory_id", "pattern", "classification", "group_key", "start_sequence", "end_sequence")))


def top_candidates(found: DataFrame, n: int = 10) -> DataFrame:
    """The n best candidates of experiences: by score, then by key."""
    return found.where("status = 'candidate'").orderBy(F.desc("confidence"), "group_key").limit(n)


def group_sizes(found: DataFrame) -> DataFrame:
    """(group_key, n) of occurrences, the largest first."""
    return found.groupBy("group_key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "group_key")


def _counted(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    watch = Observation(name)
    return df.observe(watch, *(c.alias(n) for n, c in counts.items())), watch


def _with_id(found: DataFrame) -> DataFrame:
    return found.withColumn("occurrence_id", short_id("OCC-", F.col("trajectory_id"), F.col("group_key"), F.col("classification"), length=16))


def extraction_run(store: Pass, config: Config = Config(), now: datetime | None = None, project=None, rebuild: bool = False) -> Run:
    """One run over the store's base version.

    Trajectories whose content is as it was at their last run are not detected again; a rebuild detects all, after
    clearing what is rebuilt. With `project` only its trajectories are considered, and all others keep what they have.
    Experiences are grouped over everything that is there; their numbers and people's marks stay with their group.
    """
    began, base = time.monotonic(), store.base
    started = datetime.now(UTC) if now is None else now
    stamp = F.lit(started.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    have = set() if rebuild else set(base.tables)
    if rebuild:
        cleared_for_rebuild(store)
    every = base["trajectories"].select("trajectory_id", "content_hash", "project_id", "last_activity")
    considered = every if project is None else every.where(F.col("project_id") == F.lit(project))
    hashes = considered.select("trajectory_id", "content_hash")
    state = base["extraction_state"] if "extraction_state" in have else hashes.limit(0)
    changed = snapshot(extraction_changes(hashes, state), "changed")
    mine = snapshot(base["events"].join(changed.select("trajectory_id"), "trajectory_id", "left_semi"), "changed-events")

    def fresh(name: str, new: DataFrame) -> DataFrame:
        """The table with the rows of changed trajectories replaced; they may have none any more."""
        if name not in have:
            return new
        return base[name].join(changed.select("trajectory_id"), "trajectory_id", "left_anti").select(*new.columns).unionByName(new)

    found = _with_id(occurrences(mine, final_status(mine), config.max_event_gap, config.correction_min_words).drop("detector"))
    store.put("occurrences", fresh("occurrences", found))
    sides = profiles(mine).join(considered.select("trajectory_id", "last_activity"), "trajectory_id")
    store.put("profiles", fresh("profiles", sides))
    done, analyzed = _counted(changed, "analyzed", n=F.count(F.lit(1)))
    store.put("extraction_state", fresh("extraction_state", done))

    occ, sides = store.written("occurrences"), store.written("profiles")
    positive = occ.where(F.col("classification").isin("support", "ambiguous"))
    clusters, formed = _counted(positive.groupBy("group_key").agg(F.count("*").alias("n")), "clusters", n=F.count(F.lit(1)), rows=F.coalesce(F.sum("n"), F.lit(0)))
    store.put("clusters", clusters)
    against = contradictions(occ, sides, config.min_occurrences)
    against, opposed = _counted(_with_id(against.withColumn("repair_context", F.col("context")).drop("family", "context")), "against", n=F.count(F.lit(1)))
    groups = summaries(experiences(occ, sides, stamp, config.min_occurrences, config.min_projects))
    known = base["experiences"] if "experiences" in base.tables else base.spark.createDataFrame([], "group_key string, number int, review_status string")
    flat = groups.withColumn("recency", F.col("confidence.recency")).withColumn("confidence", F.col("confidence.score"))
    numbered, kept = _counted(numbered_groups(snapshot(flat, "groups"), known), "experiences", candidates=F.count_if(F.col("status") == "candidate"), more=F.count_if(F.col("status") == "needs_more_evidence"))
    if "review_note" in known.columns:
        numbered = numbered.join(known.select("group_key", "review_note"), "group_key", "left")
    store.put("experiences", numbered)
    links = occ.unionByName(against, allowMissingColumns=True)
    store.put("evidence", links.join(store.written("experiences").select("group_key"), "group_key", "left_semi"))
    total = considered.count()
    run = Run(rebuild, None if project is None else str(project), total, analyzed.get["n"], formed.get["rows"] + opposed.get["n"], formed.get["n"], kept.get["candidates"], kept.get["more"], round(time.monotonic() - began, 3))
    row = base.spark.createDataFrame([(started.isoformat(), *asdict(run).values())], RUNS)
    store.put("experience_runs", row if "experience_runs" not in base.tables else base["experience_runs"].unionByName(row))
    return run
