"""Read views: filters, pages, details and histories over the library's tables. Each returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 200


def filtered(df: DataFrame, **equal) -> DataFrame:
    """Rows that agree with every argument that isn't None or empty."""
    for name, value in equal.items():
        if value not in (None, ""):
            df = df.where(F.col(name) == F.lit(value))
    return df


def searched(df: DataFrame, text: str | None, *columns: str) -> DataFrame:
    """Rows with text, whatever its case, in one of the columns; % and _ are wildcards."""
    text = (text or "").strip()
    if not text:
        return df
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).cast("string").ilike(f"%{text}%"), F.lit(False))
    return df.where(hit)


def page(df: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """A page in a total order; limit is held within 1 and MOST, offset at 0 or more."""
    return df.orderBy(*order).offset(max(0, int(offset))).limit(max(1, min(MOST, int(limit))))


def projects_overview(projects: DataFrame, headers: DataFrame) -> DataFrame:
    """projects with their number of sessions, by agent too, and the last start; projects without any stay. Names sort without case."""
    by = headers.groupBy("project_id").agg(F.count("*").alias("sessions"), F.count_distinct("agent").alias("agents"), F.max("started_at").alias("last_started_at"))
    return projects.join(by, "project_id", "left").fillna(0, ["sessions", "agents"]).orderBy(F.lower("name"), "project_id")


def session_list(headers: DataFrame, projects: DataFrame, project_id=None, agent=None, status=None, text=None) -> DataFrame:
    """headers with the project's name and is_subagent, filtered; text is looked for in the task and the id."""
    found = searched(filtered(headers, project_id=project_id, agent=agent, final_status=status), text, "task", "trajectory_id")
    found = found.withColumn("is_subagent", F.coalesce(F.col("trajectory_id").ilike("%/subagents/%"), F.lit(False)))
    return found.join(projects.select("project_id", F.col("name").alias("project_name")), "project_id", "left")


#: Columns that views don't show: absolute paths, and raw JSON beside its decoded fields.
PRIVATE = ("source_path", "confidence_json", "context_json", "metadata_json")


def shown(rows: DataFrame, *more: str) -> DataFrame:
    """rows without the columns of PRIVATE and those named, whichever it has."""
    return rows.drop(*PRIVATE, *more)


def trajectory_detail(events: DataFrame, trajectory_id) -> DataFrame:
    """A session's events in order, with flags for errors and commands."""
    e = events.where(F.col("trajectory_id") == F.lit(trajectory_id))
    bad = F.col("type").isin("test_fail", "lint_fail", "build_fail", "error") | ((F.col("type") == "command") & (F.coalesce("exit_code", F.lit(0)) != 0))
    return e.withColumns({"is_error": bad, "is_command": F.col("type") == "command"}).orderBy("sequence")


ORDERS = {"confidence": ("score", "occurrence_count"), "recent": ("last_seen",), "occurrences": ("occurrence_count", "score")}


def experience_list(groups: DataFrame, order: str = "confidence", **equal) -> DataFrame:
    """Groups in one of three orders; an unknown name is by confidence."""
    flat = groups.withColumn("score", F.col("confidence.score"))
    return filtered(flat, **equal).orderBy(*[F.desc_nulls_last(c) for c in ORDERS.get(order, ORDERS["confidence"])], "group_key")


def evidence_list(evidence: DataFrame, headers: DataFrame, group_key: str) -> DataFrame:
    """A group's evidence: support first, then ambiguous, then contradictions, with the sessions' tasks."""
    place = F.when(F.col("classification") == "support", 0).when(F.col("classification") == "ambiguous", 1).otherwise(2)
    found = evidence.where(F.col("group_key") == F.lit(group_key)).join(headers.select("trajectory_id", "task", "final_status"), "trajectory_id", "left")
    return found.withColumn("place", place).orderBy("place", "trajectory_id", "start_sequence")


def placement_list(proposals: DataFrame, placement: str | None = None, recommended: str | None = None) -> DataFrame:
    """Each group's first proposal; `recommended` filters by it, `placement` by whether the group has that alternative at all."""
    best = filtered(proposals.where("rank = 1"), placement=recommended)
    if placement:
        best = best.join(proposals.where(F.col("placement") == F.lit(placement)).select("group_key"), "group_key", "left_semi")
    return best.orderBy(F.desc("score"), "group_key")


def placement_counts(sets: DataFrame, proposals: DataFrame) -> DataFrame:
    """One row (proposal_sets, proposals)."""
    return sets.agg(F.count("*").alias("proposal_sets")).crossJoin(proposals.agg(F.count("*").alias("proposals")))


def proposal_context(proposals: DataFrame, experiences: DataFrame, evidence: DataFrame, projects: DataFrame) -> DataFrame:
    """proposals with their experience's title and pattern, and the greatest root of the projects in its evidence (null if none)."""
    roots = evidence.join(projects.select("project_id", "root"), "project_id").groupBy("group_key").agg(F.max("root").alias("project_root"))
    return proposals.join(experiences.select("group_key", "title", "pattern"), "group_key").join(roots, "group_key", "left")


def proposal_evidence(proposal_evidence: DataFrame, occurrences: DataFrame, projects: DataFrame) -> DataFrame:
    """(proposal_id, role, occurrence columns, project_name, root) in order of session and occurrence."""
    found = proposal_evidence.join(occurrences, "occurrence_id").join(projects.select("project_id", F.col("name").alias("project_name"), "root"), "project_id", "left")
    return found.orderBy("proposal_id", "trajectory_id", "occurrence_id")


def policy_lineage(lineage: DataFrame, versions: DataFrame) -> DataFrame:
    """(policy_id, lineage columns): each edge from or to a version of a policy, once a policy."""
    ends = lineage.select("*", F.explode(F.array_distinct(F.array("from_version", "to_version"))).alias("version_id"))
    return ends.join(versions.select("version_id", "policy_id"), "version_id").select("policy_id", *lineage.columns).dropDuplicates(["policy_id", "lineage_id"])


def split_children(lineage: DataFrame, versions: DataFrame, version_id) -> DataFrame:
    """Versions that a split made of one."""
    edges = lineage.where((F.col("relation") == "split_from") & (F.col("from_version") == F.lit(version_id)))
    return versions.join(edges.select(F.col("to_version").alias("version_id")).distinct(), "version_id")


def inspection_sample(groups: DataFrame, seed: int = 0, top: int = 20, middle: int = 10, low: int = 10) -> DataFrame:
    """The best groups, some by seeded chance and the weakest, with `part`; a group may be in several."""
    take = lambda order, n, part: groups.orderBy(*order, "group_key").limit(n).withColumn("part", F.lit(part))
    chance = take([F.xxhash64("group_key", F.lit(seed))], middle, "random")
    return take([F.desc("score")], top, "top").unionByName(chance).unionByName(take([F.asc("score")], low, "lowest"))


def review_list(sets: DataFrame, states: DataFrame, status: str | None = None) -> DataFrame:
    """Proposal sets with the state of their review; without one they are unreviewed, with outdated sources stale."""
    out = sets.join(states, "review_id", "left")
    computed = F.when(F.coalesce("stale", F.lit(False)), "stale").otherwise(F.coalesce("status", F.lit("unreviewed")))
    return filtered(out.withColumn("status", computed), status=status)


def evaluation_history(specs: DataFrame, runs: DataFrame, comparisons: DataFrame) -> DataFrame:
    """specs with their runs and comparisons as arrays of structs in order of repetition."""
    r = runs.groupBy("evaluation_id").agg(F.array_sort(F.collect_list(F.struct("repetition", "condition", "status", "duration_ms"))).alias("runs"))
    c = comparisons.groupBy("evaluation_id").agg(F.array_sort(F.collect_list(F.struct("repetition", "outcome", "regression_count"))).alias("comparisons"))
    return specs.join(r, "evaluation_id", "left").join(c, "evaluation_id", "left")


def run_order(pairs: DataFrame, mode: str = "alternate") -> DataFrame:
    """pairs (evaluation_id, repetition) with the condition that runs first: baseline, candidate, or by turns."""
    first = F.when(F.col("repetition") % 2 == 1, "baseline").otherwise("candidate") if mode == "alternate" else F.lit("candidate" if mode == "candidate_first" else "baseline")
    return pairs.withColumn("first_condition", first)
