"""Import passes: which source files are parsed again, and how their rows replace those of the pass before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.paths import normalized
from quillspan.sources.transcripts import file_touches, session_table, steps, transcript_lines


def routed(sources: DataFrame, projects: DataFrame, path_col: str = "cwd") -> DataFrame:
    """sources with project_id and root of the project whose root is the nearest folder at or above path_col, else null.

    A path is exploded into the folders above it, so that the match is an equi-join whatever the number of projects.
    """
    p = normalized(F.col(path_col))
    parts = F.split(p, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    found = sources.select(path_col).where(F.col(path_col).isNotNull()).distinct().withColumn("root", F.explode(above)).where("root <> ''")
    best = found.join(projects.select("project_id", "root"), "root").groupBy(path_col).agg(F.max_by(F.struct("project_id", "root"), F.length("root")).alias("_p"))
    return sources.join(best, path_col, "left").select(*sources.columns, F.col("_p.project_id").alias("project_id"), F.col("_p.root").alias("root"))


def admitted(sources: DataFrame, known: DataFrame, projects: DataFrame, only_project=None) -> DataFrame:
    """sources (agent, session_id, path, content_hash, cwd) with project_id, root and outcome.

    already: imported with this content; ignored_unregistered: no project; skipped_filtered: another project than
    only_project; new and changed are to be parsed. known has the keys, content_hash and status of earlier passes.
    """
    keys = ["agent", "session_id", "path"]
    before = known.select(*keys, F.col("content_hash").alias("_h"), F.col("status").alias("_s"))
    out = routed(sources, projects).join(before, keys, "left")
    same = F.coalesce((F.col("_s") == "imported") & (F.col("_h") == F.col("content_hash")), F.lit(False))
    other = F.lit(False) if only_project is None else F.col("project_id") != F.lit(only_project)
    outcome = (
        F.when(same, "already").when(F.col("project_id").isNull(), "ignored_unregistered").when(other, "skipped_filtered")
        .when(F.col("_h").isNotNull() & (F.col("_h") != F.col("content_hash")), "changed").otherwise("new")
    )
    return out.withColumn("outcome", outcome).drop("_h", "_s")


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the rows of any key in new, and new: a source's rows are replaced as a whole."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*new.columns).unionByName(new)


def known_after(known: DataFrame, decisions: DataFrame) -> DataFrame:
    """The ledger of sources after a pass; skipped sources leave no row."""
    status = F.when(F.col("outcome").isin("new", "changed", "already"), "imported").otherwise("ignored_unregistered")
    now = decisions.where("outcome <> 'skipped_filtered'").select("agent", "session_id", "path", "content_hash", status.alias("status"))
    return replaced(known.select(*now.columns), now, ["agent", "session_id", "path"])


def parsed(spark: SparkSession, path: str, layout: str, files: DataFrame | None = None, root: str | None = None, glob: str = "*.jsonl") -> dict[str, DataFrame]:
    """events, headers and touches of the transcripts below path, or of those in files (a column file)."""
    lines = transcript_lines(spark, path, glob)
    if files is not None:
        lines = lines.join(files.select("file").distinct(), "file", "left_semi")
    events, headers = session_table(steps(lines, layout), root)
    return {"events": events, "headers": headers, "touches": file_touches(events)}


def extraction_changes(trajectories: DataFrame, state: DataFrame) -> DataFrame:
    """Trajectories (trajectory_id, content_hash) that were never analysed or have changed since; state has the same columns."""
    seen = state.select("trajectory_id", F.col("content_hash").alias("_h"))
    return trajectories.join(seen, "trajectory_id", "left").where(~F.col("_h").eqNullSafe(F.col("content_hash"))).select(*trajectories.columns)


def numbered_groups(groups: DataFrame, before: DataFrame, key: str = "group_key") -> DataFrame:
    """groups with number: that of the snapshot before (key, number, review_status), new ones behind its highest, in order of the key.

    Review marks stay with their group. Only the new groups, few in each pass, are numbered in one order.
    """
    from quillspan.operators.ledger import next_numbers

    old = groups.join(before.select(key, "number", "review_status"), key, "left")
    top = before.agg(F.coalesce(F.max("number"), F.lit(0)).alias("top")).first()["top"]
    new = next_numbers(old.where("number is null").drop("number"), top, [F.col(key)], "number")
    return old.where("number is not null").unionByName(new.select(*old.columns))
