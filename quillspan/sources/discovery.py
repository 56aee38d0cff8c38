"""Which sessions lie below a folder: file facts and a look at each file's first lines, as one table in order of the path.

The look reads each file's first lines and no others: only lines up to a fixed number count, which is the rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillspan.sources import session_lines

# File patterns of the layouts, and how many lines a look takes.
GLOBS = {"rollout": ("rollout-*.jsonl",), "messages": ("*.jsonl",)}
LOOK = {"rollout": 50, "messages": 61}
ID_IN_NAME = r"rollout-.*?-([0-9a-fA-F-]{36})\.jsonl$"
SUBAGENT = r"/subagents/[^/]+$"


def stem(file: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(file, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def id_from_name(file: Column) -> Column:
    """The UUID in a rollout's name, else its stem."""
    return F.coalesce(F.nullif(F.regexp_extract(file, ID_IN_NAME, 1), F.lit("")), stem(file))


def peeked(lines: DataFrame, layout: str) -> DataFrame:
    """(file, session_id, cwd, git_branch, git_remote) from lines (file, line, value).

    rollout: the first object, if it is a session's meta record. messages: the first value of each, up to the line by
    which folder and id are both known. Blank lines don't count, broken ones do but say nothing.
    """
    nth = F.row_number().over(W.partitionBy("file").orderBy("line"))
    near = lines.where(F.rlike("value", F.lit(r"\S"))).withColumn("nth", nth).where(F.col("nth") <= LOOK[layout])
    at = lambda path: F.nullif(F.try_variant_get("v", f"$.{path}", "string"), F.lit(""))
    v = near.withColumn("v", F.try_parse_json("value")).where(F.startswith(F.ltrim("value"), F.lit("{")) & F.col("v").isNotNull())
    if layout == "rollout":
        first = v.withColumn("own", F.row_number().over(W.partitionBy("file").orderBy("nth"))).where("own = 1")
        meta = first.where(at("type") == "session_meta")
        return meta.select(
            "file", F.coalesce(at("payload.session_id"), at("payload.id")).alias("session_id"), at("payload.cwd").alias("cwd"),
            at("payload.git.branch").alias("git_branch"), at("payload.git.repository_url").alias("git_remote"),
        )
    seen = v.select("file", "nth", F.coalesce(at("sessionId"), at("session_id")).alias("session_id"), at("cwd").alias("cwd"), at("gitBranch").alias("git_branch"))
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.col("nth"))).over(W.partitionBy("file"))
    # greatest() skips nulls, and both must be known for the look to end.
    known = F.when(first("session_id").isNotNull() & first("cwd").isNotNull(), F.greatest(first("session_id"), first("cwd")))
    seen = seen.withColumn("known", known).where(F.col("known").isNull() | (F.col("nth") <= F.col("known")))
    value = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("nth"))).alias(c)
    return seen.groupBy("file").agg(*map(value, ("session_id", "cwd", "git_branch"))).withColumn("git_remote", F.lit(None).cast("string"))


def named(files: DataFrame, looks: DataFrame, layout: str) -> DataFrame:
    """files (file and further columns) with what a look found and source_session_id.

    A rollout without an id has its name's. A sub-agent's file names the session above it, so it goes by its own name.
    """
    found = files.join(looks, "file", "left")
    if layout == "rollout":
        own = F.coalesce("session_id", id_from_name(F.col("file")))
    else:
        own = F.when(F.rlike("file", F.lit(SUBAGENT)), stem(F.col("file"))).otherwise(F.coalesce("session_id", stem(F.col("file"))))
    return found.withColumn("source_session_id", own).drop("session_id")


def discovered(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """(file, mtime, size_bytes, cwd, git_branch, git_remote, source_session_id) of the sessions below path, in order of the path.

    messages: sessions lie one folder deep, those of sub-agents in <folder>/<session>/subagents. Of each file only the
    lines of its look are read. A file without a byte is listed, under its name.
    """
    (glob,) = GLOBS[layout]
    files = session_lines.read(spark, path, "listing", glob=glob).select("file", F.col("modified").alias("mtime"), "size_bytes")
    lines = session_lines.read(spark, path, glob=glob, first=LOOK[layout]).select("file", F.col("nth").alias("line"), "value")
    if layout == "messages":
        root = path.rstrip("/").removeprefix("file://") + "/"
        below = lambda c: F.substring_index(F.col(c), root, -1)
        shape = r"^[^/]+/[^/]+\.jsonl$|^[^/]+/[^/]+/subagents/[^/]+\.jsonl$"
        files, lines = (x.where(F.rlike(below("file"), F.lit(shape))) for x in (files, lines))
    return named(files, peeked(lines, layout), layout).orderBy("file")
