"""The driver's tables as sessions: users are trajectories, their events in time order the steps.

What an event does follows from its type and the number k in its props, so that the same mapping can be written in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillspan.session import table

FAMILIES = ("test", "lint", "build")
PATHS = (
    "src/models/user.py", "db/migrations/0002_add.py", "db/queries/report.sql", "node_modules/pkg/index.js", "tests/test_user.py", "docs/guide.md",
    "pyproject.toml", "src/api/routes.ts",
)
CONTEXTS = ("model", "migration", "database", "backend", "tests", "docs", "config", "backend")
COMMANDS = ("alembic upgrade head", "cd app && pytest -q", "git status", "mypy src")
ERRORS = (
    "AssertionError: expected 3 but got 4", "ModuleNotFoundError: No module named 'foo'", "test exit 1", "TypeError: x is not a function at line 30", "2 failed",
)
NOTES = ("please use the migration instead of editing", "ok thanks", "why does this keep happening all over?")


def _pick(values: tuple[str, ...], k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(k, F.lit(len(values))) + 1).cast("int"))


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.col("k")
    of = F.col("event_type")
    base = e.select(
        F.col("user_id").alias("trajectory_id"), F.pmod("user_id", F.lit(4)).alias("project_id"),
        F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("sequence"), "ts", "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    note = (of == "view") & (k % 6 == 5)
    kind = (
        F.when((of == "error") & (k % 4 == 3), "error").when(of == "error", F.concat(_pick(FAMILIES, k), F.lit("_fail"))).when(of == "purchase", F.concat(_pick(FAMILIES, k), F.lit("_pass")))
        .when(of == "click", "file_edit").when(of == "signup", "file_create").when(note, "human_correction").otherwise("command")
    )
    return base.select(
        "trajectory_id", "project_id", "sequence", "ts", "value", "k", kind.alias("type"),
        F.when(of.isin("click", "signup"), _pick(PATHS, k)).alias("path"),
        F.when((of == "view") & ~note, _pick(COMMANDS, k)).alias("command"),
        F.when((of == "view") & ~note, k % 2).alias("exit_code"),
        F.when(of == "error", _pick(ERRORS, k)).when(note, _pick(NOTES, F.floor(k / 6))).alias("summary"),
    )


def _case(values: tuple[str, ...], k: str = "k") -> str:
    quoted = [v.replace("'", "''") for v in values]
    return f"CASE {k} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(quoted)) + " END"


#: The same in SQL: common table expressions ending in t.
EVENTS_SQL = f"""
WITH e AS (SELECT user_id AS trajectory_id, user_id % 4 AS project_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, ts,
  event_type AS et, value, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k FROM events),
t AS (SELECT trajectory_id, project_id, sequence, ts, value, k,
  CASE WHEN et = 'error' AND k % 4 = 3 THEN 'error' WHEN et = 'error' THEN {_case(FAMILIES)} || '_fail' WHEN et = 'purchase' THEN {_case(FAMILIES)} || '_pass'
    WHEN et = 'click' THEN 'file_edit' WHEN et = 'signup' THEN 'file_create' WHEN k % 6 = 5 THEN 'human_correction' ELSE 'command' END AS type,
  CASE WHEN et IN ('error', 'purchase') THEN {_case(FAMILIES)} END AS fam,
  CASE WHEN et IN ('click', 'signup') THEN {_case(PATHS)} END AS path,
  CASE WHEN et IN ('click', 'signup') AND k % 8 <> 3 THEN {_case(CONTEXTS)} END AS ctx,
  CASE WHEN et = 'view' AND k % 6 <> 5 THEN {_case(COMMANDS)} END AS command,
  CASE WHEN et = 'view' AND k % 6 <> 5 THEN k % 2 END AS exit_code,
  (et = 'view' AND k % 6 <> 5 AND k % 4 = 0) AS migration,
  CASE WHEN et = 'error' THEN {_case(ERRORS)} WHEN et = 'view' AND k % 6 = 5 THEN {_case(NOTES, "(k // 6)")} END AS summary FROM e)
"""
