"""Queries of transcripts, times, placement marks and lineage views over the driver's tables, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import times
from quillspan.operators import placement as P
from quillspan.operators import views as V
from quillspan.plans.mapping import COMMANDS, EVENTS_SQL, _case, _pick, session_events
from quillspan.session import table
from quillspan.sources import discovery as D
from quillspan.sources import transcripts as T

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


# Users' events as lines of a rollout: edits and new files are file changes, all others commands, a user_id is a file.


def _rollout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = session_events(spark, sf_dir)
    change = F.col("path").isNotNull()
    ran = F.struct(
        F.lit("CommandExecution").alias("type"), F.array(F.lit("/bin/bash"), F.lit("-lc"), _pick(COMMANDS, F.col("k"))).alias("command"), F.pmod("k", F.lit(3)).alias("exit_code"),
        F.array().cast("array<struct<type:string,path:string>>").alias("parsed_cmd"),
    )
    spec = F.struct(F.when(F.col("type") == "file_create", "add").otherwise("update").alias("type"), F.lit("-a\n+b\n+c\n").alias("unified_diff"))
    made = F.struct(F.lit("FileChange").alias("type"), F.create_map(F.concat(F.lit("/w/"), "path"), spec).alias("changes"))
    record = lambda item: F.to_json(F.struct(F.lit("event_msg").alias("type"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), F.struct(F.lit("item_completed").alias("type"), item.alias("item")).alias("payload")))
    return e.select(F.col("trajectory_id").cast("string").alias("file"), F.col("sequence").alias("line"), F.when(change, record(made)).otherwise(record(ran)).alias("value"))


_LINES_SQL = f"""{EVENTS_SQL}, l AS (SELECT CAST(trajectory_id AS VARCHAR) AS trajectory_id, sequence, path, CASE WHEN path IS NULL THEN 'command' ELSE type END AS type,
  CASE WHEN path IS NULL THEN {_case(COMMANDS)} END AS command, CASE WHEN path IS NULL THEN k % 3 END AS code FROM t),
x AS (SELECT trajectory_id, sequence, 0 AS echo, type, path, command, code FROM l UNION ALL
  SELECT trajectory_id, sequence, 1, CASE WHEN command LIKE '%pytest%' THEN 'test' ELSE 'lint' END || CASE code WHEN 0 THEN '_pass' ELSE '_fail' END, NULL, NULL, NULL FROM l WHERE command LIKE '%pytest%' OR command LIKE 'mypy%')"""


@query(f"{_LINES_SQL} SELECT trajectory_id, row_number() OVER (PARTITION BY trajectory_id ORDER BY sequence, echo) AS sequence, type, path, command, code AS exit_code FROM x")
def rollout_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of JSON read into events: commands with their outcomes, file changes, paths below the root."""
    events, _ = T.session_table(T.steps(_rollout_lines(spark, sf_dir), "rollout"), "/w")
    return events.select("trajectory_id", "sequence", "type", "path", "command", "exit_code")


@query(f"{_LINES_SQL} SELECT DISTINCT trajectory_id, path FROM x WHERE path IS NOT NULL")
def files_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, _ = T.session_table(T.steps(_rollout_lines(spark, sf_dir), "rollout"), "/w")
    return T.files_changed(T.file_touches(events))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00' WHEN 1 THEN strftime(o_orderdate - INTERVAL 90 MINUTE, '%Y-%m-%dT%H:%M:%S') || '.250000+00:00'
WHEN 2 THEN strftime(TIMESTAMP '1970-01-01' + to_seconds(o_orderkey), '%Y-%m-%dT%H:%M:%S') || '+00:00' WHEN 3 THEN strftime(TIMESTAMP '1970-01-01' + to_seconds(200000000 + o_orderkey), '%Y-%m-%dT%H:%M:%S') || '+00:00'
WHEN 4 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00+00:00' END AS stamp FROM orders"""
)
def timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of six forms: Z, an offset, seconds, milliseconds, a date and no time at all."""
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    forms = (
        F.concat(day, F.lit("Z")), F.concat(day, F.lit(".25+01:30")), key.cast("string"), ((key + 200_000_000) * 1000).cast("string"),
        F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("soon"),
    )
    text = forms[5]
    for k, form in enumerate(forms[:5]):
        text = F.when(key % 6 == k, form).otherwise(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", times.iso_instant(text).alias("stamp"))


@query("SELECT event_id, CASE WHEN event_id % 3 <> 2 THEN CAST((event_id % 7) * 60 + 0.25 AS DOUBLE) END AS seconds FROM events")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    start = F.lit("2024-03-01T10:00:00+02:00")
    end = F.when(n % 3 == 2, F.lit("2024-03-01T07:59:59Z")).otherwise(F.concat(F.lit("2024-03-01T08:0"), (n % 7).cast("string"), F.lit(":00.250Z")))
    return table(spark, sf_dir, "events").select("event_id", times.seconds_between(start, end).alias("seconds"))


@query(
    """SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'id-' || s_suppkey WHEN 1 THEN 'rollout-' || s_suppkey WHEN 2 THEN '0f0f0f0f-0000-4000-8000-00000000' || lpad(CAST(s_suppkey % 10000 AS VARCHAR), 4, '0')
ELSE 'rollout-' || s_suppkey END AS source_session_id, CASE s_suppkey % 4 WHEN 0 THEN s_name END AS cwd, CASE s_suppkey % 4 WHEN 0 THEN 'b' || s_nationkey END AS git_branch FROM supplier"""
)
def session_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A look at rollouts: with a meta record, without one, with the id in the name, and with the record behind another."""
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    uuid = F.concat(F.lit("-2026-0f0f0f0f-0000-4000-8000-00000000"), F.lpad((key % 10000).cast("string"), 4, "0"))
    file = F.concat(F.lit("file:///x/rollout"), F.when(key % 4 == 2, uuid).otherwise(F.concat(F.lit("-"), key.cast("string"))), F.lit(".jsonl"))
    meta = F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(F.concat(F.lit("id-"), key.cast("string")).alias("id"), F.col("s_name").alias("cwd"), F.struct(F.concat(F.lit("b"), F.col("s_nationkey").cast("string")).alias("branch")).alias("git")).alias("payload")))
    other = F.lit('{"type": "turn_context", "payload": {"cwd": "/y"}}')
    lines = F.when(key % 4 == 0, F.array(F.lit(""), F.lit("no json"), meta)).when(key % 4 == 3, F.array(other, meta)).otherwise(F.array(other))
    files = s.select("s_suppkey", file.alias("file"))
    looks = D.peeked(s.select(file.alias("file"), F.posexplode(lines).alias("line", "value")), "rollout")
    return D.named(files, looks, "rollout").select("s_suppkey", "source_session_id", "cwd", "git_branch")


# Parts as experiences: the size gives the counts, the key the marks.

_PLACES = ("global_rule", "project_rule", "scoped_rule", "skill", "ignore")


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, key = F.col("p_size").cast("long"), F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("group_key"), _pick(_PLACES, key).alias("placement"), (n % 5).alias("support_count"), (n % 3).alias("contradiction_count"), (n % 2 == 0).alias("global_eligible"), (n % 7).alias("project_count"),
        F.when(n % 4 == 0, F.lit("directory")).otherwise("global").alias("scope_type"), F.when(n % 4 == 0, F.lit("src")).alias("scope_value"), (n % 6).alias("scope_support_count"), (n / 64.0).alias("scope_concentration"),
        (n / 64.0).alias("project_concentration"), (n / 64.0).alias("procedural_complexity"), (n / 64.0).alias("support_ratio"), ((64 - n) / 64.0).alias("actionability"),
    )


@query(
    f"""WITH p AS (SELECT p_partkey AS group_key, {_case(_PLACES, 'p_partkey')} AS placement, CAST(p_size AS BIGINT) AS n, p_size / 64.0 AS share, (64 - p_size) / 64.0 AS act FROM part),
d AS (SELECT group_key, placement, 'support' AS code, CASE WHEN n % 5 > 0 THEN '+' ELSE '-' END AS polarity, (n % 5) || ' supporting occurrence(s)' AS message, n % 5 AS value FROM p
UNION ALL SELECT group_key, placement, 'contradictions', '-', (n % 3) || ' contradicting occurrence(s)', n % 3 FROM p WHERE n % 3 > 0
UNION ALL SELECT group_key, placement, 'global_gate', CASE WHEN n % 2 = 0 THEN '+' ELSE '-' END, CASE WHEN n % 2 = 0 THEN 'balanced repeated support across ' || (n % 7) || ' projects' ELSE 'insufficient balanced repeated independent-project support' END, n % 7 FROM p WHERE placement = 'global_rule'
UNION ALL SELECT group_key, placement, 'specific_scope', '-', 'evidence concentrates in directory: src', NULL FROM p WHERE placement = 'global_rule' AND n % 4 = 0
UNION ALL SELECT group_key, placement, 'project_concentration', CASE WHEN share >= 0.75 THEN '+' ELSE '-' END, 'largest project supplies ' || printf('%.0f', floor(100 * share + 0.5)) || '% of support', share FROM p WHERE placement = 'project_rule'
UNION ALL SELECT group_key, placement, 'scope_alternative', '-', 'a repeated directory scope is also available', NULL FROM p WHERE placement = 'project_rule' AND n % 4 = 0
UNION ALL SELECT group_key, placement, 'scope_evidence', CASE WHEN n % 4 = 0 THEN '+' ELSE '-' END, CASE WHEN n % 4 = 0 THEN (n % 6) || ' supports concentrate in directory: src' ELSE 'no repeated evidence-backed technical scope' END, CASE WHEN n % 4 = 0 THEN share END FROM p WHERE placement = 'scoped_rule'
UNION ALL SELECT group_key, placement, 'procedure', CASE WHEN share >= 0.5 THEN '+' ELSE '-' END, CASE WHEN share >= 0.5 THEN 'repeated evidence contains multi-operation ordered workflows' ELSE 'evidence does not show repeated multi-operation workflows' END, share FROM p WHERE placement = 'skill'
UNION ALL SELECT group_key, placement, 'weak_or_mixed', '+', 'mixed or weak support raises defer preference', share FROM p WHERE placement = 'ignore' AND share < 0.75
UNION ALL SELECT group_key, placement, 'actionability', '+', 'pattern is not yet a concrete reusable instruction', act FROM p WHERE placement = 'ignore' AND act < 0.5
UNION ALL SELECT group_key, placement, 'actionability', '-', 'evidence is actionable enough for a placement alternative', act FROM p WHERE placement = 'ignore' AND share >= 0.75 AND act >= 0.5)
SELECT group_key, placement, code, polarity, message, round(CAST(value AS DOUBLE), 4) AS value FROM d"""
)
def placement_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.diagnostics(_placed(spark, sf_dir))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'candidate' ELSE 'needs_more_evidence' END AS status FROM part WHERE p_size % 3 = 0 AND p_partkey % 4 NOT IN (1, 2)")
def placement_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = _pick(("unreviewed", "false_positive", "needs_more_evidence", "useful"), F.col("p_partkey"))
    marked = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, "candidate").otherwise("needs_more_evidence").alias("status"), F.when(F.col("p_partkey") % 4 != 0, mark).alias("review_status"))
    return P.eligible(marked).select("p_partkey", "status")


@query(
    r"""SELECT page_id, regexp_replace(substr(trim(regexp_replace('see ' || regexp_replace(url, '^[a-z]+://[^/]*', '') || ' and ' || url, '(^|[^A-Za-z0-9_./-])/[^\s,;:()\[\]{}<>"'']+', '\1[repository path omitted]', 'g')), 1, 500), '\s+$', '') AS content
FROM (SELECT page_id, regexp_replace(url, '://', ' ', 'g') AS url FROM pages) p"""
)
def public_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lessons that name absolute paths; the scheme's marks are gone first, so that a host isn't one."""
    url = F.regexp_replace("url", "://", " ")
    text = F.concat(F.lit("see "), url, F.lit(" and "), url)
    return table(spark, sf_dir, "pages").select("page_id", P.public_content(F.lit(""), text, F.lit("t")).alias("content"))


@query(
    """WITH l AS (SELECT o_orderkey AS lineage_id, o_custkey AS f, o_orderkey % 100 AS t FROM orders) SELECT DISTINCT policy_id, lineage_id FROM
(SELECT f % 10 AS policy_id, lineage_id FROM l JOIN customer ON f = c_custkey UNION ALL SELECT t % 10, lineage_id FROM l JOIN customer ON t = c_custkey) x"""
)
def policy_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineage = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("lineage_id"), F.col("o_custkey").alias("from_version"), (F.col("o_orderkey") % 100).alias("to_version"))
    versions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("version_id"), (F.col("c_custkey") % 10).alias("policy_id"))
    return V.policy_lineage(lineage, versions).select("policy_id", "lineage_id")


@query(
    """SELECT p_partkey AS group_key, p_name AS title, p_brand AS pattern, project_root FROM part LEFT JOIN (SELECT l_partkey, max(s_name) AS project_root FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R' GROUP BY 1) r ON l_partkey = p_partkey"""
)
def proposal_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    experiences = part.select(F.col("p_partkey").alias("group_key"), F.col("p_name").alias("title"), F.col("p_brand").alias("pattern"))
    evidence = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("group_key"), F.col("l_suppkey").alias("project_id"))
    projects = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("project_id"), F.col("s_name").alias("root"))
    return V.proposal_context(experiences.select("group_key"), experiences, evidence, projects).select("group_key", "title", "pattern", "project_root")
