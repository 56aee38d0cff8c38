"""Queries of lifecycle requests, lineage, project routing, managed blocks and windowed activity over the driver's tables, with SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators import blocks
from quillspan.operators import imports as I
from quillspan.operators import lifecycle as L
from quillspan.plans.mapping import EVENTS_SQL, session_events
from quillspan.session import table
from quillspan.streaming.transcripts import activity

OPERATIONS = ("rewrite", "promote", "demote", "rollback", "disable", "enable", "prune", "rewrite")


def _pick(values: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def _policies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Policies are parts: two versions each, one request by the part's size."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("policy_id"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("n"))
    one = F.concat(F.col("policy_id").cast("string"), F.lit("-1"))
    two = F.concat(F.col("policy_id").cast("string"), F.lit("-2"))
    policies = p.select("policy_id", F.when(F.col("n") % 5 == 0, "disabled").otherwise("active").alias("status"), two.alias("current_version_id"))
    place = _pick(("scoped_rule", "project_rule", "global_rule"), F.col("n"))
    null = F.lit(None).cast("string")
    version = lambda vid, k, content, status: p.select(
        vid.alias("version_id"), "policy_id", F.lit(k).alias("version_number"), content.alias("content"), place.alias("placement"), F.lit("project").alias("scope_type"), F.lit("x").alias("scope_value"),
        F.lit(status).alias("status"), null.alias("review_id"), F.lit("adopt").alias("created_via"),
    )
    versions = version(one, 1, F.lit("first"), "superseded").unionByName(version(two, 2, F.col("name"), "active"))
    requests = p.select(
        "policy_id", F.lit(1).alias("seq"), _pick(OPERATIONS, F.col("policy_id")).alias("operation"), F.when(F.col("n") % 3 == 0, F.col("name")).otherwise("new text").alias("content"), null.alias("target_placement"),
        F.when(F.col("n") % 2 == 0, 1).otherwise(2).alias("target_number"), (F.col("n") % 4 == 0).alias("confirm_global"),
    )
    return policies, versions, requests


def lifecycle_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = L.decided(*_policies(spark, sf_dir))
    return d.select("policy_id", "operation", "error", "from_version", "new_version_id", "new_placement", "new_scope_type", "new_content")


def lifecycle_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    policies, versions, requests = _policies(spark, sf_dir)
    d = L.decided(policies, versions, requests)
    v = L.versions_after(versions, d).groupBy("policy_id").agg(F.count("*").alias("n_versions"), F.max_by("status", "version_number").alias("last_status"))
    return L.policies_after(policies, d).join(v, "policy_id").select("policy_id", "status", "current_version_id", "n_versions", "last_status")


def lineage_ancestry(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "part").where("p_partkey > 1").select(F.lit("rewrite").alias("relation"), F.floor(F.col("p_partkey") / 2).alias("from_version"), F.col("p_partkey").alias("to_version"))
    return L.ancestry(edges).select("version", "ancestor", "depth")


def project_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cwd = F.concat(F.lit("/"), F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1))
    src = table(spark, sf_dir, "pages").select("page_id", cwd.alias("cwd"))
    roots = src.select(F.regexp_extract("cwd", "^(/[^/]+)", 1).alias("root")).union(src.where("page_id % 3 = 0").select(F.regexp_extract("cwd", "^(/[^/]+/[^/]+)", 1).alias("root"))).where("root <> ''").distinct()
    return I.routed(src, roots.withColumn("project_id", F.md5("root"))).select("page_id", "root", "project_id")


def managed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", F.pmod("c_custkey", F.lit(4)).alias("k"))
    own = F.concat(F.lit(blocks.START + "K\" -->\nold\n" + blocks.END + "\ntail of "), "c_name")
    other = F.concat(F.lit(blocks.START + "Z\" -->\nkept\n" + blocks.END + "\n"), "c_name")
    old = F.when(F.col("k") == 0, F.lit(None).cast("string")).when(F.col("k") == 1, own).when(F.col("k") == 2, other).otherwise(F.lit(blocks.END))
    return c.withColumn("r", blocks.rendered(old, F.lit("K"), F.concat("c_mktsegment", F.lit(" rule")))).select("c_custkey", "r.text", "r.error")


def windowed_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity(session_events(spark, sf_dir).select("ts", "type"), every="1 hour").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "type", "events")


QUERIES = {f.__name__: f for f in (lifecycle_requests, lifecycle_states, lineage_ancestry, project_routing, managed_blocks, windowed_activity)}

_DECIDED = """
WITH p AS (SELECT p_partkey AS policy_id, p_name AS name, p_size AS n, CASE WHEN p_size % 5 = 0 THEN 'disabled' ELSE 'active' END AS status, ['scoped_rule', 'project_rule', 'global_rule'][p_size % 3 + 1] AS place,
  ['rewrite', 'promote', 'demote', 'rollback', 'disable', 'enable', 'prune', 'rewrite'][p_partkey % 8 + 1] AS operation, CASE WHEN p_size % 3 = 0 THEN p_name ELSE 'new text' END AS content,
  p_size % 2 = 0 AS to_first, p_size % 4 = 0 AS sure FROM part),
d AS (SELECT *, operation IN ('rewrite', 'promote', 'demote', 'rollback') AS makes,
  CASE operation WHEN 'promote' THEN CASE place WHEN 'scoped_rule' THEN 'project_rule' WHEN 'project_rule' THEN 'global_rule' END WHEN 'demote' THEN CASE place WHEN 'global_rule' THEN 'project_rule' WHEN 'project_rule' THEN 'scoped_rule' END END AS target FROM p),
e AS (SELECT *, CASE WHEN makes AND status <> 'active' THEN 'policy_not_active' WHEN operation = 'rewrite' AND content = name THEN 'same_content' WHEN operation IN ('promote', 'demote') AND target IS NULL THEN 'no_such_target'
  WHEN operation = 'promote' AND target = 'global_rule' AND NOT sure THEN 'needs_confirmation' WHEN operation = 'rollback' AND NOT to_first THEN 'is_current' WHEN operation = 'disable' AND status <> 'active' THEN 'not_active'
  WHEN operation = 'enable' AND status <> 'disabled' THEN 'not_disabled' END AS error FROM d)
"""
ORACLE_SQL = {
    "lifecycle_requests": _DECIDED + """SELECT policy_id, operation, error, CASE WHEN error IS NULL AND makes THEN policy_id || CASE operation WHEN 'rollback' THEN '-1' ELSE '-2' END END AS from_version,
CASE WHEN error IS NULL AND makes THEN 'PVN-' || policy_id || '-3' END AS new_version_id, CASE WHEN error IS NULL AND makes THEN coalesce(target, place) END AS new_placement,
CASE WHEN error IS NULL AND makes AND coalesce(target, '') <> 'global_rule' THEN 'project' END AS new_scope_type, CASE WHEN error IS NULL AND makes THEN CASE operation WHEN 'rewrite' THEN content WHEN 'rollback' THEN 'first' ELSE name END END AS new_content FROM e""",
    "lifecycle_states": _DECIDED + """SELECT policy_id, CASE WHEN error IS NULL AND operation = 'disable' THEN 'disabled' WHEN error IS NULL AND operation = 'enable' THEN 'active' WHEN error IS NULL AND operation = 'prune' THEN 'pruned' ELSE status END AS status,
CASE WHEN error IS NULL AND makes THEN 'PVN-' || policy_id || '-3' ELSE policy_id || '-2' END AS current_version_id, CASE WHEN error IS NULL AND makes THEN 3 ELSE 2 END::BIGINT AS n_versions, 'active' AS last_status FROM e""",
    "lineage_ancestry": """WITH RECURSIVE a AS (SELECT p_partkey AS version, p_partkey // 2 AS ancestor, 1 AS depth FROM part WHERE p_partkey > 1 UNION ALL SELECT version, ancestor // 2, depth + 1 FROM a WHERE ancestor > 1)
SELECT version, ancestor, depth FROM a""",
    "project_routing": r"""WITH s AS (SELECT page_id, '/' || regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS cwd FROM pages),
r AS (SELECT regexp_extract(cwd, '^(/[^/]+)', 1) AS root FROM s UNION SELECT regexp_extract(cwd, '^(/[^/]+/[^/]+)', 1) FROM s WHERE page_id % 3 = 0)
SELECT page_id, arg_max(root, length(root)) AS root, md5(arg_max(root, length(root))) AS project_id FROM s LEFT JOIN r ON root <> '' AND (cwd = root OR starts_with(cwd, root || '/')) GROUP BY page_id""",
    "managed_blocks": """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN b || chr(10) WHEN 1 THEN b || chr(10) || 'tail of ' || c_name WHEN 2 THEN replace(replace(b, 'K"', 'Z"'), c_mktsegment || ' rule', 'kept') || chr(10) || c_name || chr(10) || chr(10) || b || chr(10) END AS text,
CASE WHEN c_custkey % 4 = 3 THEN 'broken_marks' END AS error FROM (SELECT *, '<!-- policy:managed key="K" -->' || chr(10) || c_mktsegment || ' rule' || chr(10) || '<!-- policy:end -->' AS b FROM customer) x""",
    "windowed_activity": EVENTS_SQL + " SELECT date_trunc('hour', ts) AS window_start, type, count(*) AS events FROM t GROUP BY 1, 2",
}
