"""Queries of joins, aggregates, sorts, text functions, evaluations and ledgers over the driver's tables, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillspan.functions import text as T
from quillspan.functions.commands import command_context, command_family, command_kind, outcome_type
from quillspan.functions.paths import directory, extension, file_context, is_vendored, normalized
from quillspan.operators import evaluation as E
from quillspan.operators import ledger as L
from quillspan.operators.sequences import corrections_after_work
from quillspan.plans.mapping import EVENTS_SQL, session_events
from quillspan.session import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# Reading views: projects are nations, their sessions customers and orders.


@query(
    """SELECT n_nationkey, n_name, count(c_custkey) AS sessions, count(*) FILTER (c_mktsegment = 'BUILDING') AS building, max(c_acctbal) AS top_balance
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2"""
)
def project_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(
        F.count("c_custkey").alias("sessions"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("building"), F.max("c_acctbal").alias("top_balance")
    )
    out = table(spark, sf_dir, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").fillna(0, ["sessions", "building"])
    return out.select("n_nationkey", "n_name", "sessions", "building", "top_balance")


@query(
    """SELECT o_orderkey, o_orderstatus, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderstatus = 'F' AND (c_name ILIKE '%customer#%7%' OR CAST(o_orderkey AS VARCHAR) ILIKE '%77%') ORDER BY o_orderkey DESC LIMIT 50 OFFSET 100"""
)
def sessions_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a listing: the limit is what is asked for."""
    o, c, n = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    x = o.join(c, o.o_custkey == c.c_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left")
    x = x.where(F.col("o_orderstatus") == "F").where(F.col("c_name").ilike("%customer#%7%") | F.col("o_orderkey").cast("string").ilike("%77%"))
    return x.select("o_orderkey", "o_orderstatus", "c_name", "n_name").orderBy(F.desc("o_orderkey")).offset(100).limit(50)


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query(
    """SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_orderstatus = 'O') AS open, max(o_orderdate) AS latest FROM orders"""
)
def scalar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_ = lambda x: F.count_if(F.col("o_orderstatus") == x)
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("total"), is_("F").alias("finished"), is_("O").alias("open"), F.max("o_orderdate").alias("latest"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def typed_exists_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey IS NOT NULL AND l_returnflag = 'R')")
def unreferenced_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return table(spark, sf_dir, "part").join(back, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query(
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM lineitem)
SELECT o_orderkey, o_orderstatus, l_linenumber, l_extendedprice FROM orders JOIN r ON l_orderkey = o_orderkey WHERE rank = 1"""
)
def recommended_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")
    best = table(spark, sf_dir, "lineitem").withColumn("rank", F.row_number().over(w)).where("rank = 1")
    return table(spark, sf_dir, "orders").join(best, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "o_orderstatus", "l_linenumber", "l_extendedprice")


@query(
    """SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS place, row_number() OVER (PARTITION BY l_orderkey
ORDER BY CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, l_linenumber) AS n FROM lineitem"""
)
def evidence_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", place.alias("place"))
    return x.withColumn("n", F.row_number().over(W.partitionBy("l_orderkey").orderBy("place", "l_linenumber")))


@query(
    """SELECT l.l_orderkey, l.l_linenumber, o.o_orderstatus, s.s_name, n.n_name FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey"""
)
def evidence_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    x = x.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return x.select("l_orderkey", "l_linenumber", "o_orderstatus", "s_name", "n_name")


# Session headers and totals.


@query(f"{EVENTS_SQL} SELECT trajectory_id, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS n FROM t GROUP BY 1")
def session_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_events(spark, sf_dir).groupBy("trajectory_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count("*").alias("n"))


@query(f"{EVENTS_SQL} SELECT trajectory_id, path, bool_or(type = 'file_edit') AS was_modified, bool_or(type = 'file_create') AS was_created, count(*) AS touches FROM t WHERE path IS NOT NULL GROUP BY 1, 2")
def file_touch_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    touched = session_events(spark, sf_dir).where("path is not null").groupBy("trajectory_id", "path")
    return touched.agg(F.bool_or(F.col("type") == "file_edit").alias("was_modified"), F.bool_or(F.col("type") == "file_create").alias("was_created"), F.count("*").alias("touches"))


@query(f"{EVENTS_SQL} SELECT trajectory_id, CAST(sum(k) AS BIGINT) AS total, CAST(sum(k) FILTER (type = 'command') AS BIGINT) AS in_commands, arg_max(k, sequence) AS last_snapshot, arg_min(path, sequence) FILTER (path IS NOT NULL) AS first_path FROM t GROUP BY 1")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_events(spark, sf_dir).groupBy("trajectory_id").agg(
        F.sum("k").alias("total"), F.sum(F.when(F.col("type") == "command", F.col("k"))).alias("in_commands"), F.max_by("k", "sequence").alias("last_snapshot"),
        F.min_by("path", F.when(F.col("path").isNotNull(), F.col("sequence"))).alias("first_path"),
    )


@query(
    """WITH x AS (SELECT *, max(CASE WHEN role = 'assistant' THEN turn END) OVER w AS acted, max(CASE WHEN role = 'user' THEN turn END) OVER w AS asked FROM conversations
WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, turn, length(text) AS chars FROM x WHERE role = 'user' AND acted IS NOT NULL AND acted > coalesce(asked, -1)"""
)
def conversation_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrections_after_work(table(spark, sf_dir, "conversations")).select("conv_id", "turn", F.length("text").alias("chars"))


# Text, command and path functions.


@query(
    r"""SELECT doc_id, CASE WHEN x = '' THEN NULL WHEN length(x) > 500 THEN regexp_replace(x[1:499], '\s+$', '') || '…' ELSE x END AS summary
FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM documents) y"""
)
def summarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.summarized(F.col("text")).alias("summary"))


def _redact_sql() -> str:
    from quillspan.functions.values import REDACTIONS

    out, found = "text", []
    for _, pattern, by in REDACTIONS:
        p, r = pattern.replace("'", "''"), by.replace("$1", "\\1")
        found.append(f"regexp_matches({out}, '{p}')" if out == "text" else f"regexp_matches(text, '{p}')")
        out = f"regexp_replace({out}, '{p}', '{r}', 'g')"
    return f"SELECT doc_id, md5({out}) AS text_md5, ({' OR '.join(found)}) AS redacted FROM documents"


@query(_redact_sql())
def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "documents").select("doc_id", T.redacted(F.col("text")).alias("r"))
    return r.select("doc_id", F.md5("r.text").alias("text_md5"), "r.redacted")


_COMMANDS = (
    "pytest -q", "FOO=1 cd app && ruff check .", "echo pytest", "npm run build", "pip install x", "git status", "cat a.txt | grep b", "ls", "rg foo src", "./vendor/make all",
    "make --version", "cargo test -- --nocapture", "uv add x", "echo 'run make' ; tsc -p .", "", "python manage.py migrate",
)
_KINDS = ("test", "lint", "other", "build", "build", "vcs", "read", "list", "search", "other", "other", "test", "package", "build", "other", "other")
_K = f"CASE l_partkey % 16 {' '.join(f'WHEN {i} THEN {k!r}' for i, k in enumerate(_KINDS))} END"


@query(f"SELECT l_partkey % 16 AS command, {_K} AS kind, CASE WHEN {_K} IN ('test', 'lint', 'build') THEN {_K} || CASE WHEN l_linenumber % 2 = 0 THEN '_pass' ELSE '_fail' END END AS outcome, count(*) AS n FROM lineitem GROUP BY ALL")
def classify_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    which = F.pmod("l_partkey", F.lit(16))
    # Each distinct pair of command and exit is classified once; lines only count.
    pairs = table(spark, sf_dir, "lineitem").groupBy(which.alias("command"), (F.col("l_linenumber") % 2).alias("exit")).agg(F.count("*").alias("n"))
    x = pairs.withColumn("kind", command_kind(F.element_at(F.array(*map(F.lit, _COMMANDS)), (F.col("command") + 1).cast("int"))))
    return x.groupBy("command", "kind", outcome_type(F.col("kind"), F.col("exit")).alias("outcome")).agg(F.sum("n").alias("n"))


@query(
    r"""SELECT page_id, p AS path, CASE WHEN p = '' THEN 'other' WHEN regexp_matches(p, '(^|/)(docs?|documentation)(/|$)|\.(md|rst|adoc|txt)$|(^|/)(README|CHANGELOG|LICENSE)') THEN 'docs'
WHEN regexp_matches(p, '(^|/)(src/)?(components?|pages|views|ui|client|frontend|web|styles?|assets)(/|$)|\.(tsx|jsx|vue|svelte|css|scss|sass|less|html)$') THEN 'frontend' ELSE 'other' END AS context,
FALSE AS vendored, coalesce(nullif(regexp_extract(p, '^(.*)/[^/]*$', 1), ''), '') AS folder, lower(regexp_extract(p, '(?:^|/)\.*[^/.][^/]*?(\.[^/.]*)$', 1)) AS suffix
FROM (SELECT page_id, rtrim(regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1), '/') AS p FROM pages) x"""
)
def file_context_of_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1)
    x = table(spark, sf_dir, "pages").select("page_id", normalized(p).alias("path"))
    none = F.lit("")
    return x.select(
        "page_id", "path", file_context(F.col("path")).alias("context"), is_vendored(F.col("path")).alias("vendored"),
        F.coalesce(directory(F.col("path")), none).alias("folder"), F.coalesce(extension(F.col("path")), none).alias("suffix"),
    )


@query(
    f"""{EVENTS_SQL} SELECT type, k % 5 AS which, CASE k % 5 WHEN 0 THEN 'assertionerror: expected N but got N' WHEN 1 THEN 'modulenotfounderror: no module named ''foo''' WHEN 2 THEN 'test exit N'
WHEN 3 THEN 'typeerror: x is not a function at' ELSE 'N failed' END AS signature, k % 5 IN (0, 1, 3) AS diagnostic, count(*) AS n FROM t WHERE summary IS NOT NULL AND type <> 'human_correction' GROUP BY ALL"""
)
def error_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = session_events(spark, sf_dir).where("summary is not null and type <> 'human_correction'").withColumn("signature", T.error_signature(F.col("summary")))
    x = x.select("type", F.pmod("k", F.lit(5)).alias("which"), "signature", T.looks_diagnostic(F.col("signature")).alias("diagnostic"))
    return x.groupBy("type", "which", "signature", "diagnostic").agg(F.count("*").alias("n"))


@query(f"{EVENTS_SQL} SELECT summary, summary LIKE 'please%' OR summary LIKE 'why%' AS meaningful, summary LIKE 'please%' AS directive, count(*) AS n FROM t WHERE type = 'human_correction' GROUP BY 1")
def correction_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = session_events(spark, sf_dir).where("type = 'human_correction'")
    x = x.select("summary", T.is_correction(F.col("summary")).alias("meaningful"), T.is_directive(F.col("summary")).alias("directive"))
    return x.groupBy("summary", "meaningful", "directive").agg(F.count("*").alias("n"))


@query(f"{EVENTS_SQL} SELECT command, CASE command WHEN 'alembic upgrade head' THEN 'migration' WHEN 'mypy src' THEN 'typecheck' END AS context, CASE command WHEN 'alembic upgrade head' THEN 'migration' WHEN 'mypy src' THEN 'typecheck' WHEN 'cd app && pytest -q' THEN 'pytest' END AS family, count(*) AS n FROM t WHERE command IS NOT NULL GROUP BY 1")
def command_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = session_events(spark, sf_dir).where("command is not null").select("command", command_context(F.col("command")).alias("context"), command_family(F.col("command")).alias("family"))
    return x.groupBy("command", "context", "family").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, 'P-' || substr(sha256(CAST(c_custkey AS VARCHAR) || chr(31) || c_name || chr(31) || ''), 1, 12) AS id, sha256(c_name) AS hash FROM customer")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", T.short_id("P-", F.col("c_custkey"), F.col("c_name"), F.lit(None)).alias("id"), F.sha2("c_name", 256).alias("hash"))


# Paired evaluation and lifecycle: orders are pairs, odd and even lines the two conditions.


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with a number for each line of an order, in a total order."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return table(spark, sf_dir, "lineitem").withColumn("id", F.row_number().over(w))


_LINES = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS id FROM lineitem)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _lines(spark, sf_dir).withColumn("pair", F.col("l_orderkey"))
    side = F.when(F.col("id") % 2 == 1, "baseline").otherwise("candidate")
    li = li.withColumn("condition", side)
    checks = li.select("pair", "condition", "id", F.ceil(F.col("id") / 2).alias("name"), (F.col("l_returnflag") != "R").alias("passed"))
    runs = li.groupBy("pair", "condition").agg(
        F.when(F.max("l_tax") > 0.07, "failed").otherwise("completed").alias("status"), F.sum("l_partkey").alias("duration_ms")
    )
    return E.compared(runs, checks)


_COMPARED = f"""
WITH li AS (SELECT l_orderkey AS pair, CASE WHEN id % 2 = 1 THEN 'baseline' ELSE 'candidate' END AS cond, id, (id + 1) // 2 AS name,
  l_returnflag <> 'R' AS passed, l_tax, l_partkey FROM {_LINES} x),
runs AS (SELECT pair, cond, CASE WHEN max(l_tax) > 0.07 THEN 'failed' ELSE 'completed' END AS status, sum(l_partkey) AS duration_ms FROM li GROUP BY 1, 2),
pr AS (SELECT pair, max(CASE WHEN cond = 'baseline' THEN status END) AS bs, max(CASE WHEN cond = 'candidate' THEN status END) AS cs,
  max(CASE WHEN cond = 'baseline' THEN duration_ms END) AS bd, max(CASE WHEN cond = 'candidate' THEN duration_ms END) AS cd FROM runs GROUP BY 1),
ch AS (SELECT pair, cond, name, arg_max(passed, id) AS passed, min(id) AS id FROM li GROUP BY 1, 2, 3),
b AS (SELECT * FROM ch WHERE cond = 'baseline'), c AS (SELECT * FROM ch WHERE cond = 'candidate'),
j AS (SELECT coalesce(b.pair, c.pair) AS pair, b.id AS bid, c.id AS cid, b.passed AS bp, c.passed AS cp FROM b FULL OUTER JOIN c ON b.pair = c.pair AND b.name = c.name),
g AS (SELECT pair, count(bid) AS nb, count(cid) AS nc, count(*) FILTER (bid IS NULL OR cid IS NULL) AS un, count(*) FILTER (bp AND NOT cp) AS reg,
  arg_min(bp, bid) FILTER (bid IS NOT NULL) AS pb, arg_min(coalesce(cp, FALSE), bid) FILTER (bid IS NOT NULL) AS pc FROM j GROUP BY 1),
o AS (SELECT pr.pair, CASE WHEN NOT coalesce(bs = 'completed' AND cs = 'completed', FALSE) OR coalesce(nb, 0) = 0 OR coalesce(nc, 0) = 0 THEN 'invalid' WHEN un > 0 THEN 'incomparable'
  WHEN pb AND NOT pc THEN 'regressed' WHEN NOT pb AND pc THEN 'improved' WHEN reg > 0 THEN 'regressed' ELSE 'unchanged' END AS outcome, reg, cd - bd AS delta FROM pr LEFT JOIN g USING (pair))
"""


@query(_COMPARED + "SELECT pair, outcome, CASE WHEN outcome IN ('improved', 'unchanged', 'regressed') THEN reg ELSE 0 END AS regression_count, delta AS duration_delta_ms FROM o")
def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("pair", "outcome", "regression_count", "duration_delta_ms")


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _pairs(spark, sf_dir).withColumns({"version_id": F.col("pair") % 40, "created_at": F.col("pair"), "id": F.col("pair")})
    return E.version_evidence(found)


_EVIDENCE = _COMPARED + """, ev AS (SELECT pair % 40 AS version_id, count(*) AS total, count(*) FILTER (outcome = 'improved') AS improved, count(*) FILTER (outcome = 'unchanged') AS unchanged,
  count(*) FILTER (outcome = 'regressed') AS regressed, count(*) FILTER (outcome = 'invalid') AS invalid, count(*) FILTER (outcome = 'incomparable') AS incomparable,
  avg(delta) AS avg_duration_delta_ms, arg_max(outcome, pair) AS latest_outcome FROM o GROUP BY 1)
"""


@query(
    _EVIDENCE + """SELECT *, improved + unchanged + regressed AS valid, CASE WHEN improved + unchanged + regressed > 0 THEN improved / (improved + unchanged + regressed) END AS improved_ratio,
CASE WHEN improved + unchanged + regressed > 0 THEN regressed / (improved + unchanged + regressed) END AS regressed_ratio FROM ev"""
)
def version_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).drop("regression_checks")


@query(
    _EVIDENCE + """, r AS (SELECT version_id, version_id // 4 AS policy_id, version_id % 4 + 1 AS n, CASE version_id % 3 WHEN 0 THEN 'global_rule' WHEN 1 THEN 'project_rule' ELSE 'scoped_rule' END AS placement,
  improved + unchanged + regressed AS valid, improved, regressed, coalesce(improved / nullif(improved + unchanged + regressed, 0), 0) AS good, coalesce(regressed / nullif(improved + unchanged + regressed, 0), 0) AS bad FROM ev),
w AS (SELECT *, lag(valid) OVER p AS wv, lag(good) OVER p AS wg FROM r WINDOW p AS (PARTITION BY policy_id ORDER BY n))
SELECT version_id, CASE WHEN valid >= 3 AND bad >= 0.5 AND wv >= 3 AND wg >= 0.7 THEN 'rollback' WHEN valid < 3 THEN 'retain' WHEN bad >= 0.5 AND placement <> 'scoped_rule' THEN 'demote' WHEN bad >= 0.5 THEN 'disable'
  WHEN bad >= 0.2 AND good > 0 AND placement <> 'scoped_rule' THEN 'demote' WHEN good >= 0.7 AND regressed = 0 AND placement <> 'global_rule' THEN 'promote' ELSE 'retain' END AS operation FROM w"""
)
def recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _evidence(spark, sf_dir)
    v = F.col("version_id")
    versions = found.select(
        "version_id", F.floor(v / 4).alias("policy_id"), (v % 4 + 1).alias("version_number"),
        F.element_at(F.array(F.lit("global_rule"), F.lit("project_rule"), F.lit("scoped_rule")), (v % 3 + 1).cast("int")).alias("placement"),
    )
    return E.recommendations(versions, found).select("version_id", "operation")


@query(
    """SELECT p_type AS content_hash, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS policy_ids FROM part WHERE p_size > 45 GROUP BY 1 HAVING count(*) >= 2"""
)
def duplicate_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("policy_id"), F.col("p_type").alias("content_hash"), F.when(F.col("p_size") > 45, "active").otherwise("disabled").alias("status"))
    return E.duplicate_policies(p).select("content_hash", F.array_join(F.transform("policy_ids", lambda x: x.cast("string")), ",").alias("policy_ids"))


@query(
    """WITH e AS (SELECT DISTINCT l_orderkey AS child, l_suppkey AS parent FROM lineitem) SELECT a.child, a.parent AS parent_a, b.parent AS parent_b FROM e a JOIN e b ON a.child = b.child AND a.parent < b.parent"""
)
def merge_parent_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").select(F.lit("merged_from").alias("relation"), F.col("l_suppkey").alias("from_version"), F.col("l_orderkey").alias("to_version")).distinct()
    return E.merge_parents(edges)


@query("SELECT p_partkey AS policy_id, CAST(p_size AS BIGINT) AS scope_value, CASE WHEN p_size >= 25 THEN 'target_project_not_registered' ELSE 'target_project_root_missing' END AS reason FROM part WHERE p_size >= 25 OR p_size % 5 = 0")
def stale_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    policies = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("policy_id"), F.lit("project").alias("scope_type"), F.col("p_size").cast("long").alias("scope_value"))
    known = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("project_id"), (F.col("n_nationkey") % 5 == 0).alias("root_missing"))
    return E.stale_policies(policies, known)


_ACTIONS = ("accept", "reject", "defer", "test_first", "edit", "choose", "apply")


@query(
    f"""WITH a AS (SELECT l_orderkey AS review_id, id AS seq, l_partkey % 7 AS action, l_suppkey % 10 > 0 AS ok FROM {_LINES} x)
SELECT review_id, coalesce(CASE arg_max(action, seq) FILTER (ok) WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' WHEN 2 THEN 'deferred' WHEN 3 THEN 'test_first' WHEN 6 THEN 'applied' WHEN 4 THEN 'unreviewed' WHEN 5 THEN 'unreviewed' END, 'unreviewed') AS status,
1 + count(*) FILTER (ok AND action IN (4, 5)) AS revision, NOT arg_max(ok, seq) AS stale FROM a GROUP BY 1"""
)
def review_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    which = F.element_at(F.array(*map(F.lit, _ACTIONS)), (F.col("l_partkey") % 7 + 1).cast("int"))
    a = _lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("review_id"), F.col("id").alias("seq"), which.alias("action"), F.when(F.col("l_suppkey") % 10 > 0, "now").otherwise("old").alias("fingerprint"), F.lit("c").alias("content")
    )
    prints = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("review_id"), F.lit("now").alias("fingerprint"))
    return L.review_states(a, prints).select("review_id", "status", "revision", "stale")


@query(
    """SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS balance FROM customer
UNION ALL SELECT c_custkey + 1000000, c_name, c_acctbal + 1 FROM customer WHERE c_custkey % 50 = 0"""
)
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    more = old.where("id % 50 = 0").select((F.col("id") + 1000000).alias("id"), "name", (F.col("balance") + 1).alias("balance"))
    new = old.where("id % 3 = 0").select("id", F.lit(None).cast("string").alias("name"), F.when(F.col("id") % 2 == 0, F.col("balance") + 1).alias("balance")).unionByName(more)
    return L.upserted(old, new, ["id"], ("name", "balance"))


@query(
    """SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'new' WHEN o_orderkey % 7 = 0 THEN 'changed' ELSE 'already' END AS outcome, o_orderpriority AS agent, count(*) AS n FROM orders GROUP BY 1, 2"""
)
def import_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("agent"), F.md5(F.col("o_orderkey").cast("string")).alias("content_hash"))
    known = found.where("o_orderkey % 5 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "other").otherwise(F.col("content_hash")).alias("content_hash"))
    return L.changed_sources(found, known, ["o_orderkey"]).groupBy("outcome", "agent").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, 100 + row_number() OVER (ORDER BY s_name, s_suppkey) AS seq FROM supplier WHERE s_acctbal < 0")
def next_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.next_numbers(table(spark, sf_dir, "supplier").where("s_acctbal < 0"), 100, [F.col("s_name"), F.col("s_suppkey")]).select("s_suppkey", "seq")


@query("SELECT c_mktsegment, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) x WHERE n = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return L.latest(c, ["c_mktsegment"], [F.col("c_acctbal"), -F.col("c_custkey")]).select("c_mktsegment", "c_custkey", "c_acctbal")
