"""Queries of line numbers, published versions, generation passes, nested JSON, previews, cascades and ledgers, with SQL."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import nested as N
from quillspan.operators import advice as A
from quillspan.operators import cascade as C
from quillspan.operators import evaluation as E
from quillspan.operators import generation as G
from quillspan.operators import ledger as LG
from quillspan.operators import placement as P
from quillspan.operators import previews as PV
from quillspan.operators import runs as R
from quillspan.operators import targets as TG
from quillspan.plans import pattern_queries as PQ
from quillspan.plans.mapping import session_events
from quillspan.session import table
from quillspan.sources import session_lines
from quillspan.tables import shared_dir
from quillspan.versions import Pass, version, versions

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


@query(
    """WITH l AS (SELECT user_id % 8 AS bucket, event_id, CASE WHEN event_id % 11 = 0 THEN '' ELSE event_id || ' ' || event_type || ' ' || props END AS value FROM events)
SELECT CAST(bucket AS INTEGER) AS bucket, CAST(row_number() OVER w AS INTEGER) AS line, CAST(coalesce(sum(strlen(value) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_start, value
FROM l WINDOW w AS (PARTITION BY bucket ORDER BY event_id)"""
)
def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as eight text files and read back by blocks of 64 KB: each line's number and place in its file."""
    blank, said = F.col("event_id") % 11 == 0, F.concat_ws(" ", "event_id", "event_type", "props")
    lines = table(spark, sf_dir, "events").select((F.col("user_id") % 8).cast("int").alias("bucket"), "event_id", F.when(blank, "").otherwise(said).alias("value"))
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    lines.repartition(8, "bucket").sortWithinPartitions("bucket", "event_id").select("bucket", "value").write.partitionBy("bucket").text(path)
    found = session_lines.numbered(spark, path, glob="part-*", blockbytes=1 << 16)
    return found.select(F.regexp_extract("file", r"bucket=(\d+)", 1).cast("int").alias("bucket"), "line", "byte_start", "value")


@query(
    """SELECT 1 AS version, o_orderstatus, count(*) AS orders, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS price, (SELECT count(*) FROM lineitem) AS lines FROM orders GROUP BY ALL
UNION ALL SELECT 2, o_orderstatus, count(*), sum(CAST(o_totalprice AS DECIMAL(18,2))), (SELECT count(*) FROM lineitem WHERE l_orderkey % 3 <> 0) FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY ALL"""
)
def published_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their lines as one version, a pass that fails between its two writes, and a version without every third order; each version as it reads at the end."""
    root = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    orders, lines = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    with Pass(spark, root) as p:
        p.put("orders", orders)
        p.put("lines", lines)
    try:
        with Pass(spark, root) as p:
            p.put("orders", orders.where("o_orderkey % 2 = 0"))
            raise InterruptedError
    except InterruptedError:
        pass
    with Pass(spark, root) as p:
        p.put("orders", p.base["orders"].where("o_orderkey % 3 <> 0"))
        p.put("lines", p.base["lines"].where("l_orderkey % 3 <> 0"))
    out = None
    for n in versions(spark, root):
        v = version(spark, root, n)
        price = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(38,2)").alias("price")
        one = v["orders"].groupBy("o_orderstatus").agg(F.count("*").alias("orders"), price).withColumn("version", F.lit(n))
        one = one.crossJoin(F.broadcast(v["lines"].agg(F.count("*").alias("lines"))))  # one row
        out = one if out is None else out.unionByName(one)
    return out


# Customers as experiences, their orders as evidence; the sets of the pass before rest on orders of which some differed.

_MARKS = ("unreviewed", "false_positive", "needs_more_evidence", "useful")


@query(
    """WITH changed AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 97 = 0)
SELECT c_custkey AS group_key, CASE WHEN c_custkey % 10 <> 3 AND c_custkey % 11 <> 4 AND c_custkey % 13 <> 5 AND c_custkey NOT IN (SELECT o_custkey FROM changed) THEN 'unchanged' ELSE 'regenerate' END AS action
FROM customer WHERE c_nationkey % 5 <> 0 AND c_custkey % 4 NOT IN (1, 2)"""
)
def generation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which proposal sets are made anew: no set (key % 10 = 3), another version (% 11 = 4), four proposals (% 13 = 5), or evidence that has changed."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    key = F.col("c_custkey")
    experiences = c.select(key.alias("group_key"), "c_name", "c_acctbal", F.when(F.col("c_nationkey") % 5 != 0, "candidate").otherwise("needs_more_evidence").alias("status"), F.element_at(F.array(*map(F.lit, _MARKS)), (key % 4 + 1).cast("int")).alias("review_status"))
    evidence = o.select(F.col("o_custkey").alias("group_key"), "o_orderkey", "o_totalprice", "o_orderdate")
    keys, evidence_keys = ["c_name", "c_acctbal", "status", "review_status"], ["o_orderkey", "o_totalprice", "o_orderdate"]
    before = evidence.withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") % 97 == 0, 1.0).otherwise(0.0))
    sets = P.source_fingerprints(experiences, before, "g", keys, evidence_keys).where("group_key % 10 <> 3").withColumn("version", F.when(F.col("group_key") % 11 == 4, "old").otherwise("g"))
    made = experiences.select("group_key", F.explode(F.array(*map(F.lit, G.PLACEMENTS))).alias("placement")).where("group_key % 13 <> 5 or placement <> 'skill'")
    return G.planned(experiences, P.source_fingerprints(experiences, evidence, "g", keys, evidence_keys), sets, made, "g").select("group_key", "action")


@query(
    """WITH p AS (SELECT p_partkey AS g FROM part), v AS (
SELECT g, 'types' AS rule FROM p WHERE g % 7 = 0 UNION SELECT g, 'ranks' FROM p WHERE g % 11 = 0 UNION SELECT g, 'fields' FROM p WHERE g % 13 = 0
UNION SELECT l_partkey, 'evidence' FROM lineitem WHERE l_orderkey % 50 = 0 UNION SELECT l_partkey, 'orphan' FROM lineitem WHERE l_partkey % 7 = 0)
SELECT g AS group_key, rule FROM v"""
)
def proposal_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as sets of five proposals: a type that is none (key % 7 = 0), ranks that tie (% 11), no content (% 13), and lines as links, some of orders that are no evidence."""
    key = F.col("p_partkey")
    one = table(spark, sf_dir, "part").select(key.alias("group_key"), F.posexplode(F.array(*map(F.lit, G.PLACEMENTS))).alias("rank", "placement"))
    g, skill = F.col("group_key"), F.col("placement") == "skill"
    rows = one.select(
        "group_key", F.when((g % 7 == 0) & skill, "defer").otherwise(F.col("placement")).alias("placement"), F.when((g % 11 == 0) & skill, 1).otherwise(F.col("rank") + 1).alias("rank"),
        F.lit(0.5).alias("score"), F.lit("global").alias("target_type"), F.when((g % 13 != 0) | ~skill, "c").alias("content"),
    )
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("group_key"), F.col("l_orderkey").alias("occurrence_id"))
    return G.set_violations(rows, lines.withColumn("placement", F.lit("skill")), lines.where("occurrence_id % 50 <> 0"))


# Events' props inside made-up nesting, with their fields in one of three orders.


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    inner = F.concat(F.lit('{"who":'), F.col("user_id").cast("string"), F.lit(',  "note":"a \\"'), F.col("event_type"), F.lit('\\" \\u00e9\\n"}'))
    fields = (F.concat(F.lit('"zeta" : '), F.col("props")), F.concat(F.lit('"alpha":['), inner, F.lit(" , true,null]")), F.concat(F.lit('"Mid":{"b":{"y":1,"x":[]},"a":"TOKEN=abcdef'), key.cast("string"), F.lit('"}')))
    orders = [F.concat(F.lit("{"), *(part for i in order for part in (fields[i], F.lit(",")))) for order in ((0, 1, 2), (2, 0, 1), (1, 2, 0))]
    text = F.when(key % 3 == 0, orders[0]).when(key % 3 == 1, orders[1]).otherwise(orders[2])
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.regexp_replace(text, ",$", ""), F.lit("}")).alias("t"))


_NESTED_SQL = """'{"Mid": {"a": "' || {secret} || '", "b": {"x": [], "y": 1}}, "alpha": [{"note": "a \\"' || event_type || '\\" é\\n", "who": ' || user_id || '}, true, null], "zeta": {"k": ' || regexp_extract(props, '"k": *([0-9]+)', 1) || '}}'"""


@query("SELECT event_id, c AS canonical, sha256(c) AS digest FROM (SELECT event_id, " + _NESTED_SQL.replace("{secret}", "'TOKEN=abcdef' || event_id") + " AS c FROM events) x")
def canonical_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested texts with keys sorted at every depth, and the digest, which the order of fields doesn't change."""
    return _nested(spark, sf_dir).select("event_id", N.canonical_json(F.col("t")).alias("canonical"), N.canonical_hash(F.col("t")).alias("digest"))


@query("SELECT event_id, TRUE AS redacted, " + _NESTED_SQL.replace("{secret}", "'TOKEN=[REDACTED:env-secret]'") + " AS canonical FROM events")
def redacted_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A secret two levels down is redacted; the text around it stays, which its canonical form shows."""
    return _nested(spark, sf_dir).select("event_id", N.redacted_json(F.col("t")).alias("r")).select("event_id", "r.redacted", N.canonical_json(F.col("r.text")).alias("canonical"))


@query(
    """SELECT event_id, event_id % 5 IN (0, 1) AS ok, CASE event_id % 5 WHEN 0 THEN CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) END AS k FROM events"""
)
def decoded_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Props as they are, in a list, with more behind them, cut short, and as no JSON: whether they can be read, and an object's field."""
    key, p = F.col("event_id"), F.col("props")
    text = F.when(key % 5 == 0, p).when(key % 5 == 1, F.concat(F.lit("["), p, F.lit("]"))).when(key % 5 == 2, F.concat(p, F.lit(" {}"))).when(key % 5 == 3, F.expr("substring(props, 1, length(props) - 1)")).otherwise(F.concat(F.lit("props "), p))
    e = table(spark, sf_dir, "events").select("event_id", text.alias("t"))
    return e.select("event_id", N.decoded(F.col("t"))["ok"].alias("ok"), F.try_variant_get(N.decoded_or(F.col("t")), "$.k", "int").alias("k"))


@query(
    """WITH l AS (SELECT l_orderkey, string_agg(l_linenumber || ' ' || l_partkey || chr(10), '' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) AS before,
  coalesce(string_agg(l_linenumber || ' ' || l_partkey || chr(10), '' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) FILTER (l_returnflag <> 'R'), '') || 'total ' || l_orderkey AS after,
  count(*) FILTER (l_returnflag = 'R') AS removed FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, sha256(before) AS before_sha256, sha256(after) AS after_sha256, CAST(1 AS BIGINT) AS added, removed, TRUE AS whole FROM l"""
)
def preview_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as a file, from which returned ones are taken and to which a total is put: hunks, and what they make of the file."""
    said = F.concat_ws(" ", "l_linenumber", "l_partkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", F.concat(said, F.lit("\n")).alias("t")).alias("x"), (F.col("l_returnflag") != "R").alias("stays"))
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["t"]), "")
    files = lines.groupBy("l_orderkey").agg(text(F.col("x")).alias("before"), text(F.when(F.col("stays"), F.col("x"))).alias("rest"))
    files = files.select("l_orderkey", F.lit("f").alias("path"), "before", F.concat("rest", F.lit("total "), F.col("l_orderkey").cast("string")).alias("after"))
    found = PV.with_patched(PV.with_hunks(files)).withColumn("n", PV.line_counts(F.col("hunks")))
    return found.select("l_orderkey", "before_sha256", "after_sha256", "n.added", "n.removed", (F.col("patched") == F.col("after")).alias("whole"))


@query(
    """WITH n AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 1), c AS (SELECT * FROM customer WHERE c_nationkey NOT IN (FROM n)), o AS (SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (FROM n))),
s AS (SELECT * FROM supplier WHERE s_nationkey NOT IN (FROM n)), gone AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (FROM n))),
l AS (SELECT l_orderkey, CASE WHEN l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (FROM n)) THEN l_suppkey END AS l_suppkey FROM lineitem WHERE l_orderkey NOT IN (FROM gone))
SELECT 'nation' AS name, count(*) AS n, sum(n_nationkey)::BIGINT AS keys FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 'customer', count(*), sum(c_custkey)::BIGINT FROM c UNION ALL SELECT 'supplier', count(*), sum(s_suppkey)::BIGINT FROM s
UNION ALL SELECT 'orders', count(*), sum(o_orderkey)::BIGINT FROM o UNION ALL SELECT 'lineitem', count(*), sum(l_suppkey)::BIGINT FROM l"""
)
def cascade_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region's nations go, with them customers, orders and lines, and suppliers, which lines forget: what is left of each table."""
    names = {"nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "orders": "o_orderkey", "lineitem": "l_suppkey"}
    tables = {n: table(spark, sf_dir, n) for n in names}
    refs = [
        C.Reference("customer", "nation", {"c_nationkey": "n_nationkey"}), C.Reference("supplier", "nation", {"s_nationkey": "n_nationkey"}), C.Reference("orders", "customer", {"o_custkey": "c_custkey"}),
        C.Reference("lineitem", "orders", {"l_orderkey": "o_orderkey"}), C.Reference("lineitem", "supplier", {"l_suppkey": "s_suppkey"}, forget=True),
    ]
    out = None
    for name, df in C.deleted(tables, refs, {"nation": tables["nation"].where("n_regionkey = 1").select("n_nationkey")}).items():
        one = df.agg(F.count("*").alias("n"), F.sum(names[name]).cast("long").alias("keys")).withColumn("name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    """WITH l AS (SELECT DISTINCT l_partkey AS k, l_orderkey AS v, l_quantity FROM lineitem), old AS (SELECT k, min(v) AS v FROM l WHERE l_quantity < 3 GROUP BY k), new AS (SELECT k, v FROM l WHERE l_quantity >= 3)
SELECT 'first' AS rule, k, v FROM old UNION ALL SELECT 'first', k, min(v) FROM new WHERE k NOT IN (SELECT k FROM old) GROUP BY k
UNION ALL SELECT 'last', k, v FROM old WHERE k NOT IN (SELECT k FROM new) UNION ALL SELECT 'last', k, max(v) FROM new GROUP BY k"""
)
def keyed_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' orders merged into those of small quantities, once keeping the first and once the last of each part."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_orderkey").alias("v"), "l_quantity")
    old = lines.where("l_quantity < 3").groupBy("k").agg(F.min("v").alias("v"))
    new = lines.where("l_quantity >= 3").select("k", "v")
    first, last = C.added_or_ignored(old, new, ["k"], [F.col("v")]), C.added_or_replaced(old, new, ["k"], [F.col("v")])
    return first.select(F.lit("first").alias("rule"), "k", "v").unionByName(last.select(F.lit("last").alias("rule"), "k", "v"))


# Orders as recommendations for customers' policies: a customer and a status make an id, every third order stands in the ledger.


@query(
    """WITH r AS (SELECT o_custkey || '-' || o_orderstatus AS id, o_custkey AS v, o_orderkey AS n FROM orders), lg AS (SELECT id, v, min(n) AS n FROM r WHERE n % 3 = 0 GROUP BY id, v),
fresh AS (SELECT id, v, min(n) AS n FROM r WHERE n % 3 <> 0 AND id NOT IN (SELECT id FROM lg) GROUP BY id, v)
SELECT id AS recommendation_id, n AS "at", CASE WHEN row_number() OVER (PARTITION BY v ORDER BY n DESC, id DESC) = 1 THEN 'open' ELSE 'superseded' END AS status FROM fresh
UNION ALL SELECT id, n, CASE n % 4 WHEN 0 THEN 'rejected' WHEN 1 THEN CASE WHEN v IN (SELECT v FROM fresh) THEN 'superseded' ELSE 'open' END WHEN 2 THEN 'accepted' ELSE 'deferred' END FROM lg"""
)
def recommendation_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New recommendations are taken into a ledger: known ids stay as they are, rejected ones too, and the newest of a version is open."""
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.concat_ws("-", "o_custkey", "o_orderstatus").alias("recommendation_id"), (F.col("o_custkey") % 40).alias("policy_id"), F.col("o_custkey").alias("version_id"), F.lit("retain").alias("operation"), F.lit(None).cast("string").alias("rollback_to"), key.alias("at"),
    )
    known = rows.where("at % 3 = 0").groupBy("recommendation_id", "policy_id", "version_id", "operation", "rollback_to").agg(F.min("at").alias("at"))
    at = F.col("at") % 4
    known = known.withColumn("status", F.when(at == 0, "rejected").when(at == 1, "open").when(at == 2, "accepted").otherwise("deferred"))
    return A.ledger_after(known, rows.where("at % 3 <> 0")).select("recommendation_id", "at", "status")


@query(
    """WITH RECURSIVE e AS (SELECT f, max_by(t, o_orderkey) AS t FROM (SELECT o_custkey AS f, o_custkey + 1 + o_orderkey % 3 AS t, o_orderkey FROM orders WHERE o_custkey % 100 < 97) x GROUP BY f),
w AS (SELECT f AS version, t AS survivor, CAST(1 AS BIGINT) AS steps FROM e UNION ALL SELECT w.version, e.t, w.steps + 1 FROM w JOIN e ON w.survivor = e.f)
SELECT version, arg_max(survivor, steps) AS survivor, max(steps) AS steps FROM w GROUP BY version"""
)
def merge_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as policy versions, each merged into one of the next three by its orders, the latest counting: where the chains end."""
    o = table(spark, sf_dir, "orders").where("o_custkey % 100 < 97")
    lineage = o.select(F.lit("merged_from").alias("relation"), F.col("o_custkey").alias("from_version"), (F.col("o_custkey") + 1 + F.col("o_orderkey") % 3).alias("to_version"), F.col("o_orderkey").alias("lineage_id"))
    return A.survivors(lineage).select("version", "survivor", "steps")


def _runs_sql() -> str:
    of = PQ.ORACLE_SQL
    figures = (
        "SELECT (SELECT count(DISTINCT user_id) FROM events) AS considered, (SELECT count(*) FROM (" + of["union_detectors"] + ") a) + (SELECT count(*) FROM (" + of["contradictions"] + ") b) AS found, "
        "(SELECT count(DISTINCT group_key) FROM (" + of["union_detectors"] + ") c) AS clusters, (SELECT count(*) FROM (" + of["experience_groups"] + ") d WHERE status = 'candidate') AS candidates, "
        "(SELECT count(*) FROM (" + of["experience_groups"] + ") e WHERE status = 'needs_more_evidence') AS more"
    )
    return f"""WITH f AS MATERIALIZED ({figures})
SELECT 1 AS run, considered AS trajectories_considered, considered AS trajectories_analyzed, found AS occurrences_found, clusters AS clusters_formed, candidates, more AS needs_more_evidence FROM f
UNION ALL SELECT 2, considered, 0, found, clusters, candidates, more FROM f"""


@query(_runs_sql())
def extraction_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over users as trajectories, the second with nothing changed: the records that the runs leave."""
    root = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    events = session_events(spark, sf_dir)
    with Pass(spark, root) as p:
        p.put("events", events)
        # The content of a trajectory is known by its number of events and their keys.
        p.put("trajectories", events.groupBy("trajectory_id").agg(F.min("project_id").alias("project_id"), F.concat_ws("-", F.count("*"), F.sum("k")).alias("content_hash"), F.max("ts").alias("last_activity")))
    for _ in range(2):
        with Pass(spark, root) as p:
            R.extraction_run(p, now=datetime(2024, 6, 1))
    runs = version(spark, root)["experience_runs"]
    n = F.when(F.col("trajectories_analyzed") == 0, 2).otherwise(1).alias("run")
    return runs.select(n, "trajectories_considered", "trajectories_analyzed", "occurrences_found", "clusters_formed", "candidates", "needs_more_evidence")


@query(
    """WITH p AS (SELECT o_orderkey, o_orderkey % 5 AS i, o_orderkey % 7 AS j, o_orderkey % 3 AS way FROM orders)
SELECT CAST(o_orderkey AS VARCHAR) AS review_id, CASE WHEN j <= i AND way < 2 THEN '/w/p/' || repeat('a/', i - j) || 'x.md' WHEN way = 2 AND j <= i THEN '/w/p/real/' || repeat('a/', i - j) || 'x.md' WHEN way = 2 AND j = i + 1 THEN '/w/p/x.md' END AS target_path,
CASE WHEN j > i AND (way < 2 OR j > i + 1) THEN 'escapes' END AS error FROM p"""
)
def review_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that go down and up again, with dots and doubled slashes, absolute ones, and ones behind a link to another folder of the project."""
    key = F.col("o_orderkey")
    inner = F.concat(F.repeat(F.lit("a//"), (key % 5).cast("int")), F.lit("./"), F.repeat(F.lit("../"), (key % 7).cast("int")), F.lit("x.md"))
    target = F.when(key % 3 == 0, inner).when(key % 3 == 1, F.concat(F.lit("/w/p/"), inner)).otherwise(F.concat(F.lit("to/"), inner))
    reviews = table(spark, sf_dir, "orders").select(key.cast("string").alias("review_id"), F.lit("project_rule").alias("placement"), F.lit("codex").alias("agent"), F.lit("/w/p").alias("project_root"), target.alias("target"))
    links = spark.createDataFrame([("/w/p/to", "real")], "link string, to string")
    return TG.targets(reviews, links).select("review_id", "target_path", "error")


@query(
    """WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem), one AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS f FROM l GROUP BY 1, 2),
ev AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2), alt AS (SELECT l_orderkey, string_agg(l_linenumber || f, ',' ORDER BY l_linenumber) AS alternatives, min(l_linenumber) AS top FROM one GROUP BY 1),
ch AS (SELECT o_orderkey, o_orderstatus, alternatives, CASE WHEN o_orderkey % 4 = 0 AND EXISTS (SELECT 1 FROM one WHERE l_orderkey = o_orderkey AND l_linenumber = 2) THEN 2 ELSE top END AS chosen FROM orders LEFT JOIN alt ON l_orderkey = o_orderkey)
SELECT o_orderkey, coalesce(alternatives, '') AS alternatives, chosen AS rank, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 3 = 0 THEN 'own' WHEN chosen IS NULL THEN '' ELSE f END AS content, coalesce(n, 0) AS evidence, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 5 ELSE 0 END AS history
FROM ch LEFT JOIN one ON one.l_orderkey = o_orderkey AND one.l_linenumber = chosen LEFT JOIN ev ON ev.l_orderkey = o_orderkey AND ev.l_linenumber = chosen"""
)
def review_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as proposal sets, their line numbers as proposals and lines as evidence; every fourth order is reviewed, with up to four actions."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    key = F.col("o_orderkey")
    sets = orders.select(key.alias("group_key"))
    place = F.concat(F.lit("p"), F.col("l_linenumber").cast("string")).alias("placement")
    proposals = lines.groupBy(F.col("l_orderkey").alias("group_key"), place, F.col("l_linenumber").alias("rank")).agg(F.lit(0.5).alias("score"), F.min("l_returnflag").alias("content"))
    experiences = orders.select(key.alias("group_key"), F.lit("t").alias("title"), F.col("o_orderstatus").alias("pattern"), F.lit("l").alias("lesson"))
    evidence = lines.select(F.col("l_orderkey").alias("group_key"), place, F.col("l_partkey").alias("occurrence_id"), F.lit("support").alias("role"))
    reviewed = orders.where(key % 4 == 0)
    reviews = reviewed.select(key.alias("review_id"), key.alias("group_key"), F.lit("p2").alias("placement"), F.lit("accepted").alias("status"), F.when(key % 3 == 0, "own").alias("content_override"))
    actions = reviewed.select(key.alias("review_id"), F.explode(F.sequence(F.lit(0), (key % 5).cast("int"))).alias("seq")).where("seq > 0").withColumn("action", F.lit("edit"))
    shown = TG.payloads(sets, proposals, experiences, evidence, reviews, actions)
    alternatives = F.array_join(F.transform("alternatives", lambda a: F.concat(a["rank"].cast("string"), a["content"])), ",")
    return shown.select(
        F.col("group_key").alias("o_orderkey"), alternatives.alias("alternatives"), "proposal.rank", F.col("proposal.effective_content").alias("content"),
        F.size("evidence").cast("long").alias("evidence"), F.size("history").cast("long").alias("history"),
    )


@query(
    """WITH k AS (SELECT s_suppkey AS id, s_name AS name, s_nationkey AS root, CASE WHEN s_suppkey % 3 = 0 THEN s_name END AS remote, CASE WHEN s_suppkey % 4 = 0 THEN 'archived' ELSE 'missing' END AS status FROM supplier),
f AS (SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_suppkey % 5 < 3 UNION SELECT s_suppkey + 1000000 FROM supplier WHERE s_suppkey % 10 = 7)
SELECT id AS project_id, CASE WHEN id IN (FROM f) THEN 'n' || id ELSE name END AS name, CASE WHEN id IN (FROM f) AND id % 2 = 0 THEN 'r' ELSE remote END AS git_remote, CASE WHEN id IN (FROM f) THEN 1 ELSE 0 END AS last_seen_at, CASE WHEN id IN (FROM f) AND status <> 'archived' THEN 'active' ELSE status END AS status FROM k
UNION ALL SELECT id, 'n' || id, CASE WHEN id % 2 = 0 THEN 'r' END, 1, 'active' FROM f WHERE id >= 1000000"""
)
def project_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as known projects, those of lines found again, some new: names, remotes and states after it."""
    s, key = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    known = s.select(
        key.alias("project_id"), F.col("s_name").alias("name"), F.concat(F.lit("/"), key.cast("string")).alias("root"), F.when(key % 3 == 0, F.col("s_name")).alias("git_remote"), F.lit(0).alias("created_at"), F.lit(0).alias("last_seen_at"),
        F.when(key % 4 == 0, "archived").otherwise("missing").alias("status"),
    )
    ids = table(spark, sf_dir, "lineitem").where("l_suppkey % 5 < 3").select(F.col("l_suppkey").alias("project_id")).distinct().unionByName(s.where(key % 10 == 7).select((key + 1_000_000).alias("project_id")))
    i = F.col("project_id")
    found = ids.select("project_id", F.concat(F.lit("n"), i.cast("string")).alias("name"), F.concat(F.lit("/"), i.cast("string")).alias("root"), F.when(i % 2 == 0, "r").alias("git_remote"))
    return LG.projects_after(known, found, F.lit(1)).select("project_id", "name", "git_remote", "last_seen_at", "status")


@query(
    """WITH r AS (SELECT l_orderkey AS pair, l_linenumber % 2 AS side, CASE WHEN l_partkey % 5 > 0 THEN l_quantity END AS d, CASE WHEN l_partkey % 3 > 0 THEN l_partkey END AS t FROM lineitem),
p AS (SELECT pair, max(d) FILTER (side = 1) AS bd, max(d) FILTER (side = 0) AS cd, max(t) FILTER (side = 1) AS bt, max(t) FILTER (side = 0) AS ct FROM r GROUP BY pair)
SELECT pair, bd AS baseline_duration_ms, cd AS candidate_duration_ms, cd - bd AS duration_delta_ms, bt AS baseline_tokens, ct AS candidate_tokens, bt IS NOT NULL AND ct IS NOT NULL AS tokens_available, ct AS policy_bytes FROM p"""
)
def metrics_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pairs, odd and even lines as their two runs: durations, tokens and sizes, some unknown."""
    x = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("pair"), F.when(F.col("l_linenumber") % 2 == 1, "baseline").otherwise("candidate").alias("condition"), F.when(F.col("l_partkey") % 5 > 0, F.col("l_quantity")).alias("duration_ms"),
        F.when(F.col("l_partkey") % 3 > 0, F.col("l_partkey")).alias("tokens"), F.when(F.col("l_partkey") % 3 > 0, F.col("l_partkey")).alias("policy_bytes"),
    )
    return E.metrics_delta(x)
