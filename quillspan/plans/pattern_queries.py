"""Queries of the sequence detectors, groups and placements over the events table, with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators import experiences as X
from quillspan.operators import placement as P
from quillspan.operators import sequences as S
from quillspan.plans.group_sql import group_oracles
from quillspan.plans.mapping import EVENTS_SQL, session_events
from quillspan.tables import snapshot

KEYS = ["trajectory_id", "group_key", "classification", "start_sequence", "end_sequence"]


def _base(spark: SparkSession, sf_dir: str, detector: str) -> DataFrame:
    return S.prepared(session_events(spark, sf_dir), detectors=(detector,))


def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events, occurrences and profiles; the last two as snapshots, since several operators read them."""
    events = session_events(spark, sf_dir)
    seen = events.groupBy("trajectory_id").agg(F.max("ts").alias("last_activity"))
    found = snapshot(S.occurrences(events, S.final_status(events)), "occurrences")
    return events, found, snapshot(S.profiles(events).join(seen, "trajectory_id"), "profiles")


def failure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.failure_repairs(_base(spark, sf_dir, "failure_repair")).select(*KEYS, F.array_join("antecedents", ",").alias("antecedents"))


def correction_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.correction_repairs(_base(spark, sf_dir, "correction_repair")).select(*KEYS, "detail")


def repeated_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.repeated_failures(_base(spark, sf_dir, "repeated_failure"), S.final_status(session_events(spark, sf_dir))).select(*KEYS, "failure_family")


def file_change_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.file_changes(_base(spark, sf_dir, "file_change"), S.final_status(session_events(spark, sf_dir))).select(*KEYS, F.col("detail").alias("from_context"))


def union_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = session_events(spark, sf_dir)
    return S.occurrences(events, S.final_status(events)).select(*KEYS, "pattern")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = S.profiles(session_events(spark, sf_dir))
    return p.select("trajectory_id", *[F.array_join(c, ",").alias(c) for c in ("edit_contexts", "clean_passes", "failed_families")], "max_sequence")


def final_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.final_status(session_events(spark, sf_dir)).select("trajectory_id", "final_status")


def repair_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.repair_notes(session_events(spark, sf_dir))


def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found, sides = _found(spark, sf_dir)
    return X.contradictions(found, sides).select("trajectory_id", "group_key", "end_sequence")


def _experiences(found: DataFrame, sides: DataFrame) -> DataFrame:
    return X.experiences(found, sides, F.lit("2024-06-01 00:00:00").cast("timestamp_ntz"))


def experience_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found, sides = _found(spark, sf_dir)
    return _experiences(found, sides).select(
        "group_key", "pattern", "support_count", "ambiguous_count", "contradiction_count", "occurrence_count", "project_count", "support_projects", "status",
        F.col("confidence.score").alias("confidence"),
    )


def experience_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found, sides = _found(spark, sf_dir)
    return X.summaries(_experiences(found, sides)).select("group_key", "title", "lesson", F.array_join("contexts", ",").alias("contexts"))


def _with_ids(found: DataFrame) -> DataFrame:
    return found.withColumn("occurrence_id", F.concat_ws("|", "trajectory_id", "group_key", "classification"))


def span_events_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = session_events(spark, sf_dir)
    found = S.failure_repairs(S.prepared(events, detectors=("failure_repair",)))
    spans = P.span_events(_with_ids(found), events.drop("project_id"))
    return spans.groupBy("group_key").agg(F.count("*").alias("n_events"), F.count_distinct("type").alias("n_types"), F.count_distinct("path").alias("n_paths"))


def _evidence(found: DataFrame, sides: DataFrame) -> DataFrame:
    against = X.contradictions(found, sides).withColumn("repair_context", F.col("context"))
    return _with_ids(found.drop("detector").unionByName(against.drop("family", "context"), allowMissingColumns=True))


def scope_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, found, _ = _found(spark, sf_dir)
    return P.inferred_scopes(_with_ids(found.where("classification = 'support'")), events.drop("project_id"))


def placement_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, found, sides = _found(spark, sf_dir)
    evidence = snapshot(_evidence(found, sides), "evidence")
    groups = snapshot(_experiences(found, sides), "experiences")
    return P.proposals(P.features(evidence, groups, events.drop("project_id")))


QUERIES = {
    f.__name__: f
    for f in (
        failure_repair, correction_repair, repeated_failure, file_change_pairs, union_detectors, profiles, final_status, repair_notes, contradictions,
        experience_groups, experience_summaries, span_events_range_join, scope_inference, placement_rank,
    )
}

STATUS = """
v AS (SELECT trajectory_id, arg_max(type, sequence) AS last FROM t WHERE type LIKE '%\\_pass' ESCAPE '\\' OR type LIKE '%\\_fail' ESCAPE '\\' GROUP BY 1),
tail AS (SELECT trajectory_id, arg_max(CASE WHEN type = 'command' THEN exit_code <> 0 ELSE FALSE END, sequence) AS bad FROM t
  WHERE type LIKE '%\\_pass' ESCAPE '\\' OR type LIKE '%\\_fail' ESCAPE '\\' OR (type = 'command' AND exit_code IS NOT NULL) GROUP BY 1),
status AS (SELECT u.trajectory_id, CASE WHEN v.last LIKE '%fail' THEN 'partial' WHEN v.last LIKE '%pass' THEN 'success' WHEN tail.bad THEN 'partial' ELSE 'unknown' END AS final_status
  FROM (SELECT DISTINCT trajectory_id FROM t) u LEFT JOIN v USING (trajectory_id) LEFT JOIN tail USING (trajectory_id))
"""
NEXT = """
f AS (SELECT * FROM t WHERE type IN ('test_fail', 'lint_fail', 'build_fail')),
np AS (SELECT f.trajectory_id, f.sequence AS fs, f.fam, min(p.sequence) AS ps FROM f JOIN t p ON p.trajectory_id = f.trajectory_id AND p.type = f.fam || '_pass'
  AND p.sequence > f.sequence AND p.sequence <= f.sequence + 20 GROUP BY 1, 2, 3)
"""


def _dominant(source: str, keys: str) -> str:
    """Context by keys of rows (keys, ctx) in `source`, ctx null where there was no edit."""
    return f"""
cc AS (SELECT {keys}, ctx, count(*) AS n FROM {source} WHERE ctx IS NOT NULL GROUP BY {keys}, ctx),
cm AS (SELECT {keys}, max(n) AS top FROM cc GROUP BY {keys}),
dom AS (SELECT {keys}, CASE WHEN count(*) > 1 THEN 'mixed' ELSE max(ctx) END AS ctx FROM cc JOIN cm USING ({keys}) WHERE n = top GROUP BY {keys})
"""


FR = f"""{EVENTS_SQL}, {NEXT},
b AS (SELECT np.trajectory_id, np.fs, e.ctx, e.migration FROM np JOIN t e ON e.trajectory_id = np.trajectory_id AND e.sequence > np.fs AND e.sequence < np.ps WHERE e.ctx IS NOT NULL OR e.migration),
{_dominant('b', 'trajectory_id, fs')},
mig AS (SELECT trajectory_id, fs, bool_or(migration) AS m FROM b GROUP BY 1, 2),
fr AS (SELECT np.trajectory_id, np.fs AS start_sequence, np.ps AS end_sequence, np.fam, CASE WHEN mig.m THEN 'migration' ELSE coalesce(dom.ctx, 'other') END AS ctx
  FROM np JOIN mig USING (trajectory_id, fs) LEFT JOIN dom USING (trajectory_id, fs)),
a1 AS (SELECT fr.trajectory_id, fr.start_sequence, e.ctx, min(e.sequence) AS s FROM fr JOIN t e ON e.trajectory_id = fr.trajectory_id AND e.ctx IS NOT NULL
  AND e.sequence >= fr.start_sequence - 20 AND e.sequence < fr.start_sequence GROUP BY 1, 2, 3),
an AS (SELECT trajectory_id, start_sequence, string_agg(ctx, ',' ORDER BY s) AS antecedents FROM a1 GROUP BY 1, 2)"""
HC = f"""{EVENTS_SQL}, {NEXT},
c AS (SELECT trajectory_id, sequence AS cs, summary FROM t WHERE type = 'human_correction' AND (k // 6) % 3 = 0),
cf AS (SELECT c.trajectory_id, c.cs, min(f.sequence) AS fs FROM c JOIN f ON f.trajectory_id = c.trajectory_id AND f.sequence > c.cs AND f.sequence <= c.cs + 20 GROUP BY 1, 2),
h AS (SELECT cf.trajectory_id, cf.cs, np.fs, np.ps, np.fam FROM cf JOIN np USING (trajectory_id, fs) WHERE np.ps <= cf.cs + 20),
b AS (SELECT h.trajectory_id, h.cs, e.ctx, e.migration FROM h JOIN t e ON e.trajectory_id = h.trajectory_id AND e.sequence > h.fs AND e.sequence <= h.ps WHERE e.ctx IS NOT NULL OR e.type = 'command'),
{_dominant('b', 'trajectory_id, cs')},
mig AS (SELECT trajectory_id, cs, bool_or(migration) AS m FROM b GROUP BY 1, 2),
hc AS (SELECT h.trajectory_id, h.cs AS start_sequence, h.ps AS end_sequence, h.fam, coalesce(dom.ctx, CASE WHEN mig.m THEN 'migration' ELSE 'other' END) AS ctx
  FROM h JOIN mig USING (trajectory_id, cs) LEFT JOIN dom USING (trajectory_id, cs))"""
RF = f"""{EVENTS_SQL}, {STATUS},
s AS (SELECT trajectory_id, sequence, CASE WHEN type <> 'error' THEN fam END AS fam, CASE k % 5 WHEN 0 THEN 'assertionerror: expected N but got N'
  WHEN 1 THEN 'modulenotfounderror: no module named ''foo''' WHEN 3 THEN 'typeerror: x is not a function at' END AS sig FROM t WHERE summary IS NOT NULL AND type <> 'human_correction'),
hits AS (SELECT trajectory_id, sig, min(sequence) AS lo, max(sequence) AS hi, count(*) AS n, arg_min(coalesce(fam, '-'), sequence) AS fam FROM s WHERE sig IS NOT NULL GROUP BY 1, 2),
r AS (SELECT hits.*, status.final_status = 'partial' AS bad, EXISTS (SELECT 1 FROM t p WHERE p.trajectory_id = hits.trajectory_id AND p.type = hits.fam || '_pass' AND p.sequence > hits.hi) AS later
  FROM hits JOIN status USING (trajectory_id)),
rf AS (SELECT trajectory_id, 'rf::' || sig AS group_key, CASE WHEN n < 2 AND NOT bad THEN 'ambiguous' ELSE 'support' END AS classification, lo AS start_sequence, hi AS end_sequence,
  nullif(fam, '-') AS failure_family FROM r WHERE NOT later OR bad)"""

# File changes: candidate pairs, then each kind of pair and each first change once, in order, by recursion over three steps.
FC = f"""{EVENTS_SQL}, {STATUS},
ch AS (SELECT trajectory_id, sequence, ctx FROM t JOIN status USING (trajectory_id) WHERE type IN ('file_edit', 'file_create') AND ctx IN ('model', 'database', 'migration') AND final_status = 'success'),
cand AS (SELECT a.trajectory_id, a.sequence AS a, a.ctx AS actx, b.sequence AS b, b.ctx AS bctx, (SELECT p.fam FROM t p WHERE p.trajectory_id = b.trajectory_id AND p.type LIKE '%pass'
   AND p.sequence > b.sequence AND p.sequence <= b.sequence + 20 ORDER BY p.sequence LIMIT 1) AS fam
  FROM ch a JOIN ch b ON a.trajectory_id = b.trajectory_id AND b.sequence > a.sequence AND b.sequence - a.sequence <= 20
  WHERE (a.ctx = 'model' AND b.ctx IN ('migration', 'database')) OR (a.ctx = 'database' AND b.ctx = 'migration')),
ok AS (SELECT * FROM cand WHERE fam IS NOT NULL),
p1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trajectory_id ORDER BY a, b) AS rn FROM ok) x WHERE rn = 1),
p2 AS (SELECT * FROM (SELECT ok.*, row_number() OVER (PARTITION BY ok.trajectory_id ORDER BY ok.a, ok.b) AS rn FROM ok JOIN p1 ON p1.trajectory_id = ok.trajectory_id
  WHERE ok.a > p1.a AND ok.actx || ok.bctx <> p1.actx || p1.bctx) x WHERE rn = 1),
p3 AS (SELECT * FROM (SELECT ok.*, row_number() OVER (PARTITION BY ok.trajectory_id ORDER BY ok.a, ok.b) AS rn FROM ok JOIN p1 ON p1.trajectory_id = ok.trajectory_id
  JOIN p2 ON p2.trajectory_id = ok.trajectory_id WHERE ok.a > p2.a AND ok.actx || ok.bctx NOT IN (p1.actx || p1.bctx, p2.actx || p2.bctx)) x WHERE rn = 1),
fc AS (SELECT trajectory_id, 'fr::' || bctx || '::' || fam AS group_key, 'support' AS classification, a AS start_sequence, b AS end_sequence, actx AS from_context
  FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3) x)"""


ORACLE_SQL = {
    "file_change_pairs": FC + " SELECT * FROM fc",
    "span_events_range_join": FR + """ SELECT 'fr::' || fr.ctx || '::' || fr.fam AS group_key, count(*) AS n_events, count(DISTINCT t.type) AS n_types, count(DISTINCT t.path) AS n_paths
  FROM fr JOIN t ON t.trajectory_id = fr.trajectory_id AND t.sequence BETWEEN fr.start_sequence AND fr.end_sequence GROUP BY 1""",
    "failure_repair": FR + """ SELECT fr.trajectory_id, 'fr::' || ctx || '::' || fam AS group_key, CASE WHEN ctx IN ('other', 'mixed') THEN 'ambiguous' ELSE 'support' END AS classification,
  start_sequence, end_sequence, coalesce(antecedents, '') AS antecedents FROM fr LEFT JOIN an USING (trajectory_id, start_sequence)""",
    "correction_repair": HC + """ SELECT trajectory_id, 'hc::' || ctx || '::' || fam AS group_key, CASE WHEN ctx IN ('other', 'mixed') THEN 'ambiguous' ELSE 'support' END AS classification,
  start_sequence, end_sequence, 'please use the migration instead of editing' AS detail FROM hc""",
    "repeated_failure": RF + " SELECT * FROM rf",
    "profiles": EVENTS_SQL + """,
fl AS (SELECT trajectory_id, fam, min(sequence) AS s FROM t WHERE type LIKE '%fail' GROUP BY 1, 2),
cp AS (SELECT DISTINCT t.trajectory_id, t.fam FROM t LEFT JOIN fl ON fl.trajectory_id = t.trajectory_id AND fl.fam = t.fam WHERE t.type LIKE '%pass' AND (fl.s IS NULL OR fl.s > t.sequence)),
a AS (SELECT trajectory_id, string_agg(DISTINCT ctx, ',' ORDER BY ctx) AS edit_contexts, max(sequence) AS max_sequence FROM t GROUP BY 1),
b AS (SELECT trajectory_id, string_agg(fam, ',' ORDER BY fam) AS clean_passes FROM cp GROUP BY 1),
c AS (SELECT trajectory_id, string_agg(fam, ',' ORDER BY fam) AS failed_families FROM fl GROUP BY 1)
SELECT trajectory_id, coalesce(edit_contexts, '') AS edit_contexts, coalesce(clean_passes, '') AS clean_passes, coalesce(failed_families, '') AS failed_families, max_sequence
FROM a LEFT JOIN b USING (trajectory_id) LEFT JOIN c USING (trajectory_id)""",
    "final_status": f"{EVENTS_SQL}, {STATUS} SELECT trajectory_id, final_status FROM status",
    "repair_notes": EVENTS_SQL + """,
n AS (SELECT f.trajectory_id, f.sequence AS fs, f.fam, min(p.sequence) AS ps FROM t f JOIN t p ON p.trajectory_id = f.trajectory_id AND p.type = f.fam || '_pass' AND p.sequence > f.sequence
  WHERE f.type LIKE '%\\_fail' ESCAPE '\\' GROUP BY 1, 2, 3)
SELECT trajectory_id, ps AS pass_sequence, max(fs) AS fail_sequence, arg_max(fam, fs) AS family FROM n GROUP BY 1, 2""",
}
ORACLE_SQL |= group_oracles(FR, HC, RF, FC, ORACLE_SQL["profiles"])
