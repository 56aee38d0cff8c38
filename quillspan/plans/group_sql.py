"""SQL of the same rows for queries over groups of occurrences: union of detectors, contradictions, groups, scopes, placements."""

from __future__ import annotations

from quillspan.functions import values as V
from quillspan.operators.experiences import PATTERN_RANK
from quillspan.plans.mapping import EVENTS_SQL


def _texts(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _place(column: str, values) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(values)) + " END"


def group_oracles(fr: str, hc: str, rf: str, fc: str, profiles: str) -> dict[str, str]:
    """name -> SQL. fr, hc, rf and fc are the detectors' common table expressions, profiles a whole query."""
    occurrences = f"""
WITH frx AS ({fr} SELECT fr.*, an.antecedents FROM fr LEFT JOIN an USING (trajectory_id, start_sequence)), hcx AS ({hc} SELECT * FROM hc), rfx AS ({rf} SELECT * FROM rf),
fcx AS ({fc} SELECT * FROM fc), tt AS ({EVENTS_SQL} SELECT * FROM t), prof AS (SELECT * REPLACE (string_split(edit_contexts, ',') AS edit_contexts, string_split(clean_passes, ',') AS clean_passes) FROM ({profiles}) p),
early AS (
  SELECT trajectory_id, 0 AS detector, 'failure_repair' AS pattern, 'fr::' || ctx || '::' || fam AS group_key, CASE WHEN ctx IN ('other', 'mixed') THEN 'ambiguous' ELSE 'support' END AS classification,
    start_sequence, end_sequence, ctx AS repair_context, coalesce(string_split(antecedents, ','), []::VARCHAR[]) AS antecedents FROM frx
  UNION ALL SELECT trajectory_id, 1, 'human_correction_repair', 'hc::' || ctx || '::' || fam, CASE WHEN ctx IN ('other', 'mixed') THEN 'ambiguous' ELSE 'support' END, start_sequence, end_sequence, ctx, []::VARCHAR[] FROM hcx
  UNION ALL SELECT trajectory_id, 2, 'repeated_failure', group_key, classification, start_sequence, end_sequence, NULL, []::VARCHAR[] FROM rfx),
both_ AS (SELECT * FROM early UNION ALL SELECT trajectory_id, 3, 'file_change_pattern', group_key, classification, start_sequence, end_sequence, split_part(group_key, '::', 2), [from_context]
  FROM fcx WHERE NOT EXISTS (SELECT 1 FROM early x WHERE x.trajectory_id = fcx.trajectory_id AND x.group_key = fcx.group_key)),
occ AS (SELECT *, trajectory_id % 4 AS project_id, trajectory_id || '|' || group_key || '|' || classification AS occurrence_id
  FROM (SELECT *, row_number() OVER (PARTITION BY trajectory_id, group_key, classification ORDER BY detector, start_sequence) AS n FROM both_) x WHERE n = 1)
"""
    contradictions = occurrences + f""",
g0 AS (SELECT group_key, count(*) AS n, count(*) FILTER (classification = 'support') AS s FROM occ GROUP BY 1 HAVING n >= 2 AND s > 0),
g1 AS (SELECT DISTINCT group_key, split_part(group_key, '::', 2) AS context, split_part(group_key, '::', 3) AS family, unnest(antecedents) AS edited FROM occ WHERE group_key IN (SELECT group_key FROM g0) AND group_key LIKE 'fr::%'),
g2 AS (SELECT * FROM g1 WHERE family IN ({_texts(V.FAMILIES)}) AND context NOT IN ('other', 'mixed', '-') AND edited NOT IN ('', 'other', 'mixed')),
against AS (SELECT DISTINCT p.trajectory_id, g2.group_key, greatest(1, p.max_sequence) AS end_sequence, context FROM prof p JOIN g2 ON list_contains(p.clean_passes, g2.family) AND list_contains(p.edit_contexts, g2.edited)
  AND NOT list_contains(p.edit_contexts, g2.context) WHERE NOT EXISTS (SELECT 1 FROM occ WHERE occ.group_key = g2.group_key AND occ.trajectory_id = p.trajectory_id))
"""
    days = "".join(f" WHEN epoch_us(TIMESTAMP '2024-06-01') - epoch_us(max(ts)) <= {most} * 86400000000 THEN {factor}" for most, factor in V.RECENCY_DAYS)
    w = V.CONFIDENCE_WEIGHTS
    groups = contradictions + f""",
ev AS (SELECT group_key, trajectory_id, trajectory_id % 4 AS project_id, classification FROM occ UNION ALL SELECT group_key, trajectory_id, trajectory_id % 4, 'contradiction' FROM against),
seen AS (SELECT trajectory_id, max(ts) AS ts FROM tt GROUP BY 1),
cnt AS (SELECT group_key, count(*) FILTER (classification = 'support') AS support_count, count(*) FILTER (classification = 'ambiguous') AS ambiguous_count, count(*) FILTER (classification = 'contradiction') AS contradiction_count,
  count(*) AS occurrence_count, count(DISTINCT project_id) AS project_count, count(DISTINCT CASE WHEN classification = 'support' THEN project_id END) AS support_projects,
  CAST(CASE{days} ELSE {V.RECENCY_OLD} END AS DOUBLE) AS recency FROM ev JOIN seen USING (trajectory_id) GROUP BY 1),
ctx AS (SELECT group_key, string_agg(DISTINCT c, ',' ORDER BY c) AS contexts FROM (SELECT group_key, repair_context AS c FROM occ UNION ALL SELECT group_key, unnest(antecedents) FROM occ) x WHERE c NOT IN ('other', '') GROUP BY 1),
nam AS (SELECT group_key, arg_min(pattern, {_place('pattern', PATTERN_RANK)}) AS pattern FROM occ GROUP BY 1),
exs AS (SELECT *, support_count + ambiguous_count AS positive, CASE WHEN support_count + contradiction_count > 0 THEN support_count / (support_count + contradiction_count) ELSE 0.0 END AS ratio FROM cnt JOIN nam USING (group_key) LEFT JOIN ctx USING (group_key)
  WHERE support_count > 0 AND support_count + ambiguous_count >= 2),
grp AS (SELECT *, CASE WHEN positive >= 3 AND project_count >= 1 THEN 'candidate' ELSE 'needs_more_evidence' END AS status,
  round(CAST({w['support']} AS DOUBLE) * ratio + CAST({w['recurrence']} AS DOUBLE) * least(1.0, positive / {V.RECURRENCE_FULL}::DOUBLE) + CAST({w['cross_project']} AS DOUBLE) * least(1.0, greatest(0, support_projects - 1) / {V.CROSS_PROJECT_FULL}::DOUBLE)
    + CAST({w['recency']} AS DOUBLE) * recency, 2) AS confidence FROM exs)
"""
    title = """CASE pattern WHEN 'failure_repair' THEN 'A failing ' || fam || ' run is repaired in ' || c WHEN 'human_correction_repair' THEN 'A correction leads to work in ' || c || ' until ' || fam || ' passes'
WHEN 'file_change_pattern' THEN 'Changes that end in ' || c || ' before ' || fam || ' passes' ELSE 'A failure keeps coming back: ' || c END"""
    ext = r"lower(regexp_extract(path, '(?:^|/)\.*[^/.][^/]*?(\.[^/.]*)$', 1))"
    language = f"CASE {ext} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.LANGUAGES.items()) + " END"
    scopes = """,
sup AS (SELECT * FROM occ WHERE classification = 'support'),
span AS (SELECT sup.group_key, sup.occurrence_id, tt.sequence, tt.type, tt.path, tt.command FROM sup JOIN tt ON tt.trajectory_id = sup.trajectory_id AND tt.sequence BETWEEN sup.start_sequence AND sup.end_sequence),
""" + rf"""
val AS (SELECT group_key, occurrence_id, 'directory' AS t, nullif(regexp_extract(path, '^(.*)/[^/]*$', 1), '') AS v FROM span WHERE path IS NOT NULL
  UNION ALL SELECT group_key, occurrence_id, 'extension', nullif({ext}, '') FROM span WHERE path IS NOT NULL UNION ALL SELECT group_key, occurrence_id, 'language', {language} FROM span WHERE path IS NOT NULL
  UNION ALL SELECT group_key, occurrence_id, 'command', CASE command WHEN 'alembic upgrade head' THEN 'migration' WHEN 'cd app && pytest -q' THEN 'pytest' WHEN 'mypy src' THEN 'typecheck' END FROM span
  UNION ALL SELECT group_key, occurrence_id, 'subsystem', v FROM (SELECT group_key, occurrence_id, unnest(list_distinct(list_append(antecedents, repair_context))) AS v FROM sup) x WHERE v IN ({_texts(V.CONTEXTS)})),
num AS (SELECT group_key, t, v, count(DISTINCT occurrence_id) AS n FROM val WHERE v IS NOT NULL GROUP BY 1, 2, 3),
alls AS (SELECT group_key, count(*) AS al FROM sup GROUP BY 1),
cand AS (SELECT group_key, t AS scope_type, v AS scope_value, n AS scope_support_count, n / al AS scope_concentration, CASE t {' '.join(f"WHEN '{k}' THEN CAST({x} AS DOUBLE)" for k, x in V.SCOPE_SPECIFICITY.items())} END AS scope_specificity
  FROM num JOIN alls USING (group_key) WHERE n >= {V.SCOPE_COUNT} AND n / al >= {V.SCOPE_SHARE}),
scope AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY scope_concentration * scope_specificity DESC, scope_support_count DESC, {_place('scope_type', V.SCOPE_ORDER)}, scope_value) AS rn FROM cand) x WHERE rn = 1)
"""
    placements = groups + scopes + """,
pj AS (SELECT group_key, project_id, count(*) AS n FROM sup GROUP BY 1, 2),
pr AS (SELECT group_key, count(*) AS np, max(n) AS top, min(n) AS low, arg_min(project_id, -n * 1000 + project_id) AS dominant FROM pj GROUP BY 1),
cx AS (SELECT group_key, max(n) AS context_top FROM (SELECT group_key, repair_context, count(*) AS n FROM sup WHERE coalesce(repair_context, '') NOT IN ('', 'other', 'mixed') GROUP BY 1, 2) x GROUP BY 1),
pc AS (SELECT group_key, least(1.0, count(*) FILTER (n >= 3 AND kinds >= 2) / 2.0) AS complexity FROM (SELECT group_key, occurrence_id, count(DISTINCT sequence) AS n, count(DISTINCT type) AS kinds FROM span
  WHERE coalesce(path, '') <> '' OR coalesce(command, '') <> '' GROUP BY 1, 2) x GROUP BY 1),
ft AS (SELECT grp.group_key, pattern, confidence AS cf, support_count AS s, contradiction_count AS co, ratio AS sr, least(1.0, positive / 6.0::DOUBLE) AS rec, coalesce(np, 0) AS np, least(1.0, greatest(0, coalesce(np, 0) - 1) / 2.0::DOUBLE) AS cp,
  coalesce(top / s, 0.0) AS pcn, coalesce(context_top / s, 0.0) AS cc, CASE WHEN s < 2 THEN 0.25 WHEN pattern = 'repeated_failure' THEN 0.35 ELSE 1.0 END::DOUBLE AS ac, coalesce(complexity, 0.0)::DOUBLE AS px,
  coalesce(scope_concentration, 0.0) * coalesce(scope_specificity, 0.0) AS sc, coalesce(scope_type, 'global') AS st, scope_value AS sv, dominant, co / greatest(1, s + co) AS ag,
  coalesce(np, 0) >= 2 AND low >= 2 AND top / s <= 0.75 AS ok FROM grp LEFT JOIN pr USING (group_key) LEFT JOIN cx USING (group_key) LEFT JOIN pc USING (group_key) LEFT JOIN scope USING (group_key)),
raw AS (SELECT *, 0.05::DOUBLE + 0.24::DOUBLE * sr + 0.22::DOUBLE * rec + 0.35::DOUBLE * cp + 0.14::DOUBLE * ac + 0.10::DOUBLE * cf - 0.10::DOUBLE * pcn - 0.15::DOUBLE * sc - 0.20::DOUBLE * ag AS ev FROM ft),
sco AS (SELECT *, 0 AS tie, 'ignore' AS placement, 0.10::DOUBLE + 0.35::DOUBLE * (1 - sr) + 0.40::DOUBLE * ag + 0.15::DOUBLE * (1 - ac) + 0.10::DOUBLE * (1 - cf) + CASE WHEN s < 2 THEN 0.10::DOUBLE ELSE 0.0::DOUBLE END AS x FROM raw
  UNION ALL SELECT *, 1, 'global_rule', CASE WHEN ok THEN ev ELSE least(ev, 0.24::DOUBLE) END FROM raw
  UNION ALL SELECT *, 2, 'project_rule', 0.10::DOUBLE + 0.20::DOUBLE * sr + 0.20::DOUBLE * rec + 0.25::DOUBLE * pcn + 0.15::DOUBLE * ac + 0.10::DOUBLE * cf - 0.12::DOUBLE * sc - 0.25::DOUBLE * cp - 0.40::DOUBLE * ag FROM raw
  UNION ALL SELECT *, 3, 'scoped_rule', 0.05::DOUBLE + 0.16::DOUBLE * sr + 0.10::DOUBLE * rec + 0.40::DOUBLE * sc + 0.12::DOUBLE * ac + 0.07::DOUBLE * cf + 0.05::DOUBLE * cc - 0.35::DOUBLE * ag FROM raw
  UNION ALL SELECT *, 4, 'skill', 0.03::DOUBLE + 0.15::DOUBLE * sr + 0.10::DOUBLE * rec + 0.50::DOUBLE * px + 0.12::DOUBLE * ac + 0.08::DOUBLE * cf - 0.10::DOUBLE * ag FROM raw)
SELECT group_key, placement, round(greatest(0.0, least(1.0, x)), 4) AS score, row_number() OVER (PARTITION BY group_key ORDER BY round(greatest(0.0, least(1.0, x)), 4) DESC, tie) AS rank,
  CASE placement WHEN 'project_rule' THEN 'project' WHEN 'scoped_rule' THEN st ELSE 'global' END AS target_type, CASE placement WHEN 'project_rule' THEN CAST(dominant AS VARCHAR) WHEN 'scoped_rule' THEN sv END AS target_value FROM sco"""
    return {
        "union_detectors": occurrences + " SELECT trajectory_id, group_key, classification, start_sequence, end_sequence, pattern FROM occ",
        "contradictions": contradictions + " SELECT trajectory_id, group_key, end_sequence FROM against",
        "experience_groups": groups + " SELECT group_key, pattern, support_count, ambiguous_count, contradiction_count, occurrence_count, project_count, support_projects, status, confidence FROM grp",
        "experience_summaries": groups + f""" SELECT group_key, {title} AS title, {title} || '. Seen ' || occurrence_count || ' times in ' || project_count || ' projects, contradicted ' || contradiction_count || ' times.' AS lesson,
coalesce(contexts, '') AS contexts FROM (SELECT *, split_part(group_key, '::', 2) AS c, coalesce(nullif(split_part(group_key, '::', 3), ''), '-') AS fam FROM grp) x""",
        "scope_inference": occurrences + scopes + " SELECT * FROM scope",
        "placement_rank": placements,
    }
