"""Detectors on hand-built sessions, and against a plain loop on random ones."""

import random

import pytest

from quillspan.operators import experiences as X
from quillspan.operators import sequences as S

SCHEMA = "trajectory_id string, project_id string, sequence int, type string, path string, command string, exit_code int, summary string"


def _events(spark, sessions):
    rows = []
    for tid, events in sessions.items():
        for seq, (kind, extra) in events.items():
            rows.append((tid, f"p{tid[-1]}", seq, kind, extra.get("path"), extra.get("command"), extra.get("exit"), extra.get("say")))
    return spark.createDataFrame(rows, SCHEMA)


def _edit(path, kind="file_edit"):
    return kind, {"path": path}


FAIL, PASS = ("test_fail", {"say": "ValueError: bad thing in x"}), ("test_pass", {})
REPAIR = {1: ("user_prompt", {}), 2: _edit("app/models/user.py"), 3: FAIL, 4: _edit("db/migrations/2.py", "file_create"), 5: PASS}


SAID = ("human_correction", {"say": "please use the helper instead"})
BODY = {4: FAIL, 5: ("command", {"command": "ls", "exit": 0}), 6: _edit("src/api/x.py"), 7: PASS}
BAD = ("build_fail", {"say": "ModuleNotFoundError: No module named 'foo'"})
SESSIONS = {
    "repair": REPAIR,
    "no edit": {1: FAIL, 2: PASS},
    "too far": {1: FAIL, **{k: ("assistant_message", {}) for k in range(2, 30)}, 30: _edit("a.py"), 31: PASS},
    "vendored": {1: FAIL, 2: _edit("node_modules/x/index.js"), 3: PASS},
    "tied": {1: FAIL, 2: _edit("docs/a.md"), 3: _edit("src/api/x.py"), 4: PASS},
    "corrected": {3: SAID, **BODY},
    "thanked": {3: ("human_correction", {"say": "ok thanks"}), **BODY},
    "again": {1: BAD, 2: BAD, 3: ("abort", {})},
    "resolved": {1: BAD, 2: BAD, 3: ("build_pass", {}), 4: ("completion", {"say": "done"})},
    "change": {1: _edit("app/models/a.py"), 2: _edit("db/migrations/1.py", "file_create"), 3: PASS},
}
STATUSES = {
    "success": [{1: FAIL, 2: PASS}, {1: ("completion", {"say": "done"})}], "aborted": [{1: PASS, 2: ("abort", {})}],
    "partial": [{1: PASS, 2: FAIL}, {1: ("command", {"exit": 1})}, {1: ("command", {"exit": 2}), 2: ("completion", {"say": "done"})}],
    "unknown": [{1: ("command", {"exit": 1}), 2: ("command", {"exit": 0})}, {1: ("completion", {"say": " "})}],
}


@pytest.fixture(scope="module")
def found(spark):
    e = _events(spark, SESSIONS)
    rows = [r.asDict() for r in S.occurrences(e, S.final_status(e)).collect()]
    return lambda tid, start="": [r for r in rows if r["trajectory_id"] == tid and r["group_key"].startswith(start)]


def test_repair_is_found_once(found):
    got = found("repair", "fr::")
    assert [(r["group_key"], r["start_sequence"], r["end_sequence"], r["classification"], r["antecedents"]) for r in got] == [("fr::migration::test", 3, 5, "support", ["model"])]
    assert [r["pattern"] for r in got] == ["failure_repair"]  # it takes the place of the file change of its group


@pytest.mark.parametrize("tid", ["no edit", "too far", "vendored"])
def test_no_repair(found, tid):
    assert not found(tid, "fr::")


def test_tied_contexts_are_ambiguous(found):
    assert [(r["group_key"], r["classification"]) for r in found("tied", "fr::")] == [("fr::mixed::test", "ambiguous")]


def test_directive_correction(found):
    assert [(r["group_key"], r["start_sequence"], r["end_sequence"]) for r in found("corrected", "hc::")] == [("hc::backend::test", 3, 7)]
    assert not found("thanked", "hc::")


def test_repeated_failure(found):
    assert [(r["classification"], r["start_sequence"], r["end_sequence"], r["failure_family"]) for r in found("again", "rf::")] == [("support", 1, 2, "build")]
    assert not found("resolved", "rf::")


def test_file_change_pattern(found):
    assert [(r["pattern"], r["group_key"], r["antecedents"]) for r in found("change")] == [("file_change_pattern", "fr::migration::test", ["model"])]


def test_final_status(spark):
    sessions = {f"{status} {n}": e for status, many in STATUSES.items() for n, e in enumerate(many)}
    got = {r["trajectory_id"]: r["final_status"] for r in S.final_status(_events(spark, sessions)).collect()}
    assert got == {t: t.split()[0] for t in sessions}


def _loop_repairs(events, gap=20):
    """(start, end, context) of repairs by a plain loop; contexts are given with the events."""
    out = []
    for i, (kind, context) in enumerate(events):
        if not kind.endswith("_fail"):
            continue
        family = kind[:-5]
        stop = next((j for j in range(i + 1, min(i + gap, len(events) - 1) + 1) if events[j][0] == f"{family}_pass"), None)
        if stop is None:
            continue
        edits = [c for k, c in events[i + 1 : stop] if k == "file_edit"]
        if edits:
            most = max(edits.count(c) for c in set(edits))
            top = {c for c in edits if edits.count(c) == most}
            out.append((i + 1, stop + 1, f"fr::{top.pop() if len(top) == 1 else 'mixed'}::{family}"))
    return sorted(out)


def test_random_sessions_agree_with_a_loop(spark):
    rng = random.Random(11)
    where = {"model": "app/models/a.py", "docs": "docs/a.md", "backend": "src/api/a.py"}
    kinds = ["test_fail", "test_pass", "lint_fail", "lint_pass", "file_edit", "assistant_message"]
    plain = {f"t{k}": [(kind := rng.choice(kinds), rng.choice(list(where)) if kind == "file_edit" else None) for _ in range(rng.randint(1, 60))] for k in range(40)}
    sessions = {t: {n + 1: (k, {"path": where[c]} if c else {}) for n, (k, c) in enumerate(e)} for t, e in plain.items()}
    found = S.failure_repairs(S.prepared(_events(spark, sessions))).collect()
    got = {t: sorted((r["start_sequence"], r["end_sequence"], r["group_key"]) for r in found if r["trajectory_id"] == t) for t in plain}
    assert got == {t: _loop_repairs(e) for t, e in plain.items()}


def test_groups_and_contradictions(spark):
    clean = {1: _edit("app/models/user.py"), 2: PASS}
    e = _events(spark, {"a1": REPAIR, "b2": REPAIR, "c1": REPAIR, "d2": clean})
    found, sides = S.occurrences(e, S.final_status(e)), S.profiles(e)
    from pyspark.sql import functions as F

    groups = {r["group_key"]: r for r in X.experiences(found, sides, F.lit("2024-01-01").cast("timestamp")).collect()}
    g = groups["fr::migration::test"]
    assert (g["support_count"], g["contradiction_count"], g["project_count"], g["status"]) == (3, 1, 2, "candidate")
    assert [r["trajectory_id"] for r in X.contradictions(found, sides).collect()] == ["d2"]
    touched = _events(spark, {"a1": REPAIR, "b2": REPAIR, "c1": REPAIR, "d2": {**clean, 3: _edit("db/migrations/9.py")}})
    assert X.contradictions(S.occurrences(touched, S.final_status(touched)), S.profiles(touched)).count() == 0


def test_empty_events(spark):
    e = spark.createDataFrame([], SCHEMA)
    assert S.occurrences(e, S.final_status(e)).count() == 0 and S.profiles(e).count() == 0 and S.repair_notes(e).count() == 0
