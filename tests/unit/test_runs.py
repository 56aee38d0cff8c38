from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillspan.operators.cascade import triaged
from quillspan.operators.generation import generation_pass
from quillspan.operators.runs import Config, dedupe_key, extraction_run, group_sizes, top_candidates
from quillspan.versions import Pass, version, versions

NOW = datetime(2026, 2, 1)


def test_config():
    assert Config().max_event_gap == 20
    for name in ("min_occurrences", "min_projects", "max_event_gap", "correction_min_words"):
        for bad in (0, -1, 1.5, True, None):
            with pytest.raises(ValueError, match=name):
                Config(**{name: bad})
    with pytest.raises(AttributeError):
        Config().min_projects = 2


def sessions(spark, ids, fixed=True):
    rows = []
    for t in ids:
        steps = [("user_prompt", None), ("file_edit", "app/models/user.py"), ("test_fail", None), ("file_edit", "db/migrations/2.py" if fixed else "docs/a.md"), ("test_pass", None)]
        rows += [(t, f"p{int(t[1:]) % 2}", i, kind, path, None, None, "ValueError: bad thing in x" if kind == "test_fail" else None) for i, (kind, path) in enumerate(steps, 1)]
    return spark.createDataFrame(rows, "trajectory_id string, project_id string, sequence int, type string, path string, command string, exit_code int, summary string")


def put(store, spark, ids, events, content="h"):
    store.put("trajectories", spark.createDataFrame([(t, f"p{int(t[1:]) % 2}", content + t, datetime(2026, 1, 1)) for t in ids], "trajectory_id string, project_id string, content_hash string, last_activity timestamp_ntz"))
    store.put("events", events)


def run(spark, root, **options):
    with Pass(spark, root) as p:
        return extraction_run(p, now=NOW, **options)


def test_runs(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    ids = [f"t{i}" for i in range(5)]
    with Pass(spark, root) as p:
        put(p, spark, ids, sessions(spark, ids))
    one = run(spark, root)
    now = version(spark, root)
    assert (one.trajectories_considered, one.trajectories_analyzed, one.rebuild, one.project) == (5, 5, False, None)
    assert one.occurrences_found == now["occurrences"].count() and one.clusters_formed == now["clusters"].count() == now["occurrences"].select("group_key").distinct().count()
    assert one.candidates == now["experiences"].where("status = 'candidate'").count() > 0
    assert {r["group_key"] for r in now["evidence"].collect()} == {r["group_key"] for r in now["experiences"].collect()}
    best = top_candidates(now["experiences"]).collect()
    assert best[0]["group_key"].startswith("fr::migration::test") or best[0]["confidence"] >= best[-1]["confidence"]
    assert group_sizes(now["occurrences"]).first()["n"] == 5
    assert now["occurrences"].select(dedupe_key().alias("k")).distinct().count() == one.occurrences_found

    with Pass(spark, root) as p:  # a mark, and a session that changes
        triaged(p, spark.createDataFrame([(best[0]["group_key"], "useful", "yes")], "group_key string, review_status string, note string"))
        changed = p.base["events"].where("trajectory_id <> 't0'").unionByName(sessions(spark, ["t0"], fixed=False))
        p.put("events", changed)
        p.put("trajectories", p.base["trajectories"].withColumn("content_hash", F.when(F.col("trajectory_id") == "t0", F.lit("new")).otherwise(F.col("content_hash"))))
    two = run(spark, root)
    after = version(spark, root)
    assert (two.trajectories_analyzed, two.trajectories_considered) == (1, 5)
    keep = lambda v: sorted(map(tuple, v["occurrences"].where("trajectory_id <> 't0'").select("occurrence_id", "start_sequence").collect()))
    assert keep(after) == keep(now)
    numbers = lambda v: {r["group_key"]: r["number"] for r in v["experiences"].collect()}
    assert all(numbers(after)[g] == n for g, n in numbers(now).items() if g in numbers(after))
    assert [(r["review_status"], r["review_note"]) for r in after["experiences"].where(F.col("group_key") == best[0]["group_key"]).collect()] == [("useful", "yes")]
    assert run(spark, root).trajectories_analyzed == 0
    assert run(spark, root, project="p1").trajectories_considered == 2
    whole = run(spark, root, rebuild=True)
    end = version(spark, root)
    assert whole.trajectories_analyzed == 5 and sorted(r["occurrence_id"] for r in end["occurrences"].collect()) == sorted(r["occurrence_id"] for r in after["occurrences"].collect())
    assert [r["rebuild"] for r in end["experience_runs"].orderBy("rebuild").collect()] == [False] * 4 + [True]

    with Pass(spark, root) as p:
        figures, _ = generation_pass(p, "g1")
    assert figures.eligible == figures.regenerated == whole.candidates and version(spark, root)["proposals"].count() == 5 * figures.eligible


def test_a_failing_run_publishes_nothing(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/s"
    with Pass(spark, root) as p:
        put(p, spark, ["t1"], sessions(spark, ["t1"]))
    monkeypatch.setattr("quillspan.operators.runs.summaries", lambda found: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        run(spark, root)
    assert versions(spark, root) == [1]
