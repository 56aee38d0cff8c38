"""Import passes, managed blocks, read views."""

import json

import pytest
from pyspark.sql import functions as F

from quillspan.operators import blocks, imports, views


def test_admission_and_second_pass(spark):
    src = spark.createDataFrame(
        [("a", "1", "f1", "h1", "/w/app/src"), ("a", "2", "f2", "h2", "/w/app/sub/x"), ("a", "3", "f3", "h3", "/other"), ("a", "4", "f4", "h4", None)], "agent string, session_id string, path string, content_hash string, cwd string"
    )
    projects = spark.createDataFrame([("P", "/w/app"), ("Q", "/w/app/sub")], "project_id string, root string")
    known = spark.createDataFrame([("a", "1", "f1", "old", "imported")], "agent string, session_id string, path string, content_hash string, status string")
    first = imports.admitted(src, known, projects)
    assert {r["path"]: (r["outcome"], r["project_id"]) for r in first.collect()} == {"f1": ("changed", "P"), "f2": ("new", "Q"), "f3": ("ignored_unregistered", None), "f4": ("ignored_unregistered", None)}
    after = imports.known_after(known, first)
    assert {r["path"]: r["outcome"] for r in imports.admitted(src, after, projects).collect()} == {"f1": "already", "f2": "already", "f3": "ignored_unregistered", "f4": "ignored_unregistered"}
    assert {r["path"]: r["outcome"] for r in imports.admitted(src, known, projects, only_project="Q").collect()}["f1"] == "skipped_filtered"


def test_rows_are_replaced_by_source(spark):
    old, new = spark.createDataFrame([("f1", 1), ("f1", 2), ("f2", 1)], "file string, n int"), spark.createDataFrame([("f1", 9)], "file string, n int")
    assert sorted(map(tuple, imports.replaced(old, new, ["file"]).collect())) == [("f1", 9), ("f2", 1)]


def test_groups_keep_their_numbers(spark):
    g = spark.createDataFrame([("b",), ("a",), ("c",)], "group_key string")
    before = spark.createDataFrame([("b", 7, "accepted")], "group_key string, number int, review_status string")
    assert {r["group_key"]: (r["number"], r["review_status"]) for r in imports.numbered_groups(g, before).collect()} == {"b": (7, "accepted"), "a": (8, None), "c": (9, None)}


def test_changes_since_the_last_extraction(spark):
    t = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", None)], "trajectory_id string, content_hash string")
    state = spark.createDataFrame([("x", "1"), ("y", "old")], "trajectory_id string, content_hash string")
    assert [r[0] for r in imports.extraction_changes(t, state).collect()] == ["y"]


def _render(spark, existing, key, content):
    return spark.createDataFrame([(existing, key, content)], "e string, k string, c string").select(blocks.rendered(F.col("e"), F.col("k"), F.col("c")).alias("r")).first()["r"]


def test_blocks_are_appended_and_replaced(spark):
    one = _render(spark, "# Mine", "K", "rule")
    assert one["text"] == '# Mine\n\n<!-- policy:managed key="K" -->\nrule\n<!-- policy:end -->\n'
    two = _render(spark, one["text"] + "tail", "K", "other\nlines")
    assert two["text"] == '# Mine\n\n<!-- policy:managed key="K" -->\nother\nlines\n<!-- policy:end -->\ntail'
    assert _render(spark, two["text"], "K", "other\nlines")["text"] == two["text"]
    assert _render(spark, None, "K", "x")["text"].startswith("<!-- policy")
    assert "\r\nx\r\ny\r\n" in _render(spark, "a\r\nb\r\n", "K", "x\ny")["text"]


@pytest.mark.parametrize(
    "existing, content, error",
    [("<!-- policy:end -->", "x", "broken_marks"), ('<!-- policy:managed key="K" -->', "x", "broken_marks"), ("", "<!-- policy:end -->", "reserved_marks"), ("", None, "nothing_to_write"), ('<!-- policy:managed key="K" -->a<!-- policy:end -->' * 2, "x", "repeated_key")],
)
def test_block_errors(spark, existing, content, error):
    r = _render(spark, existing, "K", content)
    assert r["error"] == error and r["text"] is None


def test_views(spark):
    projects = spark.createDataFrame([("P", "beta"), ("Q", "Alpha")], "project_id string, name string")
    heads = spark.createDataFrame([("t1", "P", "x", "Fix A", "success", "2024"), ("t/subagents/2", "P", "y", "other", "partial", "2025")], "trajectory_id string, project_id string, agent string, task string, final_status string, started_at string")
    assert [(r["name"], r["sessions"], r["agents"]) for r in views.projects_overview(projects, heads).collect()] == [("Alpha", 0, 0), ("beta", 2, 2)]
    assert [r["trajectory_id"] for r in views.session_list(heads, projects, text="fix").collect()] == ["t1"]
    assert {r["trajectory_id"]: r["is_subagent"] for r in views.session_list(heads, projects).collect()} == {"t1": False, "t/subagents/2": True}
    assert views.page(heads, [F.desc("trajectory_id")], limit=0, offset=-3).count() == 1
    order = views.run_order(spark.createDataFrame([(1, 1), (1, 2)], "evaluation_id int, repetition int")).orderBy("repetition")
    assert [r["first_condition"] for r in order.collect()] == ["baseline", "candidate"]
    p = spark.createDataFrame([("g", "skill", 0.9, 1), ("g", "ignore", 0.1, 2), ("h", "ignore", 0.5, 1)], "group_key string, placement string, score double, rank int")
    assert [r["group_key"] for r in views.placement_list(p, placement="ignore").collect()] == ["g", "h"] and [r["group_key"] for r in views.placement_list(p, recommended="ignore").collect()] == ["h"]


def test_parsing_of_admitted_files_only(spark, tmp_path):
    for name in ("one", "two"):
        lines = [{"type": "user", "timestamp": "2026-01-01T00:00:00Z", "cwd": "/w", "message": {"role": "user", "content": f"task {name}"}}]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(map(json.dumps, lines)))
    everything = imports.parsed(spark, str(tmp_path), "messages")
    files = [r[0] for r in everything["headers"].select("trajectory_id").collect()]
    assert len(files) == 2
    some = imports.parsed(spark, str(tmp_path), "messages", files=spark.createDataFrame([(files[0],)], "file string"))
    assert [r["trajectory_id"] for r in some["headers"].collect()] == files[:1]
