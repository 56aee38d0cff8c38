import json
from datetime import datetime, timezone

from pyspark.sql import functions as F

from quillspan.functions import times
from quillspan.operators import placement as P
from quillspan.operators import views as V
from quillspan.sources import discovery as D
from quillspan.sources import transcripts as T


def put(tmp_path, name, records):
    path = tmp_path / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records))


def test_times(spark):
    cases = {
        "2026-09-02T08:41:16.123Z": "2026-09-02T08:41:16.123000+00:00", "2026-09-02 08:41": "2026-09-02T08:41:00+00:00", "2026-09-02T08:41:16+02:00": "2026-09-02T06:41:16+00:00",
        "2026-09-02T00:10:00-0030": "2026-09-02T00:40:00+00:00", "20260902": "2026-09-02T00:00:00+00:00", "1700000000": datetime.fromtimestamp(1700000000, timezone.utc).isoformat(),
        "1700000000500": datetime.fromtimestamp(1700000000.5, timezone.utc).isoformat(), " 12.5 ": "1970-01-01T00:00:12.500000+00:00", "-1": "1969-12-31T23:59:59+00:00",
        "2026-13-02": None, "soon": None, "": None, "1e300": None, "2026-09": None, None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", times.iso_instant(F.col("t")).alias("iso"))
    assert {r["t"]: r["iso"] for r in df.collect()} == cases
    both = spark.createDataFrame([("2026-01-01T00:00:00Z", "2026-01-01T01:00:01.0005+01:00"), ("2026-01-02", "2026-01-01"), (None, "2026-01-01")], "a string, b string")
    assert [r[0] for r in both.select(times.seconds_between(F.col("a"), F.col("b"))).collect()] in ([1.0, None, None], [1.001, None, None])
    ms = spark.createDataFrame([(7.9, None, None), (None, 1.0, 5e8), (None, 2.0, None), (None, None, 1.0)], "n double, s double, ns double")
    assert [r[0] for r in ms.select(times.duration_ms(F.col("n"), F.col("s"), F.col("ns"))).collect()] == [7, 1500, 2000, None]


def test_commands_and_exits_of_free_texts():
    long = "x" * 1999
    assert T.freeform_command({"cmd": ["/bin/bash", "-lc", "pytest -q"]}) == "pytest -q" and T.freeform_command({"script": " "}) is None
    assert T.freeform_command('{"command": "ls"}') == "ls" and T.freeform_command("{broken") is None and T.freeform_command(["a"]) is None
    assert T.freeform_command('tools.exec({cmd:"ruff check"})') == "ruff check"
    assert T.freeform_command("cd a\npytest") == "cd a\npytest" and T.freeform_command(long) == long and T.freeform_command(long + "x") is None and T.freeform_command(" ") is None
    assert [T.output_exit(x) for x in ("Exit code: 1", "exit 2", [{"text": "exit code 3"}], {"exit_code": 4}, {"output": "Exit code 5"})] == [1, 2, 3, 4, 5]
    assert [T.output_exit(x) for x in ("Script completed", "Build SUCCEEDED", "nothing", None, {})] == [0, 0, None, None, None]


def test_texts_and_tails(spark, tmp_path):
    def item(**x):
        return {"type": "event_msg", "payload": {"type": "item_completed", "item": x}}

    records = [
        item(type="AgentMessage", content=["plain", {"type": "any", "text": "typed"}, {"type": "encrypted_content"}]),
        item(type="CommandExecution", command=["/bin/sh", "-lc", "ls"], exit_code=0, formatted_output=" first ", stdout="second"),
        {"type": "event_msg", "payload": {"type": "task_started"}},
    ]
    put(tmp_path, "rollout-1.jsonl", records)
    events, _ = T.session_table(T.steps(T.transcript_lines(spark, str(tmp_path)), "rollout"))
    assert [(r["type"], r["summary"]) for r in events.orderBy("sequence").collect()] == [("assistant_message", "plain typed [encrypted]"), ("command", "first")]


def test_task_falls_back_and_bounds(spark, tmp_path):
    say = {"type": "assistant", "timestamp": "2026-01-01T02:00:00+01:00", "message": {"content": [{"type": "text", "text": "x"}]}}
    put(tmp_path, "p/a.jsonl", [say, {"type": "last-prompt", "lastPrompt": "older"}, {"type": "last-prompt", "lastPrompt": "newer TOKEN=abcdef123456"}, say | {"timestamp": "2026-01-01T01:30:00Z"}])
    put(tmp_path, "p/b.jsonl", [say, {"type": "ai-title", "aiTitle": "a title"}, {"type": "ai-title", "aiTitle": "later"}, {"type": "last-prompt", "lastPrompt": "p"}])
    _, headers = T.session_table(T.steps(T.transcript_lines(spark, str(tmp_path)), "messages"))
    a, b = headers.orderBy("trajectory_id").collect()
    assert (a["task"], b["task"]) == ("newer TOKEN=[REDACTED:env-secret]", "a title")
    assert (a["started_at"], a["ended_at"]) == ("2026-01-01T01:00:00+00:00", "2026-01-01T01:30:00+00:00")


def test_discovery(spark, tmp_path):
    uuid = "0f0f0f0f-0000-4000-8000-000000000001"
    meta = {"type": "session_meta", "payload": {"id": "own", "cwd": "/w", "git": {"branch": "main", "repository_url": "u"}}}
    put(tmp_path, "r/2026/rollout-a.jsonl", ["", "no json", meta])
    put(tmp_path, f"r/rollout-2026-{uuid}.jsonl", [{"type": "turn_context"}, meta])
    put(tmp_path, "r/rollout-b.jsonl", ["", ""])
    put(tmp_path, "r/rollout-c.jsonl", [])  # no bytes: listed by its name
    put(tmp_path, "r/other.jsonl", [meta])
    found = D.discovered(spark, str(tmp_path / "r"), "rollout").collect()
    assert [(r["source_session_id"], r["cwd"], r["git_branch"], r["git_remote"]) for r in found] == [("own", "/w", "main", "u"), (uuid, None, None, None), ("rollout-b", None, None, None), ("rollout-c", None, None, None)]
    assert found[0]["size_bytes"] > 0 and found[2]["size_bytes"] == 1
    line = {"sessionId": "s", "cwd": "/w"}
    put(tmp_path, "m/p/a.jsonl", [{"sessionId": "s"}, {"cwd": "/w"}, {"gitBranch": "late"}])
    put(tmp_path, "m/p/b.jsonl", [{"x": 1}] * 61 + [line])
    put(tmp_path, "m/p/c/subagents/agent-1.jsonl", [line | {"gitBranch": "g"}])
    put(tmp_path, "m/top.jsonl", [line])
    put(tmp_path, "m/p/c/deep.jsonl", [line])
    found = D.discovered(spark, str(tmp_path / "m"), "messages").collect()
    assert [(r["source_session_id"], r["cwd"], r["git_branch"]) for r in found] == [("s", "/w", None), ("b", None, None), ("agent-1", "/w", "g")]


def test_placement_marks(spark):
    x = spark.createDataFrame([("a", "candidate", None), ("b", "candidate", "false_positive"), ("c", "open", None), ("d", "candidate", "useful")], "group_key string, status string, review_status string")
    assert [r[0] for r in P.eligible(x).orderBy("group_key").collect()] == ["a", "d"]
    ev = spark.createDataFrame([("a", 1), ("a", 2), ("d", 3)], "group_key string, occurrence_id int")
    one = P.source_fingerprints(x, ev, "v1", ["status", "review_status"], ["occurrence_id"])
    two = P.source_fingerprints(x, ev.orderBy(F.desc("occurrence_id")), "v1", ["review_status", "status"], ["occurrence_id"])
    as_dict = lambda df: {r["group_key"]: r["fingerprint"] for r in df.collect()}
    assert as_dict(one) == as_dict(two) and len(set(as_dict(one).values())) == 4
    assert as_dict(P.source_fingerprints(x, ev.where("occurrence_id <> 2"), "v1", ["status", "review_status"], ["occurrence_id"]))["a"] != as_dict(one)["a"]
    sets = one.where("group_key = 'a'").withColumns({"version": F.lit("v1"), "n": F.lit(5)})
    assert [r["group_key"] for r in P.outdated(x, one, sets, "v1").collect()] == ["d"]
    text = spark.createDataFrame([("", None, "see /home/u/a.py, C:\\x and a/b"), (None, "", None), ("x" * 499 + " y", None, None)], "l string, s string, t string")
    got = [r[0] for r in text.select(P.public_content(*map(F.col, "lst"))).collect()]
    assert got == ["see [repository path omitted], [repository path omitted] and a/b", "", "x" * 499]


def test_views(spark):
    lineage = spark.createDataFrame([(1, "split_from", 10, 11), (2, "split_from", 10, 12), (3, "merged", 11, 10)], "lineage_id int, relation string, from_version int, to_version int")
    versions = spark.createDataFrame([(10, "p"), (11, "p"), (12, "q")], "version_id int, policy_id string")
    assert sorted((r["policy_id"], r["lineage_id"]) for r in V.policy_lineage(lineage, versions).collect()) == [("p", 1), ("p", 2), ("p", 3), ("q", 2)]
    assert sorted(r["version_id"] for r in V.split_children(lineage, versions, 10).collect()) == [11, 12]
    groups = spark.range(50).select(F.col("id").cast("string").alias("group_key"), F.col("id").alias("score"))
    parts = V.inspection_sample(groups, seed=3).collect()
    assert [sum(r["part"] == p for r in parts) for p in ("top", "random", "lowest")] == [20, 10, 10]
    assert sorted(map(tuple, parts)) == sorted(map(tuple, V.inspection_sample(groups, seed=3).collect()))
    assert V.placement_counts(versions, lineage).first().asDict() == {"proposal_sets": 3, "proposals": 3}
    occurrences = spark.createDataFrame([(1, "t2", 5), (2, "t1", None)], "occurrence_id int, trajectory_id string, project_id int")
    roles = spark.createDataFrame([("x", "support", 1), ("x", "against", 2)], "proposal_id string, role string, occurrence_id int")
    projects = spark.createDataFrame([(5, "n", "/r")], "project_id int, name string, root string")
    assert [(r["role"], r["root"]) for r in V.proposal_evidence(roles, occurrences, projects).collect()] == [("against", None), ("support", "/r")]
