import json

from pyspark.sql import functions as F

from quillspan.operators.sequences import occurrences
from quillspan.sources import transcripts as T


def rollout(*items):
    meta = {"type": "session_meta", "payload": {"cwd": "/work/r", "cli_version": "1", "git": {"branch": "main"}}}
    return [meta, *({"type": "event_msg", "timestamp": "2026-01-01T00:00:00Z", "payload": p} for p in items)]


def item(kind, **x):
    return {"type": "item_completed", "item": {"type": kind, **x}}


def ran(command, code):
    return item("CommandExecution", command=["/bin/sh", "-lc", command], exit_code=code, aggregated_output=f"out of {command}", parsed_cmd=[])


def written(tmp_path, name, records, extra=()):
    path = tmp_path / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join([*(json.dumps(r) for r in records), *extra]))


def test_rollout(spark, tmp_path):
    records = rollout(
        item("UserMessage", content=[{"type": "text", "text": "Add an endpoint"}]), ran("pytest tests", 1),
        item("FileChange", changes={"/work/r/app/models/a.py": {"type": "update", "unified_diff": "-a\n+b\n+c\n"}}), ran("pytest tests", 0),
        item("UserMessage", content=[{"type": "text", "text": "<environment_context>x</environment_context>use tabs instead, TOKEN=abcdef123456"}]),
        {"type": "token_count", "info": {"total_token_usage": {"total_tokens": 120}}}, {"type": "task_complete", "last_agent_message": "done"},
    )
    written(tmp_path, "a/rollout-1.jsonl", records, ["not json", ""])
    lines = T.transcript_lines(spark, str(tmp_path), "rollout-*.jsonl")
    steps = T.steps(lines, "rollout")
    events, headers = T.session_table(steps, "/work/r")
    got = [(r["sequence"], r["type"], r["path"], r["exit_code"]) for r in events.orderBy("sequence").collect()]
    assert [x[1] for x in got] == ["user_prompt", "command", "test_fail", "file_edit", "command", "test_pass", "human_correction", "completion"]
    assert got[3][2] == "app/models/a.py" and [x[3] for x in got if x[1] == "command"] == [1, 0]
    said = events.where("type = 'human_correction'").first()
    assert said["redacted"] and said["summary"] == "use tabs instead, TOKEN=[REDACTED:env-secret]"
    head = headers.first()
    assert (head["task"], head["branch"], head["final_status"], head["n_warnings"]) == ("Add an endpoint", "main", "success", 1)
    assert [(r["key"], r["tokens"]) for r in T.token_usage(steps, "rollout").collect()] == [("total_tokens", 120)]
    found = occurrences(events, headers).collect()
    assert [(r["group_key"], r["classification"]) for r in found] == [("fr::model::test", "support")]


def test_raw_fallback(spark, tmp_path):
    raw = [
        {"type": "response_item", "payload": p}
        for p in (
            {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "fix it"}]},
            {"type": "function_call", "name": "shell", "call_id": "1", "arguments": json.dumps({"command": "ruff check"})},
            {"type": "function_call_output", "call_id": "1", "output": "Exit code: 1"},
        )
    ]
    written(tmp_path, "rollout-2.jsonl", raw)
    events, headers = T.session_table(T.steps(T.transcript_lines(spark, str(tmp_path)), "rollout"))
    assert [(r["type"], r["exit_code"]) for r in events.orderBy("sequence").collect()] == [("user_prompt", None), ("command", 1), ("lint_fail", None)]
    assert headers.first()["final_status"] == "partial"


def test_messages(spark, tmp_path):
    def user(content, **x):
        return {"type": "user", "message": {"content": content}, "cwd": "/w", "gitBranch": "b", **x}

    def call(i, name, **given):
        return {"type": "assistant", "message": {"model": "m", "content": [{"type": "tool_use", "id": i, "name": name, "input": given}], "usage": {"input_tokens": 2}}}

    def result(i, error=False, **use):
        return user([{"type": "tool_result", "tool_use_id": i, "content": "c", "is_error": error}], toolUseResult=use)

    records = [
        user("write a readme"), call("r", "Read", file_path="/w/main.py"), result("r"), call("b", "Bash", command="pytest -q"), result("b", stdout="1 passed"),
        call("w", "Write", file_path="/w/README.md"), result("w", type="create"), result("nobody"), call("lost", "Grep", pattern="x"),
        {"type": "assistant", "message": {"content": [{"type": "text", "text": "all done"}], "stop_reason": "end_turn", "usage": {"input_tokens": 3}}},
    ]
    written(tmp_path, "p/s.jsonl", records)
    steps = T.steps(T.transcript_lines(spark, str(tmp_path)), "messages")
    events, headers = T.session_table(steps, "/w")
    got = [(r["type"], r["path"]) for r in events.orderBy("sequence").collect()]
    assert got == [("user_prompt", None), ("file_read", "main.py"), ("command", None), ("test_pass", None), ("file_create", "README.md"), ("tool_call", None), ("assistant_message", None), ("tool_call", None)]
    head = headers.first()
    assert (head["final_status"], head["task"], head["cwd"], head["model"]) == ("success", "write a readme", "/w", "m")
    assert {r["key"]: r["tokens"] for r in T.token_usage(steps, "messages").collect()} == {"input_tokens": 4 * 2 + 3}
    touched = {r["path"]: (r["was_read"], r["was_created"]) for r in T.file_touches(events).collect()}
    assert touched == {"main.py": (True, False), "README.md": (False, True)}


def test_interruption_and_recovery(spark, tmp_path):
    stop = {"type": "user", "message": {"content": "[Request interrupted by user]"}}
    end = {"type": "assistant", "message": {"content": [{"type": "text", "text": "ok"}], "stop_reason": "end_turn"}}
    ask = {"type": "user", "message": {"content": "do"}}
    written(tmp_path, "one.jsonl", [ask, end, stop])
    written(tmp_path, "two.jsonl", [ask, stop, end])
    _, headers = T.session_table(T.steps(T.transcript_lines(spark, str(tmp_path)), "messages"))
    assert {r["trajectory_id"][-9:]: r["final_status"] for r in headers.collect()} == {"one.jsonl": "aborted", "two.jsonl": "success"}


def test_a_prompt_behind_six_blocks_is_found(spark):
    text = "".join(f"# AGENTS.md instructions {i}\nmore\n\n" for i in range(6)) + "Do the work"
    rows = spark.createDataFrame([(text,), ("# AGENTS.md instructions\nno blank line",), (None,), ("plain\n\ntext",)], "t string")
    assert [r["h"] for r in rows.select(T.human_text(F.col("t")).alias("h")).collect()] == ["Do the work", None, None, "plain\n\ntext"]


def test_durations_and_the_warning_of_a_fallback(spark, tmp_path):
    done = {"type": "event_msg", "payload": {"type": "task_complete", "last_agent_message": "ok", "duration_ms": 1500}}
    one = item("CommandExecution", command=["bash", "-lc", "ls"], exit_code=0, duration={"secs": 2, "nanos": 500_000_000})
    written(tmp_path, "a.jsonl", [*rollout(one), done])
    written(tmp_path, "b.jsonl", [{"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "fix it"}]}}])
    events, headers = T.session_table(T.steps(T.transcript_lines(spark, str(tmp_path)), "rollout"))
    got = {r["type"]: r["duration_ms"] for r in events.where("trajectory_id like '%a.jsonl'").collect()}
    assert got["command"] == 2500 and got["completion"] == 1500
    assert {r["trajectory_id"][-7:]: r["n_warnings"] for r in headers.collect()} == {"a.jsonl": 0, "b.jsonl": 1}
