"""Transcripts as a stream."""

import json

from quillspan.streaming import transcripts as ST


def _write(path, texts):
    lines = [{"type": "user", "timestamp": f"2026-01-01T0{i}:00:00Z", "cwd": "/w", "message": {"role": "user", "content": t}} for i, t in enumerate(texts)]
    path.write_text("\n".join(map(json.dumps, lines)))


def test_arriving_files_are_imported_once(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    _write(source / "one.jsonl", ["build it"])

    def drain():
        q = ST.start_import(spark, str(source), "messages", out, state, once=True)
        assert q.awaitTermination(120) and q.exception() is None

    drain()
    assert [r["type"] for r in ST.imported(spark, out, "events").collect()] == ["user_prompt"]
    _write(source / "two.jsonl", ["first", "second"])
    drain()
    heads = {r["trajectory_id"].rsplit("/", 1)[1]: r["task"] for r in ST.imported(spark, out, "headers").collect()}
    assert heads == {"one.jsonl": "build it", "two.jsonl": "first"}
    assert ST.imported(spark, out, "events").count() == 3


def test_activity_of_a_table(spark):
    e = spark.createDataFrame([("2026-01-01 00:01:00", "command"), ("2026-01-01 00:02:00", "command"), ("2026-01-01 00:11:00", "command")], "ts string, type string")
    assert sorted(r["events"] for r in ST.activity(e).collect()) == [1, 2]
