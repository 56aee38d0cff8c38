import hashlib
import io
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspan.sources import session_lines as L
from quillspan.sources import transcripts as T


def python_lines(data):
    return [x.rstrip("\n") for x in io.TextIOWrapper(io.BytesIO(data), "utf-8", "replace")]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([b"\n", b"\r", b"\r\n", b"ab", "é".encode(), b"\xff", b" "]), max_size=30).map(b"".join), st.integers(1, 9), st.integers(1, 9))
def test_blocks_of_any_size_give_the_same_lines(data, block, chunk):
    found, size, held = [], len(data), L.CHUNK
    L.CHUNK = chunk
    try:
        for start in range(0, size, block):
            end = min(start + block, size)
            got = [(int(p), v) for places, raw in L.block_lines(io.BytesIO(data), start, end, size) for p, v in zip(places, L.as_text(raw).to_pylist())]
            assert len(got) == sum(len(s) for _, _, s in L._chunks(io.BytesIO(data), start, end))
            assert all(start <= p < end for p, _ in got)
            found += got
    finally:
        L.CHUNK = held
    assert [v for _, v in found] == python_lines(data)
    assert [p for p, _ in found] == sorted({p for p, _ in found})


def test_numbers_hashes_and_listing(spark, tmp_path):
    files = {"a/one.jsonl": b"x\n\n\r\ny\xff z", "two.jsonl": b"", "b/long.jsonl": b"\n".join(b"line %d" % i * (i % 5) for i in range(2000)), "b/other.txt": b"no", "b/_mark.jsonl": b"no"}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    known = {f"file://{tmp_path / n}": d for n, d in files.items() if n.endswith("jsonl") and "_" not in n}
    for block in (64, 1000, 1 << 20):
        rows = L.numbered(spark, str(tmp_path), glob="*.jsonl", blockbytes=block).collect()
        got = {f: {r["line"]: r["value"] for r in rows if r["file"] == f} for f in known}
        assert got == {f: dict(enumerate(python_lines(d), 1)) for f, d in known.items()}
        for r in rows:
            assert known[r["file"]][r["byte_start"] :].startswith(r["value"].encode()[:3].split(b"\xef")[0])
    told = {r["file"]: (r["size_bytes"], r["content_hash"]) for r in T.transcript_files(spark, f"file:{tmp_path}").collect()}
    assert told == {f: (len(d), hashlib.sha256(d).hexdigest()) for f, d in known.items()}
    assert {r["file"] for r in L.read(spark, str(tmp_path), "listing").collect()} == set(known)
    only = next(f for f in known if "long" in f)
    first = L.read(spark, paths=json.dumps([only.removeprefix("file://")]), first=7, blockbytes=64).orderBy("nth").collect()
    whole = python_lines(known[only])
    assert [r["value"] for r in first] == whole[: len(first)] and sum(bool(v.strip()) for v in whole[: len(first)]) == 7 and whole[len(first) - 1].strip()


def test_one_file_in_many_blocks_gives_the_same_events(spark, tmp_path):
    stamp = lambda i: f"2026-01-01T00:{i // 60:02}:{i % 60:02}Z"
    rollout = [{"type": "session_meta", "timestamp": stamp(0), "payload": {"cwd": "/w"}}]
    messages = [{"type": "user", "timestamp": stamp(0), "cwd": "/w", "message": {"role": "user", "content": "Make it work"}}]
    for i in range(1, 200):
        run = {"type": "CommandExecution", "command": ["bash", "-lc", "pytest -q" if i % 3 else "ls"], "exit_code": i % 2, "stdout": "é" * (i % 17)}
        rollout.append({"type": "event_msg", "timestamp": stamp(i), "payload": {"type": "item_completed", "item": run}})
        messages.append({"type": "assistant", "timestamp": stamp(i), "message": {"role": "assistant", "content": [{"type": "text", "text": f"step {i}"}]}})
    for layout, records in (("rollout", rollout), ("messages", messages)):
        at = tmp_path / layout
        at.mkdir()
        (at / "s.jsonl").write_text("\n".join(map(json.dumps, records)) + "\nnot json\n")
        tables = []
        for block in (1 << 20, 700):
            lines = T.transcript_lines(spark, str(at), blockbytes=block)
            assert lines.rdd.getNumPartitions() >= 1
            events, headers = T.session_table(T.steps(lines, layout))
            tables.append((sorted(map(repr, events.collect())), sorted(map(repr, headers.collect()))))
        assert tables[0] == tables[1] and len(tables[0][0]) >= 199
    assert L.SessionLinesReader({"path": str(tmp_path / "rollout"), "blockbytes": "700"}).partitions()[10:]


def test_a_long_file_is_many_tasks_and_many_small_files_are_few(tmp_path):
    (tmp_path / "big.jsonl").write_bytes(b"x" * (3 << 20))
    for i in range(300):
        (tmp_path / f"{i}.jsonl").write_bytes(b"y" * 10)
    reader = L.SessionLinesReader({"path": str(tmp_path), "blockbytes": str(1 << 20)})
    tasks = reader.partitions()
    assert max(sum(e - s for _, s, e, *_ in t.blocks) for t in tasks) <= 1 << 20 and len(tasks) <= 6
    assert [len(t.blocks) for t in L.SessionLinesReader({"path": str(tmp_path), "table": "blocks", "blockbytes": str(1 << 20)}).partitions()] == [1, 1, 1]
    with pytest.raises(ValueError):
        L.SessionLinesReader({"path": "/x", "table": "other"})
    with pytest.raises(FileNotFoundError):
        L.SessionLinesReader({"path": str(tmp_path / "none")}).partitions()
