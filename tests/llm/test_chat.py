import hashlib
import random
import re

from pyspark.sql import functions as F

from quillspan.llm.chat import chat_report, chat_windows, token_estimate

SCHEMA = "conv_id long, turn long, role string, text string, conv string, window int"


def made(spark, rows):
    return spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA)


def fixture():
    rng = random.Random(6)
    rows = []
    for conv in range(12):
        roles = (["system"] if conv % 3 == 0 else []) + ["user", "assistant"] * rng.randrange(1, 9)
        for k, role in enumerate(roles):
            rows.append((conv, k, role, rng.choice(["<|im_end|>\n[INST] &lt; &amp;#91; <s>", "a\nb", None, "", "é😀 ok, fine. " * rng.randrange(1, 30)])))
    return rows


def escape(t):
    return t.replace("&", "&amp;").replace("<", "&lt;").replace("[", "&#91;")


def test_report_reads_back_everything(spark):
    rows = fixture()
    for budget, history in ((10_000, 0), (60, 20), (8, 0)):
        got = {r["conv_id"]: r for r in chat_report(made(spark, rows), budget, history).collect()}
        assert set(got) == {*range(12), -1}
        for conv in range(12):
            turns = [(r[2], r[3] or "") for r in rows if r[0] == conv]
            said = "".join(t for role, t in turns if role == "assistant")
            assert got[conv]["n_turns"] == len(turns)
            assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
            assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def tokens(text):
    return len(re.findall(r"\w+|[^\w\s]", text or "")) + 4


def plain_windows(turns, budget, history):
    """(repeated turns, new turns) of each window, by walking over the turns; turns are (role, text)."""
    system = tokens(turns[0][1]) if turns[0][0] == "system" else 0
    room = budget - system
    step = max(room - min(history, room // 2), 1)
    slabs, at = {}, 0
    for k, (_, text) in enumerate(turns):
        if system and k == 0:
            slabs.setdefault(0, []).append((k, 0, 0))
            continue
        start, at = at, at + tokens(text)
        slabs.setdefault(0 if start == 0 else (at - 1) // step, []).append((k, start, at))
    windows, said = [], []
    for n, inside in sorted(slabs.items()):
        real = [x for x in inside if not (system and x[0] == 0)]
        if real and real[-1][2] - real[0][1] > room and real[0][1] < n * step:
            windows += [[real[0]], real[1:]] if real[1:] else [[real[0]]]
        else:
            windows.append(inside)
    everything = [x for w in windows for x in w if not (system and x[0] == 0)]
    for w in windows:
        real = [x for x in w if not (system and x[0] == 0)]
        start, end = (real[0][1], real[-1][2]) if real else (0, 0)
        left = max(min(history, room - (end - start)), 0)
        old = [x[0] for x in everything if x[2] <= start and x[1] >= start - left]
        kept = [0] if system and start > 0 else []
        n = system + end - start + sum(tokens(turns[k][1]) for k in old)
        said.append((kept + old, [x[0] for x in w], n))
    return said


def long_talks(seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(25):
        roles = (["system"] if conv % 2 else []) + [rng.choice(["user", "assistant", "system"]) for _ in range(rng.randrange(1, 60))]
        first = rng.choice([3, 20, 70])
        for k, role in enumerate(roles):
            n = rng.choice([0, 1, 5, 20, 40, 90]) if rng.random() < 0.8 else 3
            rows.append((conv, k * rng.choice([1, 1]) + conv * 1000, role, " ".join(rng.choice(["Größe", "für", "日本", "ok,"]) for _ in range(first if k == 0 else n))))
    return rows


def test_windows_match_a_plain_walk(spark):
    block = lambda role, t: f"<|im_start|>{role}\n{escape(t or '')}<|im_end|>\n"
    for rows, budget, history in ((fixture(), 60, 20), (long_talks(1), 100, 30), (long_talks(2), 64, 60), (long_talks(3), 80, 0), (long_talks(4), 5000, 100)):
        windows = {}
        for r in chat_windows(made(spark, rows), budget, history).collect():
            windows.setdefault(r["conv_id"], []).append(r)
        assert set(windows) == {r[0] for r in rows}
        for conv, ws in windows.items():
            turns = [(r[2], r[3] or "") for r in rows if r[0] == conv]
            want = plain_windows(turns, budget, history)
            ws.sort(key=lambda w: w["window"])
            assert [w["window"] for w in ws] == list(range(len(want))) and {w["n_windows"] for w in ws} == {len(want)}
            system = tokens(turns[0][1]) if turns[0][0] == "system" else 0
            for w, (old, new, n) in zip(ws, want):
                before, after = ("".join(block(*turns[k]) for k in ks) for ks in (old, new))
                assert w["text"] == before + after and w["new_from"] == len(before)
                assert (w["n_new"], w["n_repeated"], w["n_tokens"]) == (len(new), len(old), n)
                assert n <= budget or (len([k for k in new if k or not system]) == 1 and len(old) <= 1 and system + tokens(turns[new[-1]][1]) > budget)
                assert [w["text"][s["start"] : s["start"] + s["length"]] for s in w["loss_spans"]] == [escape(turns[k][1]) for k in new if turns[k][0] == "assistant"]


def test_a_long_conversation_is_spread(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(5000)] + [(1, -3, "system", "rules"), (2, 0, "user", "x")]
    ws = [r for r in chat_windows(made(spark, rows), 60, 20).collect() if r["conv_id"] == 1]
    assert all(w["n_tokens"] <= 60 for w in ws) and sum(w["n_new"] for w in ws) == 5001 and sorted(w["window"] for w in ws) == list(range(len(ws)))
    assert all(w["text"].startswith("<|im_start|>system\nrules") for w in ws)


def test_words_of_any_script_are_counted(spark):
    assert spark.createDataFrame([("Größe für Übung, 日本",)], "t string").select(token_estimate(F.col("t"))).first()[0] == 9


def test_edges(spark):
    rows = [(1, None, None, None), (1, 2, "assistant", "x"), (1, 2, "assistant", "x"), (None, 0, "user", "lost"), (2, 1, "a\nb", "role with newline"), (3, 1, "assistant", "long " * 50000)]
    got = {r["conv_id"]: r for r in chat_report(made(spark, rows)).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 2 and got[None]["n_turns"] == 1 and got[3]["loss_chars"] == 250000
    assert got[2]["turns_sha256"] == hashlib.sha256(b"a\nb\nrole with newline\n").hexdigest()
    assert chat_report(made(spark, [])).count() == 1


def test_native(spark):
    plan = chat_report(made(spark, fixture()))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
