import random

import numpy as np

from quillspan.llm import chunking as c


def prose(rng, n):
    return " ".join("".join(rng.choice(["on", "er", "th", "é", "st", "ing"]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


def test_gear_hash_is_the_rolling_one():
    buf = np.frombuffer(prose(random.Random(1), 60).encode(), np.uint8)
    h, want = 0, []
    for b in buf.tolist():
        h = ((h << 1) + int(c.GEAR[b])) & 0xFFFF
        want.append(h)
    assert c.gear_hashes(buf)[16:].tolist() == want[16:]


def test_chunks_cover_and_resist_shifts():
    rng = random.Random(2)
    text = prose(rng, 600)
    split = lambda t: np.split(np.frombuffer(t, np.uint8), c.chunk_bounds(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[1:])
    a, b = (([x.tobytes() for x in split(t.encode())]) for t in (text, text[:900] + "inserted words " + text[900:]))
    assert b"".join(a).decode() == text and max(map(len, a)) <= 260
    assert len(set(a) - set(b)) <= 4
    for x in a:
        x.decode()


def test_repeated_passages_go(docs_of):
    rng = random.Random(3)
    shared = prose(rng, 80)
    rows = [(i, prose(rng, 60) + " " + (shared + " " if i % 2 else "") + prose(rng, 60)) for i in range(20)]
    got = {r["doc_id"]: r for r in c.substring_dedup(docs_of(rows)).collect()}
    for i, text in rows:
        if i % 2 == 0 or i == 1:
            assert got[i]["text"] == text and got[i]["removed_bytes"] == 0
        else:
            assert 0.6 * len(shared.encode()) < got[i]["removed_bytes"] <= len(shared.encode()) + 2
            assert got[i]["text"].startswith(text[:200]) and got[i]["text"].endswith(text[-200:])


def test_edges(edges, docs_of):
    got = c.substring_dedup(edges).collect()
    assert len(got) == 9 and {r["text"] for r in got if r["doc_id"] in (1, 2)} == {None, ""}
    assert [r["text"] for r in got if r["doc_id"] == 4] == ["one", "one"]
    assert c.substring_dedup(docs_of([])).count() == 0
    copies = c.substring_dedup(docs_of([(1, "long enough " * 30), (2, "long enough " * 30)])).collect()
    assert {r["doc_id"]: len(r["text"]) for r in copies}[2] < 30


def test_parts_of_many_documents_are_no_passage(docs_of):
    rng = random.Random(8)
    whole = prose(rng, 60)
    rows = [(i, f"{prose(rng, 40)} #{whole[at : at + 85]}# {prose(rng, 40)}") for i, at in enumerate(range(0, len(whole), 12))]
    rows += [(i, f"{prose(rng, 40)} {whole} {prose(rng, 40)}") for i in (900, 901)]
    got = {r["doc_id"]: r for r in c.substring_dedup(docs_of(rows)).collect()}
    assert all(got[i]["text"] == text and got[i]["removed_bytes"] == 0 for i, text in rows[:-1])
    assert got[901]["removed_bytes"] > 0


def test_short_passages_go_whole(docs_of):
    rng = random.Random(11)
    passages = [" ".join(f"{prose(rng, 1)}{rng.randrange(10)}" for _ in range(51)) for _ in range(40)]
    rows = [(i, f"{prose(rng, 30)} (A{i}) {passages[i % 40]} [B{i}] {prose(rng, 30)}") for i in range(120)]
    got = {r["doc_id"]: r["text"] for r in c.substring_dedup(docs_of(rows)).collect()}
    for i, text in rows:
        assert got[i].split() == (text if i < 40 else text.replace(passages[i % 40], "")).split()


def plain_dedup(rows, run):
    """The bytes that may go, for each row in order: places whose `run` bytes stand in an earlier text, or before them."""
    seen, out = set(), {}
    for i, text in rows:
        raw = text.encode()
        here = {}
        for k in range(len(raw) - run + 1):
            here.setdefault(raw[k : k + run], k)
        old = [k for k in range(len(raw) - run + 1) if raw[k : k + run] in seen or k - here[raw[k : k + run]] >= run]
        may = set()
        for k in old:
            may.update(range(k, k + run))
        out[i] = may
        seen.update(raw[k : k + run] for k in range(len(raw) - run + 1))
    return out


def test_what_is_cut_stands_earlier(docs_of, monkeypatch):
    """Against all byte windows: nothing is cut but what has stood in an earlier text, and of long repeats all but edges is cut."""
    rng = random.Random(21)
    shared = [prose(rng, n) for n in (70, 90, 120, 12)]
    rows = []
    for i in range(60):
        parts = [prose(rng, rng.randrange(10, 60))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(shared), prose(rng, rng.randrange(5, 40))]
        rows.append((i, " ".join(parts)))
    may = plain_dedup(rows, 96)
    for look in (0.02, 1.0):
        monkeypatch.setattr(c, "LOOK", look)
        got = {r["doc_id"]: r for r in c.substring_dedup(docs_of(rows)).collect()}
        for i, text in rows:
            gone = {k for s in got[i]["removed_spans"] for k in range(s["start"], s["end"])}
            assert not gone - may[i], i
            assert len(may[i] - gone) <= 0.12 * len(may[i]) + 2 * c.SNAP * len(got[i]["removed_spans"]), i


def test_clashing_columns_are_kept(docs_of):
    names = ["_mark", "_id", "_spans", "_mark2", "_n", "others", "text2", "spans", "doc", "n", "id", "mark"]
    docs = docs_of([(1, "long enough " * 30), (2, "long enough " * 30)]).selectExpr("doc_id", "text", *(f"'own' as {n}" for n in names))
    got = c.substring_dedup(docs).collect()
    assert list(got[0].asDict())[: 2 + len(names)] == ["doc_id", "text", *names] and all(r[n] == "own" for r in got for n in names)
