import random
import re

import numpy as np

from quillspan.llm.components import connected_components
from quillspan.llm import minhash
from quillspan.llm.minhash import block_links, near_duplicates
from quillspan.llm.shared import sieved


def brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def near_copies(seed=3, families=12, size=12):
    rng = random.Random(seed)
    rows = []
    for f in range(families):
        base = [f"w{rng.randrange(900)}" for _ in range(rng.choice([4, 30, 120]))]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 25) + 1)):
                text[rng.randrange(len(text))] = f"x{rng.randrange(900)}"
            rows.append((len(rows), " ".join(text)))
    return rows


def test_matches_brute_force(docs_of):
    rows = near_copies()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs_of(rows)).collect()}
    assert got == brute(rows)


def test_edges(edges):
    got = near_duplicates(edges).collect()
    assert len(got) == 9
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[1]["n_shingles"] == by[2]["n_shingles"] == by[3]["n_shingles"] == 0 and by[1]["component_id"] == 1
    assert by[7]["component_id"] == 6 and not by[7]["kept"] and by[5]["n_shingles"] == 1
    assert [r for r in got if r["doc_id"] is None][0]["kept"]


def test_empty(docs_of):
    assert near_duplicates(docs_of([])).collect() == []


def _groups(pairs, names):
    up = {x: x for x in names}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, y in pairs:
        up[max(root(x), root(y))] = min(root(x), root(y))
    return {x: root(x) for x in names}


def test_blocks_link_every_open_component():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    members = []
    for k in range(40):
        s = base.copy()
        s[rng.integers(0, 300, k)] = rng.integers(0, 2**63, k).astype(np.uint64)
        members.append((k // 2, np.unique(s)))
    sets = [(c, set(x.tolist())) for c, x in members]
    like = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    want = _groups([(a[0], b[0]) for a in sets for b in sets if a[0] < b[0] and like(a[1], b[1])], range(20))
    found = block_links(members, None, 75)
    assert _groups(found, range(20)) == want and len(found) == 20 - len(set(want.values()))
    across = block_links(members[:25], members[25:], 75)
    assert _groups(across, range(20)) == _groups([(a[0], b[0]) for a in sets[:25] for b in sets[25:] if like(a[1], b[1])], range(20))
    assert block_links([], None, 75) == []


def test_long_texts_at_the_threshold(docs_of):
    words = [f"w{i}" for i in range(20004)]
    # 20,000 shingles, of which the copies share 17,143 or 17,142 with the first: just above and just below 75 of 100.
    rows = [(1, " ".join(words)), (2, " ".join(words[:17147] + [f"x{i}" for i in range(2857)])), (3, " ".join(words[:17146] + [f"y{i}" for i in range(2858)]))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs_of(rows)).collect()}
    assert got == {1: (20000, 1), 2: (20000, 1), 3: (20000, 3)} == {i: x[:2] for i, x in brute(rows).items()}


def chain(n, size=400, step=20):
    """Texts of a sliding window over one word list: each is near only those close by, and all share buckets with many."""
    return [(i, " ".join(f"w{j}" for j in range(i * step, i * step + size))) for i in range(n)]


def test_large_buckets_of_many_components(docs_of, monkeypatch):
    rng = random.Random(5)
    common = [f"c{i}" for i in range(60)]
    # 2,000 texts that share half of their words: one bucket or more holds them all, few are near each other.
    rows = [(i, " ".join(common + [f"u{i}-{j}" for j in range(rng.choice([4, 50, 60]))])) for i in range(2000)]
    want = brute_fast(rows)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs_of(rows)).collect()}
    assert got == want
    rows = chain(60)
    want = {i: x[1] for i, x in brute(rows).items()}
    for block in (512, 8):
        monkeypatch.setattr(minhash, "BLOCK", block)
        assert {r["doc_id"]: r["component_id"] for r in near_duplicates(docs_of(rows)).collect()} == want


def brute_fast(rows):
    """Components of texts that share one common part and are else distinct: linked if the common part is large enough in both."""
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    shared = set.intersection(*sets.values())
    sizes = {i: len(s) for i, s in sets.items()}
    pairs = [(a, b) for a in sizes for b in sizes if a < b and 100 * len(shared) >= 75 * (sizes[a] + sizes[b] - len(shared))]
    return _groups(pairs, list(sizes))


def test_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, 5, 6, 7), (2, text + " x", 5, 6, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id long, mark long, n long")
    assert sorted((r["doc_id"], r["component_id"]) for r in near_duplicates(docs).collect()) == [(1, 1), (2, 1)]
    by_text = spark.createDataFrame([(str(r[0]), r[1]) for r in rows], "node string, text string")
    assert sorted((r["node"], r["component_id"]) for r in near_duplicates(by_text, "node").collect()) == [("1", "1"), ("2", "1")]


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_an_id_of_two_texts_keeps_the_clean_one(spark, docs_of):
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (9, c), (9, None), (12, b), (14, c)]
    docs = docs_of(rows)
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(docs).collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 3, True), (9, 9, True), (9, 9, True), (12, 3, False), (14, 9, False)]
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(left, key=str) == sorted([(3, a), (5, b), (9, c), (9, None)], key=str)


def test_sieve_keeps_all_rows_with_a_key_and_few_others(spark, monkeypatch):
    rows = spark.range(20000).selectExpr("id", "struct(id % 5000 AS a, nullif(id % 5000, 7) AS b) AS key", "'x' AS _t")
    table = rows.where("id % 50 = 7 AND id < 5000").select("key")
    out = sieved(rows, ["key"], table)
    assert out.columns == rows.columns and out.where("id % 50 = 7").count() == 400 and out.count() < 420
    assert sieved(rows, ["key"], table.limit(0)).count() == 0
    monkeypatch.setattr("quillspan.llm.shared.SIEVE_WORDS", 1)  # full: it lets more through, and loses none
    assert sieved(rows, ["key"], table).where("id % 50 = 7").count() == 400


def test_texts_and_members_are_sieved_before_joins(docs_of, monkeypatch):
    seen = []
    monkeypatch.setattr(minhash, "sieved", lambda rows, keys, table: seen.append(keys) or sieved(rows, keys, table))
    rows = near_copies()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs_of(rows)).collect()} == brute(rows)
    assert {"bucket", "first"} <= {k for keys in seen for k in keys}
