import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspan.llm.sharding import permuted, position_of, shard_report, shuffled_shards


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 1000))
def test_permutation_and_inverse(n, seed):
    p = permuted(np.arange(n), n, seed)
    assert sorted(p.tolist()) == list(range(n))
    assert permuted(p, n, seed, back=True).tolist() == list(range(n))


def test_report(docs_of):
    rows = [(i * 3, "x" * (i % 7)) for i in range(500)] + [(5, None), (9, "é"), (9, "é")]
    got = shard_report(docs_of(rows)).collect()
    assert len(got) == len(rows) and {r["law"] for r in got} == {"rows"}
    sizes = [sum(r["shard"] == s for r in got) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(16):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    by = {(r["doc_id"], r["size"]): r["text_crc32"] for r in got}
    assert by[(5, 1)] == 0 and by[(9, 3)] == zlib.crc32("é".encode())
    first = got[0]
    assert position_of(first["shard"], first["slot"], len(rows), 16, 17) == first["row_number"]


def test_same_whatever_the_partitions(docs_of):
    docs = docs_of([(i, "t") for i in range(200)])
    a = {r["doc_id"]: (r["shard"], r["slot"]) for r in shuffled_shards(docs.repartition(7), 5, ["doc_id"]).collect()}
    b = {r["doc_id"]: (r["shard"], r["slot"]) for r in shuffled_shards(docs.coalesce(1), 5, ["doc_id"]).collect()}
    assert a == b


def test_edges(edges, docs_of):
    assert shard_report(edges).count() == 9
    assert shard_report(docs_of([])).count() == 0


def test_columns_of_any_name_are_kept(docs_of):
    names = ["_range", "_in_range", "_start", "_position", "range", "nth", "start", "position", "row"]
    docs = docs_of([(i, "t") for i in range(20)]).selectExpr("doc_id", *(f"'own' as {n}" for n in names), "1 as shard")
    got = shuffled_shards(docs, 3, ["doc_id"]).collect()
    assert set(got[0].asDict()) == {"doc_id", *names, "row_number", "shard", "slot"}
    assert all(r[n] == "own" for r in got for n in names) and sorted(r["row_number"] for r in got) == list(range(20))
