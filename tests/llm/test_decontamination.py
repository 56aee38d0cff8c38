import random
import re

import numpy as np
import pytest

from quillspan.llm import fmindex
from quillspan.llm.fmindex import FMIndex, contamination_report, decontaminate


def words(x):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (x or "").translate({c: c + 32 for c in range(65, 91)}))


def test_index_finds_all_occurrences():
    rng = np.random.default_rng(4)
    text = rng.integers(1, 4, 400)
    text[rng.integers(0, 400, 30)] = 0
    text = np.concatenate([[0], text, [0]])
    index = FMIndex(text, 5)
    for n in (1, 2, 5):
        for _ in range(60):
            p = rng.integers(1, 5, n)
            which, lo, hi = index.search(np.pad(p, (10 - n, 0))[None, :], np.array([n]))
            got = sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) if len(which) else []
            assert got == [i for i in range(len(text) - n + 1) if (text[i : i + n] == p).all()]


def fixture():
    rng = random.Random(8)
    word = lambda: rng.choice(["the", "of", "és", "to", "a1"]) + rng.choice(["", "x", "y"])
    items = [(k, " ".join(word() for _ in range(rng.choice([3, 10, 25])))) for k in range(15)] + [(90, None), (91, "--"), (92, "Same Words Here"), (93, "same words here")]
    docs = []
    for i in range(60):
        text = [word() for _ in range(rng.randrange(0, 60))]
        if i % 3 == 0:
            text[5:5] = (items[rng.randrange(15)][1] or "").upper().split()
        docs.append((i, ", ".join(text)))
    return [*docs, (60, None), (61, "x same words here y")], items


@pytest.mark.parametrize("phrase_bytes", [16 << 20, 400])
def test_matches_brute_force(spark, docs_of, monkeypatch, phrase_bytes):
    monkeypatch.setattr(fmindex, "PHRASE_BYTES", phrase_bytes)  # the second: several parts of test items
    docs, items = fixture()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in contamination_report(docs_of(docs), bench).collect()}
    cut = {r["doc_id"]: r for r in decontaminate(docs_of(docs), bench).collect()}
    for i, text in docs:
        w, hit, named = words(text), set(), set()
        for item, t in items:
            x = words(t)
            for k in range(max(1, len(x) - 9) if x else 0):
                p = x[k : k + 10]
                for j in range(len(w) - len(p) + 1):
                    if w[j : j + len(p)] == p:
                        hit.update(range(j, j + len(p)))
                        named.add(str(item))
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"]) == (len(w), len(hit), len(named)), i
        assert cut[i]["items"] == sorted(named)
        assert words(cut[i]["text"]) == [x for k, x in enumerate(w) if k not in hit]


def test_edges(spark, edges, docs_of):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(edges, empty).where("n_hit > 0").count() == 0
    assert contamination_report(docs_of([]), empty).count() == 0
    some = spark.createDataFrame([(1, "word word"), (1, "word word")], "item_id long, text string")
    assert contamination_report(edges, some).where("n_hit = 40000 and n_items = 1").count() == 1


def test_clashing_columns_are_kept(spark, docs_of):
    names = ["place", "others", "hits", "kept"]
    docs = docs_of([(1, "a b same words here c")]).selectExpr("doc_id", "text", "'mine' as items", *(f"'own' as {n}" for n in names))
    row = decontaminate(docs, spark.createDataFrame([(1, "same words here")], "item_id long, text string")).first()
    assert all(row[n] == "own" for n in names) and row["items"] == ["1"] and row["text"].split() == ["a", "b", "c"]


def test_one_part_takes_one_python_worker_and_each_text_once(spark, docs_of):
    docs, items = fixture()
    bench = spark.createDataFrame(items, "item_id long, text string")
    plan = decontaminate(docs_of(docs), bench)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
