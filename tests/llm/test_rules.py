import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspan.llm.rules import BUDGETS, LEVELS, MARGINS, RULES, RULES_SQL, binomial_tail, chosen_cutoffs, counted, judged, log_factorial, rules_report, rules_sql

WORD = r"[^\x20\x09-\x0D]+"


def plain_counts(text):
    text = text or ""
    w = re.findall(WORD, text)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_repeat_words": len(hit), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_capitals": sum(c.isupper() and c.isalpha() for c in text), "n_marks": sum(not c.isalnum() and not re.fullmatch(r"[ \t-\r]", c) for c in text),
    }


def test_counts_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n\x0b\x0c\r", "one", "a b c d e", "a b c d e a b c d e", "a b c d e f a b c d e", "x " * 20000, "line one\nline one\n\n \nline one\r\nline two", "É É É|É É É # * É 😀 日本語", "a\x1fb\x85c d"]
    texts += [rng.choice([" ", "\n", "  "]).join(rng.choice("abc#AB!") * rng.randrange(1, 3) for _ in range(rng.randrange(40))) for _ in range(150)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", counted(F.col("t")).alias("c")).collect()
    for r in got:
        assert r["c"].asDict() == plain_counts(texts[r["i"]]), texts[r["i"]]


def exact_tail(k, n, p):
    return math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_binomial_tail(spark):
    cases = [(0, 1), (0, 228), (1, 228), (5, 400), (11, 1000), (20, 1000), (29, 1000), (30, 1000), (3, 20), (0, 0), (2, 5)]
    got = spark.createDataFrame(cases, "k long, n long").select("k", "n", binomial_tail(F.col("k"), F.col("n"), 0.03).alias("p")).collect()
    for r in got:
        assert r["p"] == (pytest.approx(exact_tail(r["k"], r["n"], 0.03), rel=1e-9) if r["k"] < 0.03 * r["n"] else 1.0)
    large = spark.range(1).select(binomial_tail(F.lit(2_980_000).cast("long"), F.lit(100_000_000).cast("long"), 0.03).alias("p")).first()["p"]
    z = (2_980_000.5 - 3e6) / math.sqrt(3e6 * 0.97)
    assert large == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)), rel=0.05)
    logs = spark.range(200).select("id", log_factorial(F.col("id")).alias("f")).collect()
    assert all(r["f"] == pytest.approx(math.lgamma(r["id"] + 1), rel=1e-13, abs=1e-13) for r in logs)


def plain_cutoffs(observations, share, error, least):
    """Levels and cutoffs with lists and exact fractions of counts."""
    held = Counter(s for s, _, clean, holdout in observations if clean and holdout)
    pool_of = {s: f"={s}" if held[s] >= least else "*" for s, *_ in observations}
    by = defaultdict(list)
    for s, sig, clean, holdout in observations:
        by[pool_of[s]].append((sig, clean, holdout))
    out = {}
    for pool, rows in by.items():
        tune = [sig for sig, clean, h in rows if clean and not h]
        test, junk = [sig for sig, clean, h in rows if clean and h], [sig for sig, clean, _ in rows if not clean]
        best, levels = None, []
        for level in range(LEVELS) if tune else ():
            allowed = len(tune) * share * (level - len(MARGINS)) // (1000 * BUDGETS * len(RULES))
            cut = [next(c for c in range(1002) if sum(sig[r] >= c for sig in tune) <= allowed) for r in range(len(RULES))] if level >= len(MARGINS) else None
            cut = cut or [max(sig[r] for sig in tune) * MARGINS[level][0] // 2 + MARGINS[level][1] + 1 for r in range(len(RULES))]
            levels.append(cut)
            k = sum(any(x >= c for x, c in zip(sig, cut)) for sig in test)
            if not test or k >= len(test) * share / 1000 or exact_tail(k, len(test), share / 1000) > error / len(by):
                break
            gain = sum(any(x >= c for x, c in zip(sig, cut)) for sig in junk) * len(test) - k * len(junk)
            if best is None or gain > best[0]:
                best = (gain, level)
        out[pool] = (best[1], levels[best[1]]) if best else (None, None)
    return pool_of, out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cutoffs_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for stratum, n in (("en", 2500), ("de", 700), ("few", 60), ("", 30), ("none", 5)):
        for _ in range(n):
            clean = rng.random() < (0.85 if stratum != "none" else 0)
            sig = [min(1000, int(rng.expovariate(1 / (3 if clean or rng.random() < 0.3 else 40)))) if r < 3 else 0 for r in range(len(RULES))]
            rows.append((stratum, sig, clean, rng.random() < 0.5))
    df = spark.createDataFrame(rows, "stratum string, signals array<int>, clean boolean, holdout boolean").repartition(3)
    pools, levels = chosen_cutoffs(df, 30, 0.05, 100)
    pool_of, want = plain_cutoffs(rows, 30, 0.05, 100)
    assert {r["stratum"]: r["pool"] for r in pools.collect()} == pool_of
    assert {r["pool"]: (r["level"], r["cutoffs"]) for r in levels.collect()} == want
    assert any(level is not None for level, _ in want.values())


def test_false_rejections_stay_below_the_share(spark):
    """Clean signals of two strata are drawn anew 40 times; the chosen level's true share of rejections is known from its cutoffs."""
    rng = random.Random(9)
    rows = [(f"{t}", [int(rng.expovariate(1 / 20)) if r == 0 else 0 for r in range(len(RULES))], rng.random() < 0.9, rng.random() < 0.5) for t in range(40) for _ in range(1600)]
    df = spark.createDataFrame(rows, "stratum string, signals array<int>, clean boolean, holdout boolean")
    _, levels = chosen_cutoffs(df, 30, 0.05, 100)
    found = [r for r in levels.collect() if r["cutoffs"]]
    assert found and all(math.exp(-r["cutoffs"][0] / 20) <= 0.03 for r in found)


def corpus(spark, n=1600, seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["on", "er", "th", "st", "ing", "re", "an", "ou"]) for _ in range(rng.randrange(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words, bad = [word() for _ in range(rng.randrange(12, 60))], rng.random() < 0.2
        if bad:
            words = [w + rng.choice(["***", "%%%", "&&&"]) for w in words] if i % 2 else [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words), rng.choice(["en", "en", "en", "de", None, f"x{i}"]), "s", 0, "own"))
        labels.append((i, int(not bad), 0))
    schema = "doc_id long, text string, lang string, source string, n_chars long, signals string"
    return docs, labels, lambda rows=docs: spark.createDataFrame(rows, schema), lambda rows=labels: spark.createDataFrame(rows, "doc_id long, quality int, kept int")


def test_report_equals_its_sql(spark):
    docs, labels, docs_df, labels_df = corpus(spark)
    docs += [docs[3], (None, docs[5][1], "en", "s", 0, "own"), (8, docs[9][1], "en", "s", 0, "own"), (2000, None, None, None, None, None), (2001, docs[11][1], "de", "s", 0, "own")]
    labels += [(3, 0, 0), (2001, 1, 0), (2000, 0, 0), (5000, 1, 1), (None, 1, 1), (7, None, None)]
    d, q = docs_df(docs), labels_df(labels)
    db = duckdb.connect()
    db.register("documents", d.select("doc_id", "text", "lang").toArrow())
    db.register("labels", q.select("doc_id", "quality").toArrow())
    got = sorted(map(repr, map(tuple, rules_report(d, q).collect())))
    assert got == sorted(map(repr, db.sql(RULES_SQL).fetchall()))
    kept = {r["doc_id"]: r["kept"] for r in judged(d, q, least=150).collect()}
    bad = {i for i, quality, _ in labels[:1600] if not quality}
    assert sum(kept[i] for i in range(1600) if i not in bad) > 0.95 * (1600 - len(bad)) and sum(kept[i] for i in bad) < 0.1 * len(bad)
    few = sorted(db.sql(rules_sql(least=150)).fetchall(), key=repr)
    assert sorted((r[0], r[-1]) for r in few if r[0] is not None) == sorted((r["doc_id"], r["kept"]) for r in judged(d, q, least=150).collect() if r["doc_id"] is not None)


def test_edges(edges, docs_of, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = judged(edges, labels).collect()
    assert len(got) == 9
    texts = {r["doc_id"]: r["text"] for r in edges.collect()}
    for r in got:
        c = plain_counts(texts[r["doc_id"]])
        assert all(r[k] == c[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert r["base_failed"] and not r["kept"]
    assert rules_report(docs_of([]), labels).count() == 0
    assert rules_report(docs_of([(1, "one two three four five six seven eight nine ten eleven")]), labels).first()["kept"]


def test_no_python_in_the_plan(spark):
    _, _, docs_df, labels_df = corpus(spark, 50)
    plan = rules_report(docs_df(), labels_df())._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
