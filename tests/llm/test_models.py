import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillspan.llm import bytekernel as bk
from quillspan.llm import langid, toxicity


def prose(rng, n, bad=()):
    w = ["".join(rng.choice(["on", "er", "th", "st", "ing", "re", "an"]) for _ in range(rng.randrange(1, 4))) for _ in range(n)]
    for x in bad:
        w.insert(rng.randrange(len(w)), x)
    return " ".join(w)


def toxic_rows(seed=1, n=700):
    rng = random.Random(seed)
    return [(i, prose(rng, rng.randrange(20, 120), rng.choices(["idiot", "moron", "pathetic"], k=3) if i % 4 == 0 else ()), int(i % 4 == 0)) for i in range(n)]


def test_toxicity_held_out_and_misspelled(spark, docs_of):
    rows = toxic_rows()
    docs = docs_of([r[:2] for r in rows])
    labels = spark.createDataFrame([(r[0], 0, r[2]) for r in rows], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_report(docs, labels).collect()
    truth = {r[0]: r[2] for r in rows}
    out = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in out]) > 0.95
    model = toxicity.train(docs, labels)
    rng = random.Random(9)
    score = lambda bad: np.mean([model.probabilities(model.logits(b, o)) for _, b, o in bk.blocks(pa.array([prose(rng, 40, bad) for _ in range(50)]))])
    assert score(["idiiot", "morons"]) > score([]) + 0.2


def test_toxicity_edges(spark, edges, docs_of):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_report(edges, labels).collect()
    assert len(got) == 9 and all(0 <= r["score"] <= 1 for r in got)
    some = spark.createDataFrame([(1, 0, 1), (4, None, 0), (4, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity_report(edges, some).count() == 9
    assert toxicity.toxicity_report(docs_of([]), labels).count() == 0


def test_long_rows_score_like_any(docs_of):
    rng = random.Random(2)
    model = toxicity.fit([r[1] for r in toxic_rows()], np.array([r[2] for r in toxic_rows()], float), np.arange(700) % 5 == 0)
    clean = prose(rng, 3000)
    one, two = (model.probabilities(model.logits(*next(iter(bk.blocks(pa.array([t]))))[1:]))[0] for t in (clean, clean + " idiot moron pathetic idiot"))
    assert two > one


def evidence(spark, rows):
    return spark.createDataFrame(rows, "id long, text string, declared string, host string, parent string, suffix string, hint string")


def model():
    rng = random.Random(4)
    make = lambda parts: [" ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(60)) for _ in range(30)]
    a, b = make(["the", "ing", "of", "and"]), make(["che", "ung", "der", "ein"])
    return langid.fit_texts(a + b, ["en"] * 30 + ["de"] * 30)


def test_evidence_is_fused(spark):
    m = model()
    rows = [(i, "the ingof andthe ofthe", "en", "a.com", "com", "com", None) for i in range(30)]
    rows += [(100 + i, "chederein ungder einche", "de", "b.de", "de", "de", "de") for i in range(30)]
    rows += [(200, "xyz", "de", "b.de", "de", "de", "de"), (201, "xyz", "en", "a.com", "com", "com", None), (202, "zzz", None, "new.de", "de", "de", None), (203, None, "de", "b.de", "de", "de", "de"), (204, "", None, None, None, None, None)]
    got = {r["id"]: r for r in langid.identified(evidence(spark, rows), m).collect()}
    assert got[0]["language"] == "en" and got[100]["language"] == "de" and got[0]["posterior"] > 0.99
    assert got[200]["language"] == "de" and got[201]["language"] == "en"
    assert got[203]["rejected"] and got[204]["rejected"] and got[203]["language"] == "und"
    assert got[0]["text_language"] == "en" and got[200]["posterior"] > 0.5
    assert langid.identified(evidence(spark, []), m).count() == 0


def test_posterior_matches_a_plain_form(spark):
    """Bayes' rule by hand, from counts of the texts' own languages."""
    m, names = model(), ["de", "en"]
    rng = random.Random(3)
    hosts = [("a.x.de", "x.de", "de"), ("b.x.de", "x.de", "de"), ("c.com", "c.com", "com"), (None, None, None)]
    texts = ["theofing andthe", "cheung dereinche", "ofung", "the", "?!", None, "x" * 400]
    rows = []
    for i in range(120):
        host = rng.choice(hosts)
        rows.append((i, rng.choice(texts), rng.choice(["de", "en", "xx", None]), *host, rng.choice([None, "de"])))
    got = {r["id"]: r for r in langid.identified(evidence(spark, rows), m).collect()}
    seen = {}
    for r in rows:
        (_, buf, offs), *_ = list(bk.blocks(pa.array([r[1] or ""], pa.large_string()))) or [(0, np.zeros(0, np.uint8), np.array([0, 0]))]
        n, ll, far = (x[0] for x in m.log_likelihoods(buf, offs))
        seen[r[0]] = (n, ll * n**langid.POWER, far, names[int(ll.argmax())] if n and not far else None)
    count = lambda key: np.array([sum(1 for r in rows if key(r) and seen[r[0]][3] == x) for x in names], float)
    strength = langid.STRENGTH
    for r in rows:
        n, ll, far, _ = seen[r[0]]
        prior = (count(lambda q: q[3] is not None) + strength / 2) / (count(lambda q: q[3] is not None).sum() + strength)
        if r[3] is None:
            prior = np.array([0.5, 0.5])
        else:
            for k in (5, 4, 3):
                c = count(lambda q: q[k] == r[k])
                prior = (c + strength * prior) / (c.sum() + strength)
        score = ll + np.log(prior)
        for k in (2, 6):
            if r[k] is not None:
                c, total = count(lambda q: q[k] == r[k]), count(lambda q: q[k] is not None)
                share = (c.sum() + 1) / (total.sum() + 1)
                score = score + np.log((c + strength * share) / (total + strength))
        p = np.exp(score - score.max()) / np.exp(score - score.max()).sum()
        gone = not (r[1] or "").strip() or far or (n == 0 and r[2] is None and r[6] is None) or p.max() < 0.5
        assert got[r[0]]["rejected"] == gone
        assert abs(got[r[0]]["posterior"] - p.max()) < 1e-9
        assert got[r[0]]["language"] == ("und" if gone else names[int(p.argmax())])


def test_clashing_names_are_kept(spark):
    rows = evidence(spark, [(1, "theofing andthe", "en", "a", "a", "", None), (2, None, None, None, None, None, None)])
    more = [F.lit(7).alias(c) for c in ("_h", "prior", "n_grams", "text_ll", "declared_ll", "_s", "_top", "text_lang", "rest", "score", "top", "n", "foreign")]
    got = langid.identified(rows.select("*", *more), model())
    assert set(got.columns) == {*rows.columns, "language", "posterior", "text_language", "rejected", "_h", "prior", "n_grams", "text_ll", "declared_ll", "_s", "_top", "text_lang", "rest", "score", "top", "n", "foreign"} - {"text"}
    assert all(r["prior"] == r["top"] == r["text_lang"] == 7 for r in got.collect()) and got.count() == 2


def test_texts_of_no_known_language_are_rejected(spark):
    rng = random.Random(8)
    m = model()
    junk = [" ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(7)) for _ in range(60)), "".join(rng.choice("0123456789abcdef") for _ in range(600)), "Все люди рождаются свободными и равными " * 4]
    mixed = "theofing andthe ingof cheung dereinche ungder " * 8
    got = {r["id"]: r for r in langid.identified(evidence(spark, [(i, t, "en", "a", "a", "", None) for i, t in enumerate([*junk, mixed])]), m).collect()}
    assert [got[i]["rejected"] for i in range(4)] == [True, True, True, False] and got[0]["text_language"] is None


def test_host_priors_are_drawn_to_their_surroundings(spark):
    rows = spark.createDataFrame([("h1.x.de", "x.de", "de", "de")] * 40 + [("h2.x.de", "x.de", "de", "en")] + [("h3.y.com", "y.com", "com", "en")] * 40, "host string, parent string, suffix string, text_lang string")
    prior = {r["host"]: r["prior"] for r in langid._prior_table(rows, ["de", "en"]).collect()}
    assert prior["h1.x.de"][0] > 0.9 and prior["h3.y.com"][1] > 0.9 and 0.3 < prior["h2.x.de"][0] < 0.95
    assert all(abs(sum(p) - 1) < 1e-9 for p in prior.values())


def test_addresses(spark):
    cols = langid.address_columns(F.col("u"), ["de", "fr"])
    rows = spark.createDataFrame([("https://m.a.example.com/fr/25#top",), ("http://fr.site.de/x",), ("not a url",), (None,)], "u string").select("u", *(c.alias(n) for n, c in cols.items())).collect()
    assert (rows[0]["host"], rows[0]["parent"], rows[0]["suffix"], rows[0]["hint"]) == ("m.a.example.com", "a.example.com", "com", "fr")
    assert rows[1]["hint"] == "de" and rows[3]["host"] is None


def test_language_of_tables(edges, docs_of):
    docs = langid.of_documents(edges, [F.col("doc_id")])
    got = langid.identified(docs, langid.train(edges)).collect()
    assert len(got) == 9 and {r["doc_id"] for r in got if r["rejected"]} == {1, 2, 3}
    assert langid.train(docs_of([])).languages == []


def test_every_labelled_language_has_a_class(spark):
    rows = [(i, f"text of language {i} " * (3 if i else 2000), f"l{i}") for i in range(70)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == sorted(f"l{i}" for i in range(70))
