import json
import random

from pyspark.sql import functions as F

from quillspan.functions.nested import canonical_hash, canonical_json, decoded, decoded_or, redacted_json

BROKEN = ["", "bad", "{", '{"a":1} x', '{"a":1}}', "1],[2", '"a" "', '{"a":1,"a":2}', "[1,2", "1 2", '{"a":1} "b', "'a'"]


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 5 else 4)
    if kind < 2:
        return rng.choice(["", "a", 'quote " in', "back \\ slash", "\\\\\"\\", "é😀", "line\nbreak\ttab", "\x01\x0b\x1f", "a:b,c{}[]", "\\u005c \\u0022", "/"])
    if kind == 2:
        return rng.choice([0, -5, 12345678901234567890, 2.5, True, False, None])
    if kind == 3:
        return rng.choice([{}, []])
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "Z", "é", "key:,", 'k"q', "k\\", "b" * 3, "\n"]): value(rng, depth + 1) for _ in range(rng.randrange(5))}


def shuffled(rng, x):
    if isinstance(x, dict):
        items = [(k, shuffled(rng, v)) for k, v in x.items()]
        rng.shuffle(items)
        return dict(items)
    return [shuffled(rng, v) for v in x] if isinstance(x, list) else x


def test_canonical_texts(spark):
    rng = random.Random(7)
    values = [value(rng) for _ in range(400)] + [{"deep": json.loads('{"a":[' * 200 + "1" + "]}" * 200)}]
    texts = [(i, json.dumps(shuffled(rng, v), ensure_ascii=bool(i % 2), indent=i % 3 or None)) for i, v in enumerate(values)]
    got = spark.createDataFrame(texts, "i int, t string").select("i", canonical_json(F.col("t")).alias("c"), canonical_hash(F.col("t")).alias("h")).collect()
    for r in got:
        assert r["c"] == json.dumps(values[r["i"]], ensure_ascii=False, sort_keys=True)
    other = [(i, json.dumps(shuffled(rng, v))) for i, v in enumerate(values)]
    again = spark.createDataFrame(other, "i int, t string").select("i", canonical_hash(F.col("t")).alias("h")).collect()
    assert {r["i"]: r["h"] for r in got} == {r["i"]: r["h"] for r in again}


def test_broken_texts_and_scalars(spark):
    texts = [*BROKEN, None, '{"a": [1]}', " 12 ", '"x"', "null", "[]", "true"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", decoded(F.col("t")).alias("d"), canonical_json(F.col("t")).alias("c"), F.to_json(decoded_or(F.col("t"))).alias("o"))
    got = {r["t"]: (r["d"]["ok"], r["c"], r["o"]) for r in rows.withColumn("d", F.struct("d.ok")).collect()}
    assert all(got[t] == (False, t, "{}") for t in BROKEN)
    assert got[None] == (True, None, "{}") and got['{"a": [1]}'] == (True, '{"a": [1]}', '{"a":[1]}') and got[" 12 "] == (True, "12", "{}") and got["null"][0]
    assert {t: v[2] for t, v in got.items() if t in ('"x"', "[]", "true")} == {'"x"': "{}", "[]": "{}", "true": "{}"}


def test_redaction_keeps_structure(spark):
    secret = "TOKEN=abcdef123456"
    rng = random.Random(3)

    def planted(x, depth=0):
        if isinstance(x, dict):
            return {k: planted(v, depth + 1) for k, v in x.items()} | ({"s": f'it is {secret} "q"\n\\'} if rng.random() < 0.3 else {})
        if isinstance(x, list):
            return [planted(v, depth + 1) for v in x] + ([secret] if rng.random() < 0.3 else [])
        return x

    def expected(x):
        if isinstance(x, dict):
            return {k: expected(v) for k, v in x.items()}
        if isinstance(x, list):
            return [expected(v) for v in x]
        return x.replace(secret, "TOKEN=[REDACTED:env-secret]") if isinstance(x, str) else x

    values = [planted(value(rng)) for _ in range(200)] + [{secret: 1}, [], "plain"]
    texts = [json.dumps(v) for v in values]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", redacted_json(F.col("t")).alias("r")).collect()
    for r in rows:
        v, out = values[r["i"]], r["r"]["text"]
        assert json.loads(out) == expected(v) and r["r"]["redacted"] == (expected(v) != v)
        if expected(v) == v:
            assert out == texts[r["i"]]
    plain = spark.createDataFrame([(f"no json, {secret}",), ("{",), (None,)], "t string").select(redacted_json(F.col("t")).alias("r")).collect()
    assert [r["r"]["text"] for r in plain] == ["no json, TOKEN=[REDACTED:env-secret]", "{", None]


def test_each_pattern_is_applied_once(spark):
    rows = spark.createDataFrame([('{"a": "TOKEN=abcdef and sk-ant-' + "x" * 30 + ' at https://u:pw1234@h"}',)], "t string").select(redacted_json(F.col("t")).alias("r"))
    assert rows.first()["r"]["text"] == '{"a": "TOKEN=[REDACTED:env-secret] and [REDACTED:openai-key] at https://[REDACTED:basic-auth-url]@h"}'
    assert rows._jdf.queryExecution().analyzed().toString().count("regexp_replace(") < 60
