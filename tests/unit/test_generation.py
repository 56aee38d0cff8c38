import random

import pytest
from pyspark.sql import functions as F

from quillspan.functions.digests import row_digest, set_digest
from quillspan.operators.generation import PLACEMENTS, generated, generation_pass, set_violations
from quillspan.versions import Pass, version, versions


def start(spark, root):
    x = [(g, f"title {g}", f"lesson of /abs/path {g}", "failure_repair", 0.5, 1.0, 2, 0, 0, 2, 1, "candidate", mark) for g, mark in (("a", None), ("b", "useful"), ("c", "false_positive"))]
    names = "group_key title lesson pattern confidence recency support_count contradiction_count ambiguous_count occurrence_count project_count status review_status".split()
    kinds = "string string string string double double long long long long long string string".split()
    ev = [(g, f"{g}{i}", f"t{g}", 1, "support", 1, 3, "model", ["tests"]) for g in "abc" for i in range(2)]
    events = [(f"t{g}", s, "file_edit", f"src/{g}.py", None) for g in "abc" for s in range(1, 5)]
    with Pass(spark, root) as p:
        p.put("experiences", spark.createDataFrame(x, ", ".join(f"{n} {k}" for n, k in zip(names, kinds))))
        p.put("evidence", spark.createDataFrame(ev, "group_key string, occurrence_id string, trajectory_id string, project_id long, classification string, start_sequence int, end_sequence int, repair_context string, antecedents array<string>"))
        p.put("events", spark.createDataFrame(events, "trajectory_id string, sequence int, type string, path string, command string"))


def run(spark, root, v="g1", **options):
    with Pass(spark, root) as p:
        return generation_pass(p, v, **options)


def test_passes(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    start(spark, root)
    figures, bad = run(spark, root)
    assert (figures.eligible, figures.regenerated, figures.unchanged, figures.rejected) == (2, 2, 0, 0) and bad.count() == 0
    one = version(spark, root)
    got = one["proposals"].collect()
    assert {(r["group_key"], r["placement"]) for r in got} == {(g, p) for g in "ab" for p in PLACEMENTS} and {r["rank"] for r in got} == {1, 2, 3, 4, 5}
    assert all("[repository path omitted]" in r["content"] and r["diagnostics"] for r in got)
    assert one["proposal_evidence"].count() == 2 * 2 * 5
    again, none = run(spark, root)
    assert (again.regenerated, again.unchanged, none) == (0, 2, None) and versions(spark, root) == [1, 2]
    with Pass(spark, root) as p:  # an event of b's session changes, and an order of rows that means nothing
        p.put("events", p.base["events"].withColumn("path", F.when(F.col("trajectory_id") == "tb", F.lit("db/x.sql")).otherwise(F.col("path"))).orderBy(F.desc("sequence")))
    third, _ = run(spark, root)
    now = version(spark, root)
    assert (third.regenerated, third.unchanged) == (1, 1)
    prints = lambda v: {r["group_key"]: r["fingerprint"] for r in v["proposal_sets"].collect()}
    assert prints(now)["a"] == prints(one)["a"] and prints(now)["b"] != prints(one)["b"] and now["proposals"].count() == 10
    assert run(spark, root, "g2")[0].regenerated == 2
    assert [r["regenerated"] for r in version(spark, root)["placement_runs"].collect()].count(2) == 2


def test_a_set_that_breaks_a_rule_keeps_what_it_had(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    start(spark, root)
    run(spark, root)
    before = version(spark, root)

    def wrong(x, ev, events):
        rows, links = generated(x, ev, events)
        return rows, links.withColumn("occurrence_id", F.when(F.col("group_key") == "a", F.lit("b0")).otherwise(F.col("occurrence_id")))

    figures, bad = run(spark, root, "g2", make=wrong)
    assert (figures.regenerated, figures.rejected) == (1, 1) and [tuple(r) for r in bad.collect()] == [("a", "evidence")]
    now = {r["group_key"]: r["version"] for r in version(spark, root)["proposal_sets"].collect()}
    assert now == {"a": "g1", "b": "g2"}
    links = lambda v: sorted(map(tuple, v["proposal_evidence"].where("group_key = 'a'").select("occurrence_id", "placement").collect()))
    assert links(version(spark, root)) == links(before)


def test_violations(spark):
    rows = []
    for g, places, ranks, content in (("ok", PLACEMENTS, (1, 2, 3, 4, 5), "c"), ("twice", (*PLACEMENTS[:4], "ignore"), (1, 2, 3, 4, 5), "c"), ("four", PLACEMENTS[:4], (1, 2, 3, 4), "c"), ("tie", PLACEMENTS, (1, 2, 2, 4, 5), "c"), ("null", PLACEMENTS, (1, 2, 3, 4, 5), None), ("other", (*PLACEMENTS[:4], "defer"), (1, 2, 3, 4, 5), "c")):
        rows += [(g, p, r, 0.5, "global", content) for p, r in zip(places, ranks)]
    df = spark.createDataFrame(rows, "group_key string, placement string, rank int, score double, target_type string, content string")
    links = spark.createDataFrame([("ok", "skill", 1), ("four", "skill", 1), ("tie", "ignore", 9)], "group_key string, placement string, occurrence_id long")
    ev = spark.createDataFrame([("ok", 1), ("four", 1), ("tie", 1)], "group_key string, occurrence_id long")
    got = sorted(map(tuple, set_violations(df, links, ev).collect()))
    assert got == [("four", "orphan"), ("four", "types"), ("null", "fields"), ("other", "types"), ("tie", "evidence"), ("tie", "ranks"), ("twice", "types")]


def test_violations_hold_no_row_twice(spark):
    rng = random.Random(2)
    sets = {g: [rng.randrange(1, n + 1) for _ in range(n)] if g % 2 else rng.sample(range(1, n + 1), n) for g, n in enumerate([3, 5, 62, 63, 64, 200] * 4)}
    sets |= {100: [None, 2], 101: [None], 102: [0, 1], 103: [-1, 2], 104: [63], 105: [1, 2, 3, 4, 5, 5]}
    rows = [(g, rng.choice([*PLACEMENTS, None]), r, 0.5, "global", "c") for g, ranks in sets.items() for r in ranks]
    df = spark.createDataFrame(rows, "group_key int, placement string, rank int, score double, target_type string, content string")
    none = spark.createDataFrame([], "group_key int, placement string, occurrence_id long")
    found = set_violations(df, none, none)
    got = {r["group_key"] for r in found.where("rule = 'ranks'").collect()}
    assert got == {g for g, ranks in sets.items() if None in ranks or sorted(ranks) != list(range(1, len(ranks) + 1))}
    places = {g: [r[1] for r in rows if r[0] == g] for g in sets}
    assert {r["group_key"] for r in found.where("rule = 'types'").collect()} == {g for g, p in places.items() if sorted(map(str, p)) != sorted(PLACEMENTS)}
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_digests(spark):
    df = spark.createDataFrame([(1, 0.1, "a", ["x"], None), (1, 0.1, "a", ["x"], ""), (2, float("nan"), None, [None], ""), (2, 1e40, None, [], "")], "g int, d double, s string, l array<string>, n string")
    d = [r[0] for r in df.select(row_digest(df, ["d", "s", "l", "n"])).collect()]
    assert len(set(d)) == 4
    one = df.withColumn("h", row_digest(df, ["d", "s", "l", "n"])).groupBy("g").agg(set_digest("h").alias("h"))
    two = df.orderBy(F.desc("n")).repartition(3).withColumn("h", row_digest(df, ["n", "l", "s", "d"])).groupBy("g").agg(set_digest("h").alias("h"))
    assert dict(map(tuple, one.collect())) == dict(map(tuple, two.collect()))
    with pytest.raises(TypeError):
        row_digest(spark.sql("select named_struct('a', 1) as m"), ["m"])
