import os
import posixpath
import random

from pyspark.sql import functions as F

from quillspan.operators.targets import cleaned, frozen_specs, inside, linked, payloads, targets


def test_cleaned_paths(spark):
    rng = random.Random(2)
    texts = ["/" + "/".join(rng.choice(["a", "b", "..", ".", "", "...", "c d"]) for _ in range(rng.randrange(9))) for _ in range(300)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", cleaned(F.col("t")).alias("c")).collect()
    assert all(r["c"] == posixpath.normpath(r["t"]).replace("//", "/") for r in got)
    rows = spark.createDataFrame([("/w/p", "/w/p"), ("/w/p/x", "/w/p/"), ("/w/pp", "/w/p"), ("/W/P/x", "/w/p"), ("/", "/w")], "p string, r string").select(inside(F.col("p"), F.col("r")).alias("a"), inside(F.col("p"), F.col("r"), True).alias("b")).collect()
    assert [(r["a"], r["b"]) for r in rows] == [(True, True), (True, True), (False, False), (False, True), (False, False)]


def test_links_as_a_file_system_follows_them(spark, tmp_path):
    root = str(tmp_path)
    os.makedirs(f"{root}/w/p/docs")
    os.makedirs(f"{root}/out/deep")
    links = [("w/p/away", "../../out"), ("w/p/abs", f"{root}/out/deep"), ("w/p/docs/up", ".."), ("w/p/two", "away/deep"), ("out/deep/home", "../../w/p"), ("w/p/loop", "loop"), ("w/p/chain", "docs/up/docs")]
    for at, to in links:
        os.symlink(to, f"{root}/{at}")
    paths = ["away/x", "abs/x", "docs/up/docs/y", "two/home/docs/z", "two/../x", "away/../x", "docs/./a//b", "loop/x", "chain/q", "none/../docs", "abs", "docs/up/away/deep/home/two"]
    df = spark.createDataFrame([(f"{root}/w/p/{p}",) for p in paths] + [(None,)], "path string")
    got = {r["path"]: r["resolved"] for r in linked(df, spark.createDataFrame([(f"{root}/{a}", t) for a, t in links], "link string, to string")).collect()}
    for p in paths:
        want = None if p.startswith("loop") else os.path.realpath(f"{root}/w/p/{p}")
        assert got[f"{root}/w/p/{p}"] == want, p
    assert got[None] is None


HOSTILE = [
    "../x.md", "../../etc/passwd", "/etc/passwd", "a/../../x.md", "a/b/../../../p2/x.md", "/w/p2/x.md", "/w/p/../p2/x", "away/x.md", "away/../../x.md", "/w/p/away/x", "..", "/", "/w", "./../p2/./x", "a//..//..//x", "x\0y.md", "loop/a.md", "/w/pp", "/w/P/x.md", "in/../../x.md",
]


def test_hostile_and_good_targets(spark):
    links = spark.createDataFrame([("/w/p/away", "/out"), ("/w/p/loop", "loop"), ("/w/p/in", "docs"), ("/link", "/w/p")], "link string, to string")
    good = {"docs/a.md": "/w/p/docs/a.md", "./a/../b.md": "/w/p/b.md", "/w/p/c.md": "/w/p/c.md", "in/a.md": "/w/p/docs/a.md", "a/../../p/x.md": "/w/p/x.md", "/link/y.md": "/w/p/y.md", None: "/w/p/AGENTS.md", "": "/w/p/AGENTS.md"}
    names = [*HOSTILE, *good]
    rows = [(str(i), "project_rule", "codex", "/w/p", t) for i, t in enumerate(names)]
    rows += [
        ("s1", "skill", "claude", "/link", None), ("s2", "skill", "claude", "/w/p", "skills/x.md"), ("s3", "skill", "claude", "/w/p", "k/SKILL.md"), ("g", "global_rule", "claude", None, None), ("i", "ignore", "codex", "/w/p", None),
        ("a", "project_rule", "other", "/w/p", None), ("n", "project_rule", None, "/w/p", None), ("p", "scoped_rule", "codex", None, None), ("r", "project_rule", "codex", "w/p", None), ("u", "else", "codex", "/w/p", None),
    ]
    schema = "review_id string, placement string, agent string, project_root string, target string"
    got = {r["review_id"]: r for r in targets(spark.createDataFrame(rows, schema), links, "/home/u/.agent").collect()}
    for i, t in enumerate(names):
        r = got[str(i)]
        if t in good:
            assert (r["target_path"], r["kind"], r["root"], r["error"]) == (good[t], "policy", "/w/p", None), t
        else:
            assert r["target_path"] is None and r["error"] == ("nul" if "\0" in t else "goes_round" if t.startswith("loop") else "escapes"), t
    assert (got["s1"]["target_path"], got["s1"]["kind"]) == ("/w/p/skills/s1/SKILL.md", "skill") and got["s3"]["target_path"] == "/w/p/k/SKILL.md"
    assert (got["g"]["target_path"], got["g"]["kind"]) == ("/home/u/.agent/CLAUDE.md", "global")
    errors = {"s2": "not_a_skill_file", "i": "no_target", "a": "agent_required", "n": "agent_required", "p": "project_required", "r": "root_not_absolute", "u": "unsupported"}
    assert {k: got[k]["error"] for k in errors} == errors
    assert targets(spark.createDataFrame([("g", "global_rule", "codex", None, None)], schema), links).first()["error"] == "global_root_required"
    any_case = targets(spark.createDataFrame([("c", "project_rule", "codex", "/w/p", "/w/P/x.md")], schema), links, ignore_case=True).first()
    assert any_case["error"] is None


def test_payloads_and_specs(spark):
    sets = spark.createDataFrame([("a",), ("b",), ("c",)], "group_key string")
    proposals = spark.createDataFrame([("a", "skill", 2, 0.5, "s"), ("a", "ignore", 1, 0.9, "i"), ("b", "skill", 1, 0.7, "t")], "group_key string, placement string, rank int, score double, content string")
    experiences = spark.createDataFrame([("a", "T", "fr", "L")], "group_key string, title string, pattern string, lesson string")
    evidence = spark.createDataFrame([("a", "skill", 2, "support"), ("a", "skill", 1, "support"), ("a", "ignore", 1, "support")], "group_key string, placement string, occurrence_id int, role string")
    reviews = spark.createDataFrame([("r1", "a", "skill", "accepted", "mine"), ("r2", "b", "skill", "rejected", None)], "review_id string, group_key string, placement string, status string, content_override string")
    actions = spark.createDataFrame([("r1", 2, "accept"), ("r1", 1, "edit")], "review_id string, seq int, action string")
    shown = payloads(sets, proposals, experiences, evidence, reviews, actions)
    got = {r["group_key"]: r.asDict(recursive=True) for r in shown.collect()}
    assert got["a"]["proposal"] == {"placement": "skill", "rank": 2, "score": 0.5, "content": "s", "effective_content": "mine"}
    assert [x["placement"] for x in got["a"]["alternatives"]] == ["ignore", "skill"] and [x["occurrence_id"] for x in got["a"]["evidence"]] == [1, 2]
    assert [x["action"] for x in got["a"]["history"]] == ["edit", "accept"] and got["a"]["experience"]["title"] == "T"
    assert got["b"]["proposal"]["effective_content"] == "t" and got["b"]["history"] == [] and got["b"]["experience"] is None
    assert (got["c"]["alternatives"], got["c"]["evidence"], got["c"]["history"], got["c"]["review"]) == ([], [], [], None)

    sha = "a" * 40
    asked = [("r1", 1, "codex", "t", ["v"], sha), ("r1", 2, "codex", "t", ["v"], sha), ("r1", 3, "x", "t", ["v"], sha), ("r1", 4, "codex", " ", ["v"], sha), ("r1", 5, "codex", "t", [], sha), ("r1", 6, "codex", "t", ["v"], "HEAD"), ("r2", 7, "codex", "t", ["v"], sha), ("r9", 8, "codex", "t", ["v"], sha)]
    asked = spark.createDataFrame(asked, "review_id string, seq int, agent string, task string, verifiers array<string>, commit string")
    revisions = spark.createDataFrame([("r1", 3, False)], "review_id string, revision int, stale boolean")
    specs = {r["seq"]: r for r in frozen_specs(asked, shown, revisions).collect()}
    assert [specs[i]["error"] for i in range(1, 9)] == [None, None, "agent_required", "no_task", "no_verifier", "no_commit", "not_eligible", "not_reviewed"]
    assert specs[1]["content"] == "mine" and specs[1]["revision"] == 3 and specs[1]["evaluation_id"] != specs[2]["evaluation_id"]
    stale = frozen_specs(asked, shown, revisions.withColumn("stale", F.lit(True))).where("seq = 1").first()
    assert stale["error"] == "stale" and stale["evaluation_id"] is None
