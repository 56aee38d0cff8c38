import difflib
import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quillspan.operators.previews import common_lines, line_counts, line_hunks, patched, previews, unified, with_hunks, with_patched


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row, last = [0], row
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=18), st.lists(st.integers(0, 3), max_size=18))
def test_common_lines_are_a_longest_common_subsequence(a, b):
    got = common_lines(a, b)
    assert all(a[i] == b[j] for i, j in got) and len(got) == lcs_length(a, b)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))


def pairs(n, seed):
    rng = random.Random(seed)
    line = lambda: rng.choice(["a", "b", "", "long line", "é", "x\x0by"]) + rng.choice(["\n", "\n", "\r\n"])
    for _ in range(n):
        before = [line() for _ in range(rng.randrange(40))]
        after = [x for x in before if rng.random() > 0.15]
        for _ in range(rng.randrange(4)):
            after.insert(rng.randrange(len(after) + 1), line())
        end = rng.choice(["", "no end"])
        yield "".join(before) + rng.choice(["", "no end"]), "".join(after) + end


def test_hunks_make_after_of_before(spark):
    rows = [(i, f"p{i}", x, y) for i, (x, y) in enumerate(pairs(1000, 5))]
    df = with_patched(with_hunks(spark.createDataFrame(rows, "i int, path string, before string, after string")))
    for r in df.collect():
        assert r["patched"] == r["after"] and r["after_sha256"] == hashlib.sha256(r["after"].encode()).hexdigest()
        theirs = list(difflib.unified_diff(r["before"].splitlines(True), r["after"].splitlines(True), r["path"], r["path"]))
        ours = sum(x[0] in "+-" for h in r["hunks"] for x in h["lines"])
        assert ours <= sum(x[0] in "+-" and not x.startswith(("---", "+++")) for x in theirs)


def test_unified_text_reads_as_the_usual_one():
    for before, after in (("a\nb\nc\n", "a\nx\nc\n"), ("", "a\n"), ("a\n", ""), ("a\n" * 3 + "b\n" + "c\n" * 20 + "d", "a\n" * 3 + "c\n" * 20 + "e"), ("same", "same")):
        assert unified("p", line_hunks(before, after)) == "".join(difflib.unified_diff(before.splitlines(True), after.splitlines(True), "p", "p"))


def test_changed_files_are_refused_and_long_ones_are_quick():
    hunks = line_hunks("a\nb\nc\n", "a\nx\nc\n")
    assert patched("a\nb\nother\n", hunks) is None and patched("", hunks) is None and patched("a\nb\nc\n", hunks) == "a\nx\nc\n"
    long = [f"{i}\n" for i in range(60000)]
    other = [x for i, x in enumerate(long) if i % 700] + ["end\n"]
    assert patched("".join(long), line_hunks("".join(long), "".join(other))) == "".join(other)


def test_previews(spark):
    reviews = [("r1", "accepted", "e1", "skill", "a.md", "Do it."), ("r2", "unreviewed", "e2", "skill", "a.md", "no"), ("r3", "applied", "e3", "skill", "none.md", "New."), ("r4", "accepted", "e4", "skill", "a.md", "<!-- policy:end -->")]
    files = [("a.md", "# Title\nText\n")]
    got = {r["review_id"]: r for r in previews(spark.createDataFrame(reviews, "review_id string, status string, experience_id string, placement string, path string, content string"), spark.createDataFrame(files, "path string, text string")).collect()}
    assert set(got) == {"r1", "r3", "r4"}
    assert "Do it." in got["r1"]["after"] and patched("# Title\nText\n", [h.asDict() for h in got["r1"]["hunks"]]) == got["r1"]["after"]
    assert got["r3"]["before_sha256"] is None and got["r3"]["unified_diff"].startswith("--- none.md\n+++ none.md\n@@ -0,0 +1")
    assert got["r4"]["error"] and got["r4"]["after"] is None and got["r4"]["hunks"] is None
    df = with_hunks(spark.createDataFrame([("p", "a\nb\n", "b\nc\nd\n")], "path string, before string, after string"))
    assert df.select(line_counts(df["hunks"]).alias("n")).first()["n"].asDict() == {"added": 2, "removed": 1}
