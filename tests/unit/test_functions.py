"""Scalar functions on small tables of cases."""

import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillspan.functions import commands, paths, scores, text


def _column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").withColumn("y", make(F.col("x")))
    return [r["y"] for r in df.orderBy("i").collect()]


def _agree(spark, make, cases):
    assert dict(zip(cases, _column(spark, list(cases), make))) == cases


def test_command_kinds(spark):
    _agree(spark, commands.command_kind, {
        "pytest -q": "test", "FOO=1 pytest tests": "test", "cd app && ruff check .": "lint", "echo pytest": "other", "npm run build": "build", "uv add x": "package",
        "git status": "vcs", "cat a.txt": "read", "rg foo src": "search", "ls": "list", "./vendor/make all": "other", "make --version": "other", "grep foo README": "search",
        "échomake": "other", "": "other", None: "other", "true; (pytest)": "test", "echo 'x' | tee log && cargo test": "test",
    })


def test_outcome_types(spark):
    df = spark.createDataFrame([("test", 0), ("lint", 1), ("build", None), ("read", 0)], "k string, e int")
    got = [r[0] for r in df.select(commands.outcome_type(F.col("k"), F.col("e"))).collect()]
    assert got == ["test_pass", "lint_fail", None, None]


def test_command_contexts_and_families(spark):
    _agree(spark, commands.command_context, {"alembic upgrade head": "migration", "python manage.py makemigrations": "migration", "MYPY src": "typecheck", "ls": None, None: None})
    _agree(spark, commands.command_family, {"cd a && pytest -q": "pytest", "npx jest": "jest", "go test ./...": "go-test", "alembic upgrade head": "migration", "ls": None, None: None})


def test_file_contexts(spark):
    _agree(spark, paths.file_context, {
        "db/migrations/0001_x.py": "migration", "src/models/user.py": "model", "tests/test_a.py": "tests", "pyproject.toml": "config", ".github/workflows/ci.yml": "ci", "Makefile": "build",
        "docs/guide.md": "docs", "db/report.sql": "database", "web/pages/index.tsx": "frontend", "src/api/routes.ts": "backend", "LICENSE": "docs", "notes": "other", "": "other", None: "other",
        "src\\models\\user.py": "model", "./src/../src/models/a.py": "model",
    })


def test_vendored_paths(spark):
    _agree(spark, paths.is_vendored, {"node_modules/a/index.js": True, "src/vendor/x.go": True, "src/vendors/x.go": False, "a/.git/config": True, None: False})


@pytest.mark.parametrize(
    "given, expected",
    [("a/./b//c", "a/b/c"), ("a/../b", "b"), ("../a", "../a"), ("/../a", "/a"), ("", ""), (".", "."), ("/", "/"), (" a/b ", "a/b"), ("a\\b", "a/b"), ("a/../..", "..")],
)
def test_normalized_paths(spark, given, expected):
    assert _column(spark, [given], paths.normalized) == [expected]


def test_repository_paths(spark):
    _agree(spark, paths.repository_path, {"src/a.py": "src/a.py", "/etc/passwd": None, "~/x": None, "C:\\x": None, "../x": None, "https://x/y": None, "a/../../x": None, "": None, None: None})


def test_extensions_and_folders(spark):
    _agree(spark, paths.extension, {"a/b.TXT": ".txt", ".env": None, "a.tar.gz": ".gz", "README": None, "a.b/c": None})
    _agree(spark, paths.directory, {"a/b/c.py": "a/b", "c.py": None})
    _agree(spark, paths.language, {"a.py": "python", "b.tsx": "typescript", "c.unknown": None})


def test_summaries_and_bounds(spark):
    long = "ab " * 300
    got = _column(spark, ["  a \n b ", "", " \t", None, long], text.summarized)
    assert got[:4] == ["a b", None, None, None] and len(got[4]) <= 500 and got[4].endswith("…")
    assert _column(spark, ["abcdef"], lambda c: text.bounded(c, 4)) == ["abc…"]


def test_redaction(spark):
    made = {
        "key AKIA" + "A" * 16: "aws-access-key", "ghp_" + "a" * 36: "github-token", "sk-" + "b" * 24: "openai-key", "Authorization: Bearer " + "c" * 20: "bearer",
        "PASSWORD=hunter22": "env-secret", "https://u:p4ss@host/x": "basic-auth-url",
    }
    for (source, label), r in zip(made.items(), _column(spark, list(made), text.redacted)):
        assert r["redacted"] and f"[REDACTED:{label}]" in r["text"], source
    plain = _column(spark, ["nothing here", "", None], text.redacted)
    assert [r["redacted"] for r in plain] == [False] * 3 and plain[0]["text"] == "nothing here" and plain[2]["text"] is None


def test_error_signatures(spark):
    a, b = _column(spark, ["File /a/b.py line 3\nValueError: bad id 17", "File /other/c.py line 99\nValueError: bad id 4"], text.error_signature)
    assert a == b == "valueerror: bad id N"
    assert _column(spark, ["first\nsecond\n----", "12 34", "", None], text.error_signature) == ["second", "", "", ""]
    _agree(spark, lambda c: text.looks_diagnostic(text.error_signature(c)), {"ModuleNotFoundError: No module named 'x'": True, "tests failed": False, "exit code 1": False, "TypeError: x is not a function": True})


def test_corrections(spark):
    _agree(spark, text.is_correction, {"ok": False, "thanks!": False, "": False, None: False, "use it": True, "why?": True, "this keeps on happening here": True, "src/a.py": True, "fine by me": False})
    _agree(spark, text.is_directive, {"please use tabs": True, "hello there": False, None: False})


def test_ids_match_hashlib(spark):
    df = spark.createDataFrame([("a", None)], "x string, y string").select(text.short_id("P-", F.col("x"), F.col("y")))
    assert df.first()[0] == "P-" + hashlib.sha256(b"a\x1f").hexdigest()[:12]


def test_slugs(spark):
    _agree(spark, text.slug, {"A b/c!": "A-b-c", "...": "policy", "": "policy", None: "policy"})


def test_recency_and_confidence(spark):
    now = F.lit(datetime(2024, 6, 1))
    df = spark.createDataFrame([(datetime(2024, 5, 29),), (datetime(2024, 4, 1),), (datetime(2024, 1, 1),), (datetime(2020, 1, 1),), (None,)], "t timestamp_ntz")
    assert [r[0] for r in df.select(scores.recency(F.col("t"), now)).collect()] == [1.0, 0.6, 0.3, 0.1, 0.3]
    row = spark.range(1).select(scores.confidence(F.lit(5), F.lit(1), F.lit(6), F.lit(2), F.lit(1.0)).alias("c")).first()["c"]
    assert row["score"] == pytest.approx(0.84)


def test_excerpts_ids_and_hidden_columns(spark):
    from quillspan.functions.text import excerpt, project_id
    from quillspan.operators.views import shown

    rows = spark.createDataFrame([("abc", "/w/p/"), ("abcdefgh", "/w/p"), (None, "/")], "t string, root string")
    got = rows.select(excerpt(F.col("t"), 5).alias("e"), project_id(F.col("root")).alias("i")).collect()
    assert [r["e"] for r in got] == ["abc", "abcde\n... [truncated 3 bytes]", None]
    assert got[0]["i"] == got[1]["i"] != got[2]["i"] and got[0]["i"].startswith("proj_") and len(got[0]["i"]) == 17
    assert shown(rows.selectExpr("*", "t as source_path", "t as context_json"), "root").columns == ["t"]


def test_numbers_behind_the_highest_in_order(spark):
    from quillspan.operators.ledger import next_numbers

    rows = spark.range(500).select((F.col("id") * 7919 % 500).alias("k"), F.when(F.col("id") % 100 != 0, F.col("id")).alias("n")).repartition(5)
    got = next_numbers(rows, 40, [F.col("n"), F.col("k")]).collect()
    want = sorted(((r["n"] is not None, r["n"] or 0, r["k"]) for r in got))
    assert [(r["n"] is not None, r["n"] or 0, r["k"]) for r in sorted(got, key=lambda r: r["seq"])] == want and sorted(r["seq"] for r in got) == list(range(41, 541))
    assert next_numbers(rows.limit(0), 3, [F.col("k")]).count() == 0
