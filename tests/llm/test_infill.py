import hashlib
import re

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspan.llm.infill import INFILL_SQL, fill_in_middle, infill_report, rebuilt, restored, transformed_text, unit_ends


def plain_form(text, doc_id):
    """The contract read word by word, with lists of tokens."""
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    tokens = re.findall(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+", text)
    n = len(tokens)
    if text == "" or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return n, "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab <>PSM\t\n\x1f  é😀", max_size=40), st.integers(-5, 10**12))
def test_one_text(text, doc_id):
    got = transformed_text(text, doc_id, 42, 50, 80)
    assert got == plain_form(text, doc_id)
    assert rebuilt(got[-1], got[1]) == text
    assert list(unit_ends(text))[-1:] == ([len(text)] if text else [])


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="a <>PSM", min_size=1, max_size=30), st.integers(0, 10**6))
def test_broken_marks_at_the_cuts_are_rebuilt(text, doc_id):
    for share in (0, 100):
        *_, form, _, _, output = transformed_text(text, doc_id, 7, 100, share)
        assert rebuilt(output, form) == text


def test_edges_and_clashing_columns(edges):
    docs = edges.selectExpr("*", "'own' as form", "'own' as fim", "'own' as back", "1 as restored")
    got = restored(fill_in_middle(docs)).collect()
    assert len(got) == 9 and {r["fim"] for r in got} == {r["back"] for r in got} == {"own"} and {r["node"] for r in got} == {"x"}
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_form(r["text"], r["doc_id"])
        assert r["restored"] == (r["text"] or "")
    alike = [r for r in got if r["doc_id"] == 4]
    assert len(alike) == 2 and alike[0] == alike[1]


def test_empty_table(docs_of):
    assert infill_report(docs_of([])).count() == 0


def test_report_equals_its_sql(docs_of):
    rows = [(i, "one  two\tthree <four> five\n" * (i % 9) + "tail " * (i % 4)) for i in range(300)] + [(900, None), (901, "<P> in it " * 9), (-902, "  "), (903, "naïve 日本語 😀 x" * 5)]
    docs = docs_of(rows)
    got = sorted(map(tuple, infill_report(docs).collect()))
    db = duckdb.connect()
    db.register("documents", docs.toArrow())
    assert got == sorted(db.sql(INFILL_SQL).fetchall())
    assert {r[2] for r in got} == {"plain", "spm", "psm"}
