"""Previews of policy files as rows: what a review's content would make of its file, as digests and hunks of changed lines.

Only rows and small lists of lines are handled: a review is joined with its file, the managed block is rendered with column
functions, and a short function in Arrow batches finds the longest common subsequence of two files' lines by Myers' method,
in memory that grows with the lines and not with their product.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.operators.blocks import managed_key, rendered

CONTEXT = 3  # unchanged lines around a change
SHOWN = ("accepted", "applied")
HUNK = "struct<before_start:int,before_lines:int,after_start:int,after_lines:int,lines:array<string>>"
_HUNK = pa.struct([("before_start", pa.int32()), ("before_lines", pa.int32()), ("after_start", pa.int32()), ("after_lines", pa.int32()), ("lines", pa.list_(pa.string()))])


def _snake(a: Sequence[int], b: Sequence[int]) -> tuple[int, int, int, int]:
    """Ends of a run of equal lines in the middle of a shortest edit of a into b; paths from both ends meet there."""
    n, m = len(a), len(b)
    delta = n - m
    ahead, back = {1: 0}, {1: 0}
    for d in range((n + m + 1) // 2 + 1):
        for k in range(-d, d + 1, 2):
            x = ahead[k + 1] if k == -d or (k != d and ahead[k - 1] < ahead[k + 1]) else ahead[k - 1] + 1
            x0, y = x, x - k
            while x < n and y < m and a[x] == b[y]:
                x, y = x + 1, y + 1
            ahead[k] = x
            if delta % 2 and abs(delta - k) < d and x + back[delta - k] >= n:
                return x0, x0 - k, x, y
        for k in range(-d, d + 1, 2):
            x = back[k + 1] if k == -d or (k != d and back[k - 1] < back[k + 1]) else back[k - 1] + 1
            x0, y = x, x - k
            while x < n and y < m and a[n - 1 - x] == b[m - 1 - y]:
                x, y = x + 1, y + 1
            back[k] = x
            if not delta % 2 and abs(delta - k) <= d and x + ahead[delta - k] >= n:
                return n - x, m - y, n - x0, m - x0 + k
    raise AssertionError("paths always meet")


def common_lines(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of two lists, ascending."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 < a1 and b0 < b1:
            x0, y0, x1, y1 = _snake(a[a0:a1], b[b0:b1])
            todo += [(a0, a0 + x0, b0, b0 + y0), (a0 + x1, a1, b0 + y1, b1)]
            out += [(a0 + x0 + i, b0 + y0 + i) for i in range(x1 - x0)]
    return sorted(out)


def line_hunks(before: str, after: str, context: int = CONTEXT) -> list[dict]:
    """Hunks that make after of before: starts from 0, and lines with their ends behind a space, - or +."""
    old, new = before.splitlines(keepends=True), after.splitlines(keepends=True)
    ids: dict[str, int] = {}
    a, b = ([ids.setdefault(x, len(ids)) for x in lines] for lines in (old, new))
    changes, i, j = [], 0, 0  # runs (i0, i1, j0, j1) between common lines
    for x, y in [*common_lines(a, b), (len(old), len(new))]:
        if x > i or y > j:
            changes.append((i, x, j, y))
        i, j = x + 1, y + 1
    hunks: list[list[tuple]] = []
    for c in changes:
        if hunks and c[0] - hunks[-1][-1][1] <= 2 * context:
            hunks[-1].append(c)
        else:
            hunks.append([c])
    out = []
    for group in hunks:
        start, end = max(group[0][0] - context, 0), min(group[-1][1] + context, len(old))
        shift = group[0][2] - group[0][0]
        lines, at = [], start
        for i0, i1, j0, j1 in group:
            lines += [" " + x for x in old[at:i0]] + ["-" + x for x in old[i0:i1]] + ["+" + x for x in new[j0:j1]]
            at = i1
        lines += [" " + x for x in old[at:end]]
        n_new = sum(x[0] != "-" for x in lines)
        out.append({"before_start": start, "before_lines": end - start, "after_start": start + shift, "after_lines": n_new, "lines": lines})
    return out


def patched(before: str, hunks: Sequence[dict]) -> str | None:
    """before with the hunks' changes; None where it doesn't hold the lines that they name."""
    old = before.splitlines(keepends=True)
    out, at = [], 0
    for h in hunks:
        start, lines = h["before_start"], h["lines"]
        named = [x[1:] for x in lines if x[0] != "+"]
        if start < at or old[start : start + len(named)] != named:
            return None
        out += old[at:start] + [x[1:] for x in lines if x[0] != "-"]
        at = start + len(named)
    return "".join(out + old[at:])


def _span(start: int, n: int) -> str:
    return str(start + 1) if n == 1 else f"{start + (n > 0)},{n}"


def unified(path: str, hunks: Sequence[dict]) -> str:
    """The hunks as a unified diff of one path; empty without hunks."""
    heads = [f"--- {path}\n+++ {path}\n"] if hunks else []
    for h in hunks:
        heads += [f"@@ -{_span(h['before_start'], h['before_lines'])} +{_span(h['after_start'], h['after_lines'])} @@\n", *h["lines"]]
    return "".join(heads)


def _sha256(text: str | None) -> str | None:
    return None if text is None else hashlib.sha256(text.encode()).hexdigest()


def with_hunks(files: DataFrame, path_col: str = "path", before_col: str = "before", after_col: str = "after") -> DataFrame:
    """files with before_sha256 (null for a file that isn't there), after_sha256, hunks and unified_diff.

    A null before is a file without lines; a null after has no digest, hunks or diff. Columns named so are replaced.
    """
    names = ["before_sha256", "after_sha256", "hunks", "unified_diff"]
    rest = [c for c in files.columns if c not in names]
    base = files.select(*rest)
    at = [rest.index(c) for c in (path_col, before_col, after_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, before, after = (batch.column(i).to_pylist() for i in at)
            hunks = [None if y is None else line_hunks(x or "", y) for x, y in zip(before, after)]
            new = [
                pa.array([_sha256(x) for x in before], pa.string()), pa.array([_sha256(y) for y in after], pa.string()), pa.array(hunks, pa.list_(_HUNK)),
                pa.array([None if h is None else unified(p or "", h) for p, h in zip(path, hunks)], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*rest, *names])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, *T.StructType.fromDDL(f"before_sha256 string, after_sha256 string, hunks array<{HUNK}>, unified_diff string").fields]))


def with_patched(files: DataFrame, before_col: str = "before", hunks_col: str = "hunks") -> DataFrame:
    """files with patched: before with the hunks applied, null where it has changed since, or there are none."""
    rest = [c for c in files.columns if c != "patched"]
    base = files.select(*rest)
    at = [rest.index(c) for c in (before_col, hunks_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, hunks = (batch.column(i).to_pylist() for i in at)
            done = [None if h is None else patched(x or "", h) for x, h in zip(before, hunks)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(done, pa.string())], names=[*rest, "patched"])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField("patched", T.StringType())]))


def line_counts(hunks: Column) -> Column:
    """Struct of added and removed: how many lines the hunks change."""
    lines = F.flatten(hunks["lines"])
    count = lambda sign: F.size(F.filter(lines, lambda x: F.startswith(x, F.lit(sign)))).cast("long")
    return F.struct(count("+").alias("added"), count("-").alias("removed"))


def previews(reviews: DataFrame, files: DataFrame) -> DataFrame:
    """(review_id, path, key, error, before, after, before_sha256, after_sha256, hunks, unified_diff) of accepted and applied reviews.

    reviews: review_id, status, experience_id, placement, path, content. files: path, text; a path without a row is a file
    that isn't there. A file that can't be rendered has an error, and neither after nor hunks.
    """
    shown = reviews.where(F.col("status").isin(*SHOWN)).join(files.select("path", F.col("text").alias("before")), "path", "left")
    shown = shown.withColumn("key", managed_key(F.col("experience_id"), F.col("placement"), F.col("path")))
    shown = shown.withColumn("r", rendered(F.col("before"), F.col("key"), F.col("content")))
    return with_hunks(shown.select("review_id", "path", "key", "r.error", "before", F.col("r.text").alias("after")))
