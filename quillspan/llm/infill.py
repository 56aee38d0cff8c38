"""Fill-in-middle transformation: a text's tokens are cut at two seeded places and put out of order behind marks.

A token is a run of white space with the word behind it, or white space at the end. The cuts, the form and whether a text
is transformed at all follow from a digest of the seed and the row's id, so they are the same on every run and cluster.
The work is two Arrow-batched pandas UDFs over columns of whole texts: one transforms, one rebuilds from output and form.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.shared import fresh

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
TOKEN = regex.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
RATE = 50  # of a hundred texts are transformed
SPM_SHARE = 80  # of a hundred transformed texts start with their suffix
TRANSFORMED = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"
RESTORED = "restored string, restored_sha256 string"


def unit_ends(text: str) -> array:
    """The end offsets, in code points, of a text's tokens; eight bytes each."""
    return array("q", (m.end() for m in TOKEN.finditer(text)))


def seeds(seed: int, doc_id: int | None) -> tuple[int, ...]:
    """The first four 8-digit groups of the digest of `seed:id`; a null id is written as nothing."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4]) for i in (0, 4, 8, 12))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def transformed_text(text: str, doc_id: int | None, seed: int, rate: int, spm_share: int) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    h1, h2, h3, h4 = seeds(seed, doc_id)
    ends = unit_ends(text)
    n = len(ends)
    if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, last))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_share:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def rebuilt(output: str, form: str) -> str:
    """The text of an output; the marks stand in it once each, since no text with one of them is transformed."""
    if form == "plain":
        return output
    opening, between = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    one, rest = output.removeprefix(opening).split(between)
    two, middle = rest.split(MIDDLE)
    return two + middle + one if form == "spm" else one + middle + two


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = RATE, spm_share: int = SPM_SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n (tokens), form (plain, psm or spm), prefix_chars, middle_chars, output and output_sha256.

    `rate` of a hundred texts are transformed, `spm_share` of those with the suffix in front. Null texts are empty, and
    empty texts are plain; texts that hold a mark are plain. Null ids are seeded like an empty one, so all rows without
    an id are cut alike, as are repeated rows. Texts of any length are cut whole, a row at a time. Columns of docs named
    as the new ones are replaced, all others are kept; an empty table stays empty.
    """

    @F.pandas_udf(TRANSFORMED)
    def transform(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, texts in parts:
            rows = []
            for doc_id, text in zip(ids, texts):
                row = transformed_text(text or "", doc_id, seed, rate, spm_share)
                rows.append((*row, sha256(row[-1])))
            out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"])
            yield out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    names = [c.split()[0] for c in TRANSFORMED.split(", ")]
    held = fresh(docs, "fim")
    # The id goes as its decimal text: a null among longs would make a pandas column of floats.
    done = docs.withColumn(held, transform(F.col(id_col).cast("string"), F.col(text_col)))
    kept = [c for c in docs.columns if c not in names]
    return done.select(*kept, *(F.col(held).getField(n).alias(n) for n in names))


def restored(transformed: DataFrame) -> DataFrame:
    """transformed with restored, the exact text rebuilt from output and form alone, and restored_sha256; null outputs stay null."""

    @F.pandas_udf(RESTORED)
    def rebuild(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for outputs, forms in parts:
            texts = [None if o is None else rebuilt(o, f) for o, f in zip(outputs, forms)]
            yield pd.DataFrame({"restored": texts, "restored_sha256": [None if t is None else sha256(t) for t in texts]}, dtype=object)

    held = fresh(transformed, "back")
    done = transformed.withColumn(held, rebuild("output", "form"))
    kept = [c for c in transformed.columns if c not in ("restored", "restored_sha256")]
    return done.select(*kept, *(F.col(held).getField(n).alias(n) for n in ("restored", "restored_sha256")))


def infill_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every document, with the registered settings."""
    done = restored(fill_in_middle(docs.select("doc_id", "text")))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


#: The report's rows in DuckDB SQL.
INFILL_SQL = r"""
WITH cut AS MATERIALIZED (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
        sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h
    FROM documents),
seeded AS (
    SELECT doc_id, t, w, len(w) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
        ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
    FROM cut),
placed AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
             WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM seeded),
parts AS (
    SELECT *, coalesce(array_to_string(w[1:a], ''), '') AS p, coalesce(array_to_string(w[a + 1:b], ''), '') AS m, coalesce(array_to_string(w[b + 1:n], ''), '') AS s
    FROM placed)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM parts
"""
