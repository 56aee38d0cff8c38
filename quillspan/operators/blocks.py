"""Managed blocks in policy files, as column functions: a block of one key is replaced or appended, all other text stays.

Files are rows (path, text); writing them back is left to whoever owns them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marks around a block.
START, END = '<!-- policy:managed key="', "<!-- policy:end -->"
_BLOCK = r'(?s)<!-- policy:managed key="[^"]*" -->.*?<!-- policy:end -->'


def managed_key(*parts: Column) -> Column:
    """A stable key of the policy and its target."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit("POLICY-"), F.substring(F.sha2(joined, 256), 1, 20))


def _count(text: Column, part: str) -> Column:
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part))


def rendered(existing: Column, key: Column, content: Column) -> Column:
    """Struct of text and error: existing with the block of key holding content.

    A null file is empty. Errors leave the text null: reserved marks in the content, marks that don't pair up, or two
    blocks of one key. Line ends follow the file's.
    """
    old = F.coalesce(existing, F.lit(""))
    crlf = _count(old, "\r\n") * 2 >= F.greatest(_count(old, "\n"), F.lit(1))
    newline = F.when(crlf, F.lit("\r\n")).otherwise(F.lit("\n"))
    body = F.trim(F.replace(F.replace(content, F.lit("\r\n"), F.lit("\n")), F.lit("\n"), newline))
    head = F.concat(F.lit(START), key, F.lit('" -->'))
    block = F.concat(head, newline, body, newline, F.lit(END))
    whole = F.regexp_count(old, F.lit(_BLOCK))
    error = (
        F.when(content.isNull() | key.isNull(), "nothing_to_write").when(F.contains(content, F.lit(START)) | F.contains(content, F.lit(END)), "reserved_marks")
        .when((_count(old, START) != whole) | (_count(old, END) != whole), "broken_marks").when(F.length(old) - F.length(F.replace(old, head, F.lit(""))) > F.length(head), "repeated_key")
    )
    at = F.instr(old, head)
    before = F.substr(old, F.lit(1), at - 1)
    rest = F.substr(old, at)
    after = F.substr(rest, F.instr(rest, F.lit(END)) + len(END))
    gap = F.when(old == "", "").when(F.endswith(old, F.concat(newline, newline)), "").when(F.endswith(old, newline), newline).otherwise(F.concat(newline, newline))
    text = F.when(at > 0, F.concat(before, block, after)).otherwise(F.concat(old, gap, block, newline))
    return F.struct(F.when(error.isNull(), text).alias("text"), error.alias("error"))
