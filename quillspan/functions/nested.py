"""JSON texts of any depth as column functions: canonical form, tolerant reading, redaction that keeps structure.

Values are read as VARIANT, whose objects keep their fields in order of the name, so writing one gives sorted keys at every
depth. Where a text is changed in place it is cut at its quotation marks, after escaped ones and backslashes have been
written as \\u0022 and \\u005c: every second piece is then a string's inside. So a text's depth and length have no bound but
memory, and no pattern recurses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspan.functions import values as V
from quillspan.functions.text import matches, replaced

_SLASH, _MARK = "\\u005c", "\\u0022"
_TOKEN = r'"[^"]*"|[{}\[\],:]|[^\s{}\[\],:"]+|"'
#: Control characters whose escapes have letters; they are written in lower case.
_CONTROLS = (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once for a row."""
    return F.get(F.transform(F.array(value), body), 0)


def _flat(text: Column) -> Column:
    """text without a backslash or mark that is escaped by a backslash."""
    return F.replace(F.replace(text, F.lit("\\\\"), F.lit(_SLASH)), F.lit('\\"'), F.lit(_MARK))


def _restored(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(_MARK), F.lit('\\"')), F.lit(_SLASH), F.lit("\\\\"))


def _tokens(text: Column) -> Column:
    return F.size(F.regexp_extract_all(_flat(text), F.lit(_TOKEN), F.lit(0)))


def decoded(text: Column) -> Column:
    """Struct of value (a VARIANT, null if text is none) and ok: whether all of text is one JSON value. Null is ok and null.

    What stands behind a first value is found by counting marks and words of the text and of the value written again. An
    object that names a field twice, and nesting beyond what the reader takes (1,000 levels), is not ok.
    """
    # A text with a field named twice fails to parse, so a value has as many tokens as what it was read from.
    read = lambda v: F.coalesce(_tokens(F.to_json(v)) == _tokens(text), F.lit(False))
    return let(F.try_parse_json(text), lambda v: let(read(v), lambda ok: F.struct(F.when(ok, v).alias("value"), (ok | text.isNull()).alias("ok"))))


def decoded_or(text: Column, default: str = "{}") -> Column:
    """The text's value if it is an object, else that of `default`."""
    found = decoded(text)["value"]
    return F.when(F.startswith(F.schema_of_variant(found), F.lit("OBJECT")), found).otherwise(F.parse_json(F.lit(default)))


def canonical_json(text: Column) -> Column:
    """The value written with sorted keys, a space behind each comma and colon, and no escape that isn't needed.

    Equal for texts that differ in the order of fields, white space, escapes or the writing of numbers (1.0 is 1, 1e3 is
    1000.0). A text that is no JSON value stays as it is, and so does a null.
    """

    def spaced(written: Column) -> Column:
        pieces = F.transform(F.split(_flat(written), '"'), lambda x, i: F.when(i % 2 == 1, x).otherwise(F.replace(F.replace(x, F.lit(","), F.lit(", ")), F.lit(":"), F.lit(": "))))
        out = F.array_join(pieces, '"')
        for code in _CONTROLS:
            out = F.replace(out, F.lit(f"\\u{code:04X}"), F.lit(f"\\u{code:04x}"))
        return _restored(out)

    return let(decoded(text), lambda d: F.when(d["value"].isNotNull(), spaced(F.to_json(d["value"]))).otherwise(text))


def canonical_hash(text: Column) -> Column:
    return F.sha2(canonical_json(text), 256)


#: What any of the patterns matches; a text that it doesn't match stays as it is.
_ANY = "|".join(f"(?:{pattern})" for _, pattern, _ in V.REDACTIONS)


def _redacted(text: Column) -> Column:
    """text.redacted() for use inside a lambda, where an expression that stands twice is evaluated twice: each step once, and
    none for a text without a secret."""

    def step(pattern: str, by: str) -> Callable[[Column], Column]:
        return lambda r: F.struct(replaced(r["text"], pattern, by).alias("text"), (r["redacted"] | matches(r["text"], pattern)).alias("redacted"))

    out = F.struct(text.alias("text"), F.lit(False).alias("redacted"))
    for _, pattern, by in V.REDACTIONS:
        out = let(out, step(pattern, by))
    return F.when(matches(text, _ANY), out).otherwise(F.struct(text.alias("text"), F.lit(False).alias("redacted")))


def redacted_json(text: Column) -> Column:
    """Struct of text and redacted: each string that is a value, at any depth, redacted by itself; all else stays.

    Keys are not redacted. Strings without a secret keep their bytes. A text that is no JSON value is redacted as a text.
    """
    inside = lambda x: F.try_variant_get(F.try_parse_json(F.concat(F.lit('"'), x, F.lit('"'))), "$", "string")
    outside = lambda x: F.regexp_extract(F.to_json(F.struct(x.alias("v"))), r'(?s)^\{"v":"(.*)"\}$', 1)

    def each(pieces: Column) -> Column:
        is_value = lambda i: (i % 2 == 1) & ~F.startswith(F.ltrim(F.coalesce(F.get(pieces, i + 1), F.lit(""))), F.lit(":"))
        clean = lambda x: let(let(inside(x), _redacted), lambda r: F.struct(F.when(r["redacted"], _flat(outside(r["text"]))).otherwise(x).alias("x"), r["redacted"].alias("hit")))
        done = F.transform(pieces, lambda x, i: F.when(is_value(i), clean(x)).otherwise(F.struct(x.alias("x"), F.lit(False).alias("hit"))))
        return let(done, lambda d: F.struct(_restored(F.array_join(F.transform(d, lambda p: p["x"]), '"')).alias("text"), F.exists(d, lambda p: p["hit"]).alias("redacted")))

    return F.when(decoded(text)["value"].isNotNull(), let(F.split(_flat(text), '"'), each)).otherwise(let(text, _redacted))
