"""Text functions on columns. Patterns run with Unicode classes and newline-only line ends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspan.functions import values as V

UNICODE = "(?Ud)"


def matches(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(UNICODE + pattern), F.lit(False))


def replaced(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, UNICODE + pattern, by)


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return replaced(text, r"^\s+|\s+\z", "")


def collapsed(text: Column) -> Column:
    """White space runs as one space, ends stripped."""
    return stripped(replaced(text, r"\s+", " "))


def bounded(text: Column, limit: int) -> Column:
    """Stripped and at most `limit` long, with an ellipsis where it was cut; blank is null."""
    x = stripped(text)
    cut = F.concat(replaced(F.substring(x, 1, limit - 1), r"\s+\z", ""), F.lit("…"))
    return F.when(x == "", None).when(F.length(x) > limit, cut).otherwise(x)


def summarized(text: Column, limit: int = V.SUMMARY_LIMIT) -> Column:
    return bounded(replaced(text, r"\s+", " "), limit)


def redacted(text: Column) -> Column:
    """Struct of the text with secrets replaced, in the fixed order, and whether any was found."""
    found = F.lit(False)
    for _, pattern, by in V.REDACTIONS:
        found = found | matches(text, pattern)
        text = replaced(text, pattern, by)
    return F.struct(text.alias("text"), found.alias("redacted"))


def error_signature(text: Column) -> Column:
    """One comparable line for an error text: the first line that names an error, else the last that isn't noise, with
    names of places and numbers masked. Without letters it is empty."""
    lines = F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), stripped)
    lines = F.filter(lines, lambda x: (x != "") & ~matches(x, V.NOISE_LINE))
    named = F.filter(lines, lambda x: matches(x, V.ERROR_LINE))
    line = F.coalesce(F.get(named, F.lit(0)), F.try_element_at(lines, F.lit(-1)), collapsed(text))
    line = F.lower(line)
    for pattern, by in V.SIGNATURE_MASKS:
        line = replaced(line, pattern, by)
    line = replaced(line, r"^[ .:\-=_*#]+|[ .:\-=_*#]+\z", "")
    return F.when(text.isNull() | ~matches(line, "[a-z]"), F.lit("")).otherwise(F.substring(line, 1, V.SIGNATURE_LIMIT))


def looks_diagnostic(signature: Column) -> Column:
    """Whether a signature names what went wrong."""
    generic = signature.isin(*V.GENERIC_SIGNATURES) | matches(signature, V.GENERIC_TEMPLATE)
    return F.coalesce((F.length(signature) >= 12) & ~generic & matches(signature, V.DIAGNOSTIC_TOKEN), F.lit(False))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({V.WORD})"), F.lit(1))


def is_directive(text: Column) -> Column:
    return F.coalesce(F.arrays_overlap(tokens(F.lower(text)), F.array(*map(F.lit, V.DIRECTIVES))), F.lit(False))


def is_correction(text: Column, least: int = 3) -> Column:
    """Whether a human turn redirects the work: long, or short with a question, path, code, error or directive."""
    flat = collapsed(F.coalesce(text, F.lit("")))
    low = F.regexp_replace(F.lower(flat), r"[ .!]+$", "")
    words = tokens(low)
    sign = F.contains(flat, F.lit("?")) | matches(flat, V.PATH_SIGN) | matches(flat, V.CODE_SIGN) | matches(flat, V.ERROR_SIGN)
    sign = sign | F.arrays_overlap(words, F.array(*map(F.lit, V.DIRECTIVES)))
    return (flat != "") & ~low.isin(*V.ACKNOWLEDGEMENTS) & (F.size(words) > 0) & ((F.size(words) > least) | sign)


def short_id(prefix: str, *parts: Column, length: int = 12) -> Column:
    """Prefix and the first hex digits of the SHA-256 of the parts, joined by the unit separator; null counts as empty."""
    joined = F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, length))


def slug(text: Column) -> Column:
    """A file name: unsafe runs as a hyphen, 60 characters, 'policy' if nothing is left."""
    x = F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "-"), r"^[.-]+|[.-]+$", "")
    return F.coalesce(F.nullif(F.substring(x, 1, 60), F.lit("")), F.lit("policy"))


def iso(ts: Column) -> Column:
    """ISO 8601 in UTC; the fraction stands only where it isn't 0."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(ts.cast("timestamp")), F.lit(1_000_000))
    return F.concat(whole, F.when(micros == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))), F.lit("+00:00"))


def excerpt(text: Column, limit: int = 20_000) -> Column:
    """The first `limit` characters of an output, with a note of how many are left out."""
    left = F.length(text) - limit
    return F.when(left <= 0, text).otherwise(F.concat(F.substring(text, 1, limit), F.lit("\n... [truncated "), left.cast("string"), F.lit(" bytes]")))


def project_id(root: Column, prefix: str = "proj_") -> Column:
    """A project's id, which follows from its cleaned root alone."""
    return short_id(prefix, F.regexp_replace(root, "(?<=.)/+$", ""))
