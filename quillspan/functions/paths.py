"""Contexts, folders and languages of repository paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspan.functions import values as V
from quillspan.functions.text import matches, stripped


def normalized(path: Column) -> Column:
    """POSIX form without '.', '..' and doubled slashes, as far as they resolve; empty stays empty."""
    p = F.replace(stripped(path), F.lit("\\"), F.lit("/"))
    rooted = F.startswith(p, F.lit("/"))
    parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))

    def fold(done: Column, part: Column) -> Column:
        n = F.size(done)
        up = (part == "..") & (n > 0) & (F.try_element_at(done, F.lit(-1)) != "..")
        gone = (part == "..") & (n == 0) & rooted
        return F.when(gone, done).when(up, F.slice(done, 1, F.greatest(n - 1, F.lit(0)))).otherwise(F.array_append(done, part))

    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), fold), "/")
    whole = F.concat(F.when(rooted, "/").otherwise(""), joined)
    return F.when(p == "", p).otherwise(F.when(whole == "", ".").otherwise(whole))


def file_context(path: Column) -> Column:
    """The first context whose rule fits, else other."""
    return context_of_normalized(normalized(path))


def context_of_normalized(path: Column) -> Column:
    """file_context() of a path that is a normalized column already, so that it is cleaned once and not for each rule."""
    out = F.when(path.isNull() | (path == ""), "other")
    for name, rule in V.CONTEXT_RULES:
        out = out.when(matches(path, rule), name)
    return out.otherwise("other")


def is_vendored(path: Column) -> Column:
    return matches(normalized(path), V.VENDORED)


def directory(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), F.lit(""))


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot; leading dots of a name start none."""
    return F.nullif(F.lower(F.regexp_extract(path, r"(?:^|/)\.*[^/.][^/]*?(\.[^/.]*)$", 1)), F.lit(""))


def language(path: Column) -> Column:
    ext = extension(path)
    out = F.when(ext.isNull(), None)
    for suffix, name in V.LANGUAGES.items():
        out = out.when(ext == suffix, name)
    return out


def repository_path(path: Column) -> Column:
    """A safe path inside the repository, or null: not absolute, of a home, of Windows, a URI, with control characters or upward."""
    bad = matches(path, r"^\s*([/~]|[A-Za-z]:|[A-Za-z][A-Za-z0-9+.-]*://)|[\x00-\x1f\x7f]")
    p = normalized(path)
    return F.when(path.isNull() | bad | p.isin("", ".", "..") | F.startswith(p, F.lit("../")), None).otherwise(p)
