"""Kinds and contexts of shell commands."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspan.functions import values as V
from quillspan.functions.text import collapsed, matches


def token_pattern(tokens: tuple[str, ...]) -> str:
    """Any of the tokens: phrases anywhere, single words as whole arguments."""
    phrases = [re.escape(t) for t in tokens if " " in t]
    words = [re.escape(t) for t in tokens if " " not in t]
    return "|".join([*([rf"(?<![\w./-])(?:{'|'.join(words)})(?![\w-])"] if words else []), *phrases])


def runnable(segments: Column) -> Column:
    """Segments that run something: no printing or looking up, no version or help, without assignments before and quoted text."""
    first = lambda s: F.regexp_replace(F.regexp_extract(s, r"^(?:[a-z_][a-z0-9_]*=\S*\s+)*(\S*)", 1), r"^[()]+|[()]+$", "")
    runs = F.filter(segments, lambda s: ~first(s).isin(*V.INSPECT_ONLY) & ~F.contains(s, F.lit("--version")) & ~F.contains(s, F.lit("--help")))
    return F.transform(runs, lambda s: F.regexp_replace(s, "\"[^\"]*\"|'[^']*'", " "))


def _any_matches(texts: Column, pattern: str) -> Column:
    return F.exists(texts, lambda s: matches(s, pattern))


def command_kind(command: Column, hint: Column | None = None) -> Column:
    """test, lint, build, package, read, search, list, vcs or other; kinds that run things go before those that look."""
    flat = collapsed(F.lower(command))
    parts = F.filter(F.transform(F.split(flat, r"&&|\|\||;|\|"), lambda s: F.trim(s)), lambda s: s != "")
    parts = F.when(F.size(parts) == 0, F.array(flat)).otherwise(parts)
    run = runnable(parts)
    kind = F.when(command.isNull() | (command == ""), "other")
    for name, tokens in V.COMMAND_TOKENS.items():
        kind = kind.when(_any_matches(run, token_pattern(tokens)), name)
    if hint is not None:
        kind = kind.when(hint == "read", "read").when(hint == "search", "search").when(hint.isin("list_files", "list"), "list")

    def plain(s: Column) -> Column:
        has = lambda name: F.array_contains(F.array(*[F.contains(s, F.lit(t)) for t in V.PLAIN_TOKENS[name]]), True)
        return F.when(has("vcs"), "vcs").when(has("read"), "read").when(has("search"), "search").when(has("list") | s.isin("ls", "pwd"), "list")

    first = F.get(F.filter(F.transform(parts, plain), lambda x: x.isNotNull()), F.lit(0))
    return kind.otherwise(F.coalesce(first, F.lit("other")))


def outcome_type(kind: Column, exit_code: Column) -> Column:
    """The pass or fail event of a test, lint or build command; null for others and unknown exits."""
    return F.when(kind.isin(*V.FAMILIES) & exit_code.isNotNull(), F.concat(kind, F.when(exit_code == 0, "_pass").otherwise("_fail")))


def command_context(command: Column) -> Column:
    return F.when(matches(command, V.MIGRATION_COMMAND), "migration").when(matches(command, V.TYPECHECK_COMMAND), "typecheck")


def command_family(command: Column) -> Column:
    """A stable name for clear tools: migration, typecheck or the tool."""
    out = F.when(command_context(command).isNotNull(), command_context(command))
    for token, name in V.COMMAND_FAMILIES:
        out = out.when(F.contains(F.lower(command), F.lit(token)), name)
    return out
