"""Queries of text rules over words of the driver's texts; their SQL applies the rules anew, by DuckDB's own expressions.

The patterns are fixed values, so both sides read them from one place; what is done with them is written twice. Letters
beyond ASCII are taken out of the texts first, since the two engines' word classes differ there.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import commands as K
from quillspan.functions import paths as P
from quillspan.functions import text as T
from quillspan.functions import values as V
from quillspan.session import table
from quillspan.sources import transcripts as TR

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_q, values)) + "]"


def _nth(values, k: str) -> str:
    return f"{_list(values)}[({k}) % {len(values)} + 1]"


def _of(values, k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(k, F.lit(len(values))) + 1).cast("int"))


_WORDS_SQL = r"SELECT doc_id, list_filter(string_split_regex(regexp_replace(text, '[^\x21-\x7E]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.filter(F.split(F.regexp_replace("text", r"[^\x21-\x7E]+", " "), " "), lambda x: x != "")
    return table(spark, sf_dir, "documents").select("doc_id", w.alias("w"))


# Commands: something before, a tool, a word of the document, something behind.

_TOOLS = (
    *(t for tokens in V.COMMAND_TOKENS.values() for t in tokens), *(t.strip() for tokens in V.PLAIN_TOKENS.values() for t in tokens), "alembic upgrade head", "python manage.py migrate", "flask db stamp", "mypy", "flow check",
    "./vendor/make", "maker", "my-pytest", "run", "ls", "pwd",
)
_BEFORE = ("", "cd app && ", "FOO=1 BAR=x ", "echo ", "(", "true; ", "which ", "ls | ", "printf 'make ' ; ", "sudo ")
_BEHIND = ("", " --version", " && git status", " | grep b", " '", ' "quoted make" ', " --help; pytest", "\n\t-q", ";")


def _has(pattern_tokens) -> str:
    words = "|".join(re.escape(t).replace("'", "''") for t in pattern_tokens if " " not in t)
    phrases = "|".join(re.escape(t).replace("'", "''").replace("\\ ", " ") for t in pattern_tokens if " " in t)
    one = rf"(^|[^\w./-])({words})([^\w-]|$)" if words else ""
    return "|".join(p for p in (one, phrases) if p)


def _plain(s: str) -> str:
    tests = " ".join(f"WHEN {' OR '.join(f'contains({s}, {_q(t)})' for t in V.PLAIN_TOKENS[n])}{f' OR {s} IN ({_q('ls')}, {_q('pwd')})' if n == 'list' else ''} THEN '{n}'" for n in ("vcs", "read", "search", "list"))
    return f"CASE {tests} END"


_COMMAND_RULES_SQL = rf"""
WITH c AS (SELECT doc_id, {_nth(_BEFORE, 'doc_id // 7')} || {_nth(_TOOLS, 'doc_id')} || ' ' || coalesce(w[1], '') || {_nth(_BEHIND, 'doc_id // 3')} AS command FROM ({_WORDS_SQL}) x),
f AS (SELECT doc_id, command, trim(regexp_replace(lower(command), '\s+', ' ', 'g')) AS flat FROM c),
p AS (SELECT *, list_filter(list_transform(string_split_regex(flat, '&&|\|\||;|\|'), lambda s: trim(s)), lambda s: s <> '') AS found FROM f),
s AS (SELECT *, CASE WHEN len(found) = 0 THEN [flat] ELSE found END AS parts FROM p),
r AS (SELECT *, list_transform(list_filter(parts, lambda s: NOT list_contains({_list(V.INSPECT_ONLY)}, regexp_replace(regexp_extract(s, '^(?:[a-z_][a-z0-9_]*=\S*\s+)*(\S*)', 1), '^[()]+|[()]+$', '', 'g'))
    AND NOT contains(s, '--version') AND NOT contains(s, '--help')), lambda s: regexp_replace(s, '"[^"]*"|''[^'']*''', ' ', 'g')) AS run FROM s)
SELECT doc_id, command, CASE {' '.join(f"WHEN len(list_filter(run, lambda s: regexp_matches(s, '{_has(tokens)}'))) > 0 THEN '{name}'" for name, tokens in V.COMMAND_TOKENS.items())}
    ELSE coalesce(list_filter(list_transform(parts, lambda s: {_plain('s')}), lambda x: x IS NOT NULL)[1], 'other') END AS kind,
    CASE WHEN regexp_matches(command, {_q(V.MIGRATION_COMMAND)}) THEN 'migration' WHEN regexp_matches(command, {_q(V.TYPECHECK_COMMAND)}) THEN 'typecheck' END AS context,
    CASE WHEN regexp_matches(command, {_q(V.MIGRATION_COMMAND)}) THEN 'migration' WHEN regexp_matches(command, {_q(V.TYPECHECK_COMMAND)}) THEN 'typecheck'
        {' '.join(f"WHEN contains(lower(command), {_q(token)}) THEN {_q(name)}" for token, name in V.COMMAND_FAMILIES)} END AS family
FROM r"""


@query(_COMMAND_RULES_SQL)
def command_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind, context and family of a command a document: every tool with what may stand around it, and a word of the text."""
    d = F.col("doc_id")
    command = F.concat(_of(_BEFORE, F.floor(d / 7)), _of(_TOOLS, d), F.lit(" "), F.coalesce(F.get("w", F.lit(0)), F.lit("")), _of(_BEHIND, F.floor(d / 3)))
    x = _words(spark, sf_dir).select("doc_id", command.alias("command"))
    return x.select("doc_id", "command", K.command_kind(F.col("command")).alias("kind"), K.command_context(F.col("command")).alias("context"), K.command_family(F.col("command")).alias("family"))


# Notes: words of the document, and in their midst an acknowledgement, a directive, a sign, or nothing.

_SAID = (*V.ACKNOWLEDGEMENTS, *V.DIRECTIVES, "why?", "src/app.py", "`x`", "a::b", "--flag", "TypeError", "stack trace", "404", "NaN", "", "", "")
_NOTE_SQL = f"trim(regexp_replace(array_to_string(w[1:doc_id % 5], ' ') || ' ' || {_nth(_SAID, 'doc_id')} || CASE doc_id % 4 WHEN 0 THEN '!' WHEN 1 THEN '. .' ELSE '' END, '\\s+', ' ', 'g'))"


@query(
    rf"""WITH n AS (SELECT doc_id, {_NOTE_SQL} AS note FROM ({_WORDS_SQL}) x), l AS (SELECT *, regexp_replace(lower(note), '[ .!]+$', '') AS low FROM n),
t AS (SELECT *, regexp_extract_all(low, {_q(V.WORD)}) AS words, regexp_extract_all(lower(note), {_q(V.WORD)}) AS every FROM l)
SELECT doc_id, note, note <> '' AND NOT list_contains({_list(V.ACKNOWLEDGEMENTS)}, low) AND len(words) > 0 AND (len(words) > 3 OR contains(note, '?') OR regexp_matches(note, {_q(V.PATH_SIGN)}) OR regexp_matches(note, {_q(V.CODE_SIGN)})
    OR regexp_matches(note, {_q(V.ERROR_SIGN)}) OR list_has_any(words, {_list(V.DIRECTIVES)})) AS meaningful, list_has_any(every, {_list(V.DIRECTIVES)}) AS directive FROM t"""
)
def correction_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which notes redirect the work, and which name a directive."""
    d = F.col("doc_id")
    tail = F.when(d % 4 == 0, "!").when(d % 4 == 1, ". .").otherwise("")
    note = F.concat(F.array_join(F.slice("w", F.lit(1), (d % 5).cast("int")), " "), F.lit(" "), _of(_SAID, d), tail)
    x = _words(spark, sf_dir).select("doc_id", F.trim(F.regexp_replace(note, r"\s+", " ")).alias("note"))
    return x.select("doc_id", "note", T.is_correction(F.col("note")).alias("meaningful"), T.is_directive(F.col("note")).alias("directive"))


# Outputs: some lines around one that may name an error, with places and numbers to be masked.

_ERRORS = (
    "{w} failed", "TypeError: {w} is not a function at /srv/app/{w}.js:10:4", "E   assert 3 == {w}", "ModuleNotFoundError: No module named '{w}'", "error at 0xDEADbeef in src/{w}/x.py line 12", "{w}", "exit code 1", "2 failed, 3 passed", "Exception in 0f0f0f0f-0000-4000-8000-000000000001: {w}",
    "cannot find module {w}", "permission denied: C:\\Users\\{w}.txt", "*** fail *** {w}", "process exited with code 2", "42", "",
)
_AROUND = ("", "=====\n", "Traceback (most recent call last)\n", "  \n...\n", "{w} ran\n", "During handling\r\n")
_TEXT_SQL = f"replace({_nth(_AROUND, 'doc_id // 5')} || {_nth(_ERRORS, 'doc_id')} || {_nth(('', '\n----', '\n{w} end', '\n  '), 'doc_id // 2')}, '{{w}}', coalesce(w[1], 'x'))"


def _masked(text: str) -> str:
    for pattern, by in V.SIGNATURE_MASKS:
        text = f"regexp_replace({text}, {_q(pattern)}, {_q(by)}, 'g')"
    return rf"regexp_replace({text}, '^[ .:\-=_*#]+|[ .:\-=_*#]+$', '', 'g')"


@query(
    rf"""WITH t AS (SELECT doc_id, {_TEXT_SQL} AS text FROM ({_WORDS_SQL}) x),
l AS (SELECT *, list_filter(list_transform(string_split_regex(text, '\r\n|[\n\r]'), lambda s: trim(s)), lambda s: s <> '' AND NOT regexp_matches(s, {_q(V.NOISE_LINE)})) AS lines FROM t),
p AS (SELECT *, lower(coalesce(list_filter(lines, lambda s: regexp_matches(s, {_q(V.ERROR_LINE)}))[1], lines[-1], trim(regexp_replace(text, '\s+', ' ', 'g')))) AS line FROM l),
m AS (SELECT doc_id, {_masked('line')} AS line FROM p), s AS (SELECT doc_id, CASE WHEN regexp_matches(line, '[a-z]') THEN substr(line, 1, {V.SIGNATURE_LIMIT}) ELSE '' END AS signature FROM m)
SELECT doc_id, signature, length(signature) >= 12 AND NOT list_contains({_list(V.GENERIC_SIGNATURES)}, signature) AND NOT regexp_matches(signature, {_q(V.GENERIC_TEMPLATE)}) AND regexp_matches(signature, {_q(V.DIAGNOSTIC_TOKEN)}) AS diagnostic FROM s"""
)
def signature_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signature of an output a document, and whether it names what went wrong."""
    d = F.col("doc_id")
    text = F.replace(F.concat(_of(_AROUND, F.floor(d / 5)), _of(_ERRORS, d), _of(("", "\n----", "\n{w} end", "\n  "), F.floor(d / 2))), F.lit("{w}"), F.coalesce(F.get("w", F.lit(0)), F.lit("x")))
    x = _words(spark, sf_dir).select("doc_id", T.error_signature(text).alias("signature"))
    return x.select("doc_id", "signature", T.looks_diagnostic(F.col("signature")).alias("diagnostic"))


# Paths: a folder, a part of the page's address, a file name.

_FOLDERS = ("", "src/", "tests/", "db/migrations/", "app/models/", "node_modules/x/", "a/.venv/lib/", ".github/workflows/", "docs/", "frontend/components/", "config/", "build/", "server/api/", "sql/", "vendor/")
_FILES = ("page.md", "x.py", "view.tsx", "test_y.py", "a.spec.ts", "Dockerfile", "package.json", "q.sql", "main.go", "schema.rb", "notes", "style.scss", "README", ".env.local", "Makefile", "a.TXT", ".hidden")
_PATH_SQL = f"{_nth(_FOLDERS, 'page_id')} || regexp_extract(url, '([a-z0-9-]*)/?[^/]*$', 1) || '/' || {_nth(_FILES, 'page_id // 3')}"


@query(
    rf"""WITH x AS (SELECT page_id, ltrim(replace({_PATH_SQL}, '//', '/'), '/') AS path FROM pages)
SELECT page_id, path, CASE {' '.join(f"WHEN regexp_matches(path, {_q(rule)}) THEN '{name}'" for name, rule in V.CONTEXT_RULES)} ELSE 'other' END AS context, regexp_matches(path, {_q(V.VENDORED)}) AS vendored,
CASE lower(regexp_extract(path, '(?:^|/)\.*[^/.][^/]*?(\.[^/.]*)$', 1)) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in V.LANGUAGES.items())} END AS language FROM x"""
)
def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context, language and whether it is generated or third-party, of a path a page, over all contexts."""
    k = F.col("page_id")
    path = F.concat(_of(_FOLDERS, k), F.regexp_extract("url", r"([a-z0-9-]*)/?[^/]*$", 1), F.lit("/"), _of(_FILES, F.floor(k / 3)))
    x = table(spark, sf_dir, "pages").select("page_id", F.ltrim(F.replace(path, F.lit("//"), F.lit("/")), F.lit("/")).alias("path"))
    return x.select("page_id", "path", P.file_context(F.col("path")).alias("context"), P.is_vendored(F.col("path")).alias("vendored"), P.language(F.col("path")).alias("language"))


# Conversations as records of layout messages: a third of the answers run a check behind them, a third edit a file.


@query(
    """WITH c AS (SELECT conv_id, turn, role, (conv_id + turn) % 3 AS k, turn % 2 = 1 AS bad, lag(role) OVER w AS before, count(*) FILTER (role = 'user') OVER w AS nth FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
x AS (SELECT conv_id, turn, 0 AS echo, CASE WHEN role = 'assistant' THEN 'assistant_message' WHEN nth > 1 AND before = 'assistant' THEN 'human_correction' ELSE 'user_prompt' END AS type, NULL AS path, NULL AS command, NULL::INTEGER AS exit_code FROM c
UNION ALL SELECT conv_id, turn, 1, 'command', NULL, 'pytest -q', bad::INTEGER FROM c WHERE role = 'assistant' AND k = 1 UNION ALL SELECT conv_id, turn, 2, CASE WHEN bad THEN 'test_fail' ELSE 'test_pass' END, NULL, NULL, NULL FROM c WHERE role = 'assistant' AND k = 1
UNION ALL SELECT conv_id, turn, 1, 'file_edit', 'src/a.py', NULL, NULL FROM c WHERE role = 'assistant' AND k = 2)
SELECT CAST(conv_id AS VARCHAR) AS trajectory_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, echo) AS INTEGER) AS sequence, type, path, command, exit_code FROM x"""
)
def messages_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts, corrections, answers, calls with their results and their outcomes, read from records of messages."""
    c = table(spark, sf_dir, "conversations")
    call, k, bad = F.concat_ws("-", "conv_id", "turn"), (F.col("conv_id") + F.col("turn")) % 3, F.col("turn") % 2 == 1
    record = lambda kind, content, **more: F.to_json(F.struct(F.lit(kind).alias("type"), F.struct(F.lit(kind).alias("role"), content.alias("content")).alias("message"), *(v.alias(n) for n, v in more.items())))
    block = lambda **fields: F.array(F.struct(*(v.alias(n) for n, v in fields.items())))
    said = record("assistant", block(type=F.lit("text"), text=F.col("text")))
    runs = record("assistant", block(type=F.lit("tool_use"), id=call, name=F.lit("Bash"), input=F.struct(F.lit("pytest -q").alias("command"))))
    edits = record("assistant", block(type=F.lit("tool_use"), id=call, name=F.lit("Edit"), input=F.struct(F.lit("/w/src/a.py").alias("file_path"))))
    result = record("user", block(type=F.lit("tool_result"), tool_use_id=call, content=F.lit("done"), is_error=bad), toolUseResult=F.struct(F.lit("done").alias("stdout")))
    lines = (
        F.when(F.col("role") == "user", F.array(record("user", F.col("text")))).when(F.col("role") != "assistant", F.array(F.lit('{"type": "system"}')))
        .when(k == 1, F.array(said, runs, result)).when(k == 2, F.array(said, edits, result)).otherwise(F.array(said))
    )
    rows = c.select(F.col("conv_id").cast("string").alias("file"), "turn", F.posexplode(lines).alias("pos", "value"))
    rows = rows.select("file", (F.col("turn") * 4 + F.col("pos")).cast("int").alias("line"), "value")
    events, _ = TR.session_table(TR.steps(rows, "messages"), "/w")
    return events.select("trajectory_id", "sequence", "type", "path", "command", "exit_code")
