"""Session transcripts (JSON lines in two layouts) as event tables.

A line becomes plain steps by itself, in a small function under mapInArrow. What needs the lines before or behind it
(numbering, pairing of calls and results, prompts and corrections, aborts, the task, the status) is joins and windows
over the steps. Layout `rollout` has envelopes with a payload; layout `messages` has user and assistant records.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillspan.functions import values as V
from quillspan.functions.commands import command_kind, outcome_type
from quillspan.functions.paths import normalized
from quillspan.functions.text import bounded, redacted, stripped, summarized
from quillspan.functions.times import iso_instant
from quillspan.operators.sequences import final_status
from quillspan.sources import session_lines

# Wrappers that tools put around prompts, and marks of texts without one.
WRAPPERS = ("environment_context", "recommended_plugins", "skills_instructions", "user_instructions", "available-skills", "system-reminder")
INJECTED = (
    "<environment_context>", "<recommended_plugins>", "<skills_instructions>", "<user_instructions>", "<system-reminder>", "<available-skills>",
    "# AGENTS.md instructions", "# CLAUDE.md", "Caveat: The messages below", "<command-name>", "<local-command-", "<user-prompt-submit-hook>",
)
EDIT_TOOLS, SEARCH_TOOLS = ("Edit", "MultiEdit", "NotebookEdit"), ("Grep", "Glob", "LS")
SHELLS = ("-lc", "-c", "-ic")
HIDDEN = "[encrypted]"
SHELL_NAMES = ("sh", "bash", "zsh")
QUOTED_COMMAND = r'(?:cmd|command)\s*:\s*"([^"]+)"'
EXIT = r"exit(?:\s+code)?[:\s]+(\d{1,3})"
USAGE = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")

STEP = {
    "kind": "string", "ts": "string", "text": "string", "call_id": "string", "tool": "string", "path": "string", "command": "string", "hint": "string",
    "exit_code": "int", "is_error": "boolean", "interrupted": "boolean", "added": "int", "removed": "int", "change": "string", "sidechain": "boolean",
    "raw": "boolean", "works": "boolean", "duration_ms": "long", "usage": "map<string,long>", "cwd": "string", "branch": "string", "version": "string", "model": "string",
}


def transcript_lines(spark: SparkSession, path: str, glob: str = "*.jsonl", **options) -> DataFrame:
    """(file, line, value) of all files below path; lines count from 1, blank ones too. Options are those of session_lines."""
    return session_lines.numbered(spark, path, glob=glob, **options).select("file", "line", "value")


def transcript_files(spark: SparkSession, path: str, glob: str = "*.jsonl", **options) -> DataFrame:
    """(file, size_bytes, modified, content_hash) of all files below path; the hash is that of the raw bytes."""
    return session_lines.read(spark, path, "files", glob=glob, **options)


def _text(content, hidden: str | None = None) -> str:
    """The texts of content's blocks, a line each; a rollout names encrypted blocks by `hidden`, and takes texts of any type."""
    if isinstance(content, str):
        return content
    parts = []
    for b in content if isinstance(content, list) else ():
        if isinstance(b, str):
            parts.append(b)
        elif isinstance(b, dict) and isinstance(b.get("text"), str) and (hidden or b.get("type") in (None, "text")):
            parts.append(b["text"])
        elif isinstance(b, dict) and b.get("type") == "encrypted_content" and hidden:
            parts.append(hidden)
    return "\n".join(p for p in parts if p)


def _number(x) -> int | None:
    return x if isinstance(x, int) and not isinstance(x, bool) else None


def milliseconds(duration) -> int | None:
    """Whole milliseconds of a number, or of seconds and nanoseconds."""
    if isinstance(duration, (int, float)) and not isinstance(duration, bool):
        return int(duration)
    if isinstance(duration, dict) and "secs" in duration:
        return int((duration.get("secs") or 0) * 1000 + (duration.get("nanos") or 0) / 1e6)
    return None


def _diff(lines: list[str]) -> tuple[int, int]:
    plus = sum(x.startswith("+") and not x.startswith("+++") for x in lines)
    return plus, sum(x.startswith("-") and not x.startswith("---") for x in lines)


def rollout_steps(obj: dict) -> list[dict]:
    """Steps of a record with type, timestamp and payload."""
    p, kind = obj.get("payload"), obj.get("type")
    if not isinstance(p, dict):
        return [] if kind == "world_state" else [{"kind": "warning", "text": f"{kind} without a payload"}]
    sub = p.get("type")
    if kind == "session_meta":
        git = p.get("git") if isinstance(p.get("git"), dict) else {}
        return [{"kind": "header", "cwd": p.get("cwd"), "version": p.get("cli_version"), "branch": git.get("branch")}]
    if kind == "turn_context":
        return [{"kind": "header", "cwd": p.get("cwd"), "model": p.get("model")}]
    if kind == "compacted":
        return [{"kind": "note", "text": "context compacted"}]
    if kind == "response_item":
        if sub == "message":
            return [{"kind": {"user": "human", "assistant": "say"}.get(p.get("role"), "skip"), "text": _text(p.get("content"), HIDDEN), "raw": True, "works": True}]
        if sub in ("function_call", "custom_tool_call", "local_shell_call"):
            given = p.get("input") or p.get("arguments") or ""
            return [{"kind": "call", "call_id": p.get("call_id") or p.get("id"), "tool": p.get("name") or sub, "command": freeform_command(given), "text": str(given), "raw": True, "works": True}]
        if sub in ("function_call_output", "custom_tool_call_output"):
            return [{"kind": "result", "call_id": p.get("call_id"), "exit_code": output_exit(p.get("output")), "raw": True}]
        return []
    if kind != "event_msg":
        return [] if kind in ("inter_agent_communication_metadata", "world_state") else [{"kind": "warning", "text": f"unknown record type {kind!r}"}]
    if sub == "token_count":
        info = p.get("info") or {}
        usage = info.get("total_token_usage") or info.get("last_token_usage")
        return [{"kind": "usage", "usage": {k: usage[k] for k in USAGE if _number(usage.get(k)) is not None}}] if isinstance(usage, dict) else []
    if sub == "task_complete":
        return [{"kind": "completion", "text": p.get("last_agent_message") or "", "duration_ms": milliseconds(p.get("duration_ms"))}]
    if sub == "turn_aborted":
        return [{"kind": "turn_aborted", "text": "turn aborted"}]
    item = p.get("item")
    if sub != "item_completed" or not isinstance(item, dict):
        return []
    what = item.get("type")
    if what == "UserMessage":
        return [{"kind": "human", "text": _text(item.get("content"), HIDDEN)}]
    if what in ("AgentMessage", "Plan"):
        return [{"kind": "say", "text": _text(item.get("content"), HIDDEN) if what == "AgentMessage" else item.get("text") or "", "works": True}]
    if what == "CommandExecution":
        argv, parsed = item.get("command"), [x for x in item.get("parsed_cmd") or [] if isinstance(x, dict)]
        command = argv_command(argv)
        tail = next((x.strip() for x in (item.get("formatted_output"), item.get("aggregated_output"), item.get("stdout"), item.get("stderr")) if isinstance(x, str) and x.strip()), None)
        ran = {"kind": "ran", "command": command, "exit_code": _number(item.get("exit_code")), "hint": parsed[0].get("type") if parsed else None, "text": tail[-400:] if tail else None, "works": True, "duration_ms": milliseconds(item.get("duration"))}
        return [ran, *({"kind": "read", "path": x["path"]} for x in parsed if x.get("type") == "read" and x.get("path"))]
    if what == "FileChange":
        out = []
        for path, spec in (item.get("changes") or {}).items() if isinstance(item.get("changes"), dict) else ():
            if isinstance(spec, dict):
                plus, minus = _diff((spec.get("unified_diff") or "").split("\n"))
                change = {"add": "file_create", "delete": "file_delete"}.get(spec.get("type"), "file_edit")
                out.append({"kind": "change", "path": path, "change": change, "added": plus, "removed": minus, "works": True})
                if spec.get("move_path"):
                    out.append({"kind": "change", "path": spec["move_path"], "change": "file_create"})
        return out
    if what == "McpToolCall":
        tool = f"{item.get('server') or item.get('appName') or 'mcp'}.{item.get('tool') or item.get('actionName') or 'call'}"
        return [{"kind": "tool", "tool": tool, "text": f"{tool} ({item.get('status', 'unknown')})", "works": True}]
    if what == "Extension":
        return [{"kind": "tool", "tool": f"extension:{item.get('kind', 'extension')}", "text": str(item.get("query") or item.get("kind") or ""), "works": True}]
    if what == "SubAgentActivity":
        return [{"kind": "tool", "tool": "subagent", "text": f"subagent {item.get('kind', '')} {item.get('agent_path', '')}".strip()}]
    if what == "Reasoning":
        return []
    return [{"kind": "note", "text": "context compaction" if what == "ContextCompaction" else f"unhandled item {what}"}]


def message_steps(obj: dict) -> list[dict]:
    """Steps of a user, assistant or system record."""
    msg, side = obj.get("message"), bool(obj.get("isSidechain"))
    out: list[dict] = [{"kind": "header", "cwd": obj.get("cwd"), "branch": obj.get("gitBranch"), "version": obj.get("version")}]
    kind, content = obj.get("type"), msg.get("content") if isinstance(msg, dict) else None
    if kind == "user" and isinstance(msg, dict):
        results = [b for b in content if isinstance(b, dict) and b.get("type") == "tool_result"] if isinstance(content, list) else []
        use = obj.get("toolUseResult") if isinstance(obj.get("toolUseResult"), dict) else {}
        for b in results:
            hunks = [x for h in use.get("structuredPatch") or [] if isinstance(h, dict) for x in h.get("lines") or [] if isinstance(x, str)]
            plus, minus = _diff(hunks)
            tail = next((x.strip() for x in (use.get("stdout"), use.get("stderr"), _text(b.get("content"))) if isinstance(x, str) and x.strip()), None)
            out.append({"kind": "result", "call_id": b.get("tool_use_id"), "is_error": bool(b.get("is_error")), "interrupted": bool(use.get("interrupted")), "change": str(use.get("type") or "").lower(), "added": plus, "removed": minus, "text": tail[-400:] if tail else None})
        origin = obj.get("origin")
        if not results and not obj.get("isMeta"):
            text = _text(content)
            if "[Request interrupted by user" in text:
                out.append({"kind": "stopped"})
            elif not isinstance(origin, dict) or origin.get("kind") in (None, "human"):
                out.append({"kind": "human", "text": text, "sidechain": side})
    elif kind == "assistant" and isinstance(msg, dict):
        usage = msg.get("usage") if isinstance(msg.get("usage"), dict) else {}
        out.append({"kind": "usage", "usage": {k: v for k, v in usage.items() if _number(v) is not None}, "model": msg.get("model")})
        said = None
        for b in content if isinstance(content, list) else ():
            if isinstance(b, dict) and b.get("type") == "text" and (b.get("text") or "").strip():
                said = b["text"]
                out.append({"kind": "say", "text": said, "sidechain": side, "works": True})
            elif isinstance(b, dict) and b.get("type") == "tool_use":
                given = b.get("input") if isinstance(b.get("input"), dict) else {}
                name = b.get("name") or "unknown"
                words = {"Task": given.get("description") or given.get("prompt"), "Agent": given.get("description") or given.get("prompt"), "Skill": f"skill: {given.get('command') or given.get('skill') or ''}".strip()}
                todos = given.get("todos")
                words["TodoWrite"] = f"{len(todos)} todos" if isinstance(todos, list) else "todos"
                words |= {x: given.get("pattern") or given.get("path") for x in SEARCH_TOOLS} | {"Bash": given.get("description")}
                text = words.get(name)
                out.append({"kind": "call", "call_id": b.get("id"), "tool": name, "path": given.get("file_path") or given.get("notebook_path"), "command": given.get("command") if name == "Bash" else None, "text": None if text is None else str(text), "sidechain": side, "works": True})
        if msg.get("stop_reason") in ("end_turn", "stop_sequence") and said:
            out.append({"kind": "ended", "text": said, "sidechain": side})
        elif msg.get("stop_reason") == "aborted":
            out.append({"kind": "stopped"})
    elif kind == "system" and obj.get("subtype") == "compact_boundary":
        out.append({"kind": "note", "text": "context compacted"})
    elif kind in ("ai-title", "last-prompt", "custom-title"):
        for tool in ("aiTitle", "lastPrompt"):
            if obj.get(tool):
                out.append({"kind": "title", "tool": tool, "text": str(obj[tool])})
    if obj.get("isApiErrorMessage"):
        out.append({"kind": "api_error", "text": "API error message", "sidechain": side})
    if obj.get("interruptedByShutdown") or obj.get("isAbortedMidStream"):
        out.append({"kind": "stopped"})
    return out


def argv_command(argv) -> str | None:
    """The command of an argument list: what a shell is given to run, else all arguments."""
    if isinstance(argv, list) and argv:
        shell = len(argv) >= 3 and str(argv[0]).endswith(SHELL_NAMES) and str(argv[1]) in SHELLS
        return str(argv[2]) if shell else " ".join(map(str, argv))
    return argv if isinstance(argv, str) else None


def freeform_command(given) -> str | None:
    """The command in a tool call's free input: a mapping's, JSON's, a quoted one, or a raw text within the limit of commands."""
    if isinstance(given, dict):
        values = (given.get(k) for k in ("command", "cmd", "script", "shell"))
        return next((argv_command(v) for v in values if (isinstance(v, str) and v.strip()) or (isinstance(v, list) and v)), None)
    if not isinstance(given, str):
        return None
    given = given.strip()
    if given.startswith("{"):
        try:
            return freeform_command(json.loads(given))
        except ValueError:
            return None
    if quoted := re.search(QUOTED_COMMAND, given):
        return quoted[1]
    return given if 0 < len(given) < V.COMMAND_LIMIT else None


def output_exit(output) -> int | None:
    """The exit code that a tool's output names; 0 if it says that all went well."""
    if isinstance(output, dict) and isinstance(output.get("exit_code"), int):
        return output["exit_code"]
    if isinstance(output, list):
        text = " ".join(str(b.get("text") or "") for b in output if isinstance(b, dict))
    else:
        text = str(output.get("output") or "") if isinstance(output, dict) else output if isinstance(output, str) else ""
    if found := re.search(EXIT, text, re.I):
        return int(found[1])
    return 0 if "Script completed" in text or "succeeded" in text.lower() else None


LAYOUTS = {"rollout": rollout_steps, "messages": message_steps}


def steps(lines: DataFrame, layout: str) -> DataFrame:
    """(file, line, pos, step columns); a line that is no JSON object is a warning step."""
    read = LAYOUTS[layout]
    names = list(STEP)
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "map<string,long>": pa.map_(pa.string(), pa.int64())}

    def run(batches):
        for batch in batches:
            rows = []
            for file, line, value in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if not (value or "").strip():
                    continue
                try:
                    obj = json.loads(value.strip())
                    found = read(obj) if isinstance(obj, dict) else [{"kind": "warning", "text": f"line {line}: not an object"}]
                    stamp = obj.get("timestamp") if isinstance(obj, dict) else None
                except ValueError as x:
                    found, stamp = [{"kind": "warning", "text": f"line {line}: {x}"}], None
                rows += [(file, line, pos, {"ts": None if stamp is None else str(stamp)} | s) for pos, s in enumerate(found)]
            columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())]
            for n in names:
                values = [r[3].get(n) for r in rows]
                columns.append(pa.array([list(v.items()) if isinstance(v, dict) else v if v is None or STEP[n] != "string" else str(v) for v in values], kinds[STEP[n]]))
            yield pa.RecordBatch.from_arrays(columns, names=["file", "line", "pos", *names])

    return lines.select("file", "line", "value").mapInArrow(run, "file string, line int, pos int, " + ", ".join(f"{k} {t}" for k, t in STEP.items()))


def human_text(text: Column) -> Column:
    """A prompt without wrappers; null if nothing of a person's is left. Marked blocks are dropped up to a blank line, until none is left."""
    pair = "|".join(WRAPPERS)
    strip = lambda t: F.nullif(stripped(F.regexp_replace(t, rf"(?is)<({pair})>.*?</\1>", "")), F.lit(""))
    marked = lambda t: F.exists(F.array(*map(F.lit, INJECTED)), lambda m: F.startswith(t, m))
    # Folds bind each step's text once; nested columns would repeat it in the plan at every depth.
    step = lambda t, _: F.when(marked(t), strip(F.regexp_extract(t, r"(?s)^.*?\n\n(.*)$", 1))).otherwise(t)
    # Each drop takes a blank line with it, so there are no more drops than blank lines.
    left = F.aggregate(F.sequence(F.lit(1), F.regexp_count(text, F.lit("\n\n")) + 1), strip(text), step)
    tag = lambda t: F.startswith(t, F.lit("<")) & F.endswith(t, F.lit(">")) & ~F.contains(t, F.lit("\n"))
    return F.get(F.transform(F.array(left), lambda t: F.when(tag(t) | marked(t), None).otherwise(t)), F.lit(0))


def relative(path: Column, root: Column) -> Column:
    """The path below root, if it is; else cleaned. Without a root, cleaned."""
    p = F.regexp_replace(stripped(path), "^file://", "")
    clean, base = normalized(p), F.regexp_replace(root, "/+$", "")
    return F.when(root.isNull(), p).when(clean == base, "").when(F.startswith(clean, F.concat(base, F.lit("/"))), F.substr(clean, F.length(base) + 2)).otherwise(clean)


def session_table(all_steps: DataFrame, root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Events and headers of the files in steps().

    Events: trajectory_id (the file), project_id (null), sequence from 1, type, ts, path, command, exit_code, summary,
    tool, redacted, duration_ms (of commands and completions that tell it). A file whose raw items stand in for items has a
    warning for that. A session's windows go by file, so the steps of one file, not its bytes, are a task's work. Headers: trajectory_id, cwd, branch, version, model, task (the first prompt,
    else the title, else the last prompt), started_at and ended_at (of the events, ISO in UTC), n_warnings, final_status, reason.
    """
    file = W.partitionBy("file")
    order = file.orderBy("line", "pos")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    s = all_steps.withColumn("item_stream", F.max(F.col("kind").isin("ran", "change", "tool", "read", "human", "say", "note") & F.coalesce("raw", F.lit(False)).eqNullSafe(False)).over(file))
    s = s.where(~F.coalesce("raw", F.lit(False)) | ~F.col("item_stream"))
    nth = W.partitionBy("file", "call_id", "kind").orderBy("line", "pos")
    s = s.withColumn("nth", F.when(F.col("kind").isin("call", "result"), F.row_number().over(nth)))
    calls = s.where("kind = 'call' and call_id is not null").select(
        "file", "call_id", "nth", *[F.col(c).alias(f"c_{c}") for c in ("tool", "path", "command", "text", "sidechain")], F.lit(True).alias("known")
    )
    done = s.where("kind = 'result'").select("file", "call_id", "nth", F.lit(True).alias("answered"), F.col("exit_code").alias("r_exit"))
    s = s.join(calls, ["file", "call_id", "nth"], "left").join(done, ["file", "call_id", "nth"], "left")
    is_ = lambda *k: F.col("kind").isin(*k)
    # Prompts: the first main one is the task; later ones correct, if the assistant has acted since the one before.
    sub = F.regexp_like("file", F.lit(r"/subagents/[^/]+$"))
    s = s.withColumn("asked", F.when(is_("human"), human_text(F.col("text")))).where(~is_("human") | F.col("asked").isNotNull())
    place = F.struct("line", "pos")
    acted, turned = (F.max(F.when(c, place)).over(before) for c in (F.coalesce("works", F.lit(False)), is_("human")))
    first = F.min(F.when(is_("human") & (~F.coalesce("sidechain", F.lit(False)) | sub), place)).over(file)
    s = s.withColumns({"acted": acted, "turned": turned, "first": first})
    busy = F.col("acted").isNotNull() & (F.col("turned").isNull() | (F.col("acted") > F.col("turned")))
    raw_call = is_("call") & F.coalesce("raw", F.lit(False))
    bash = is_("ran") | (is_("result") & (F.col("c_tool") == "Bash")) | (raw_call & F.col("command").isNotNull())
    command = F.when(is_("ran", "call"), F.col("command")).otherwise(F.col("c_command"))
    own_exit = F.when(F.col("interrupted"), None).when(F.col("is_error"), 1).otherwise(0)
    code = F.when(is_("ran"), F.col("exit_code")).when(raw_call, F.col("r_exit")).otherwise(own_exit)
    s = s.withColumns({"bash": F.coalesce(bash, F.lit(False)), "cmd": command, "code": code})
    s = s.withColumn("cmd_kind", F.when(F.col("bash"), command_kind(F.col("cmd"), F.col("hint"))))
    tool = F.col("c_tool")
    answered = is_("result") & ~F.coalesce("raw", F.lit(False))
    kind = (
        F.when(F.col("bash"), "command")
        .when(is_("human"), F.when(place == F.col("first"), "user_prompt").when(busy & ~F.coalesce("sidechain", F.lit(False)), "human_correction").otherwise("user_prompt"))
        .when(is_("say"), "assistant_message").when(is_("change"), F.col("change")).when(is_("read"), "file_read").when(is_("completion"), "completion")
        .when(is_("note", "turn_aborted"), "unknown").when(is_("api_error"), "error").when(is_("tool"), "tool_call")
        .when(answered & (tool == "Read"), "file_read").when(answered & tool.isin(*EDIT_TOOLS), "file_edit")
        .when(answered & (tool == "Write"), F.when(F.col("change") == "update", "file_edit").otherwise("file_create"))
        .when(answered, "tool_call").when(raw_call, "tool_call").when(is_("call") & F.col("answered").isNull(), "tool_call")
    )
    text = F.when(F.col("bash"), F.coalesce("text", "c_text")).when(is_("result"), F.col("c_text")).when(is_("human"), F.col("asked")).when(is_("completion") & (F.col("text") == ""), "task complete").otherwise(F.col("text"))
    path = F.when(is_("change", "read"), F.col("path")).when(is_("result") & ~F.col("bash"), F.col("c_path"))
    late = is_("call") & ~F.coalesce("raw", F.lit(False))
    s = s.withColumns({"type": kind, "said": redacted(text), "ran": redacted(F.when(F.col("bash"), F.col("cmd"))), "at": relative(path, F.lit(root)), "late": late.cast("int")})
    rows = s.where("type is not null").select(
        "file", "late", "line", "pos", "type", "ts", F.col("at").alias("path"), bounded(F.col("ran.text"), V.COMMAND_LIMIT).alias("command"), F.when(F.col("bash"), F.col("code")).alias("exit_code"),
        F.when(late, "tool call without recorded result").otherwise(summarized(F.col("said.text"))).alias("summary"), F.coalesce("c_tool", "tool").alias("tool"),
        (F.coalesce("said.redacted", F.lit(False)) | F.coalesce("ran.redacted", F.lit(False))).alias("redacted"), outcome_type(F.col("cmd_kind"), F.col("code")).alias("outcome"), "cmd_kind", F.when(is_("ran", "completion"), F.col("duration_ms")).alias("duration_ms"),
    )
    echo = rows.where("outcome is not null").select(
        "file", "late", "line", (F.col("pos") + 0.5).alias("pos"), F.col("outcome").alias("type"), "ts", F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("command"),
        F.lit(None).cast("int").alias("exit_code"), F.format_string("%s exit %d", "cmd_kind", "exit_code").alias("summary"), F.lit(None).cast("string").alias("tool"), F.lit(False).alias("redacted"), F.lit(None).cast("long").alias("duration_ms"),
    )
    both = rows.drop("outcome", "cmd_kind").withColumn("pos", F.col("pos").cast("double")).unionByName(echo.withColumn("pos", F.col("pos").cast("double")))
    number = F.row_number().over(W.partitionBy("file").orderBy("late", "line", "pos"))
    events = both.withColumn("sequence", number).select(
        F.col("file").alias("trajectory_id"), F.lit(None).cast("string").alias("project_id"), "sequence", "type", F.col("ts").alias("ts"), "path", "command", "exit_code", "summary", "tool", "redacted", "duration_ms"
    )
    # Status signals: a stop counts unless a clean end follows; an aborted turn if work was done since the last prompt.
    worked = is_("turn_aborted") & busy
    last = lambda value, when: F.max_by(F.when(when, value), F.when(when, place))
    titled = lambda tool: is_("title") & (F.col("tool") == tool)
    main = is_("ended") & (~F.coalesce("sidechain", F.lit(False)) | sub)
    heads = s.groupBy("file").agg(
        F.min_by("cwd", F.when(F.col("cwd").isNotNull(), place)).alias("cwd"), F.min_by("branch", F.when(F.col("branch").isNotNull(), place)).alias("branch"),
        last(F.col("version"), F.col("version").isNotNull()).alias("version"), last(F.col("model"), F.col("model").isNotNull()).alias("model"),
        F.min_by("said.text", F.when(is_("human") & (place == F.col("first")), place)).alias("asked"),
        F.min_by("text", F.when(titled("aiTitle"), place)).alias("title"), F.max_by("said.text", F.when(titled("lastPrompt"), place)).alias("prompt"),
        (F.count_if(is_("warning")) + F.coalesce(F.max((F.coalesce("raw", F.lit(False)) & ~F.col("item_stream")).cast("long")), F.lit(0))).alias("n_warnings"), F.max(worked).alias("turn_aborted"), last(is_("stopped"), is_("stopped") | main).alias("stopped"),
        last(F.col("text"), main).alias("ended"), last(F.col("text"), is_("completion")).alias("completed"),
    )
    signals = heads.select(
        F.col("file").alias("trajectory_id"),
        F.explode(F.filter(F.array(
            F.when(F.coalesce("turn_aborted", F.lit(False)) | F.coalesce("stopped", F.lit(False)), F.struct(F.lit("abort").alias("type"), F.lit("").alias("summary"))),
            F.when(F.col("ended").isNotNull(), F.struct(F.lit("completion").alias("type"), F.col("ended").alias("summary"))),
        ), lambda x: x.isNotNull())).alias("x"),
    ).select("trajectory_id", F.lit(1 << 30).alias("sequence"), "x.type", F.lit(None).cast("int").alias("exit_code"), "x.summary")
    status = final_status(events.select("trajectory_id", "sequence", "type", "exit_code", "summary").unionByName(signals))
    stamp = iso_instant(F.col("ts"))
    bounds = events.groupBy(F.col("trajectory_id").alias("file")).agg(F.min(stamp).alias("started_at"), F.max(stamp).alias("ended_at"))
    heads = heads.withColumn("task", bounded(F.coalesce("asked", "title", "prompt"), V.TASK_LIMIT)).drop("asked", "title", "prompt").join(bounds, "file", "left")
    headers = heads.drop("turn_aborted", "stopped", "ended", "completed").withColumnRenamed("file", "trajectory_id").join(status, "trajectory_id", "left")
    return events, headers


def token_usage(all_steps: DataFrame, layout: str) -> DataFrame:
    """(trajectory_id, key, tokens): the last snapshot of a rollout, the sum over a file of messages."""
    each = all_steps.where("kind = 'usage'").select("file", "line", F.explode("usage").alias("key", "n"))
    if layout == "rollout":
        newest = all_steps.where("kind = 'usage'").groupBy("file").agg(F.max_by("usage", "line").alias("usage"))
        return newest.select(F.col("file").alias("trajectory_id"), F.explode("usage").alias("key", "tokens"))
    return each.groupBy(F.col("file").alias("trajectory_id"), "key").agg(F.sum("n").alias("tokens"))


def file_touches(events: DataFrame) -> DataFrame:
    """(trajectory_id, path, was_read, was_created, was_modified, was_deleted)."""
    flag = lambda name, kind: F.bool_or(F.col("type") == kind).alias(name)
    at = events.where("path is not null and path <> ''").groupBy("trajectory_id", "path")
    return at.agg(flag("was_read", "file_read"), flag("was_created", "file_create"), flag("was_modified", "file_edit"), flag("was_deleted", "file_delete"))


def files_changed(touches: DataFrame) -> DataFrame:
    """(trajectory_id, path) of file_touches() that a session created, modified or deleted, in order of the path."""
    return touches.where("was_created or was_modified or was_deleted").select("trajectory_id", "path").orderBy("trajectory_id", "path")
