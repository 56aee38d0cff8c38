"""Pattern detectors over event sequences, as windows of a trajectory ordered by sequence.

Events have trajectory_id, project_id, sequence, type, path, command, exit_code, summary. Every detector reads one
shuffle by trajectory: what lies between two events is a difference of running counts, and the next event of a kind is a
minimum over a bounded frame, so no detector collects a trajectory or joins it to itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.sql.window import WindowSpec

from quillspan.functions import values as V
from quillspan.functions.commands import command_context
from quillspan.functions.paths import context_of_normalized, normalized
from quillspan.functions.text import error_signature, is_correction, is_directive, looks_diagnostic, matches, stripped
from quillspan.tables import snapshot

GAP = 20
COLUMNS = [
    "trajectory_id", "project_id", "pattern", "group_key", "classification", "start_sequence", "end_sequence", "failure_family", "resolution_family",
    "repair_context", "signature", "antecedents", "detail",
]


def _order() -> WindowSpec:
    return W.partitionBy("trajectory_id").orderBy("sequence")


def tagged(events: DataFrame) -> DataFrame:
    """events with context, vendored, command context, pass and fail family, and the running counts that detectors need."""
    base = events.withColumn("clean_path", normalized(F.col("path"))).withColumns({
        "context": F.when(F.col("path").isNotNull(), context_of_normalized(F.col("clean_path"))).otherwise(""),
        "cmd_context": command_context(F.col("command")),
        "fail_family": F.when(F.col("type").isin(*[f"{f}_fail" for f in V.FAMILIES]), F.regexp_replace("type", "_fail$", "")),
        "pass_family": F.when(F.col("type").isin(*[f"{f}_pass" for f in V.FAMILIES]), F.regexp_replace("type", "_pass$", "")),
    })
    base = base.withColumn("edit", F.col("type").isin(*V.EDIT_TYPES) & F.col("path").isNotNull() & (F.col("path") != "") & ~matches(F.col("clean_path"), V.VENDORED)).drop("clean_path")
    count = lambda x: F.sum(F.when(x, 1).otherwise(0)).over(_order().rowsBetween(W.unboundedPreceding, W.currentRow))
    so_far = F.struct(
        count(F.col("edit")).alias("edits"),
        count(F.col("cmd_context") == "migration").alias("migrations"),
        count(F.col("type") == "command").alias("commands"),
        F.array(*[count(F.col("edit") & (F.col("context") == c)) for c in V.CONTEXTS]).alias("contexts"),
    )
    return base.withColumn("so_far", so_far)


def _between(first: Column, last: Column) -> dict[str, Column]:
    """Counts of what lies behind `first` up to `last`, both running counts."""
    return {
        "edits": last["edits"] - first["edits"],
        "migrations": last["migrations"] - first["migrations"],
        "commands": last["commands"] - first["commands"],
        "contexts": F.zip_with(last["contexts"], first["contexts"], lambda a, b: a - b),
    }


def dominant(counts: Column) -> Column:
    """The context with most edits; mixed if the two top counts are equal, other if there is none."""
    most = F.array_max(counts)
    name = F.element_at(F.array(*map(F.lit, V.CONTEXTS)), F.array_position(counts, most).cast("int"))
    return F.when(most == 0, "other").when(F.size(F.filter(counts, lambda x: x == most)) > 1, "mixed").otherwise(name)


def _classified(context: Column) -> Column:
    return F.when(context.isin("other", "mixed"), "ambiguous").otherwise("support")


def _finished(df: DataFrame, pattern: str, **columns: Column) -> DataFrame:
    null = {"signature": "string", "resolution_family": "string", "repair_context": "string", "failure_family": "string", "detail": "string", "antecedents": "array<string>"}
    made = {k: F.lit(None).cast(t) for k, t in null.items()} | {"pattern": F.lit(pattern)} | columns
    return df.select("trajectory_id", "project_id", *[made[c].alias(c) for c in COLUMNS[2:]])


def with_next_pass(events: DataFrame, gap: int = GAP) -> DataFrame:
    """tagged events with next_pass: of a fail, sequence and running counts of the next pass of its family among the next `gap` events."""
    frame = _order().rowsBetween(1, gap)
    ahead = [F.min(F.when(F.col("pass_family") == f, F.struct("sequence", "so_far"))).over(frame) for f in V.FAMILIES]
    out = F.when(F.col("fail_family") == V.FAMILIES[0], ahead[0])
    for f, column in zip(V.FAMILIES[1:], ahead[1:]):
        out = out.when(F.col("fail_family") == f, column)
    return events.withColumn("next_pass", out)


#: What an event needs for a detector to start from it.
STARTS = {
    "failure_repair": "fail_family is not null and next_pass is not null", "correction_repair": "told and fail is not null",
    "file_change": "size(pairs) > 0", "repeated_failure": "coalesce(sig, '') <> ''",
}


def prepared(events: DataFrame, gap: int = GAP, least_words: int = 3, detectors: tuple[str, ...] = tuple(STARTS)) -> DataFrame:
    """with_next_pass() and what each detector looks for around an event, all in the one order of a trajectory.

    antecedents: contexts changed shortly before; fail: of a directive correction, the next failing event; changed and pairs:
    of a change, its context and the later changes that it calls for; sig: of a failure, its diagnostic signature; last_pass:
    each family's last pass. Events that none of `detectors` (names of STARTS) starts from are dropped; where only some are
    named, the plan holds no window or pattern that the others alone need.
    """
    changed = F.when(F.col("type").isin(*V.CHANGE_TYPES) & F.col("edit"), F.col("context"))
    told = (F.col("type") == "human_correction") & is_correction(F.col("summary"), least_words) & is_directive(F.col("summary"))
    fails = F.col("fail_family").isNotNull()
    near = _order().rangeBetween(1, gap)
    passing = F.min(F.when(F.col("pass_family").isNotNull(), F.struct("sequence", "pass_family"))).over(near)
    base = with_next_pass(tagged(events), gap).withColumns({"changed": changed, "told": told})
    base = base.withColumns({
        "antecedents": F.array_distinct(F.collect_list("changed").over(_order().rangeBetween(-gap, -1))),
        "fail": F.min(F.when(fails, F.struct("sequence", "fail_family", "so_far", "next_pass"))).over(_order().rowsBetween(1, gap)),
        "family": passing["pass_family"],
        "said": F.when(fails | (F.col("type") == "error"), diagnostic_text()),
        "last_pass": F.array(*[F.max(F.when(F.col("pass_family") == f, F.col("sequence"))).over(W.partitionBy("trajectory_id")) for f in V.FAMILIES]),
    })
    pairs = []
    for k, (a, b) in enumerate(V.TRANSITIONS):
        second = F.min(F.when((F.col("changed") == b) & F.col("family").isNotNull(), F.struct("sequence", "family"))).over(near)
        pairs.append(F.when(F.col("changed") == a, F.struct(second["sequence"].alias("b"), F.lit(k).alias("kind"), second["family"].alias("family"))))
    base = base.withColumns({
        "pairs": F.filter(F.array(*pairs), lambda x: x["b"].isNotNull()), "sig": F.when(F.col("said").isNotNull(), error_signature(F.col("said"))),
        "fail": F.when(F.col("told"), F.col("fail")), "antecedents": F.when(fails & F.col("next_pass").isNotNull(), F.col("antecedents")),
    })
    base = base.select("trajectory_id", "project_id", "sequence", "type", "summary", "fail_family", "next_pass", "so_far", "told", "fail", "antecedents", "pairs", "sig", "last_pass")
    return base.where(" or ".join(f"({STARTS[d]})" for d in detectors))


def failure_repairs(events: DataFrame) -> DataFrame:
    """A failing check, repair work, and the same check passing among the next events; events are prepared()."""
    hit = events.where("fail_family is not null and next_pass is not null")
    hit = hit.withColumns({f"b_{k}": v for k, v in _between(F.col("so_far"), F.col("next_pass.so_far")).items()})
    hit = hit.where("b_edits > 0 or b_migrations > 0")
    context = F.when(F.col("b_migrations") > 0, "migration").otherwise(dominant(F.col("b_contexts")))
    hit = hit.withColumn("ctx", context)
    return _finished(
        hit, "failure_repair",
        group_key=F.concat_ws("::", F.lit("fr"), "ctx", "fail_family"), classification=_classified(F.col("ctx")), start_sequence=F.col("sequence"),
        end_sequence=F.col("next_pass.sequence"), failure_family=F.col("fail_family"), resolution_family=F.col("fail_family"), repair_context=F.col("ctx"),
        antecedents=F.col("antecedents"),
    )


def correction_repairs(events: DataFrame, gap: int = GAP) -> DataFrame:
    """A directive correction, the first failure behind it, work, and that check passing, all among the next `gap` events; events are prepared()."""
    hit = events.where(F.col("told") & F.col("fail.next_pass").isNotNull() & (F.col("fail.next_pass.sequence") <= F.col("sequence") + gap))
    hit = hit.withColumns({f"b_{k}": v for k, v in _between(F.col("fail.so_far"), F.col("fail.next_pass.so_far")).items()}).where("b_edits > 0 or b_commands > 0")
    context = F.when(F.col("b_edits") > 0, dominant(F.col("b_contexts"))).when(F.col("b_migrations") > 0, "migration").otherwise("other")
    hit = hit.withColumn("ctx", context)
    family = F.col("fail.fail_family")
    return _finished(
        hit, "human_correction_repair",
        group_key=F.concat_ws("::", F.lit("hc"), "ctx", family), classification=_classified(F.col("ctx")), start_sequence=F.col("sequence"),
        end_sequence=F.col("fail.next_pass.sequence"), failure_family=family, resolution_family=family, repair_context=F.col("ctx"),
        detail=F.substring("summary", 1, 280),
    )


def diagnostic_text() -> Column:
    """The event's own summary, unless it only repeats an exit code and a command shortly before says more."""
    own = F.nullif(stripped(F.col("summary")), F.lit(""))
    tell = [F.when(F.lag("type", k).over(_order()).isin("command", "tool_call"), F.nullif(stripped(F.lag("summary", k).over(_order())), F.lit(""))) for k in (1, 2)]
    return F.when(own.isNotNull() & ~matches(own, V.SYNTHETIC_OUTCOME), own).otherwise(F.coalesce(*tell, own))


def repeated_failures(events: DataFrame, status: DataFrame) -> DataFrame:
    """Failures with one diagnostic signature that stay unresolved; events are prepared(), status has trajectory_id and final_status."""
    seen = events.where(F.col("sig").isNotNull() & looks_diagnostic(F.col("sig")))
    hits = seen.groupBy("trajectory_id", "sig").agg(
        F.first("project_id").alias("project_id"), F.min("sequence").alias("lo"), F.max("sequence").alias("hi"), F.count("*").alias("n"),
        F.min_by("fail_family", "sequence").alias("family"), F.first("last_pass").alias("last_pass"),
    )
    hits = hits.join(status.select("trajectory_id", "final_status"), "trajectory_id", "left")
    position = F.array_position(F.array(*map(F.lit, V.FAMILIES)), F.col("family")).cast("int")
    later = F.coalesce(F.get("last_pass", position - 1) > F.col("hi"), F.lit(False))
    bad = F.coalesce(F.col("final_status").isin("partial", "aborted", "failure"), F.lit(False))
    hits = hits.withColumns({"later": later, "bad": bad}).where("not later or bad")
    return _finished(
        hits, "repeated_failure",
        group_key=F.concat(F.lit("rf::"), "sig"), classification=F.when((F.col("n") < 2) & ~F.col("bad"), "ambiguous").otherwise("support"),
        start_sequence=F.col("lo"), end_sequence=F.col("hi"), failure_family=F.col("family"), signature=F.col("sig"),
        detail=F.concat(F.col("n").cast("string"), F.lit(" hits")),
    )


def file_changes(events: DataFrame, status: DataFrame) -> DataFrame:
    """In successful sessions, a change in one context followed by one that it calls for, and a check passing behind both; events are prepared().

    Each kind of pair counts once and each first change once, in order: with three kinds that is three minima in turn.
    """
    seen = events.where(F.size("pairs") > 0).join(status.where("final_status = 'success'").select("trajectory_id"), "trajectory_id", "left_semi")
    one = seen.select("trajectory_id", "project_id", F.col("sequence").alias("a"), F.explode("pairs").alias("p"))
    whole = W.partitionBy("trajectory_id")
    pick = F.struct("a", F.col("p.b").alias("b"), F.col("p.kind").alias("kind"), F.col("p.family").alias("family"))
    allowed = F.lit(True)
    for k in range(len(V.TRANSITIONS)):
        one = one.withColumn(f"m{k}", F.min(F.when(allowed, pick)).over(whole))
        allowed = allowed & (F.col("a") > F.col(f"m{k}.a")) & (F.col("p.kind") != F.col(f"m{k}.kind"))
    found = one.select("trajectory_id", "project_id", *[f"m{k}" for k in range(len(V.TRANSITIONS))]).distinct()
    found = found.select("trajectory_id", "project_id", F.explode(F.array(*[f"m{k}" for k in range(len(V.TRANSITIONS))])).alias("m")).where("m is not null")
    names = [F.element_at(F.array(*[F.lit(t[side]) for t in V.TRANSITIONS]), F.col("m.kind") + 1) for side in (0, 1)]
    return _finished(
        found, "file_change_pattern",
        group_key=F.concat_ws("::", F.lit("fr"), names[1], F.col("m.family")), classification=F.lit("support"), start_sequence=F.col("m.a"),
        end_sequence=F.col("m.b"), resolution_family=F.col("m.family"), repair_context=names[1], antecedents=F.array(names[0]), detail=names[0],
    )


def occurrences(events: DataFrame, status: DataFrame, gap: int = GAP, least_words: int = 3) -> DataFrame:
    """All detectors' rows, the first for each (group, classification) of a trajectory; file changes yield to a repair of the same group.

    The prepared events that a detector may start from are written once and read by all four.
    """
    base = snapshot(prepared(events, gap, least_words), "prepared")
    early = [failure_repairs(base), correction_repairs(base, gap), repeated_failures(base, status)]
    early = [d.withColumn("detector", F.lit(k)) for k, d in enumerate(early)]
    early = early[0].unionByName(early[1]).unionByName(early[2])
    late = file_changes(base, status).withColumn("detector", F.lit(3))
    late = late.join(early.select("trajectory_id", "group_key").distinct(), ["trajectory_id", "group_key"], "left_anti")
    first = W.partitionBy("trajectory_id", "group_key", "classification").orderBy("detector", "start_sequence")
    return early.unionByName(late).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def profiles(events: DataFrame) -> DataFrame:
    """Of each trajectory: edited contexts, families that passed before any failure of theirs, families that failed, last sequence."""
    base = tagged(events)
    failed = {f: F.max(F.when(F.col("fail_family") == f, 1)).over(_order().rowsBetween(W.unboundedPreceding, -1)) for f in V.FAMILIES}
    clean = F.lit(None).cast("string")
    for f in V.FAMILIES:
        clean = F.when((F.col("pass_family") == f) & failed[f].isNull(), f).otherwise(clean)
    base = base.withColumn("clean", clean)
    sets = lambda c: F.array_sort(F.collect_set(c))
    return base.groupBy("trajectory_id").agg(
        F.first("project_id").alias("project_id"), sets(F.when(F.col("edit"), F.col("context"))).alias("edit_contexts"), sets("clean").alias("clean_passes"),
        sets("fail_family").alias("failed_families"), F.max("sequence").alias("max_sequence"),
    )


def final_status(events: DataFrame) -> DataFrame:
    """(trajectory_id, final_status, reason) from the events; abort and completion events stand for the session's own signals."""
    verify = F.col("type").rlike("^(test|lint|build)_(pass|fail)$")
    tail = verify | ((F.col("type") == "command") & F.col("exit_code").isNotNull())
    bad = (F.col("type") == "command") & (F.col("exit_code") != 0)
    last = lambda value, when: F.max_by(F.when(when, value), F.when(when, F.col("sequence")))
    of = events.groupBy("trajectory_id").agg(
        F.max((F.col("type") == "abort").cast("int")).alias("aborted"), last(F.col("type"), verify).alias("verified"), last(bad, tail).alias("trailing"),
        last(F.coalesce(stripped(F.col("summary")), F.lit("")), F.col("type") == "completion").alias("said"),
    )
    trailing = F.coalesce("trailing", F.lit(False))
    status = (
        F.when(F.col("aborted") == 1, "aborted").when(F.col("verified").endswith("_fail"), "partial").when(F.col("verified").endswith("_pass"), "success")
        .when((F.col("said") != "") & trailing, "partial").when(F.col("said") != "", "success").when(trailing, "partial").otherwise("unknown")
    )
    reason = (
        F.when(F.col("aborted") == 1, "session was aborted").when(F.col("verified").isNotNull(), F.concat(F.lit("last verification: "), "verified"))
        .when(F.col("said") != "", "completion signal").when(trailing, "ended on a failing command").otherwise("no evidence")
    )
    return of.select("trajectory_id", status.alias("final_status"), reason.alias("reason"))


def repair_notes(events: DataFrame) -> DataFrame:
    """Of each pass, the last failure of its family that it is the next pass of, at any distance."""
    base = tagged(events)
    ahead = _order().rowsBetween(1, W.unboundedFollowing)
    nxt = F.lit(None).cast("int")
    for f in V.FAMILIES:
        nxt = F.when(F.col("fail_family") == f, F.min(F.when(F.col("pass_family") == f, F.col("sequence"))).over(ahead)).otherwise(nxt)
    hit = base.withColumn("pass_sequence", nxt).where("pass_sequence is not null")
    return hit.groupBy("trajectory_id", "pass_sequence").agg(F.max("sequence").alias("fail_sequence"), F.max_by("fail_family", "sequence").alias("family"))


def corrections_after_work(turns: DataFrame) -> DataFrame:
    """Human turns with assistant activity since the human turn before; turns have conv_id, turn, role, text."""
    before = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    acted, asked = (F.max(F.when(F.col("role") == r, F.col("turn"))).over(before) for r in ("assistant", "user"))
    marked = turns.withColumns({"acted": acted, "asked": asked}).where("role = 'user'")
    return marked.where("acted is not null and acted > coalesce(asked, -1)").drop("acted", "asked")
