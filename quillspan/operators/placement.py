"""Where a lesson belongs: features of a group's evidence, scope inference, scores and ranks of five placements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillspan.functions import values as V
from quillspan.functions.commands import command_family
from quillspan.functions.paths import directory, extension, language, repository_path
from quillspan.functions.scores import placement_scores
from quillspan.functions.digests import row_digest, set_digest
from quillspan.functions.text import collapsed
from quillspan.tables import snapshot

# Patterns that say what to do, triage marks that bar a proposal, and absolute paths in texts.
ACTIONABLE = ("failure_repair", "file_change_pattern", "human_correction_repair")
BARRED = ("false_positive", "needs_more_evidence")
ABSOLUTE_PATH = r"(?:(?:[A-Za-z]:[\\/])|(?:~[\\/])|(?<![A-Za-z0-9_.-])/)[^\s,;:()\[\]{}<>\"']+"
CONTENT_LIMIT = 500


def eligible(experiences: DataFrame) -> DataFrame:
    """Experiences that may be placed: candidates that no review has set aside; one without a mark is unreviewed."""
    return experiences.where((F.col("status") == "candidate") & ~F.coalesce("review_status", F.lit("unreviewed")).isin(*BARRED))


def public_content(lesson: Column, summary: Column, title: Column) -> Column:
    """The first text that isn't empty, on one line, without absolute paths, at most CONTENT_LIMIT long; empty if none."""
    own = lambda c: F.nullif(c, F.lit(""))
    text = F.coalesce(own(lesson), own(summary), own(title), F.lit(""))
    flat = collapsed(F.replace(text, F.lit("\x00"), F.lit(" ")))
    return F.regexp_replace(F.substring(F.regexp_replace(flat, ABSOLUTE_PATH, "[repository path omitted]"), 1, CONTENT_LIMIT), r"\s+$", "")


def diagnostics(placed: DataFrame) -> DataFrame:
    """(group_key, placement, code, polarity, message, value): what speaks for (+) and against (-) each placement, a row each.

    placed has a row for each group and placement with the columns of features(). value is the number that the message
    rests on. The messages are fixed values.
    """
    c = F.col
    scope_type, scope_value = F.coalesce(c("scope_type"), F.lit("")), F.coalesce(c("scope_value"), F.lit(""))
    scoped = scope_value != ""
    sign = lambda good: F.when(good, "+").otherwise("-")
    for_ = lambda name: c("placement") == name
    weak, vague, ignored = c("support_ratio") < 0.75, c("actionability") < 0.5, for_("ignore")

    def say(when, code, polarity, value, *message):
        text = F.concat(*(m if isinstance(m, Column) else F.lit(m) for m in message))
        return F.when(when, F.struct(F.lit(code).alias("code"), polarity.alias("polarity"), text.alias("message"), F.round(value.cast("double"), 4).alias("value")))

    percent = F.format_string("%.0f%%", 100 * c("project_concentration"))
    gate = F.when(c("global_eligible"), F.format_string("balanced repeated support across %d projects", c("project_count"))).otherwise("insufficient balanced repeated independent-project support")
    procedure = F.when(c("procedural_complexity") >= 0.5, "repeated evidence contains multi-operation ordered workflows").otherwise("evidence does not show repeated multi-operation workflows")
    evidence = F.when(scoped, F.concat(c("scope_support_count").cast("string"), F.lit(" supports concentrate in "), scope_type, F.lit(": "), scope_value)).otherwise("no repeated evidence-backed technical scope")
    none = F.lit(None).cast("double")
    notes = F.array(
        say(F.lit(True), "support", sign(c("support_count") > 0), c("support_count"), c("support_count").cast("string"), " supporting occurrence(s)"),
        say(c("contradiction_count") > 0, "contradictions", F.lit("-"), c("contradiction_count"), c("contradiction_count").cast("string"), " contradicting occurrence(s)"),
        say(for_("global_rule"), "global_gate", sign(c("global_eligible")), c("project_count"), gate),
        say(for_("global_rule") & scoped, "specific_scope", F.lit("-"), none, "evidence concentrates in ", scope_type, ": ", scope_value),
        say(for_("project_rule"), "project_concentration", sign(c("project_concentration") >= 0.75), c("project_concentration"), "largest project supplies ", percent, " of support"),
        say(for_("project_rule") & scoped, "scope_alternative", F.lit("-"), none, "a repeated ", scope_type, " scope is also available"),
        say(for_("scoped_rule"), "scope_evidence", sign(scoped), F.when(scoped, c("scope_concentration")), evidence),
        say(for_("skill"), "procedure", sign(c("procedural_complexity") >= 0.5), c("procedural_complexity"), procedure),
        say(ignored & weak, "weak_or_mixed", F.lit("+"), c("support_ratio"), "mixed or weak support raises defer preference"),
        say(ignored & vague, "actionability", F.lit("+"), c("actionability"), "pattern is not yet a concrete reusable instruction"),
        say(ignored & ~weak & ~vague, "actionability", F.lit("-"), c("actionability"), "evidence is actionable enough for a placement alternative"),
    )
    rows = placed.select("group_key", "placement", F.explode(F.filter(notes, lambda x: x.isNotNull())).alias("x"))
    return rows.select("group_key", "placement", "x.*")


def source_fingerprints(experiences: DataFrame, evidence: DataFrame, version: str, keys: list[str], evidence_keys: list[str], events: DataFrame | None = None, event_keys: tuple[str, ...] = ()) -> DataFrame:
    """(group_key, fingerprint): a SHA-256 over the version, the named columns of an experience and of all its evidence, and the
    named columns of all events of the evidence's trajectories.

    Evidence and events count as sets of row digests, whatever their order in the tables.
    """
    each = evidence.select("group_key", row_digest(evidence, evidence_keys).alias("d")).groupBy("group_key").agg(set_digest("d").alias("e"))
    own = experiences.select("group_key", row_digest(experiences, keys).alias("own")).join(each, "group_key", "left").withColumn("t", F.lit(""))
    if events is not None:
        tracks = events.select("trajectory_id", row_digest(events, event_keys).alias("d")).groupBy("trajectory_id").agg(set_digest("d").alias("d"))
        seen = evidence.select("group_key", "trajectory_id").distinct().join(tracks, "trajectory_id")
        seen = seen.select("group_key", F.sha2(F.concat_ws("|", F.col("trajectory_id").cast("string"), "d"), 256).alias("d")).groupBy("group_key").agg(set_digest("d").alias("seen"))
        own = own.join(seen, "group_key", "left").withColumn("t", F.coalesce("seen", F.lit("")))
    return own.select("group_key", F.sha2(F.concat_ws("|", F.lit(version), "own", F.coalesce("e", F.lit("")), "t"), 256).alias("fingerprint"))


def outdated(experiences: DataFrame, fingerprints: DataFrame, sets: DataFrame, version: str) -> DataFrame:
    """Eligible experiences whose proposals are to be made anew: sets (group_key, fingerprint, version, n) has none with
    the same fingerprint and version and all five rows."""
    done = sets.where((F.col("version") == version) & (F.col("n") == 5)).select("group_key", "fingerprint")
    return eligible(experiences).join(fingerprints, "group_key").join(done, ["group_key", "fingerprint"], "left_anti")


STRETCH = 64  # events of a trajectory that meet spans by equality; the range decides inside


def span_events(occurrences: DataFrame, events: DataFrame) -> DataFrame:
    """Each occurrence's events: equal trajectory, sequence between its ends. Occurrences have occurrence_id and group_key.

    A trajectory is cut into stretches of sequence numbers and a span is laid out over those it touches, so that events
    meet the spans near them and a long trajectory is many keys.
    """
    spans = occurrences.select("occurrence_id", "group_key", "trajectory_id", "start_sequence", "end_sequence").where("start_sequence <= end_sequence")
    stretch = lambda c: F.floor(F.col(c) / STRETCH).cast("long")
    laid = spans.withColumn("_stretch", F.explode(F.sequence(stretch("start_sequence"), stretch("end_sequence"))))
    met = laid.join(events.withColumn("_stretch", stretch("sequence")), ["trajectory_id", "_stretch"])
    return met.where(F.col("sequence").between(F.col("start_sequence"), F.col("end_sequence"))).drop("_stretch")


def procedural_complexity(support: DataFrame, events: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """(group_key, procedural_complexity): spans with three operations of two kinds, half a point each, one at most.

    spans may hold span_events() of both, where others read it too.
    """
    work = (span_events(support, events) if spans is None else spans).where("coalesce(path, '') <> '' or coalesce(command, '') <> ''")
    each = work.groupBy("group_key", "occurrence_id").agg(F.count_distinct("sequence").alias("n"), F.count_distinct("type").alias("kinds"))
    return each.groupBy("group_key").agg(F.least(F.lit(1.0), F.count_if((F.col("n") >= 3) & (F.col("kinds") >= 2)) / 2.0).alias("procedural_complexity"))


def scope_candidates(support: DataFrame, events: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """(group_key, scope_type, scope_value, scope_support_count, scope_concentration, scope_specificity) of values in enough support."""
    path = repository_path(F.col("path"))
    inside = (span_events(support, events) if spans is None else spans).withColumn("p", path)
    values = F.array(
        F.struct(F.lit("directory").alias("t"), directory(F.col("p")).alias("v")),
        F.struct(F.lit("extension").alias("t"), extension(F.col("p")).alias("v")),
        F.struct(F.lit("language").alias("t"), language(F.col("p")).alias("v")),
        F.struct(F.lit("command").alias("t"), command_family(F.col("command")).alias("v")),
    )
    from_events = inside.select("group_key", "occurrence_id", F.explode(values).alias("x")).select("group_key", "occurrence_id", "x.t", "x.v")
    subsystems = F.array_union(F.array("repair_context"), F.coalesce("antecedents", F.array().cast("array<string>")))
    own = support.select("group_key", "occurrence_id", F.lit("subsystem").alias("t"), F.explode(subsystems).alias("v")).where(F.col("v").isin(*V.CONTEXTS))
    seen = from_events.unionByName(own).where("v is not null").distinct().groupBy("group_key", "t", "v").agg(F.count("*").alias("n"))
    total = support.groupBy("group_key").agg(F.count("*").alias("all"))
    ok = seen.join(total, "group_key").withColumn("share", F.col("n") / F.col("all")).where((F.col("n") >= V.SCOPE_COUNT) & (F.col("share") >= V.SCOPE_SHARE))
    specific = F.lit(0.0)
    for name, value in V.SCOPE_SPECIFICITY.items():
        specific = F.when(F.col("t") == name, value).otherwise(specific)
    return ok.select(
        "group_key", F.col("t").alias("scope_type"), F.col("v").alias("scope_value"), F.col("n").alias("scope_support_count"),
        F.col("share").alias("scope_concentration"), specific.alias("scope_specificity"),
    )


def inferred_scopes(support: DataFrame, events: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """The best candidate of each group: concentration x specificity, count, type order, value."""
    order = F.array_position(F.array(*map(F.lit, V.SCOPE_ORDER)), F.col("scope_type"))
    best = W.partitionBy("group_key").orderBy(F.desc(F.col("scope_concentration") * F.col("scope_specificity")), F.desc("scope_support_count"), order, "scope_value")
    return scope_candidates(support, events, spans).withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def features(evidence: DataFrame, experiences: DataFrame, events: DataFrame) -> DataFrame:
    """Score inputs of each experience. evidence has occurrence_id, group_key, classification, project_id, trajectory_id,
    start_sequence, end_sequence, repair_context and antecedents; experiences has group_key, pattern and confidence."""
    is_ = lambda x: F.col("classification") == x
    support = evidence.where(is_("support"))
    counts = evidence.groupBy("group_key").agg(
        F.count_if(is_("support")).alias("support_count"), F.count_if(is_("contradiction")).alias("contradiction_count"),
        F.count_if(is_("ambiguous")).alias("ambiguous_count"), F.count_distinct(F.when(is_("support"), F.col("trajectory_id"))).alias("trajectory_count"),
    )
    projects = support.where("project_id is not null").groupBy("group_key", "project_id").agg(F.count("*").alias("n"))
    projects = projects.groupBy("group_key").agg(
        F.count("*").alias("project_count"), F.max("n").alias("top"), F.min("n").alias("low"),
        F.min_by("project_id", F.struct((-F.col("n")).alias("n"), F.col("project_id").alias("p"))).alias("dominant_project_id"),
    )
    real = support.where(~F.coalesce("repair_context", F.lit("")).isin("", "other", "mixed"))
    contexts = real.groupBy("group_key", "repair_context").agg(F.count("*").alias("n")).groupBy("group_key").agg(F.max("n").alias("context_top"))
    spans = snapshot(span_events(support, events.select("trajectory_id", "sequence", "type", "path", "command")), "spans")
    out = experiences.select("group_key", "pattern", "confidence.score", F.col("confidence.recency").alias("recency")).withColumnRenamed("score", "confidence")
    for part in (counts, projects, contexts, procedural_complexity(support, events, spans), inferred_scopes(support, events, spans)):
        out = out.join(part, "group_key", "left")
    zero = ["support_count", "contradiction_count", "ambiguous_count", "trajectory_count", "project_count", "top", "low", "context_top", "scope_support_count"]
    out = out.fillna(0, zero).fillna(0.0, ["procedural_complexity", "scope_concentration", "scope_specificity"]).fillna("global", ["scope_type"])
    n = F.col("support_count")
    share = lambda x: F.when(n > 0, F.col(x) / n).otherwise(0.0)
    out = out.withColumns({
        "support_ratio": F.when(n + F.col("contradiction_count") > 0, n / (n + F.col("contradiction_count"))).otherwise(0.0),
        "recurrence": F.least(F.lit(1.0), (n + F.col("ambiguous_count")) / 6.0),
        "cross_project_support": F.least(F.lit(1.0), F.greatest(F.lit(0), F.col("project_count") - 1) / 2.0),
        "project_concentration": share("top"),
        "context_consistency": share("context_top"),
        "actionability": F.when(n < 2, 0.25).when(F.col("pattern") == "repeated_failure", 0.35).when(F.col("pattern").isin(*ACTIONABLE), 1.0).otherwise(0.5),
    })
    gate = (F.col("project_count") >= 2) & (F.col("low") >= 2) & (F.col("project_concentration") <= 0.75)
    return out.withColumn("global_eligible", gate).drop("top", "low", "context_top")


def proposals(found: DataFrame) -> DataFrame:
    """Five ranked rows for each row of features(): placement, score, rank, scope."""
    scored = F.array(*[F.struct(F.lit(k).alias("tie"), F.lit(name).alias("placement"), score.alias("score")) for k, (name, score) in enumerate(placement_scores().items())])
    rows = found.select("*", F.explode(scored).alias("s"))
    order = W.partitionBy("group_key").orderBy(F.desc("s.score"), "s.tie")
    scope_type: Column = F.when(F.col("s.placement") == "project_rule", "project").when(F.col("s.placement") == "scoped_rule", F.col("scope_type")).otherwise("global")
    scope_value = F.when(F.col("s.placement") == "project_rule", F.col("dominant_project_id").cast("string")).when(F.col("s.placement") == "scoped_rule", F.col("scope_value"))
    rows = rows.withColumns({"rank": F.row_number().over(order), "target_type": scope_type, "target_value": scope_value})
    return rows.select("group_key", F.col("s.placement").alias("placement"), F.col("s.score").alias("score"), "rank", "target_type", "target_value")
