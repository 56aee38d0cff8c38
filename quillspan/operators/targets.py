"""Where reviewed content may go, what a reviewer sees, and what an evaluation is held to: rows instead of file operations.

Paths are resolved as texts: dots and doubled slashes by a fold over their parts, links by joins with a table of links. A
target counts only inside its approved root once all links are resolved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.text import short_id, slug
from quillspan.tables import snapshot

# The agents' files, the states that may be evaluated, placements of one project.
AGENT_FILES = {"codex": "AGENTS.md", "claude": "CLAUDE.md"}
EVALUATED = ("accepted", "test_first", "applied")
OF_PROJECT = ("project_rule", "scoped_rule", "skill")
MOST_LINKS = 40  # links that a path may lead through; beyond it goes round


def cleaned(path: Column) -> Column:
    """An absolute path without empty parts, dots, and parts that a double dot takes back; at the root a double dot stays there."""
    step = lambda done, part: F.when(part.isin("", "."), done).when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, part))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/"))


def joined(root: Column, path: Column) -> Column:
    """path as it stands, if it is absolute, else below root."""
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(root, F.lit("/"), path))


def inside(path: Column, root: Column, ignore_case: bool = False) -> Column:
    """Whether a cleaned path is root or lies below it."""
    p, r = (F.lower(c) if ignore_case else c for c in (path, F.regexp_replace(root, "/+$", "")))
    return (p == r) | F.startswith(p, F.concat(r, F.lit("/")))


def linked(paths: DataFrame, links: DataFrame, path_col: str = "path") -> DataFrame:
    """paths with `resolved`: path_col cleaned and with each folder or file that is a link replaced by where it leads.

    links: link (a cleaned absolute path, once each) and to (absolute, or relative to the link's folder). The first link
    along a path is followed first, as a file system does it. A path through more than MOST_LINKS links is null. A round
    joins the distinct paths that are left with the links by equality, so its size is paths x depth.
    """
    base = paths.select(path_col).where(F.col(path_col).isNotNull()).distinct()
    todo = base.select(path_col, F.col(path_col).alias("at"))
    done = None
    for _ in range(MOST_LINKS + 1):
        parts = F.split("at", "/")
        # Dots behind a link count from where it leads, so only the parts before a link are cleaned.
        heads = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda n: F.struct(cleaned(F.array_join(F.slice(parts, 1, n), "/")).alias("head"), n.alias("n")))
        found = todo.withColumn("h", F.explode(heads)).join(links.select(F.col("link"), "to"), F.col("h.head") == F.col("link"))
        first = found.groupBy(path_col, "at").agg(F.min_by(F.struct("h.n", "link", "to"), "h.n").alias("f"))
        rest = F.array_join(F.slice(F.split("at", "/"), F.col("f.n") + 1, F.size(F.split("at", "/"))), "/")
        folder = F.regexp_replace("f.link", "/[^/]*$", "")
        onward = first.select(path_col, F.concat_ws("/", joined(folder, F.col("f.to")), F.when(rest != "", rest)).alias("next"))
        step = snapshot(todo.join(onward, path_col, "left"), "links")
        ended = step.where("next is null").select(path_col, cleaned(F.col("at")).alias("resolved"))
        done = ended if done is None else done.unionByName(ended)
        todo = step.where("next is not null").select(path_col, F.col("next").alias("at"))
        if todo.isEmpty():
            break
    return paths.join(done, path_col, "left").select(*paths.columns, "resolved")


def targets(reviews: DataFrame, links: DataFrame, global_root: str | None = None, ignore_case: bool = False) -> DataFrame:
    """(review_id, target_path, kind, root, error) of reviews (review_id, placement, agent, project_root, target).

    A target that is given is taken relative to the root; without one it is the agent's file, or the review's own skill
    file. kind is global, policy or skill. With an error there is no path: `no_target` (ignored), `agent_required`,
    `global_root_required`, `project_required`, `unsupported`, `nul`, `root_not_absolute`, `goes_round` (links), `escapes`
    (outside the root), `not_a_skill_file`.
    """
    c = F.col
    files = F.create_map(*(F.lit(x) for kv in AGENT_FILES.items() for x in kv))
    root = F.when(c("placement") == "global_rule", F.lit(global_root)).when(c("placement").isin(*OF_PROJECT), c("project_root"))
    own = F.when(c("placement") == "skill", F.concat(F.lit("skills/"), slug(c("review_id")), F.lit("/SKILL.md"))).otherwise(F.get(F.array(files[c("agent")]), F.lit(0)))
    asked = F.coalesce(F.nullif(c("target"), F.lit("")), own)
    early = (
        F.when(c("placement") == "ignore", "no_target").when(~F.coalesce(c("agent").isin(*AGENT_FILES), F.lit(False)), "agent_required")
        .when((c("placement") == "global_rule") & F.coalesce(root, F.lit("")).isin(""), "global_root_required").when(c("placement").isin(*OF_PROJECT) & F.coalesce(root, F.lit("")).isin(""), "project_required")
        .when(~F.coalesce(c("placement").isin("global_rule", *OF_PROJECT), F.lit(False)), "unsupported").when(F.contains(asked, F.lit("\0")) | F.contains(root, F.lit("\0")), "nul").when(~F.startswith(root, F.lit("/")), "root_not_absolute")
    )
    one = reviews.select("review_id", "placement", root.alias("root"), asked.alias("asked"), early.alias("early"))
    one = one.withColumn("raw", F.when(c("early").isNull(), joined(c("root"), c("asked")))).withColumn("root_raw", F.when(c("early").isNull(), c("root")))
    one = linked(one, links, "raw").withColumnRenamed("resolved", "path")
    one = linked(one, links, "root_raw").withColumnRenamed("resolved", "home")
    error = (
        F.coalesce("early", F.when(c("path").isNull() | c("home").isNull(), "goes_round").when(~inside(c("path"), c("home"), ignore_case), "escapes")
        .when((c("placement") == "skill") & ~F.endswith("path", F.lit("/SKILL.md")), "not_a_skill_file"))
    )
    kind = F.when(c("placement") == "global_rule", "global").when(c("placement") == "skill", "skill").otherwise("policy")
    one = one.withColumn("error", error)
    good = lambda x: F.when(c("error").isNull(), x)
    return one.select("review_id", good(c("path")).alias("target_path"), good(kind).alias("kind"), good(c("home")).alias("root"), "error")


def payloads(sets: DataFrame, proposals: DataFrame, experiences: DataFrame, evidence: DataFrame, reviews: DataFrame, actions: DataFrame) -> DataFrame:
    """What a reviewer sees of each proposal set, as one nested row: group_key, review, proposal, experience, alternatives, evidence, history.

    sets: group_key. proposals: group_key, placement, rank, score, content. experiences: group_key, title, pattern, lesson.
    evidence: group_key, placement, occurrence_id, role. reviews: review_id, group_key, placement, status, content_override;
    at most one a set. actions: review_id, seq, action. The proposal is the reviewed placement, else the first in rank; its
    effective_content is the reviewer's, if there is one. Lists are put together before they are joined, and are empty
    where there is nothing.
    """
    ordered = lambda *fields: F.array_sort(F.collect_list(F.struct(*fields)))
    lists = proposals.groupBy("group_key").agg(ordered("rank", "placement", "score", "content").alias("alternatives"))
    proofs = evidence.groupBy("group_key", F.col("placement").alias("_p")).agg(ordered("occurrence_id", "role").alias("evidence"))
    past = actions.groupBy("review_id").agg(ordered("seq", "action").alias("history"))
    review = reviews.join(past, "review_id", "left").select("group_key", F.struct("review_id", "placement", "status", "content_override").alias("review"), "history")
    out = sets.select("group_key").distinct().join(lists, "group_key", "left").join(review, "group_key", "left")
    chosen = F.coalesce(F.get(F.filter("alternatives", lambda a: a["placement"] == F.col("review.placement")), F.lit(0)), F.get("alternatives", F.lit(0)))
    out = out.withColumn("c", chosen).withColumn("_p", F.col("c.placement")).join(proofs, ["group_key", "_p"], "left")
    about = experiences.select("group_key", F.struct("title", "pattern", "lesson").alias("experience"))
    effective = F.coalesce("review.content_override", "c.content", F.lit(""))
    none = lambda name: F.coalesce(name, F.array().cast(dict(out.dtypes)[name]))
    return out.join(about, "group_key", "left").select(
        "group_key", "review", F.struct("c.placement", "c.rank", "c.score", "c.content", effective.alias("effective_content")).alias("proposal"), "experience",
        none("alternatives").alias("alternatives"), none("evidence").alias("evidence"), none("history").alias("history"),
    )


def frozen_specs(requests: DataFrame, shown: DataFrame, revisions: DataFrame) -> DataFrame:
    """Specs of evaluations, a row for each of requests (review_id, seq, agent, task, verifiers, commit), with error or the spec's columns.

    shown: payloads(). revisions: review_id, revision, stale. A spec holds what is evaluated as it is now: content, its
    hash, revision and placement. Its id is a digest of the review and the request's number, so a request frozen twice is
    one spec. Errors: `not_reviewed`, `stale`, `not_eligible`, `agent_required`, `no_verifier`, `no_task`, `no_commit`.
    """
    known = shown.where("review is not null").select(F.col("review.review_id").alias("review_id"), F.col("review.status").alias("status"), F.col("proposal.effective_content").alias("content"), F.col("proposal.placement").alias("placement"), "group_key")
    one = requests.join(known, "review_id", "left").join(revisions.select("review_id", "revision", "stale"), "review_id", "left")
    blank = lambda name: F.trim(F.coalesce(name, F.lit(""))) == ""
    error = (
        F.when(F.col("status").isNull() | (F.col("status") == "unreviewed"), "not_reviewed").when(F.coalesce("stale", F.lit(False)), "stale").when(~F.col("status").isin(*EVALUATED), "not_eligible")
        .when(~F.coalesce(F.col("agent").isin(*AGENT_FILES), F.lit(False)), "agent_required").when(F.coalesce(F.size("verifiers"), F.lit(0)) <= 0, "no_verifier").when(blank("task"), "no_task")
        .when(~F.coalesce(F.rlike("commit", F.lit("^[0-9a-f]{40}$")), F.lit(False)), "no_commit")
    )
    one = one.withColumn("error", error)
    good = lambda x: F.when(F.col("error").isNull(), x)
    return one.select(
        "review_id", "seq", "error", good(short_id("EV-", F.col("review_id"), F.col("seq"))).alias("evaluation_id"), good(F.col("group_key")).alias("experience_id"), good(F.coalesce("revision", F.lit(1))).alias("revision"),
        good(F.col("content")).alias("content"), good(F.sha2("content", 256)).alias("content_hash"), good(F.col("placement")).alias("placement"), "agent", "task", "verifiers", "commit",
    )
