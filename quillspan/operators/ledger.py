"""Append-only ledgers: the state of a review or policy is its latest event; uploads and merges are joins of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillspan.tables import snapshot

# What each action makes of a review.
REVIEW_STATUS = {"accept": "accepted", "reject": "rejected", "defer": "deferred", "test_first": "test_first", "edit": "unreviewed", "choose": "unreviewed", "apply": "applied"}


def review_states(actions: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """State of each review after its actions (review_id, seq, action, fingerprint, content): status, revision, content, stale.

    An action on an outdated fingerprint makes the review stale and changes nothing else. fingerprints has the current one.
    """
    now = actions.join(fingerprints.select("review_id", F.col("fingerprint").alias("current")), "review_id", "left")
    ok = F.coalesce(F.col("fingerprint") == F.col("current"), F.lit(False))
    status = F.create_map(*[F.lit(x) for kv in REVIEW_STATUS.items() for x in kv])
    last = lambda value, when: F.max_by(F.when(when, value), F.when(when, F.col("seq")))
    return now.groupBy("review_id").agg(
        F.coalesce(last(F.get(F.array(status[F.col("action")]), F.lit(0)), ok), F.lit("unreviewed")).alias("status"),
        (1 + F.count_if(ok & F.col("action").isin("edit", "choose"))).alias("revision"),
        last(F.when(F.col("action") == "edit", F.col("content")), ok & F.col("action").isin("edit", "choose")).alias("content"),
        (~F.max_by(ok, "seq")).alias("stale"),
    )


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    w = W.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], keep_old_if_null: tuple[str, ...] = ()) -> DataFrame:
    """old with new's rows in place of those with the same key; named columns keep the old value where the new one is null."""
    patch = new
    if keep_old_if_null:
        before = old.select(*keys, *[F.col(c).alias(f"_{c}") for c in keep_old_if_null])
        patch = new.join(before, keys, "left").withColumns({c: F.coalesce(c, f"_{c}") for c in keep_old_if_null}).select(*new.columns)
    return old.join(new.select(*keys), keys, "left_anti").select(*new.columns).unionByName(patch)


def changed_sources(found: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """found with outcome: new, changed, or already (same content_hash)."""
    k = known.select(*keys, F.col("content_hash").alias("_h"), F.lit(True).alias("_k"))
    outcome = F.when(F.col("_k").isNull(), "new").when(F.col("_h").eqNullSafe(F.col("content_hash")), "already").otherwise("changed")
    return found.join(k, keys, "left").withColumn("outcome", outcome).drop("_h", "_k")


def next_numbers(new: DataFrame, taken: int, order: list[Column], number_col: str = "seq") -> DataFrame:
    """new rows numbered behind the highest number taken, in a total order.

    Rows are dealt out by ranges of the order and written once in it; a row's number is its place in its range behind the
    rows of the ranges before, of which there are as many as shuffle partitions. So no task sees more than a range.
    """
    dealt = new.repartitionByRange(*order).sortWithinPartitions(*order)
    # The id counts rows in a partition and has the partition's number above them.
    placed = snapshot(dealt.withColumn("_at", F.monotonically_increasing_id()), "numbered").withColumn("_range", F.shiftright("_at", 33))
    ranges = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(ranges.select("_range", before.alias("_before")))  # a row a partition
    number = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1 + taken
    return placed.join(starts, "_range").withColumn(number_col, number.cast("int")).select(*new.columns, number_col)


def violations(df: DataFrame, keys: list[str], checks: dict[str, Column]) -> DataFrame:
    """Rows of (rule, n) for keys that repeat and checks that fail; an empty result lets a snapshot be published."""
    repeated = df.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("unique: " + ", ".join(keys)).alias("rule"), "n")
    out = repeated
    for name, check in checks.items():
        out = out.unionByName(df.agg(F.count_if(~F.coalesce(check, F.lit(False))).alias("n")).select(F.lit(name).alias("rule"), "n"))
    return out.where("n > 0")


def projects_after(projects: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """projects (project_id, name, root, git_remote, created_at, last_seen_at, status) after found (project_id, name, root, git_remote) was registered.

    A found project is the known one of its id, else the one of its root; that gets the new name, keeps its id, root and
    creation, keeps its remote where the new one is null, and stays archived if it is. Others are new and active. Of
    several rows for one known project the one of its id counts, else the least id; of several rows of one new id the first in root order.
    """
    know = projects.select(F.col("project_id").alias("_id"), F.col("root").alias("_root"))
    by_id = found.join(know, found["project_id"] == know["_id"]).select(*found.columns, "_id", F.lit(0).alias("_way"))
    by_root = found.join(know.select("_id"), found["project_id"] == F.col("_id"), "left_anti").join(know, F.col("root") == F.col("_root")).select(*found.columns, "_id", F.lit(1).alias("_way"))
    met = by_id.unionByName(by_root)
    best = met.groupBy("_id").agg(F.min_by(F.struct("name", "git_remote"), F.struct("_way", "project_id", "root", "name")).alias("_x"))
    old = projects.join(best, projects["project_id"] == best["_id"], "left")
    hit = F.col("_id").isNotNull()
    old = old.select(
        "project_id", F.when(hit, F.col("_x.name")).otherwise(F.col("name")).alias("name"), "root", F.coalesce("_x.git_remote", "git_remote").alias("git_remote"), "created_at",
        F.when(hit, now).otherwise(F.col("last_seen_at")).alias("last_seen_at"), F.when(hit & (F.col("status") != "archived"), "active").otherwise(F.col("status")).alias("status"),
    )
    fresh = found.join(met.select("project_id").distinct(), "project_id", "left_anti").groupBy("project_id").agg(F.min(F.struct("root", "name", "git_remote")).alias("_x"))
    fresh = fresh.select("project_id", "_x.name", "_x.root", "_x.git_remote", now.alias("created_at"), now.alias("last_seen_at"), F.lit("active").alias("status"))
    return old.unionByName(fresh)


SESSION_KEYS = ["agent", "session_id", "path"]


def sessions_after(known: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """The ledger of source files after a pass: known rows of other keys, and found's in place of or beside them.

    found has SESSION_KEYS, whatever a pass learns of a file, and imported; the ledger has the same without imported, and
    first_seen_at, which stays, and last_imported_at, which only an import changes.
    """
    facts = [c for c in found.columns if c not in (*SESSION_KEYS, "imported")]
    before = known.select(*SESSION_KEYS, F.col("first_seen_at").alias("_f"), F.col("last_imported_at").alias("_l"))
    new = found.join(before, SESSION_KEYS, "left").select(
        *SESSION_KEYS, *facts, F.coalesce("_f", now).alias("first_seen_at"), F.when(F.coalesce("imported", F.lit(False)), now).otherwise(F.col("_l")).alias("last_imported_at")
    )
    return known.join(found.select(*SESSION_KEYS), SESSION_KEYS, "left_anti").select(*new.columns).unionByName(new)
