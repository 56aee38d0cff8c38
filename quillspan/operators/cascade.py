"""Deletes along declared references between tables, and merges with a stated rule of which row stays.

A set of deleted keys is carried from parents to children in the order of the references, by semi-joins on keys; what is
kept is an anti-join. Nothing is changed in place: the tables that result are put into a version as one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillspan.tables import snapshot
from quillspan.versions import Pass


@dataclass(frozen=True)
class Reference:
    """child rows name parent rows by `keys` (child column -> parent column); they go with them, or forget them."""

    child: str
    parent: str
    keys: Mapping[str, str]
    forget: bool = False

    def __post_init__(self):
        if not self.keys:
            raise ValueError("a reference needs keys")


def in_order(references: Sequence[Reference]) -> list[str]:
    """All tables of the references, parents before children; ValueError where they go round in a circle."""
    left = {t for r in references for t in (r.child, r.parent)}
    out: list[str] = []
    while left:
        free = sorted(t for t in left if not any(r.child == t and r.parent in left for r in references))
        if not free:
            raise ValueError(f"references go round: {sorted(left)}")
        out += free
        left -= set(free)
    return out


def deleted(tables: Mapping[str, DataFrame], references: Sequence[Reference], doomed: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables that change when rows go: those of `doomed` (table -> rows of some of its columns, by which it is matched),
    and all that name a row that goes. Tables that no deletion can reach are not in the result. Null keys name nothing.

    A row that goes takes with it all rows that name its keys, also where another row holds the same keys.
    """
    gone: dict[str, dict[tuple[str, ...], DataFrame]] = {}
    out: dict[str, DataFrame] = {}
    for name in in_order([*references, *(Reference(t, t + " ", {"": ""}) for t in doomed)]):
        if name not in tables:
            continue
        # What matches rows of this table: (its columns, a table of their values).
        hits = [doomed[name].distinct()] if name in doomed else []
        own = [r for r in references if r.child == name and r.parent in gone]
        for r in own:
            if not r.forget:
                hits.append(gone[r.parent][tuple(r.keys.values())].toDF(*r.keys))
        df = tables[name]
        for r in own:
            if r.forget:
                mark = gone[r.parent][tuple(r.keys.values())].toDF(*r.keys).withColumn("_gone", F.lit(True))
                df = df.join(mark, list(r.keys), "left").select(*(F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c in r.keys else c for c in tables[name].columns))
        if hits:
            needed = {tuple(r.keys.values()) for r in references if r.parent == name}
            lost = [tables[name].join(h, h.columns, "left_semi") for h in hits]
            gone[name] = {k: snapshot(reduce(DataFrame.unionByName, (x.select(*k) for x in lost)).dropna().distinct(), "gone") for k in needed}
            df = reduce(lambda d, h: d.join(h, h.columns, "left_anti"), hits, df)
        if own or hits:
            out[name] = df.select(*tables[name].columns)
    return out


def _first(new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def added_or_ignored(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """old, and of each key that it hasn't the first row of new in the given order: keep first."""
    return old.unionByName(_first(new, keys, order).join(old.select(*keys).distinct(), list(keys), "left_anti").select(*old.columns))


def added_or_replaced(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Of each key in new its last row in the given order, and the rows of old with other keys: keep last."""
    last = _first(new, keys, [c.desc_nulls_last() for c in order])
    return old.join(last.select(*keys), list(keys), "left_anti").select(*old.columns).unionByName(last.select(*old.columns))


#: What rests on what in the store of experiences.
STORE = (
    Reference("proposals", "proposal_sets", {"group_key": "group_key"}),
    Reference("proposal_evidence", "proposals", {"group_key": "group_key", "placement": "placement"}),
)
EXCLUDED = ("false_positive", "needs_more_evidence")
REBUILT = ("evidence", "occurrences", "extraction_state")


def triaged(store: Pass, marks: DataFrame) -> None:
    """Puts people's marks (group_key, review_status, note; one a group) on the base version's experiences.

    A mark of EXCLUDED takes the group's proposal set, its proposals and their links with it; the evidence stays. Marks of
    unknown groups do nothing.
    """
    base = store.base
    new = marks.select("group_key", F.col("review_status").alias("_s"), F.col("note").alias("_t"), F.lit(True).alias("_k"))
    met = base["experiences"].join(new, "group_key", "left")
    columns = [c for c in base["experiences"].columns if c not in ("review_status", "review_note")]
    note = F.col("review_note") if "review_note" in base["experiences"].columns else F.lit(None).cast("string")
    store.put("experiences", met.select(*columns, F.when(F.col("_k"), F.col("_s")).otherwise(F.col("review_status")).alias("review_status"), F.when(F.col("_k"), F.col("_t")).otherwise(note).alias("review_note")))
    if "proposal_sets" in base.tables:
        out = marks.where(F.col("review_status").isin(*EXCLUDED)).select("group_key")
        for name, df in deleted({n: base[n] for n in ("proposal_sets", "proposals", "proposal_evidence")}, STORE, {"proposal_sets": out}).items():
            store.put(name, df)


def cleared_for_rebuild(store: Pass) -> None:
    """Empties what a rebuild makes anew, of those tables that there are; experiences stay, and with them people's marks."""
    store.clear(*(t for t in REBUILT if t in store.base.tables))
