"""Connected components by alternating large-star and small-star steps, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.shared import dropped, joined_spread, written


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.bit_xor(F.xxhash64("v", "u")).alias("y")).first()
    return tuple(row)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node with an edge; component is the smallest node reached.

    Self-loops, nulls, repeated and reversed edges are allowed; null ends and self-loops link nothing. No edges give an
    empty table. A node's smallest neighbour is found by a partial aggregation and joined back, hubs by a broadcast of
    bounded size, so no neighbour list is ever held in a task. Each step is written to the shared folder; two numbers an iteration reach the driver.
    """
    clean = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    current = written(clean, "star")
    mark = _mark(current)
    while mark[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = joined_spread(both, least, ["u"], 2 * mark[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        # An edge to the smallest neighbour stays, all others go on to it; edges made twice by the large star end here.
        small = joined_spread(large, least, ["u"], 2 * mark[0]).select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
        following = written(small.distinct(), "small-star")
        dropped(large)
        dropped(current)
        current, before, mark = following, mark, _mark(following)
        if mark == before:
            break
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
