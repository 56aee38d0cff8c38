"""Reproducible shuffle and sharding: a Feistel permutation with cycle walking over global row numbers.

Every row gets a global row number (its rank by the sort columns). A keyed Feistel network permutes the numbers of the
next even power of two; results outside the table are permuted again until they fall inside (cycle walking), which makes
a permutation of exactly the table's row numbers. The shuffled position p gives shard p mod n and slot p div n, so shard
and slot follow from the row number alone, and the row number from shard and slot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.llm.shared import fresh, written

ROUNDS = 6
PRIME = (1 << 31) - 1


def round_keys(seed: int) -> list[tuple[int, int, int]]:
    """Multiplier, offset and second multiplier of each round, from a linear congruential sequence."""
    out, x = [], (seed * 2654435761 + 12345) % PRIME
    for _ in range(ROUNDS):
        key = []
        for _ in range(3):
            x = (x * 48271 + 11) % PRIME
            key.append(x | 1)
        out.append((key[0], key[1], key[2]))
    return out


def half_bits(n: int) -> int:
    """Bits of half a block, so that 4**bits >= n."""
    return max(1, ((max(n, 1) - 1).bit_length() + 1) // 2)


def _mixed(x: np.ndarray, key: tuple[int, int, int], mask: int) -> np.ndarray:
    t = (x * key[0] + key[1]) % PRIME
    t = ((t ^ (t >> 13)) * key[2]) % PRIME
    return (t ^ (t >> 9)) & mask


def _network(x: np.ndarray, keys: list[tuple[int, int, int]], bits: int) -> np.ndarray:
    mask = (1 << bits) - 1
    left, right = x >> bits, x & mask
    for key in keys:
        left, right = right, left ^ _mixed(right, key, mask)
    return (left << bits) | right


def _network_back(x: np.ndarray, keys: list[tuple[int, int, int]], bits: int) -> np.ndarray:
    mask = (1 << bits) - 1
    left, right = x >> bits, x & mask
    for key in reversed(keys):
        left, right = right ^ _mixed(left, key, mask), left
    return (left << bits) | right


def permuted(rows: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """The shuffled positions of row numbers below n; with back, the row numbers of shuffled positions."""
    if n > 1 << 62:
        raise ValueError("a table of more than 2**62 rows")
    keys, bits, step = round_keys(seed), half_bits(n), _network_back if back else _network
    out = step(np.asarray(rows, np.int64), keys, bits)
    while (outside := out >= n).any():
        out[outside] = step(out[outside], keys, bits)
    return out


def position_of(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    """The global row number that stands at a slot of a shard."""
    return int(permuted(np.array([slot * shards + shard]), n, seed, back=True)[0])


def with_row_numbers(df: DataFrame, order: list[Column], number_col: str = "row_number") -> tuple[DataFrame, int]:
    """df with global row numbers 0..n-1 in the given order, and n.

    Rows are dealt into key ranges, sorted and numbered inside each, and written once, so that a lost executor can't
    change a number; each range then starts after the rows of those before it. Only a count for each range reaches the
    driver. Rows equal in all `order` columns must be alike, or their numbers may be exchanged.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    in_range = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The caller's columns stand apart from the three that are added.
    dealt = written(dealt.select(F.struct(*df.columns).alias("row"), F.spark_partition_id().alias("range"), in_range.alias("nth")), "numbered")
    counts = sorted((r["range"], r["count"]) for r in dealt.groupBy("range").count().collect())
    starts, total = [], 0
    for part, count in counts:
        starts.append((part, total))
        total += count
    offsets = spark.createDataFrame(starts, "range int, start long")  # a row for each range: bounded by the partitions
    numbered = dealt.join(F.broadcast(offsets), "range")
    columns = [F.col("row").getField(c).alias(c) for c in df.columns if c != number_col]
    return numbered.select(*columns, (F.col("start") + F.col("nth")).alias(number_col)), total


def shuffled_shards(df: DataFrame, shards: int, order: list[Column], seed: int = 17) -> DataFrame:
    """df with row_number, shard and slot: a reproducible shuffle dealt into `shards` shards of sizes at most one apart.

    The result depends on the rows and the seed only, not on partitions or files. Any column may be null and rows may
    repeat; an empty table stays empty. Columns named row_number, shard or slot are replaced, all others are kept.
    """
    base = df.drop("row_number", "shard", "slot")
    numbered, total = with_row_numbers(base, order)

    @F.pandas_udf(T.LongType())
    def position(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series(permuted(rows.to_numpy(), total, seed))

    at = fresh(numbered, "position")
    placed = numbered.withColumn(at, position("row_number"))
    return placed.withColumns({"shard": F.pmod(at, F.lit(shards)).cast("int"), "slot": ((F.col(at) - F.pmod(at, F.lit(shards))) / shards).cast("long")}).drop(at)


def shard_report(docs: DataFrame, shards: int = 16, seed: int = 17) -> DataFrame:
    """Shard and slot of each row of documents (doc_id, text), by the law `rows`.

    Rows are ordered by doc_id, size and CRC of the text, so rows that agree in those exchange nothing that shows.
    Null texts have size 1 and the CRC of no bytes, 0. Returns doc_id, size, text_crc32, law, row_number, shard, slot
    and grown_shard, which only the law `key` has.
    """
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    base = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    placed = shuffled_shards(base, shards, [F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("text_crc32")], seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "row_number", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
