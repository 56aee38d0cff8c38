"""Digests of rows and of sets of rows that don't depend on an engine's way to print numbers, or on order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL, BETWEEN, INSIDE = "\x00", "\x1f", "\x1d"


def _said(df: DataFrame, name: str) -> Column:
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        # Nine decimals where they fit; what is no such number keeps its own text.
        c = F.coalesce(c.try_cast("decimal(38,9)").cast("string"), c.cast("string"))
    elif isinstance(kind, T.ArrayType):
        c = F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit(NULL))), INSIDE)
    elif isinstance(kind, T.TimestampType):
        c = F.unix_micros(c).cast("string")
    elif isinstance(kind, (T.StructType, T.MapType)):
        raise TypeError(f"{name}: name the fields of a struct or map instead")
    return F.coalesce(c.cast("string"), F.lit(NULL))


def row_digest(df: DataFrame, names: Sequence[str]) -> Column:
    """SHA-256 of the named columns, in the order of their names; null differs from empty."""
    return F.sha2(F.concat_ws(BETWEEN, *(part for n in sorted(names) for part in (F.lit(n), _said(df, n)))), 256)


def set_digest(digest: str) -> Column:
    """An aggregate: one SHA-256 of any number of hex digests, whatever their order, repeats counted.

    It adds up four parts of each digest and keeps only the sums, so a group of any size takes the same memory.
    """
    part = lambda k: F.sum(F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("decimal(28,0)")).cast("string")
    return F.sha2(F.concat_ws("|", F.count("*").cast("string"), *(part(k) for k in range(4))), 256)
