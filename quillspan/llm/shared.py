"""Where operators keep written tables, and small helpers that all of them use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a temporary one of a local session."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = jvm_dir.get() if jvm_dir.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quillspan-"))
        path = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return path.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's folder of written tables in the shared one."""
    return f"{shared_dir(spark)}/quillspan-{spark.sparkContext.applicationId}"


def cleared(spark: SparkSession) -> None:
    """Deletes all tables that this application's operators have written; their results can't be read any more."""
    _delete(spark, own_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df written once to the shared folder and read again: later plans start from the files, whoever is lost."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


SPREAD = 4096


def joined_spread(rows: DataFrame, table: DataFrame, keys: list[str], total: int, how: str = "inner") -> DataFrame:
    """rows joined with table, which has each key once and `n`, the number of its rows; how is inner or left.

    Keys with more than total/SPREAD rows, of which there are fewer than SPREAD, are broadcast, so that their rows stay
    where they are; all others are shuffled, and none of them fills a task. n isn't in the result.
    """
    often = F.col("n") * SPREAD > total
    values = [c for c in table.columns if c not in (*keys, "n")]
    packed = F.struct(*values).alias("_hot")
    hot = table.where(often).select(*keys, packed)
    # A row without keys meets nothing; with it the plan is of one form for all tables.
    blank = table.sparkSession.range(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in hot.schema.fields))
    # Both branches ask for the same columns of the same left join, so that its table is aggregated and broadcast once.
    met = rows.join(F.broadcast(hot.unionByName(blank)), keys, "left")
    there = met.where("_hot is not null").select(*rows.columns, *(F.col("_hot").getField(c).alias(c) for c in values))
    rare = met.where("_hot is null").drop("_hot").join(table.where(~often).drop("n"), keys, how)
    return there.unionByName(rare)


SIEVE_WORDS = 1 << 18


def sieved(rows: DataFrame, keys: list[str], table: DataFrame) -> DataFrame:
    """rows without most of those whose keys aren't in table; all whose keys are in it stay.

    The keys' hashes are broadcast as a bitmap of at most SIEVE_WORDS words of 64 bits. What it lets through by chance, a
    join behind it drops; so that join moves few rows that it doesn't need.
    """
    at = F.pmod(F.xxhash64(*keys), F.lit(64 * SIEVE_WORDS))
    word, bit = F.shiftright(at, 6).alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    words = table.groupBy(word).agg(F.bit_or(bit).alias("_bits"))
    met = rows.select(*rows.columns, word, bit.alias("_bit")).join(F.broadcast(words), "_word")
    return met.where(F.col("_bits").bitwiseAND(F.col("_bit")) != 0).select(*rows.columns)


def dropped(df: DataFrame | None) -> None:
    """Deletes the files of a table that written() made and that no plan needs any more."""
    path = getattr(df, "_written_path", None)
    if path:
        _delete(df.sparkSession, path)


def fresh(df: DataFrame, name: str) -> str:
    """name, or a longer one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def extended(df: DataFrame, ddl: str) -> T.StructType:
    """df's schema with further columns."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])


def thinned(group: str, counts: dict, rows: int, hash_col: str) -> Column:
    """A filter that lets about twice `rows` rows of each counted group through, those of low hash, and no others.

    A sample by least hash that is taken behind it moves a bounded number of rows whatever the number of partitions.
    """
    at = F.pmod(hash_col, F.lit(1 << 31))
    out = F.lit(False)
    for value, n in counts.items():
        out = F.when(F.col(group) == F.lit(value), at < int(min(1.0, (2 * rows + 50) / max(n, 1)) * (1 << 31))).otherwise(out)
    return out
