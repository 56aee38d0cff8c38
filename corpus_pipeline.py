"""Corpus pipeline: language, near duplicates, repeated passages, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; run() writes each stage's result as
Parquet in the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.bpe import encode
from quillspan.llm.chunking import substring_dedup
from quillspan.llm.fmindex import decontaminate
from quillspan.llm.langid import identified, of_documents, train
from quillspan.llm.minhash import near_rows
from quillspan.llm.queries import vocab_path
from quillspan.llm.shared import fresh, written


def _narrow(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns as one, so that an operator's columns and docs' own can't clash.

    The text stands once in a row: an operator's Python workers hold whole batches of it.
    """
    return docs.select("doc_id", "text", F.struct(*(c for c in docs.columns if c != "text")).alias("whole"))


def _widened(docs: DataFrame, changed: Column, *more: Column) -> list[Column]:
    """The columns of docs from `whole`, with the operator's text, and its n_chars where `changed`."""
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(F.col("text").cast(docs.schema[c].dataType).alias(c))
            continue
        old = F.col("whole").getField(c)
        out.append((F.when(changed, F.length("text").cast(docs.schema[c].dataType)).otherwise(old) if c == "n_chars" else old).alias(c))
    return [*out, *more]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: null and blank texts, and texts in no language of the labelled ones.

    Rows that agree in doc_id, text, lang and source fare alike; a null doc_id is like any other. All columns are kept.
    """
    mark = F.xxhash64("text", "lang", "source")
    found = identified(of_documents(docs, [F.col("doc_id").alias("id"), mark.alias("mark")]), train(docs))
    # Written first: few rows go, so that the texts need not move for them.
    gone = written(found.where("rejected").select(F.struct("id", "mark").alias("key")).distinct(), "gone")
    key = fresh(docs, "key")
    keyed = docs.withColumn(key, F.struct(F.col("doc_id").alias("id"), mark.alias("mark")))
    return keyed.join(gone, keyed[key] == gone["key"], "left_anti").drop(key)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates: the one of least doc_id, rows without one last.

    Rows are told apart by their place, so repeated rows, rows of one doc_id and rows without one are judged by their
    texts like all others. Blank texts are like nothing and stay. All columns are kept.
    """
    place = fresh(docs, "place")
    base = written(docs.withColumn(place, F.monotonically_increasing_id()), "rows")
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col(place).alias("place"))
    found = near_rows(base.select(key.alias("id"), "text"), "id", "text")
    gone = written(found.where("id <> least").select(F.col("id.place").alias(place)), "gone")
    return base.join(gone, place, "left_anti").drop(place)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out passages that stand in an earlier document; drops documents that were nothing else.

    Null texts stay as they are. Rows that agree in doc_id and text are cut alike, each only against others; rows without
    a doc_id count as earliest. All columns are kept, n_chars follows a text that is cut.
    """
    cut = substring_dedup(_narrow(docs))
    changed = F.col("removed_bytes") > 0
    return cut.where(~changed | F.rlike("text", F.lit(r"\S"))).select(*_widened(docs, changed))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out passages of the benchmark; every row stays, null and empty texts as they are.

    All columns are kept, n_chars follows a text that is cut.
    """
    cut = decontaminate(_narrow(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return cut.select(*_widened(docs, F.col("n_hit") > 0))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts into token_ids and n_tokens; the text that is returned is decoded from the ids, a null one is empty.

    All columns are kept but those named as these two, which are replaced; n_chars stays as it was.
    """
    kept = docs.drop("token_ids", "n_tokens")
    done = encode(_narrow(kept), vocab_path(), decoded_col="text")
    columns = [F.col("text") if c == "text" else F.col("whole").getField(c).alias(c) for c in kept.columns]
    return done.select(*columns, F.size("token_ids").alias("n_tokens"), "token_ids")


STAGES = [("language", language), ("near_dedup", near_dedup), ("passages", passages), ("benchmark", benchmark), ("tokens", tokens)]

#: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
