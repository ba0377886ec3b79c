"""The corpus pipeline: documents in, token shards out.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its rows are written as Parquet
and read again as the next stage's ``docs``. All stages but the last return the columns of
``documents``, and texts reach Python in Arrow batches of at most ``TEXT_ROWS`` rows:

1. language id      rejects texts without a recognisable language
2. near dedup       keeps one document of each group of near copies
3. decontamination  rejects documents that hold a benchmark item
4. mixing           brings the sources to their target weights; a row appears as often as it is taken
5. token output     writes the token shards and returns their digests, one row for each document
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ribospark.llm import decontamination, language_id, mixing, near_dedup, token_output
from ribospark.llm.common import Stored
from ribospark.llm.queries import END_ID, tokenizer_path
from ribospark.plans.runtime import bound_batches


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return language_id.keep_known(docs, language_id.learn_languages(docs, F.lit(True)))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return near_dedup.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return mixing.mixed_documents(docs, F.array(F.col("source").cast("string")), mixing.word_count(F.col("text")))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return token_output.token_output(docs, tokenizer_path(), END_ID)


STAGES = [
    ("language id", language_stage),
    ("near dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token output", token_stage),
]

#: SQL can express neither the language model nor the signatures; a test holds the stages against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a table between two stages lies in the shared folder until the later one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        written = Stored(stage(spark, docs, sf_dir))
        if before:
            before.drop()
        docs, before = written.table, written
    return docs
