"""Corpus pipeline: language ID, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents;
the last adds what the mix takes.  A stage decides on everything that its
predecessor kept.  Rows are told apart by id and text together, so one id may
stand for several texts and null ids for many.

A stage plans dozens of jobs on the driver; what its predecessors' planning and
compiling left in the driver's C allocator is given back before each.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstack.llm import decontaminate, language_id, line_dedup, mixing, near_dup
from loomstack.llm.common import Table, trim_native

#: A document below this is likelier by chance than in any language known.
LEAST_KNOWN = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language the model knows, or in several; null texts and texts without a letter go."""
    model = language_id.train_language_model(docs)
    found = language_id.predict_language(docs, model)
    return found.where((F.col("lang_pred") != language_id.UND) & (F.col("lang_known") >= LEAST_KNOWN)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later copies of runs of lines; documents of which nothing but blanks is left go."""
    out = line_dedup.dedup_lines(docs).where((F.col("n_removed") == 0) | F.col("text").rlike(mixing.WORD_RE))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays, once."""
    found = near_dup.near_duplicates(docs)
    heads = found.where("head").select(F.col("row").alias("__row")).distinct()
    return docs.withColumn("__row", near_dup.row_key()).join(heads.hint("merge"), "__row").dropDuplicates(["__row"]).select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by their weights: the documents taken, with their copies and words."""
    return mixing.mix_sources(docs, mixing.cyclic_weights(docs), keep_text=True).where("copies > 0")


def trimmed(stage):
    """``stage``, begun with a driver that holds no free native memory."""

    @wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        trim_native(spark)
        return stage(spark, docs, sf_dir)

    return begun


STAGES = [(stage.__name__, trimmed(stage)) for stage in (language, lines, near_duplicates, benchmark, mix)]

#: Language ID by a trained model cannot be written as SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            table = Table(docs, f"pipeline-{i}")
            if before is not None:
                before.drop()
            before, docs = table, table.df
    return docs
