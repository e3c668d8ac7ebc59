"""From documents to a training mix: five stages, each on what the one before it kept.

Quality rules reject documents; line dedup deletes later copies of lines, and documents of which nothing is left; of near
duplicates one document stays; documents that hold a benchmark item go; sources are mixed to their weights, where a
document may be taken more than once (`copy_no`) or not at all. `n_chars` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantry.llm import decontaminate, line_runs, mixing, ngram_join, quality_rules
from merchantry.session import new_folder
from merchantry.sources.tables import table

#: Stages learn thresholds from labels and follow links, which SQL cannot express; tests compare with brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = line_runs.delete_runs(docs)
    n_lines, n_deleted = cut.columns[-2:]
    left = (F.col(n_deleted) == 0) | F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]"))
    kept = cut.where(left).drop(n_lines, n_deleted)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else kept


def join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_join", join_stage),
    ("decontamination", benchmark_stage),
    ("mixing", mix_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            folder = new_folder(spark, f"pipeline-{name}")
            docs.write.parquet(folder)
            docs = spark.read.parquet(folder)
    return docs
