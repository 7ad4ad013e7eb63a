"""A text corpus pipeline: stages that each read what the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's documents.  All but the last return the columns of documents; the last adds how often each one is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from thicket.llm.decontamination import decontaminated
from thicket.llm.mixing import mixed
from thicket.llm.resampling import kept_documents
from thicket.llm.secrets import redact_secrets
from thicket.llm.setjoin import jaccard_components
from thicket.storage import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampler rejects go.  Null and empty texts have no n-grams and are scored as such; repeated rows and ids
    are judged row by row; of equal keys at the border all stay or go together; no rows give none."""
    return kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one with the least doc_id stays; rows without an id stay, and so do texts without words.
    Rows of one doc_id are one document here: they stay together, or go if one of them is a copy of a lesser id's."""
    gone = jaccard_components(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none; each repeated row is judged by its text."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked; null texts stay null; every row and column stays."""
    return redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their targets: doc_id, source and size of the documents that the mix takes, and how often.  A null source is one
    of its own; a null text has size 0; documents of equal size, id and source share their fate."""
    return mixed(docs).filter("copies > 0").select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("secrets", secrets), ("mix", mix)]

#: SQL can express neither the resampler nor the set join, the SimHash search, the lexer or the budget fit.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents; each stage's rows are stored in the shared folder (``storage.clear_stored`` removes
    them when the result is no longer needed)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs


