"""The corpus pipeline: documents through five stages, each of which works on all that the one before it kept.

All stages but the last return the columns of their input. ``run`` applies them to the documents of a
folder; the driver writes each stage's result as Parquet and reads it again as the next one's input.
SQL cannot express the template tree, the sketches and the packing, so there is no SQL for the whole; it is tested against plain loops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cinderloom.llm import line_templates, near_duplicates, packing, personal_data, quality_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects, without the lines that are too frequent on their hosts."""
    return quality_rules.keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of recurring templates."""
    return line_templates.drop_lines(docs)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_duplicates.drop_copies(docs)


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return personal_data.redact(personal_data.find(docs, out="__pii"), spans_col="__pii").select(*docs.columns)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in windows of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near duplicates", copies), ("personal data", privacy), ("packing", windows)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
