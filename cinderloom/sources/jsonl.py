"""Readers and writers of JSON lines, with the order of lines kept as ``ordinal``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..operators.order import numbered


def parse_lines(lines: DataFrame, schema: T.StructType, source: str | None = None, line_col: str = "value", strict: bool = True) -> DataFrame:
    """The records of a column of lines; blank lines are skipped. Other columns are kept.

    A broken line raises with ``strict``, else it gives a record of nulls. ``source`` overrides the records' own.
    """
    mode = {"mode": "FAILFAST" if strict else "PERMISSIVE"}
    rows = lines.where(F.trim(F.col(line_col)) != "").withColumn("__record", F.from_json(F.col(line_col), schema, mode))
    rows = rows.select(*(c for c in lines.columns if c != line_col and c not in schema.names), "__record.*")
    return rows if source is None else rows.withColumn("source", F.lit(source))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, source: str | None = None, ordered: bool = True, strict: bool = True) -> DataFrame:
    """The records of a file or folder, none where it is missing. ``ordinal``: file, then line, from 0 without gaps.

    The reader may split large files; a line's place is its file, its split's place in it and its number there, and places
    are numbered by ranges, as ``operators.order`` does.
    """
    empty = T.StructType([*schema, *([T.StructField("source", T.StringType())] if source is not None and "source" not in schema.names else []), *([T.StructField("ordinal", T.LongType())] if ordered else [])])
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], empty)
    if ordered:
        place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("line"))
        lines = numbered(lines.select("value", place.alias("__place")).where(F.trim("value") != ""), "__place", "ordinal").drop("__place")
    return parse_lines(lines, schema, source, strict=strict).select(*empty.names)


def read_object(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One JSON object over several lines."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def last_wins(df: DataFrame, key: str, ordinal: str = "ordinal") -> DataFrame:
    """The last record of each key, in the place of its first."""
    fields = [c for c in df.columns if c not in (key, ordinal)]
    kept = df.groupBy(key).agg(F.max_by(F.struct(*fields), ordinal).alias("__last"), F.min(ordinal).alias(ordinal))
    return kept.select(key, "__last.*", ordinal)


def as_lines(df: DataFrame, ordinal: str | None = None) -> Column:
    """Each row as a line; null fields are left out."""
    return F.to_json(F.struct(*(c for c in df.columns if c != ordinal)))


def write_jsonl(df: DataFrame, path: str, ordinal: str | None = None, mode: str = "overwrite", single: bool = False) -> None:
    """Lines by ordinal: sorted parts, whose names are in order; ``single`` asks for one file."""
    out = df
    if ordinal:
        out = df.coalesce(1).sortWithinPartitions(ordinal) if single else df.repartitionByRange(ordinal).sortWithinPartitions(ordinal)
        out = out.drop(ordinal)
    out.write.mode(mode).json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Rows of differing fields; a row's nulls are not written."""
    df.write.mode("append").option("ignoreNullFields", True).json(path)
