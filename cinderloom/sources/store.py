"""Tables that are written anew as a whole: versions side by side, of which the last complete one counts; and single JSON objects.

A version is a folder; it is complete when its writer has left the mark that Spark's committer leaves. Readers that began with an
older version can go on, since a version is removed only when ``keep`` newer ones are there.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import formatted, percent
from ..operators.evaluate import merge_cache, needed, run_phase


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


class VersionedTable:
    """A table in numbered versions under a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keep: int = 2):
        self.spark, self.path, self.schema, self.keep = spark, path.rstrip("/"), schema, keep

    def versions(self, complete: bool = True) -> list[int]:
        fs, at = _folder(self.spark, self.path)
        if not fs.exists(at):
            return []
        found = [(int(m[1]), s.getPath()) for s in fs.listStatus(at) if (m := re.fullmatch(r"version=(\d+)", s.getPath().getName()))]
        done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return sorted(n for n, p in found if not complete or fs.exists(done(p, "_SUCCESS")))

    def load(self) -> DataFrame:
        """The last complete version; no rows before the first."""
        there = self.versions()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/version={there[-1]}") if there else self.spark.createDataFrame([], self.schema)

    def save(self, df: DataFrame) -> DataFrame:
        """Writes a new version, also from a frame that reads the last one, and removes old ones."""
        number = max(self.versions(complete=False), default=0) + 1
        df.select(*self.schema.names).write.option("compression", "zstd").parquet(f"{self.path}/version={number}")
        for old in [n for n in self.versions(complete=False) if n <= number - self.keep]:
            fs, at = _folder(self.spark, f"{self.path}/version={old}")
            fs.delete(at, True)
        return self.load()


class PhaseStore:
    """A run's records, filled in field by field; what is there is not made again, in this session or a later one."""

    def __init__(self, table: VersionedTable):
        self.table = table

    def seed(self, val: DataFrame) -> DataFrame:
        """The validation rows with what the store knows of them, saved."""
        fields = tuple(c for c in self.table.schema.names if c not in ("description", "reference", "ordinal"))
        return self.table.save(merge_cache(val, self.table.load(), fields))

    def run(self, field: str, produce: Callable[[DataFrame], DataFrame], gate: str | None = None) -> DataFrame:
        """Fills a field and saves; where nothing is needed nothing is made or written."""
        cache = self.table.load()
        if needed(cache, field, gate).isEmpty():
            return cache
        return self.table.save(run_phase(cache, field, produce, gate))


def write_object(df: DataFrame, path: str) -> None:
    """The one row of a frame as a JSON object, nulls included."""
    df.limit(1).coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def printed(m: DataFrame, title: Column | str = "run") -> DataFrame:
    """(line_no, line): a row of metrics as text."""
    title = F.lit(title) if isinstance(title, str) else title
    side = lambda v: F.concat(F.lit(f"  [{v}] render-pass "), percent(F.col(f"{v}.render_rate")), F.lit("  match-of-rendered "), percent(F.col(f"{v}.match_of_rendered")), F.lit("  knockout "), percent(F.col(f"{v}.knockout_rate")))
    lines = [
        F.concat(F.lit("=== "), title, F.lit(" (n="), F.col("n").cast("string"), F.lit(") ===")),
        F.concat(F.lit("  perplexity "), formatted("%.3f", F.col("perplexity"))),
        F.concat(F.lit("  format-valid rate "), percent(F.col("format_valid_rate"))),
        side("raw"),
        side("extracted"),
    ]
    return m.select(F.posexplode(F.array(*lines)).alias("line_no", "line"))
