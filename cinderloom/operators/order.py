"""Operators in which the order of rows counts: batches, heads, tails, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered(df: DataFrame, ordinal: str = "ordinal", name: str = "position", ties: list[Column | str] | None = None) -> DataFrame:
    """Positions from 0 in the order of the ordinals, without one task for all rows.

    Rows are dealt out by ranges of the ordinal, sorted and numbered within the parts, and counted per part; only the parts'
    counts meet in one place. Rows are shuffled once.
    """
    # equal ordinals stand by their other columns, so that positions don't depend on the layout
    ties = [F.xxhash64(*(c for c, kind in df.dtypes if "map<" not in kind))] if ties is None else ties
    # the number's upper bits are the part, the lower 33 the place in it
    parts = df.repartitionByRange(ordinal).sortWithinPartitions(ordinal, *ties).withColumn("__row", F.monotonically_increasing_id()).checkpoint(eager=True)
    part = F.shiftright("__row", 33)
    counts = parts.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # a row a part
    rows = parts.join(F.broadcast(before), part == F.col("__part"))
    return rows.withColumn(name, F.col("__row").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__before")).drop("__part", "__before", "__row")


def batches(df: DataFrame, size: int, ordinal: str = "ordinal", ties: list[Column | str] | None = None) -> DataFrame:
    """With ``batch_id`` from 0 and ``idx`` from 1, in order."""
    rows = numbered(df, ordinal, "__at", ties)
    return rows.select(*df.columns, F.floor(F.col("__at") / size).alias("batch_id"), (F.col("__at") % size + 1).cast("int").alias("idx"))


def head(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def tail(df: DataFrame, n: int, ordinal: str = "ordinal") -> DataFrame:
    """The last n, in order."""
    return df.orderBy(F.col(ordinal).desc()).limit(n).orderBy(ordinal)


def drawn(key: Column | str, seed: int) -> Column:
    """What rows are drawn by: a hash of seed and key that other engines share."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string") if isinstance(key, str) else key.cast("string")))


def sample_per_stratum(df: DataFrame, stratum: str, sizes: dict[str, int], key: str, seed: int = 42) -> DataFrame:
    """Up to so many rows of each stratum, by the hash of seed and key; strata in the given order.

    Each stratum is cut by a top-k of its own, so no task gathers a whole one.
    """
    out = None
    for rank, (name, n) in enumerate(sizes.items()):
        part = df.where(F.col(stratum) == name).orderBy(drawn(key, seed), key).limit(n).withColumn("stratum_rank", F.lit(rank))
        out = part if out is None else out.union(part)
    return out


def sample(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    return df.orderBy(drawn(key, seed), key).limit(n)
