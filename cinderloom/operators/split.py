"""Stratification labels and the multilabel split into training and validation rows."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.chat import turn
from ..functions.text import bin_index
from ..schemas import BUCKETS
from .order import drawn

SKEW = 0.12


def quantile_edges(df: DataFrame, col: str, bins: int = 4) -> list[float]:
    """The distinct inner cut points of exact quantiles with linear interpolation; none for no rows."""
    shares = [i / bins for i in range(1, bins)]
    found = df.agg(F.percentile(col, F.array(*map(F.lit, shares))).alias("e")).first()["e"]
    return sorted(set(found or []))


def labels(buckets: Column, source: Column, prompt_len: Column, code_len: Column, prompt_edges: Column, code_edges: Column) -> Column:
    """array<string> of the row's labels, distinct."""
    named = F.transform(buckets, lambda b: F.concat(F.lit("bucket:"), b))
    own = F.when(F.size(buckets) > 0, named).otherwise(F.array(F.lit("bucket:none")))
    text = lambda head, x: F.concat(F.lit(head + ":"), x.cast("string"))
    return F.array_distinct(F.concat(own, F.array(text("source", source), text("plen", bin_index(prompt_len, prompt_edges)), text("clen", bin_index(code_len, code_edges)), text("complexity", F.least(F.size(buckets), F.lit(5))))))


def labelled(df: DataFrame, bins: int = 4) -> DataFrame:
    """Chat rows (messages, buckets, source) with ``labels``."""
    lengths = df.withColumns({"__p": F.length(turn(F.col("messages"), 0)), "__c": F.length(turn(F.col("messages"), 1))})
    edges = lambda c: F.array(*map(F.lit, quantile_edges(lengths, c, bins))).cast("array<double>")
    made = labels(F.coalesce("buckets", F.array().cast("array<string>")), F.col("source"), F.col("__p"), F.col("__c"), edges("__p"), edges("__c"))
    return lengths.withColumn("labels", made).drop("__p", "__c")


def label_totals(df: DataFrame) -> DataFrame:
    return df.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def to_val(n: int, val: float, val_all: float, train: float, train_all: float) -> int:
    """How many of n alike rows go to validation if each goes to the side that wants more of the label, then more rows, then to training.

    The lead of one side shrinks by one a row until the sides are level; from there on they take turns.
    """
    lead, lead_all = val - train, val_all - train_all
    first = min(n, max(0, math.ceil(abs(lead)) - 1))  # rows that go to the leading side whatever the others do
    k = first if lead > 0 else 0
    lead -= first if lead > 0 else -first
    lead_all -= first if k else -first
    rest, step = n - first, 0
    while rest and step < 8:  # near level: some single steps
        side = (lead, lead_all) > (0, 0)
        k, rest, step = k + side, rest - 1, step + 1
        lead, lead_all = lead - (1 if side else -1), lead_all - (1 if side else -1)
    if rest:  # level: every two steps come back to the same leads
        side = (lead, lead_all) > (0, 0)
        after = (lead - (1 if side else -1), lead_all - (1 if side else -1)) > (0, 0)
        if side == after:  # pragma: no cover - the lead changes sign at every step here
            raise AssertionError("the sides do not take turns")
        k += rest // 2 + (rest % 2 and side)
    return k


def quotas(signatures: list[tuple[tuple[str, ...], int]], val_share: float) -> dict[tuple[str, ...], int]:
    """How many rows of each set of labels go to validation, by greedy iterative stratification.

    Of the labels with rows left the rarest comes next (the first in name of equals); its rows go, one after another, to
    the side that wants more of the label, then more rows at all, then to training. Rows with equal label sets are
    alike, so sets are counted instead of rows: the work on the driver grows with the sets, not the rows.
    """
    left, out = dict(signatures), Counter()
    shares = {"val": val_share, "train": 1 - val_share}
    totals = Counter()
    for s, n in signatures:
        for x in s:
            totals[x] += n
    wants = {side: {x: share * n for x, n in totals.items()} for side, share in shares.items()}
    wanted = {side: share * sum(left.values()) for side, share in shares.items()}
    by_label: dict[str, set] = {}
    for s in left:
        for x in s:
            by_label.setdefault(x, set()).add(s)
    remaining = Counter(totals)
    while any(left.values()):
        open_ = [(n, x) for x, n in remaining.items() if n > 0]
        if not open_:  # only rows without labels
            for s, n in left.items():
                out[s] += round(n * val_share)
            break
        _, label = min(open_)
        for s in sorted(by_label[label]):
            if n := left[s]:
                k = to_val(n, wants["val"][label], wanted["val"], wants["train"][label], wanted["train"])
                out[s] += k
                for side, m in (("val", k), ("train", n - k)):
                    wanted[side] -= m
                    for x in s:
                        wants[side][x] -= m
                for x in s:
                    remaining[x] -= n
                left[s] = 0
    return out


def ranked(df: DataFrame, by: str, order: Column, name: str) -> DataFrame:
    """With the place, from 1, of each row within its group ``by``, in the order of a hash, where a group may have very many rows.

    Rows are dealt out by group and range of the hash, ranges are counted, and places are counted within a range: a
    group of ``n`` rows is in as many tasks as its ranges. The ranges are the hash's first hexadecimal digits.
    """
    rows = df.withColumn("__order", order).withColumn("__range", F.substring("__order", 1, 3))
    counts = rows.groupBy(by, "__range").agg(F.count("*").alias("__n"))
    before = counts.select(by, "__range", (F.sum("__n").over(Window.partitionBy(by).orderBy("__range")) - F.col("__n")).alias("__before"))  # 4096 rows a group at most
    within = F.row_number().over(Window.partitionBy(by, "__range").orderBy("__order", F.xxhash64(*(c for c, kind in df.dtypes if "map<" not in kind))))
    return rows.join(before, [by, "__range"]).withColumn(name, within + F.col("__before")).drop("__order", "__range", "__before")


#: Label sets that the greedy pass on the driver takes.
MOST_SETS = 200_000


def stratified_split(df: DataFrame, key: str, val_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Rows with ``labels`` get ``is_val``. Rows of one label set are drawn by the hash of seed and key.

    The same seed gives the same split. The label sets' counts go to the driver; sets are few beside rows, and over
    ``MOST_SETS`` of them raise an error before any comes.
    """
    spark = df.sparkSession
    signed = df.withColumn("__sig", F.array_sort("labels"))
    counts = signed.groupBy("__sig").agg(F.count("*").alias("n")).checkpoint(eager=True)
    if counts.count() > MOST_SETS:
        raise ValueError(f"over {MOST_SETS} different label sets")
    found = quotas([(tuple(r["__sig"]), r["n"]) for r in counts.collect()], val_share)
    plan = spark.createDataFrame([(list(s), int(n)) for s, n in found.items()], "__sig array<string>, __quota long") if found else spark.createDataFrame([], "__sig array<string>, __quota long")
    rows = ranked(signed, "__sig", drawn(key, seed), "__rank")
    return rows.join(F.broadcast(plan), "__sig", "left").withColumn("is_val", F.col("__rank") <= F.coalesce("__quota", F.lit(0))).select(*df.columns, "is_val")


def val_share(df: DataFrame) -> DataFrame:
    """(label, total, val, share, skewed): the part of each label in validation against the part of all rows."""
    target = df.agg(F.try_divide(F.count_if("is_val"), F.count("*")).alias("target"))
    counts = df.select(F.explode("labels").alias("label"), "is_val").groupBy("label").agg(F.count("*").alias("total"), F.count_if("is_val").alias("val"))
    rows = counts.join(F.broadcast(target))  # one row
    return rows.select("label", "total", "val", (F.col("val") / F.col("total")).alias("share"), (F.abs(F.col("val") / F.col("total") - F.col("target")) > SKEW).alias("skewed"))


def shown_order(label: Column) -> Column:
    """Buckets in their order, sources by name, bins by number; null for what is not shown."""
    group = F.substring_index(label, ":", 1)
    rest = F.substring_index(label, ":", -1)
    bucket = F.array_position(F.array(*map(F.lit, BUCKETS)), rest)
    number = F.lpad(rest, 12, "0")
    return F.when((group == "bucket") & (bucket > 0), F.concat(F.lit("0"), F.lpad(bucket.cast("string"), 12, "0"))).when(group == "source", F.concat(F.lit("1"), rest)).when(group == "plen", F.concat(F.lit("2"), number)).when(group == "clen", F.concat(F.lit("3"), number)).when(group == "complexity", F.concat(F.lit("4"), number))
