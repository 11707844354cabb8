"""Gates: what a snippet's frames must show, and composed validators."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.chat import parsed_json
from ..schemas import JUDGE_OUTPUT
from .order import batches
from .prompts import WORDING, Wording, judge_requests

#: The limits of the render gate.
WHITE, BLANK, VISIBLE, DELTA, MOTION = 245, 0.01, 0.6, 20, 0.005


def nonwhite(pixels: Column) -> Column:
    """The share of pixels that are darker than near-white."""
    return F.try_divide(F.size(F.filter(pixels, lambda p: p < WHITE)), F.size(pixels))


def changed(a: Column, b: Column) -> Column:
    """The share of pixels of two frames that differ by more than the limit; null without both."""
    differing = F.filter(F.zip_with(a, b, lambda x, y: F.abs(x.cast("int") - y.cast("int"))), lambda d: d > DELTA)
    return F.when(a.isNotNull() & b.isNotNull(), F.try_divide(F.size(differing), F.size(a)))


def render_verdicts(frames: DataFrame) -> DataFrame:
    """(snippet_id, visible_share, motion, passed) of (snippet_id, frame_idx, pixels)."""
    order = Window.partitionBy("snippet_id").orderBy("frame_idx")
    rows = frames.select("snippet_id", nonwhite(F.col("pixels")).alias("dark"), changed(F.lag("pixels").over(order), F.col("pixels")).alias("moved"))
    found = rows.groupBy("snippet_id").agg(F.avg((F.col("dark") > BLANK).cast("int")).alias("visible_share"), F.coalesce(F.max("moved"), F.lit(0.0)).alias("motion"))
    return found.withColumn("passed", (F.col("visible_share") >= VISIBLE) & (F.col("motion") >= MOTION))


Gate = Callable[[DataFrame], DataFrame]


def validate(rows: DataFrame, render: Gate, judge: Gate | None = None, key: str = "row_id", cut: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows with ``ok``. A gate takes rows and returns (key, ok); the judge sees only what the first gate passes.

    The first gate's verdicts are cut off from their history before the judge runs, so that an expensive gate runs once.
    A row without a render verdict fails; one that the judge leaves out passes, as one whose number is missing in a judge's answer does.
    """
    cut = cut or (lambda df: df.checkpoint(eager=True))
    first = cut(render(rows).select(key, F.coalesce("ok", F.lit(False)).alias("__first")))
    seen = rows.join(first, key, "left").withColumn("__first", F.coalesce("__first", F.lit(False)))
    if judge is None:
        return seen.withColumnRenamed("__first", "ok")
    second = judge(seen.where("__first").drop("__first")).select(key, F.col("ok").alias("__second"))
    return seen.join(second, key, "left").withColumn("ok", F.col("__first") & F.coalesce("__second", F.lit(True))).drop("__first", "__second")


def judged_in_chunks(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """(batch_id, idx, ok) from parsed verdicts (batch_id, index, matches); of a repeated index the last counts, a missing one passes."""
    last = answers.groupBy("batch_id", F.col("index").alias("idx")).agg(F.max_by("matches", "at").alias("ok"))
    return rows.join(last, ["batch_id", "idx"], "left").withColumn("ok", F.coalesce("ok", F.lit(True)))


def judge(call: Callable[[str], str], size: int = 10, wording: Wording = WORDING, key: str = "row_id", cut: Callable[[DataFrame], DataFrame] | None = None) -> Gate:
    """A gate that asks a model: rows (key, description, code) in chunks of ``size``, numbered from 1 in each, one request a chunk.

    ``call`` gets a request and gives a JSON text with ``results`` of (index, matches), in Python workers. Rows that an
    answer leaves out pass, and so do those of a chunk whose answer does not parse. The answers are cut off from their history.
    """

    def gate(rows: DataFrame) -> DataFrame:
        keep = cut or (lambda df: df.checkpoint(eager=True))
        chunks = keep(batches(rows.select(key, "description", "code"), size, key))

        def ask(parts):
            for p in parts:
                yield pd.DataFrame({"batch_id": p["batch_id"], "text": [call(x) for x in p["prompt"]]})

        said = keep(judge_requests(chunks, wording).mapInPandas(ask, "batch_id long, text string"))
        found = said.select("batch_id", F.posexplode(parsed_json(F.col("text"), JUDGE_OUTPUT)["results"]).alias("at", "x")).select("batch_id", "x.index", "x.matches", "at")
        return judged_in_chunks(chunks.select(key, "batch_id", "idx"), found).select(key, "ok")

    return gate


def rendered(rows: DataFrame, verdicts: DataFrame, check: bool = True, key: str = "snippet_id") -> DataFrame:
    """The rows whose render verdict (key, passed) is good; all of them without ``check``."""
    return rows.join(verdicts.where("passed").select(key), key, "left_semi") if check else rows
