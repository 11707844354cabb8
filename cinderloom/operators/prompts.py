"""Requests to models, put together from tables: numbered lists, coverage lines and sections that appear only where there is something to say.

The sentences are this engine's own; callers may give others (``Wording``) with the same placeholders.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import BUCKETS, FOCUS_BUCKETS
from .report import few_shot, underrepresented, zero_filled


@dataclass(frozen=True)
class Wording:
    """Sentences; {} is where the value goes. A section without a value is left out."""

    count: str = "Write {} different briefs for keyframe animations."
    coverage: str = "Rows there are by kind: {}."
    wanted: str = "Prefer the kinds with the fewest rows, in this order: {}."
    emphasis: str = "In this request the kind {} should lead."
    motifs: str = "Take subjects from: {}."
    avoid: str = "Briefs that exist and must not come again:\n{}"
    kinds: str = "Name kinds only from: {}."
    examples: str = "Examples of good answers:\n{}"
    pair: str = "--- index {} ---\nBRIEF: {}\nCODE:\n{}"
    judged: str = "Say for every index whether the code does what the brief asks.\n"


WORDING = Wording()


def filled(sentence: str, value: Column) -> Column:
    """The sentence with the value in its place; null without a value."""
    head, _, tail = sentence.partition("{}")
    return F.concat(F.lit(head), value.cast("string"), F.lit(tail))


def section(sentence: str, items: Column, between: str = ", ", each: str = "") -> Column:
    """A sentence on a list, null where the list is null or empty."""
    listed = F.array_join(F.transform(items, lambda x: F.concat(F.lit(each), x)), between)
    return F.when(F.size(items) > 0, filled(sentence, listed))


def coverage(counts: DataFrame) -> DataFrame:
    """One row (coverage, wanted): the buckets with their counts, in order, and those to push for, the emptiest first."""
    all_, few = zero_filled(counts, BUCKETS), underrepresented(counts)
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("dim_ordinal", "bucket", "n"))), lambda x: F.concat(x["bucket"], F.lit("="), x["n"].cast("string")))
    names = F.transform(F.array_sort(F.collect_list(F.struct("n", "dim_ordinal", "bucket"))), lambda x: x["bucket"])
    return all_.agg(F.array_join(pairs, ", ").alias("coverage")).join(F.broadcast(few.agg(F.array_join(names, ", ").alias("wanted"))))  # a row each


def idea_requests(turns: DataFrame, counts: DataFrame, wording: Wording = WORDING) -> DataFrame:
    """``turns`` (n, emphasis, motifs, avoid; the last three may be null or empty) with ``prompt``. counts: (bucket, n)."""
    rows = turns.join(F.broadcast(coverage(counts)))  # one row
    prompt = F.concat_ws(
        "\n",
        filled(wording.count, F.col("n")),
        filled(wording.coverage, F.col("coverage")),
        filled(wording.wanted, F.col("wanted")),
        F.when(F.col("emphasis") != "", filled(wording.emphasis, F.col("emphasis"))),
        section(wording.motifs, F.col("motifs")),
        section(wording.avoid, F.col("avoid"), "\n", "- "),
        F.lit(wording.kinds.format(", ".join(BUCKETS))),
    )
    return rows.select(*turns.columns, prompt.alias("prompt"))


def turn_plan(turn: Column, pool: Column, size: int = 8, names: tuple[str, ...] = FOCUS_BUCKETS, seed: int = 7) -> tuple[Column, Column]:
    """(emphasis, motifs) of a turn: kinds take turns, subjects are drawn by hash, others in every turn."""
    emphasis = F.element_at(F.array(*map(F.lit, names)), (F.pmod(turn, F.lit(len(names))) + 1).cast("int"))
    order = F.array_sort(F.transform(pool, lambda x: F.struct(F.md5(F.concat(F.lit(f"{seed}:"), turn.cast("string"), F.lit(":"), x)).alias("h"), x.alias("x"))))
    return emphasis, F.transform(F.slice(order, 1, size), lambda x: x["x"])


def system_text(instructions: str, classified: DataFrame, n: int = 2, code_col: str = "code", wording: Wording = WORDING) -> DataFrame:
    """One row (system): the instructions, and examples where there are any (``few_shot``)."""
    best = few_shot(classified, n, code_col).select(F.size("buckets").alias("n"), "ordinal", F.col(code_col).alias("code"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "ordinal", "code"))), lambda x: F.concat(F.lit('<animation index="1">\n'), x["code"], F.lit("\n</animation>")))
    return best.agg(F.concat_ws("\n\n", F.lit(instructions), section(wording.examples, listed, "\n\n")).alias("system"))


def judge_requests(batched: DataFrame, wording: Wording = WORDING) -> DataFrame:
    """(batch_id, prompt) of batches (batch_id, idx, description, code): the pairs with their numbers."""
    one = lambda x: F.concat(*(p for parts in zip(map(F.lit, wording.pair.split("{}")), (x["idx"].cast("string"), x["description"], x["code"], F.lit("\n")), strict=True) for p in parts))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "description", "code"))), one), "\n")
    return batched.groupBy("batch_id").agg(F.concat(F.lit(wording.judged), F.lit("\n"), listed).alias("prompt"))
