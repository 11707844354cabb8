"""Tiered generation: each tier gets what failed in the one before it; answers are parsed and validated, and usage is kept."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chat import animation_blocks, numbered, usable
from ..functions.text import digest
from ..schemas import DEFAULT_PRICE
from .order import batches
from .order import numbered as positions

ANSWER = "batch_id long, text string, `in` long, out long, cw long, cr long"
Cut = Callable[[DataFrame], DataFrame]


def resume(pool: DataFrame, done: DataFrame, n: int | None = None, key: str = "description", ordinal: str = "ordinal") -> DataFrame:
    """The first n briefs, less those that are done."""
    rows = pool if n is None else pool.orderBy(ordinal).limit(n)
    return rows.join(done.select(key).distinct(), key, "left_anti")


def done_briefs(chats: DataFrame) -> DataFrame:
    return chats.select(F.get("messages", F.lit(0))["content"].alias("description")).distinct()


def requests(batched: DataFrame, head: str = "Generate one animation per brief below.\n\n") -> DataFrame:
    """(batch_id, prompt): a batch's briefs, numbered."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("idx", "description"))), lambda x: x["description"])
    return batched.groupBy("batch_id").agg(numbered(listed, head).alias("prompt"))


def parse_answers(answers: DataFrame, batched: DataFrame) -> DataFrame:
    """The batches' briefs with the code that an answer has for their numbers; of a repeated number the last block counts."""
    blocks = answers.select("batch_id", F.explode(animation_blocks(F.col("text"))).alias("x"))
    last = blocks.groupBy("batch_id", F.col("x.idx").alias("idx")).agg(F.max_by("x.code", "x.at").alias("code"))
    return batched.join(last.where(usable(F.col("code"))), ["batch_id", "idx"])


def not_parsed(batched: DataFrame, parsed: DataFrame) -> DataFrame:
    """Briefs whose description no parsed row of their batch has."""
    return batched.join(parsed.select("batch_id", "description"), ["batch_id", "description"], "left_anti")


def generator(call: Callable[[str, list[str]], tuple[str, dict[str, int]]], attempts: int = 8, first_wait: float = 5, longest: float = 60, retry_on: tuple[type[Exception], ...] = ()) -> Callable[[str, DataFrame], DataFrame]:
    """A generate(tier, batched) that calls a model once per batch, in Python workers; waits double from call to call."""

    def generate(tier: str, batched: DataFrame) -> DataFrame:
        def one(p: pd.DataFrame) -> pd.DataFrame:
            import time

            briefs, wait = p.sort_values("idx")["description"].tolist(), first_wait
            for attempt in range(attempts):
                try:
                    text, used = call(tier, briefs)
                    break
                except retry_on:
                    if attempt == attempts - 1:
                        raise
                    time.sleep(wait)
                    wait = min(2 * wait, longest)
            return pd.DataFrame([(int(p["batch_id"].iloc[0]), text, *(int(used.get(k, 0) or 0) for k in ("in", "out", "cw", "cr")))], columns=["batch_id", "text", "in", "out", "cw", "cr"])

        return batched.groupBy("batch_id").applyInPandas(one, ANSWER)

    return generate


def run_cascade(briefs: DataFrame, tiers: Iterable[str], batch_size: int, generate: Callable[[str, DataFrame], DataFrame], validate: Callable[[DataFrame], DataFrame], on_keep: Callable[[DataFrame], None] | None = None, ordinal: str = "ordinal", cut: Cut | None = None, log: Callable[[str], None] | None = None) -> tuple[DataFrame, list[dict], DataFrame]:
    """(kept rows with their tier, a list of tier statistics, usage rows).

    Every tier's answers and verdicts are cut off from their history, since models answer differently when asked again.
    Descriptions are written once; tiers go by the briefs' numbers and digests, and a step that reads descriptions gets them by a join.
    ``generate`` gets batches of (ordinal, origin, description, batch_id, idx), of which ``origin`` is the brief's first ordinal.
    Of the last tier's failures nothing is kept; they are counted. ``validate`` gives rows an ``ok``. ``log`` gets a line before
    and after each tier.
    """
    cut = cut or (lambda df: df.checkpoint(eager=True))
    log = log or logging.getLogger(__name__).info
    tiers = list(tiers)
    spark = briefs.sparkSession
    kept_all, stats, usage_all = None, [], None
    rows = briefs.select(F.col(ordinal).alias("ordinal"), "description")
    rows = cut(rows.withColumns({"__brief": F.monotonically_increasing_id(), "origin": F.col("ordinal"), "__digest": digest(F.col("description")), "__tie": F.xxhash64("ordinal", "description")}))
    texts, pending = rows.select("__brief", "description"), rows.drop("description")
    place = ["batch_id", "idx"]
    told = lambda df: df.join(texts, "__brief").select("ordinal", "description", "code", "tier", *place)
    for tier in tiers:
        attempted = pending.count()
        if not attempted:
            break
        log(f"{tier}: {attempted} briefs in {-(-attempted // batch_size)} batches")
        batched = cut(batches(pending, batch_size, ties=["__tie"]))
        answers = cut(generate(tier, batched.join(texts, "__brief").select("ordinal", "origin", "description", *place)))
        parsed = cut(parse_answers(answers, batched).select("ordinal", "__brief", "__digest", "code", *place))
        seen = parsed.join(texts, "__brief").select("ordinal", "description", "code", *place, F.col("ordinal").alias("row_id"))
        judged = cut(validate(seen).select("code", "ok", *place))
        kept = judged.where("ok").join(batched, place).select("ordinal", "__brief", "code", F.lit(tier).alias("tier"), *place)
        rejected = batched.join(judged.where("not ok").select(*place), place).withColumn("kind", F.lit(0))
        unread = batched.join(parsed.select("batch_id", "__digest"), ["batch_id", "__digest"], "left_anti").withColumn("kind", F.lit(1))
        failed = rejected.unionByName(unread)
        order = failed.withColumn("ordinal", F.col("batch_id") * (2 * batch_size + 2) + F.col("kind") * (batch_size + 1) + F.col("idx"))
        pending = cut(order.select(*pending.columns))
        n_kept, n_failed = judged.where("ok").count(), pending.count()
        log(f"{tier}: kept {n_kept}, failed {n_failed}" + (", dropped" if n_failed and tier == tiers[-1] else ""))
        if on_keep is not None:
            on_keep(told(kept))
        stats.append({"tier": tier, "attempted": attempted, "kept": n_kept, "failed": n_failed})
        used = answers.select(F.lit(tier).alias("model"), "in", "out", "cw", "cr")
        kept_all = kept if kept_all is None else kept_all.unionByName(kept)
        usage_all = used if usage_all is None else usage_all.unionByName(used)
    kept_all = told(kept_all) if kept_all is not None else spark.createDataFrame([], "ordinal long, description string, code string, tier string, batch_id long, idx int")
    usage_all = usage_all if usage_all is not None else spark.createDataFrame([], "model string, `in` long, out long, cw long, cr long")
    return kept_all, stats, usage_all


def usage_by_model(usage: DataFrame) -> DataFrame:
    return usage.groupBy("model").agg(*(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("in", "out", "cw", "cr")))


def cost(usage: DataFrame, pricing: DataFrame, default: tuple[float, float] = DEFAULT_PRICE) -> DataFrame:
    """(model, cost): written cache tokens cost a quarter more than input, read ones a tenth. Prices are per million tokens."""
    priced = usage_by_model(usage).join(pricing, "model", "left").withColumns({"ip": F.coalesce("in_price", F.lit(default[0])), "op": F.coalesce("out_price", F.lit(default[1]))})
    return priced.select("model", ((F.col("in") * F.col("ip") + F.col("cw") * F.col("ip") * 1.25 + F.col("cr") * F.col("ip") * 0.1 + F.col("out") * F.col("op")) / 1e6).alias("cost"))


def top_up(state: dict, target: int, ask: Callable[[int, int], list | None], accept: Callable[[list, list], list], chunk: int = 25, stall: int = 6, least: int = 1) -> dict:
    """Asks for briefs until there are enough, at most ``chunk`` at once; the last answer may overshoot.

    ``ask(n, turn)`` gives an answer, None where it was cut short (the next request is half as large), or an empty one where it did not parse (skipped).
    ``stall`` fruitless turns in a row end it.
    """
    have, size, idle, turn = list(state.get("kept", [])), chunk, 0, 0
    while len(have) < target and idle < stall:
        answer = ask(min(size, target - len(have)), turn)
        turn += 1
        if answer is None:
            size, idle = max(least, size // 2), idle + 1
            continue
        fresh = accept(answer, have)
        have += fresh
        idle = 0 if fresh else idle + 1
    return {"kept": have, "turns": turn, "stalled": len(have) < target}
