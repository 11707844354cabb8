"""Evaluation of a run, and comparison of two."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.css import has_keyframes
from ..functions.text import digest, formatted, has_fence, percent
from ..schemas import OUTCOMES

FIELDS = ("output", "code_ext", "nll", "n_tokens", "render_raw", "render_ext", "match_raw", "match_ext")


def validation_rows(chats: DataFrame) -> DataFrame:
    """(description, reference, ordinal) of chat rows."""
    content = lambda n: F.get("messages", F.lit(n))["content"]
    return chats.select(content(0).alias("description"), content(1).alias("reference"), "ordinal")


def merge_cache(val: DataFrame, cache: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """A record per description in the validation rows; what the cache knows lies over it, field by field, later lines over earlier ones.

    Cache lines of unknown descriptions are left out. Of equal descriptions in the validation rows the last reference counts.
    Descriptions meet by their digests, so the cache's are not shuffled; a cache may have a ``digest`` in their place.
    """
    seed = val.groupBy(digest(F.col("description")).alias("digest")).agg(F.any_value("description").alias("description"), F.max_by("reference", "ordinal").alias("reference"), F.min("ordinal").alias("ordinal"))
    cache = cache if "digest" in cache.columns else cache.withColumn("digest", digest(F.col("description")))
    latest = lambda c: F.expr(f"max_by(`{c}`, ordinal) filter (where `{c}` is not null)").alias(c)
    known = cache.groupBy("digest").agg(*(latest(c) for c in (*(["reference"] if "reference" in cache.columns else []), *fields)))
    if "reference" in known.columns:
        known = known.withColumnRenamed("reference", "__reference")
    out = seed.join(known, "digest", "left").drop("digest")
    if "__reference" in out.columns:
        out = out.withColumn("reference", F.coalesce("__reference", "reference")).drop("__reference")
    return out


def needed(cache: DataFrame, field: str, gate: str | None = None) -> DataFrame:
    """Records that lack a field; with a gate, of those that it passed."""
    rows = cache.where(F.col(field).isNull())
    return rows if gate is None else rows.where(F.coalesce(gate, F.lit(False)))


def run_phase(cache: DataFrame, field: str, produce: Callable[[DataFrame], DataFrame], gate: str | None = None, cut=None) -> DataFrame:
    """The cache with the field filled in where it was missing; ``produce`` gives (description, field). Done work is not done again.

    What is made meets the cache by digests of the descriptions, so these are shuffled once, on the cache's side.
    """
    cut = cut or (lambda df: df.checkpoint(eager=True))
    made = cut(produce(needed(cache, field, gate)).select(digest(F.col("description")).alias("__digest"), F.col(field).alias("__new")))
    keyed = cache.withColumn("__digest", digest(F.col("description")))
    return keyed.join(made, "__digest", "left").withColumn(field, F.coalesce(field, "__new")).select("description", *(c for c in cache.columns if c != "description"))


def format_valid(output: Column) -> Column:
    text = F.coalesce(output, F.lit(""))
    return has_keyframes(text) & ~has_fence(text)


def metrics(cache: DataFrame, judged: bool = True) -> DataFrame:
    """One row: n, perplexity and loss a token, valid formats, and a struct each for the raw and the extracted code.

    Where there are no rows or tokens the rates are null.
    """
    n = F.count("*")
    tokens = F.sum(F.coalesce("n_tokens", F.lit(0)))
    loss = F.try_divide(F.sum(F.coalesce("nll", F.lit(0.0))), tokens)

    def variant(render: str, match: str, name: str) -> Column:
        shown = F.coalesce(render, F.lit(False))
        rendered = F.count_if(shown)
        both = F.count_if(shown & F.coalesce(match, F.lit(False)))
        unknown = F.lit(None)
        return F.struct(
            rendered.alias("render_pass"),
            F.try_divide(rendered, n).alias("render_rate"),
            (F.try_divide(both, rendered) if judged else unknown.cast("double")).alias("match_of_rendered"),
            (both if judged else unknown.cast("long")).alias("valid_and_match"),
            (1 - F.try_divide(both if judged else rendered, n)).alias("knockout_rate"),
        ).alias(name)

    return cache.agg(
        n.alias("n"),
        F.exp(loss).alias("perplexity"),
        loss.alias("mean_loss"),
        F.try_divide(F.count_if(format_valid(F.col("output"))), n).alias("format_valid_rate"),
        variant("render_raw", "match_raw", "raw"),
        variant("render_ext", "match_ext", "extracted"),
    )


LABELS = (
    ("perplexity", "perplexity"),
    ("format-valid rate", "format_valid_rate"),
    ("[raw] render-pass", "raw.render_rate"),
    ("[raw] knockout (incl. match)", "raw.knockout_rate"),
    ("[extracted] render-pass", "extracted.render_rate"),
    ("[extracted] knockout (incl. match)", "extracted.knockout_rate"),
)


def tidy(m: DataFrame) -> DataFrame:
    """(label_no, label, value) of a row of metrics."""
    rows = F.array(*(F.struct(F.lit(i).alias("label_no"), F.lit(x).alias("label"), F.col(c).alias("value")) for i, (x, c) in enumerate(LABELS)))
    return m.select(F.explode(rows).alias("x")).select("x.*")


def compare(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """(label_no, label, base, tuned, delta, shown) of two rows of metrics."""
    both = tidy(base).withColumnRenamed("value", "base").join(tidy(tuned).withColumnRenamed("value", "tuned"), ["label_no", "label"])
    text = lambda c: F.when(F.col("label_no") == 0, formatted("%.3f", F.col(c))).otherwise(percent(F.col(c)))
    return both.select("label_no", "label", "base", "tuned", (F.col("tuned") - F.col("base")).alias("delta"), F.concat(text("base"), F.lit(" -> "), text("tuned")).alias("shown"))


def pass_rates(m: DataFrame) -> DataFrame:
    """Percentages for charts."""
    rate = lambda x: 100 * x
    return m.select(
        rate(F.col("format_valid_rate")).alias("format_valid"),
        rate(F.col("extracted.render_rate")).alias("render_extracted"),
        rate(1 - F.col("extracted.knockout_rate")).alias("pass_extracted"),
        rate(F.col("raw.render_rate")).alias("render_raw"),
        rate(1 - F.col("raw.knockout_rate")).alias("pass_raw"),
    )


def passed(render: Column, match: Column) -> Column:
    return F.coalesce(render, F.lit(False)) & F.coalesce(match, F.lit(False))


def ab_join(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """Descriptions in both runs, in the order of the first, with each run's record and the ``outcome``."""
    fields = ("output", "code_ext", "render_ext", "match_ext")
    a = base.select("description", "ordinal", F.struct(*fields).alias("base"))
    b = tuned.select("description", F.struct(*fields).alias("tuned"))
    ok = {k: passed(F.col(f"{k}.render_ext"), F.col(f"{k}.match_ext")) for k in ("base", "tuned")}
    ftw, bop, baw, bof = OUTCOMES
    outcome = F.when(ok["tuned"] & ~ok["base"], ftw).when(ok["tuned"], bop).when(ok["base"], baw).otherwise(bof)
    return a.join(b, "description").withColumn("outcome", outcome)


def outcome_counts(joined: DataFrame) -> DataFrame:
    from ..schemas import dimension

    dim = dimension(joined.sparkSession, OUTCOMES, "outcome")
    counts = joined.groupBy("outcome").agg(F.count("*").alias("n"))
    return dim.join(counts, "outcome", "left").select("outcome", "dim_ordinal", F.coalesce("n", F.lit(0)).alias("n"))
