"""Quality rules: counts within each text, and the frequency of its lines in other documents of its host.

Base: a document fails with fewer than 10 words, or if over a fifth of its words stand in
five-word windows found twice or more in it. Method: lines are normalised (lower case, digits
as 0, white space as one space) and hashed; a line is above the limit on a host (``source``) if at least
``limit`` distinct documents of the host have it. Documents with equal texts count once, and so does a group of near
copies (``text_copies``), so copies do not make lines frequent. Such lines are removed, and a document is depleted, and rejected, if
under ``least`` of its words remain. ``verdicts`` reports, ``keep`` gives the documents that stay, without the removed lines.

Null texts count as empty and fail; a null host is a host of its own. Repeated rows give repeated
results and count once; an empty table gives an empty result; other columns are carried along
by ``keep`` and ignored by ``verdicts``.

Counting is by (host, line, text), then by (host, line), so a line that a third of all
documents share is summed up in many tasks; near copies are looked for among the texts with lines in enough texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .native import let, words
from .text_copies import common

LIMIT, LEAST, LEAST_WORDS, REPEATED = 20, 0.3, 10, 20


def repeated_words(w: Column) -> Column:
    """How many of the words stand in a five-word window found twice or more."""
    n = F.size(w)
    hashes = F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(5))))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        starts = lambda p: F.sort_array(
            F.filter(F.transform(p, lambda x, i: F.when(F.coalesce(F.get(p, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(p, i + 1)["h"] == x["h"], F.lit(False)), x["at"])), lambda at: at.isNotNull())
        )
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
        return F.aggregate(let(pairs, starts), zero, lambda s, at: F.struct((at + 5).alias("end"), (s["total"] + at + 5 - F.greatest(s["end"], at)).alias("total")), lambda s: s["total"])

    return F.when(n < 6, 0).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h))))


def base(text: Column) -> Column:
    """struct<n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words> of a text."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("word_chars"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        ),
    )


def line_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """A row per line with a word: _id, _text (hash), _host, _line (hash), _at (its number among all lines), _words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(x.alias("line"), i.alias("at"))), lambda x: x["line"].rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_text"), F.coalesce(F.col(host_col), F.lit("")).alias("_host"), F.explode(rows).alias("_x"))
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.col("_x.line"))), "[0-9]", "0"), r"\s+", " ")
    n_words = F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit(""))) + 1
    return df.select("_id", "_text", "_host", F.xxhash64(plain).alias("_line"), F.col("_x.at").alias("_at"), n_words.alias("_words"))


def frequent_lines(rows: DataFrame, docs: DataFrame, limit: int = LIMIT, text_col: str = "text") -> DataFrame:
    """(_host, _line) of the lines above the limit."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return common(rows, ["_host", "_line"], docs.select(F.xxhash64(text).alias("_text"), text.alias("text")), limit)


def removed_words(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(_id, _text, _host, _removed, _gone): the words of each document in lines above the limit, and their numbers, where there are any."""
    rows = line_rows(docs, id_col, text_col, host_col)
    hits = rows.join(frequent_lines(rows, docs, limit, text_col), ["_host", "_line"], "left_semi")
    return hits.select("_id", "_text", "_host", "_at", "_words").distinct().groupBy("_id", "_text", "_host").agg(F.sum("_words").alias("_removed"), F.collect_list("_at").alias("_gone"))


def verdict(n_words: Column, n_repeat_words: Column, n_removed_words: Column, least: float = LEAST) -> tuple[Column, Column]:
    """base_failed and kept."""
    failed = (n_words < LEAST_WORDS) | (100 * n_repeat_words > REPEATED * n_words)
    return failed, ~failed & (n_words - n_removed_words >= least * n_words)


def judged(docs: DataFrame, columns: list, limit: int, least: float, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """The columns of each document (expressions that may move with it), then _text, _host, _gone, n_removed_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    left = docs.select(*columns, F.col(id_col).alias("__id"), F.xxhash64(text).alias("_text"), F.coalesce(F.col(host_col), F.lit("")).alias("_host"))
    right = removed_words(docs, limit, id_col, text_col, host_col).select("_id", F.col("_text").alias("_of"), F.col("_host").alias("_on"), "_removed", "_gone")
    rows = left.join(right, left["__id"].eqNullSafe(right["_id"]) & (F.col("_text") == F.col("_of")) & (F.col("_host") == F.col("_on")), "left")
    return rows.withColumn("n_removed_words", F.coalesce("_removed", F.lit(0)).cast("long")).drop("__id", "_id", "_of", "_on", "_removed")


def verdicts(docs: DataFrame, limit: int = LIMIT, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """A row per document: id, _text, _host, the base counts, n_removed_words, base_failed, kept."""
    docs = docs.select(id_col, text_col, host_col)
    rows = judged(docs, [F.col(id_col), base(F.coalesce(F.col(text_col), F.lit(""))).alias("_base")], limit, least, id_col, text_col, host_col)
    failed, kept = verdict(F.col("n_words"), F.col("n_repeat_words"), F.col("n_removed_words"), least)
    return rows.select(id_col, "_text", "_host", "_base.*", "n_removed_words").withColumns({"base_failed": failed, "kept": kept})


def keep(docs: DataFrame, limit: int = LIMIT, least: float = LEAST) -> DataFrame:
    """The documents that no rule rejects, with all their columns, without their lines above the limit."""
    whole = F.struct(*docs.columns).alias("__whole")
    rows = judged(docs.select(whole, "doc_id", "text", "source"), ["__whole"], limit, least, "doc_id", "text", "source")
    # one expression that needs the counts of the text and of its lines: it is worked out once, after the join
    kept = let(base(F.coalesce(F.col("__whole.text"), F.lit(""))), lambda b: verdict(b["n_words"], b["n_repeat_words"], F.col("n_removed_words"), least)[1])
    rows = rows.where(kept)
    lines = F.filter(F.split("__whole.text", "\n"), lambda x, i: ~F.array_contains("_gone", i))
    rows = rows.withColumn("__text", F.when(F.col("_gone").isNull(), F.col("__whole.text")).otherwise(F.array_join(lines, "\n")))
    return rows.select(*(F.col("__text").alias("text") if c == "text" else F.col("__whole").getField(c).alias(c) for c in docs.columns))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(documents(spark, sf_dir)).drop("_text", "_host")
