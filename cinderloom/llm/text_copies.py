"""Groups of near copies by whole-text similarity, for counts of documents in which copies must count once.

A text's set holds its distinct words (ASCII white space apart, lower case); its sketch is the ``K`` least hashes of
them, the whole set where it is smaller. Texts are near copies if the Jaccard similarity that the least ``K`` hashes of both
sets' union show is ``PERCENT`` or more; the threshold is high, for documents that share boilerplate and little else are
not copies of each other. Candidates come from ``BANDS`` bands: a sketch's hashes are dealt by their remainder
into so many parts, and a band is the least ``LEASTS`` of a part, so a pair of 0.9 agrees in none with a probability of 0.004, one of
0.95 hardly ever. A band's members are compared with the least text of the band's group, so rows stay in proportion to
members; a pair that meets only other texts' leasts is missed, which can only split a group. Groups are the connected
components of the links. Equal texts are one text; texts without words are in no group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, cut, sieve
from .components import components
from .native import let, words

K, BANDS, LEASTS, PERCENT = 120, 10, 8, 90


def sketch(text: Column) -> Column:
    """The least hashes of the distinct words, in order."""
    hashed = F.transform(words(F.lower(text)), lambda x: F.hash(x))
    return F.slice(F.sort_array(F.array_distinct(hashed)), 1, K)


def bands(found: Column) -> Column:
    """array<struct<band, key>> of a sketch; none for an empty part."""
    part = lambda i: let(F.slice(F.filter(found, lambda x: F.pmod(x, F.lit(BANDS)) == i), 1, LEASTS), lambda p: F.when(F.size(p) > 0, F.struct(F.lit(i).alias("band"), F.xxhash64(p).alias("key"))))
    return F.filter(F.array(*(part(i) for i in range(BANDS))), lambda x: x.isNotNull())


def similar(a: Column, b: Column, percent: int = PERCENT) -> Column:
    """Whether the sketches' texts are near copies."""
    return let(F.slice(F.sort_array(F.array_union(a, b)), 1, K), lambda least: 100 * F.size(F.array_intersect(least, F.array_intersect(a, b))) >= percent * F.size(least))


def groups(docs: DataFrame, texts: DataFrame, tables: Tables) -> DataFrame:
    """(_text, _group) of the texts that have near copies, among ``tables``; docs: _text (hash), text; texts: _text of those that matter."""
    texts = texts.select("_text").distinct()
    sketches = sieve(docs, "_text", texts, "_text").select("_text", sketch(F.col("text")).alias("least")).where(F.size("least") > 0)
    known = tables.put(sketches.dropDuplicates(["_text"]).join(texts, "_text", "left_semi"))  # copies meet where they are read
    members = known.select("_text", F.explode(bands(F.col("least"))).alias("x")).select("_text", "x.*")
    leasts = tables.put(members.groupBy("band", "key").agg(F.min("_text").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    pairs = members.join(leasts, ["band", "key"]).where("_text != _first").select(F.col("_text").alias("u"), F.col("_first").alias("v")).distinct()
    side = lambda c: known.select(F.col("_text").alias(c), F.col("least").alias(f"{c}_least"))
    links = tables.put(pairs.join(side("u"), "u").join(side("v"), "v").where(similar(F.col("u_least"), F.col("v_least"))).select("u", "v"))
    return components(links, tables).select(F.col("node").alias("_text"), F.col("component").alias("_group"))


def common(rows: DataFrame, by: list[str], docs: DataFrame, limit: int) -> DataFrame:
    """The values of ``by`` that stand in at least ``limit`` distinct documents, near copies counted once; rows: by, _text; docs as above."""
    tables = Tables(rows.sparkSession)
    pairs = rows.select(*by, "_text").distinct()
    often = tables.put(pairs.groupBy(*by).agg(F.count("*").alias("_docs")).where(F.col("_docs") >= limit).drop("_docs"))
    pairs = tables.put(pairs.join(often, by, "left_semi"))
    named = pairs.join(groups(docs, pairs, tables), "_text", "left").select(*by, F.coalesce("_group", "_text").alias("_group"))
    found = cut(named.distinct().groupBy(*by).agg(F.count("*").alias("_docs")).where(F.col("_docs") >= limit).select(*by))
    tables.drop()
    return found
