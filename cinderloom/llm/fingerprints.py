"""Document fingerprints by consistent weighted sampling, all native.

A document's terms are its words (white space apart), their weights the words' counts. For each of K samples a
term draws, from hashes of term and sample alone, r and c of Gamma(2, 1) and b of U(0, 1); with t = floor(ln w / r + b) its value is ln c - r (t - b + 1), and the least value over the terms is the sample. Two documents agree in a sample as often as their generalised Jaccard
similarity, the sum of the lesser over the sum of the greater weights. A sample's value tells its term and t,
so 16 bits of its hash are kept: a fingerprint is 4 hexadecimal digits a sample, and likeness the share of equal ones.
Samples are taken eight at a time, a row each, so that the generated code stays small enough to be compiled.

Null texts count as empty. A text without words has the empty fingerprint, which is like (1.0) the
empty one alone. Documents are ordered by id, nulls first; of documents with equal ids the one with the
least beginning counts as the next of the id before. Rows with equal id and text are one document
and give one row. A table of one document has itself as the next; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, documents
from .native import let, words

SAMPLES, AT_ONCE = 32, 8
#: Stands for a null id in the order.
FIRST = -(1 << 63)


def terms(text: Column) -> Column:
    """array<struct<x, w>>: the hashes of the distinct words and their counts."""
    hashes = F.sort_array(F.transform(words(text), lambda x: F.xxhash64(x)))

    def runs(h: Column) -> Column:
        starts = F.filter(F.transform(h, lambda x, i: F.when(F.coalesce(F.get(h, i - 1) != x, F.lit(True)), i)), lambda i: i.isNotNull())
        return let(starts, lambda s: F.transform(s, lambda at, j: F.struct(F.get(h, at).alias("x"), (F.coalesce(F.get(s, j + 1), F.size(h)) - at).alias("w"))))

    return let(hashes, runs)


def sample(x: Column, log_w: Column, seed: Column) -> Column:
    """The value of a term in the sample of a seed."""
    one, two = F.xxhash64(x, 2 * seed), F.xxhash64(x, 2 * seed + 1)
    part = lambda h, low, bits: (F.shiftrightunsigned(h, low).bitwiseAND((1 << bits) - 1) + 0.5) / float(1 << bits)
    r = -F.log(part(one, 0, 21) * part(one, 21, 21))
    c = -F.log(part(two, 0, 32) * part(two, 32, 32))
    b = part(one, 42, 22)
    return F.log(c) - r * (F.floor(log_w / r + b) - b + 1)


def signatures(df: DataFrame, keys: list[str], text_col: str, samples: int = SAMPLES) -> DataFrame:
    """The keys of each row, a group of samples ``_g`` and its part of the fingerprint, null without words. Equal keys must have equal texts."""
    rows = df.select(*keys, F.explode_outer(terms(F.col(text_col))).alias("_t"))
    rows = rows.select(*keys, F.col("_t.x").alias("_x"), F.log(F.col("_t.w").cast("double")).alias("_w"), F.explode(F.sequence(F.lit(0), F.lit(samples // AT_ONCE - 1))).alias("_g"))
    values = rows.select(*keys, "_g", *(sample(F.col("_x"), F.col("_w"), F.col("_g") * AT_ONCE + k).alias(f"_s{k}") for k in range(AT_ONCE)))
    least = values.groupBy(*keys, "_g").agg(*(F.min(f"_s{k}").alias(f"_s{k}") for k in range(AT_ONCE)))
    short = lambda k: F.right(F.lpad(F.hex(F.xxhash64(F.col(f"_s{k}"))), 16, "0"), F.lit(4))
    text = F.lower(F.concat(*(short(k) for k in range(AT_ONCE))))
    return least.select(*keys, "_g", F.when(F.col("_s0").isNotNull(), text).alias("_part"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    same = F.aggregate(F.sequence(F.lit(0), F.lit(samples - 1)), F.lit(0), lambda s, k: s + (F.substr(a, 4 * k + 1, F.lit(4)) == F.substr(b, 4 * k + 1, F.lit(4))).cast("int"))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(same / F.lit(float(samples)))


def successors(docs: DataFrame) -> DataFrame:
    """(_key, _next, _need): each id, the next one (after the last the first), and how much of its text the edit needs at most."""
    spark = docs.sparkSession
    ids = docs.groupBy("_key").agg(F.max(F.floor(F.length("_text") / 4)).alias("_need"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the parts of the checkpoint stay as they are, so their numbers can be relied upon
    ids = cut(ids.repartitionByRange(n, "_key")).withColumn("_part", F.spark_partition_id())
    starts = ids.groupBy("_part").agg(F.min("_key").alias("_start"))
    order = Window.orderBy("_part")  # a row per part
    first = starts.agg(F.min("_start")).first()[0]
    ends = starts.select("_part", F.coalesce(F.lead("_start").over(order), F.lit(first)).alias("_after"))
    within = ids.withColumn("_lead", F.lead("_key").over(Window.partitionBy("_part").orderBy("_key")))
    return within.join(ends, "_part").select("_key", F.coalesce("_lead", "_after").alias("_next"), "_need")


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Each document with its edited text: the last quarter replaced by as much of the next document's beginning; and the successors."""
    base = docs.select(F.coalesce(F.col(id_col), F.lit(FIRST)).alias("_key"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    after = successors(base)
    wanted = after.select(F.col("_next").alias("_key"), F.col("_key").alias("_for"), "_need")
    begin = base.join(wanted, "_key").select(F.col("_for").alias("_key"), F.left("_text", F.col("_need").cast("int")).alias("_begin")).groupBy("_key").agg(F.min("_begin").alias("_begin"))
    quarter = F.floor(F.length("_text") / 4).cast("int")
    both = base.join(begin, "_key").select("_key", "_text", F.concat(F.left("_text", F.length("_text") - quarter), F.left("_begin", quarter)).alias("_edited"))
    return both, after


def fingerprint_pairs(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    both, after = edited(docs)
    versions = both.select(
        "_key",
        F.xxhash64("_text").alias("_hash"),
        F.length("_text").cast("long").alias("n_chars"),
        F.sha2("_edited", 256).alias("edited_sha256"),
        F.explode(F.array(F.struct(F.lit(0).alias("no"), F.col("_text").alias("text")), F.struct(F.lit(1).alias("no"), F.col("_edited").alias("text")))).alias("_v"),
    )
    keys = ["_key", "_hash", "n_chars", "edited_sha256", "_no"]
    found = signatures(versions.select(*keys[:-1], F.col("_v.no").alias("_no"), F.col("_v.text").alias("_of")), keys, "_of", samples)
    whole = lambda no: F.array_join(F.transform(F.array_sort(F.filter("_parts", lambda p: p["_no"] == no)), lambda p: p["_part"]), "")
    gathered = found.groupBy(*keys[:-1]).agg(F.collect_list(F.struct("_no", "_g", "_part")).alias("_parts"))
    found = cut(gathered.select(*keys[:-1], whole(0).alias("fingerprint"), whole(1).alias("edited_fingerprint")))
    one = found.groupBy("_key").agg(F.min("fingerprint").alias("_next_fingerprint"))
    nexts = after.join(one.withColumnRenamed("_key", "_next"), "_next").select("_key", "_next_fingerprint")
    return found.join(nexts, "_key").select(
        F.when(F.col("_key") != FIRST, F.col("_key")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_next_fingerprint"), samples).alias("near_next"),
    )


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_pairs(documents(spark, sf_dir))
