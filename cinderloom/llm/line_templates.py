"""Line dedup with a log-template tree.

A line's tokens are split at white space; tokens with a digit become <*>. The tree has fixed depth: the token
count, then the first three tokens; a path through it is a leaf. Within a leaf a template generalises lines that agree in at
least ``similar`` of their positions: it leaves some of the positions after the leading ones free, and stands for all
lines that are equal in the others. The free positions are runs of neighbours, or every so manieth, as many at once as ``similar`` allows
(none in short lines), so that each position is free in one run and one comb: a line has its own template, without free
positions, and ten more or so. All of that is decided by the line alone, so the templates are the same however many
lines a leaf has and wherever they are read; a leaf that a third of all lines are in is counted in many tasks.

A template recurs if it stands in at least ``limit`` distinct documents: texts that are equal count once, and so do the
texts of a group of near copies (``text_copies``), so documents with many copies keep their lines
for the near-duplicate stage. Lines of recurring templates are dropped from all documents. A line whose tokens all have
digits keeps them, for a template without a fixed token would say nothing: it recurs by its numbers. Fields that vary in both
a run and a comb, or within the leading tokens without a digit, are not generalised.

Leaves in too few documents are left out before any line's templates are counted. Templates are 64-bit hashes, sums of their tokens' hashes.

Null texts have no lines and stay null. Lines without a token are kept, unless all others are dropped. Repeated rows give
repeated results and count once; an empty table gives an empty result; other columns are ignored by ``clean_lines``, and carried along by ``drop_lines``.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, Tables, cut, documents, map_rows
from .text_copies import common

DEPTH, SIMILAR, LIMIT, BITS = 3, 0.8, 20, 1 << 24
FIRST = -(1 << 63)
_DIGIT = re.compile(r"[0-9]")
_U = np.uint64
ANY = 0x9E3779B97F4A7C15


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def raw_hash(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def totals(groups: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The sums of each group, modulo 2^64."""
    out = np.zeros(n, _U)
    np.add.at(out, groups, values)
    return out


class Lines:
    """The lines with a token of a text, with their leaves and templates."""

    def __init__(self, depth: int = DEPTH, similar: float = SIMILAR):
        self.depth, self.similar = depth, similar
        self.hashes = Memo(lambda t: ANY if _DIGIT.search(t) else raw_hash(t), 200_000)

    def leaves(self, text: str) -> tuple[list[int], list[list[str]], list[int]]:
        """(line numbers, tokens, leaves)."""
        numbers, lines, found, lead = [], [], [], self.depth
        for i, x in enumerate(text.split("\n")):
            if tokens := x.split():
                head = tokens[:lead]
                if _DIGIT.search(x) and not all(map(_DIGIT.search, tokens)):
                    head = ["<*>" if _DIGIT.search(t) else t for t in head]
                numbers.append(i)
                lines.append(tokens)
                found.append(signed(raw_hash(f"{len(tokens)} {' '.join(head)}")))
        return numbers, lines, found

    def templates(self, lines: list[list[str]], leaves: list[int]) -> list[np.ndarray]:
        """The templates of each line; its own is the first."""
        if not lines:
            return []
        sizes = np.array([len(x) for x in lines])
        h = np.fromiter(map(self.hashes.__getitem__, chain.from_iterable(lines)), _U, sizes.sum())
        ends = np.cumsum(sizes)
        fixed = np.add.reduceat((h != _U(ANY)).astype(np.int64), ends - sizes)
        for k in np.flatnonzero(fixed == 0):  # nothing but numbers
            h[ends[k] - sizes[k] : ends[k]] = [raw_hash(t) for t in lines[k]]
        line = np.repeat(np.arange(len(lines)), sizes)
        at = np.arange(len(h)) - np.repeat(ends - sizes, sizes)
        placed = mix(h + (at.astype(_U) + _U(1)) * _U(0xD6E8FEB86659FD93))
        total, leaf = totals(line, placed, len(lines)), mix(np.array(leaves, np.int64).view(_U))
        rest = np.maximum(0, sizes - self.depth)
        free = np.minimum(np.floor(sizes * (1 - self.similar) + 1e-9).astype(np.int64), rest)  # positions free at once
        parts = np.where(free > 0, -(-rest // np.maximum(1, free)), 0)
        first = np.cumsum(2 * parts) - 2 * parts
        inner = (at >= self.depth) & (free[line] > 0)
        k, p, v = line[inner], at[inner] - self.depth, placed[inner]
        n = int((2 * parts).sum())
        left = totals(first[k] + p // free[k], v, n) + totals(first[k] + parts[k] + p % parts[k], v, n)
        of = np.repeat(np.arange(len(lines)), 2 * parts)
        view = np.arange(n) - np.repeat(first, 2 * parts) + 1  # a template knows which positions are free
        masked = mix((total[of] - left) ^ mix(leaf[of] + view.astype(_U) * _U(0x9E3779B97F4A7C15))).view(np.int64)
        whole = mix(total ^ leaf).view(np.int64)
        return [np.concatenate([whole[i : i + 1], masked[first[i] : first[i] + 2 * parts[i]]]) for i in range(len(lines))]


def leaf_rows(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(leaf, text) of the lines of (_hash, _text)."""
    schema = T.StructType([T.StructField("leaf", T.LongType()), T.StructField("text", T.LongType())])

    def make():
        lines = Lines(depth)
        return lambda whole, text: [(leaf, whole) for leaf in sorted(set(lines.leaves(text)[2]))] if text else []

    return map_rows(docs.select("_hash", "_text"), make, schema, many=True)


def bitmap(leaves: DataFrame) -> np.ndarray:
    """``BITS`` bits, those of the leaves set; its size is the same for all tables, and for very many leaves it only sorts out less."""
    slot = F.pmod("leaf", F.lit(BITS))
    words = leaves.groupBy(F.floor(slot / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little")


def line_rows(docs: DataFrame, leaves: DataFrame, depth: int = DEPTH, similar: float = SIMILAR) -> DataFrame:
    """(leaf, text, key, at, templates) of the lines of (_key, _hash, _text) that are in one of the leaves, but for some few in others."""
    fields = [("leaf", T.LongType()), ("text", T.LongType()), ("key", T.LongType()), ("at", T.IntegerType()), ("templates", T.ArrayType(T.LongType()))]
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bitmap(leaves)))

    def make():
        lines, bits = Lines(depth, similar), np.unpackbits(shared.value)

        def row(key, whole, text):
            if not text:
                return []
            numbers, tokens, found = lines.leaves(text)
            use = [i for i, leaf in enumerate(found) if bits[leaf % BITS]]
            made = lines.templates([tokens[i] for i in use], [found[i] for i in use])
            return [(found[i], whole, key, numbers[i], x) for i, x in zip(use, made, strict=True)]

        return row

    return map_rows(docs.select("_key", "_hash", "_text"), make, T.StructType([T.StructField(*x) for x in fields]), many=True)


def dropped(docs: DataFrame, limit: int = LIMIT, similar: float = SIMILAR, depth: int = DEPTH) -> DataFrame:
    """(key, text hash, drop: array of line numbers) of the documents that lose lines."""
    tables = Tables(docs.sparkSession)
    leaves = tables.put(leaf_rows(docs, depth).distinct().groupBy("leaf").agg(F.count("*").alias("_docs")).where(F.col("_docs") >= limit).select("leaf"))
    hot = tables.put(line_rows(docs, leaves, depth, similar).join(leaves, "leaf", "left_semi").select("text", "key", "at", "templates"))
    rows = hot.select("text", "key", "at", F.explode("templates").alias("template"))
    again = common(rows.select("template", F.col("text").alias("_text")), ["template"], docs.select(F.col("_hash").alias("_text"), F.col("_text").alias("text")), limit)
    out = cut(rows.join(again, "template", "left_semi").groupBy("key", "text").agg(F.sort_array(F.collect_set("at")).alias("drop")))
    tables.drop()
    return out


def clean(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows with the columns __lines, __dropped (counts of lines with a token) and __clean (null for a null text)."""
    rows = docs.withColumns({"__key": F.coalesce(F.col(id_col), F.lit(FIRST)), "__hash": F.xxhash64(F.col(text_col))})
    gone = dropped(rows.select(F.col("__key").alias("_key"), F.col("__hash").alias("_hash"), F.col(text_col).alias("_text")), limit, **options)
    df = rows.join(gone.select(F.col("key").alias("__k"), F.col("text").alias("__h"), F.col("drop").alias("__drop")), (F.col("__key") == F.col("__k")) & (F.col("__hash") == F.col("__h")), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("__drop", i)), "\n")
    counted = F.coalesce(F.size(F.filter(lines, lambda x: x.rlike(r"(?U)[^\s\x1c-\x1f]"))), F.lit(0))
    found = {"__lines": F.greatest(counted, F.lit(0)), "__dropped": F.greatest(F.coalesce(F.size("__drop"), F.lit(0)), F.lit(0)), "__clean": F.when(F.col("__drop").isNull(), F.col(text_col)).otherwise(left)}
    return df.withColumns(found).drop("__key", "__hash", "__k", "__h", "__drop")


def clean_lines(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_lines, n_dropped, clean_text) of every row."""
    df = clean(docs.select("doc_id", "text"), **options)
    return df.select("doc_id", F.col("__lines").cast("long").alias("n_lines"), F.col("__dropped").cast("long").alias("n_dropped"), F.col("__clean").alias("clean_text"))


def drop_lines(docs: DataFrame, **options) -> DataFrame:
    """The rows with their recurring lines dropped; rows that had lines and lost all of them go."""
    df = clean(docs.select(F.struct(*docs.columns).alias("__whole"), "doc_id", "text"), **options)
    df = df.where((F.col("__dropped") == 0) | (F.col("__dropped") < F.col("__lines")))
    return df.select(*(F.col("__clean").alias("text") if c == "text" else F.col("__whole").getField(c).alias(c) for c in docs.columns))


def op6_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(documents(spark, sf_dir))
