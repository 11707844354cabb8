"""Exact and near duplicates where the earlier row stays."""

from __future__ import annotations

import difflib
import math
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import digest, normalise

THRESHOLD = 0.82


def first_wins(df: DataFrame, keys: list[str], ordinal: str = "ordinal") -> DataFrame:
    """The first row of each key. The least ordinal is summed up before the shuffle, so a frequent key costs a row a task.

    Texts among the keys go by their digests, so that whole rows are shuffled once at most.
    """
    kinds = dict(df.dtypes)
    rows = df.withColumns({f"__key{i}": digest(F.col(k)) if kinds[k] == "string" else F.col(k) for i, k in enumerate(keys)})
    own = [f"__key{i}" for i in range(len(keys))]
    first = rows.groupBy(*own).agg(F.min(ordinal).alias("__first"))
    on = [rows[k].eqNullSafe(first[k]) for k in own] + [rows[ordinal] == first["__first"]]
    return rows.join(first, on, "left_semi").drop(*own)


def ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity with a as the new text and b as the earlier one; it is not symmetric."""
    matcher, held, out = difflib.SequenceMatcher(), None, []
    for x, y in zip(a, b, strict=True):
        if y != held:  # what is known of the earlier text is kept for its next pairs
            matcher.set_seq2(y)
            held = y
        matcher.set_seq1(x)
        out.append(matcher.ratio())
    return pd.Series(out, dtype="float64")


class Earlier:
    """Earlier texts of a cell, and which of them a later text may be like: none that is like enough is missed.

    At ``threshold`` M characters match, 2 M >= threshold * (la + lb), and they are a common subsequence, so its length bounds
    them. It is counted for many texts at once, a bit a character, after the letters in common have sifted out most.
    Of earlier texts of 200 characters and more difflib begins a match at seldom characters only (its ``autojunk``; besides, the
    texts' common beginning can match). With r places of these there are r + 1 matches at most, and one has M / (r + 1) characters.
    Where that is long enough the texts are found by the pieces around those places, without a look at the others.
    """

    #: Characters of their own; the others count as one, which can only raise a bound.
    CLASSES = 64
    #: Lengths of pieces, and so many places of a piece that its texts are better compared as all others.
    PIECES, COMMON = (10, 6), 64
    #: Texts whose bits stand in one number.
    AT_ONCE = 512

    def __init__(self, ordinals: list[int], texts: list[str], threshold: float):
        self.ordinals, self.texts, self.threshold = ordinals, texts, threshold
        self.pieces: dict[int, dict[str, list[tuple[int, int]]]] = {}
        self.least = [self._longest_match(t) for t in texts]
        plain = {i for i, n in enumerate(self.least) if n < self.PIECES[-1]}
        for size, above in zip(self.PIECES, (None, *self.PIECES), strict=False):
            own = self.pieces[size] = {}
            for i, n in enumerate(self.least):
                if n >= size and (above is None or n < above):
                    t, seldom = texts[i], self._seldom(texts[i])
                    starts = {0}.union(*(range(max(0, at - size + 1), min(at, len(t) - size) + 1) for at, c in enumerate(t) if c in seldom))
                    for at in starts:
                        own.setdefault(t[at : at + size], []).append((i, at))
            for piece in [x for x, found in own.items() if len(found) > self.COMMON]:
                plain.update(i for i, _ in own.pop(piece))
        self.plain = np.array(sorted(plain), dtype="int64")
        self.before = np.array([ordinals[i] for i in self.plain], dtype="int64")
        self._tables([texts[i] for i in self.plain])

    @staticmethod
    def _seldom(text: str) -> set[str]:
        return {c for c, n in Counter(text).items() if n <= len(text) // 100 + 1}

    def _longest_match(self, text: str) -> int:
        """So long one match with the text must be at least."""
        if len(text) < 200:
            return 0
        places = sum(map(text.count, self._seldom(text)))
        return math.ceil(self.threshold / (2 - self.threshold) * len(text) / (places + 1) - 1e-6)

    def _tables(self, texts: list[str]) -> None:
        first = [c for c, _ in Counter("".join(texts)).most_common(self.CLASSES - 1)]
        self.classes, n = {c: k for k, c in enumerate(first)}, len(texts)
        self.lengths = np.array([len(t) for t in texts], dtype="int64")
        self.width = int(self.lengths.max(initial=0)) // 8 + 1  # bytes of a text's bits, the last of which stays free
        codes = np.full((n, self.width * 8), self.CLASSES, dtype="uint8")
        for row, t in zip(codes, texts, strict=True):
            row[: len(t)] = [self.classes.get(c, self.CLASSES - 1) for c in t]
        kind = next(k for k in ("uint8", "uint16", "uint32") if self.width * 8 <= np.iinfo(k).max)
        self.counts = np.zeros((self.CLASSES, n), dtype=kind)
        self.places = np.zeros((self.CLASSES, n, self.width), dtype="uint8")
        for k in range(self.CLASSES if n else 0):
            hit = codes == k
            self.counts[k] = hit.sum(axis=1)
            self.places[k] = np.packbits(hit, axis=1, bitorder="little")

    def like(self, ordinal: int, text: str) -> list[int]:
        """Places of earlier texts that the text may be like."""
        return [*self._by_pieces(ordinal, text), *self._by_all(ordinal, text)]

    def _by_pieces(self, ordinal: int, text: str) -> set[int]:
        found = set()
        for size, own in self.pieces.items():
            for at in range(len(text) - size + 1) if own else ():
                for i, place in own.get(text[at : at + size], ()):
                    if i not in found and self.ordinals[i] < ordinal:
                        other, lo, hi = self.texts[i], 0, size
                        while min(at, place) > lo and text[at - lo - 1] == other[place - lo - 1]:
                            lo += 1
                        while at + hi < len(text) and place + hi < len(other) and text[at + hi] == other[place + hi]:
                            hi += 1
                        if lo + hi >= self.least[i]:
                            found.add(i)
        return found.difference(self.plain.tolist()) if found else found

    def _by_all(self, ordinal: int, text: str) -> list[int]:
        n = int(np.searchsorted(self.before, ordinal))
        if not n:
            return []
        codes = [self.classes.get(c, self.CLASSES - 1) for c in text]
        wanted = np.ceil(self.threshold / 2 * (self.lengths[:n] + len(text)) - 1e-6)
        own = Counter(codes)
        common, most = np.zeros(n, dtype=self.counts.dtype), np.iinfo(self.counts.dtype).max
        for k, times in own.items():
            common += np.minimum(self.counts[k, :n], self.counts.dtype.type(min(times, most)))
        near = np.flatnonzero(common >= wanted)
        found: list[int] = []
        for at in range(0, len(near), self.AT_ONCE):
            part = near[at : at + self.AT_ONCE]
            found += self.plain[part[self._in_common(codes, part) >= wanted[part]]].tolist()
        return found

    def _in_common(self, codes: list[int], part: np.ndarray) -> np.ndarray:
        """Lengths of the longest common subsequences with those texts: their bits stand in one number (Hyyro's recurrence)."""
        places = {k: int.from_bytes(self.places[k][part].tobytes(), "little") for k in set(codes)}
        keep = int.from_bytes((b"\xff" * (self.width - 1) + b"\x7f") * len(part), "little")  # a text's last bit takes its carry
        free = keep
        for k in codes:
            used = free & places[k]
            free = ((free + used) | (free ^ used)) & keep
        left = np.frombuffer(free.to_bytes(self.width * len(part), "little"), dtype="uint8").reshape(len(part), self.width)
        return self.width * 8 - 1 - np.bitwise_count(left).sum(axis=1, dtype="int64")


def pairs_between(later: tuple[list[int], list[str]], earlier: tuple[list[int], list[str]], threshold: float, at_once: int = 50_000) -> list[tuple[int, int]]:
    """(later, earlier) ordinals of texts whose ratio reaches the threshold; both sides are in order."""
    if not later[0] or not earlier[0] or later[0][-1] <= earlier[0][0]:
        return []
    known, open_, out = Earlier(*earlier, threshold), [], []

    def decide() -> None:
        open_.sort(key=lambda x: x[1])
        found = ratios(pd.Series([later[1][a] for a, _ in open_]), pd.Series([earlier[1][b] for _, b in open_])) >= threshold
        out.extend((later[0][a], earlier[0][b]) for (a, b), ok in zip(open_, found, strict=True) if ok)
        open_.clear()

    for a, (ordinal, text) in enumerate(zip(*later, strict=True)):
        open_ += ((a, b) for b in known.like(ordinal, text))
        if len(open_) >= at_once:
            decide()
    decide()
    return out


def length_groups(counts: list[tuple[int, int]], room: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Groups of rows of like length, of (length, rows): (length, its first group, how many it is dealt to) and each group's least and greatest length.

    A group has room for so many words of 64 characters; lengths that have more are dealt to several groups.
    """
    lengths, groups, left = [], [], 0
    for length, n in sorted(counts):
        words = n * max(1, -(-length // 64))
        if words <= left:
            groups[-1] = (groups[-1][0], length)
            left -= words
            lengths.append((length, len(groups) - 1, 1))
        else:
            parts = min(n, -(-words // room))
            lengths.append((length, len(groups), parts))
            groups += [(length, length)] * parts
            left = room - words if parts == 1 else 0
    return lengths, groups


#: Words of 64 characters that a group has room for; a cell holds two groups, and 64 times as many words while it is compared.
ROOM = 16_384


def similar_pairs(new: DataFrame, threshold: float = THRESHOLD, room: int = ROOM) -> DataFrame:
    """(later, earlier) of rows (ordinal, norm) whose ratio reaches the threshold.

    The ratio is at most 2 m / (la + lb) with m characters in common, so lengths must be near: rows are dealt to groups by
    length, and every two groups that can reach each other meet in a cell, whose size has a bound. There ``Earlier`` sifts, and difflib decides on what is left.
    """
    spark, reach = new.sparkSession, threshold / (2 - threshold)
    cores = spark.sparkContext.defaultParallelism
    rows = new.select("ordinal", "norm", F.length("norm").alias("len"))
    counts = [tuple(r) for r in rows.groupBy("len").agg(F.count("*")).collect()]
    total = sum(n * max(1, -(-length // 64)) for length, n in counts)
    lengths, groups = length_groups(counts, max(1, min(room, math.ceil(total / (4 * cores**0.5)))))
    seats: list[list[tuple[int, int]]] = [[] for _ in groups]
    cells = 0
    for g, (_, longest) in enumerate(groups):
        for h in range(g, len(groups)):
            if h > g and groups[h][0] * reach > longest + 1e-6:
                break  # groups stand by their lengths
            seats[g].append((cells, 0 if h > g else 2))
            if h > g:
                seats[h].append((cells, 1))
            cells += 1
    if not cells:
        return spark.createDataFrame([], "later long, earlier long")
    dealt = F.broadcast(spark.createDataFrame(lengths, "len int, first int, parts int"))
    seated = F.broadcast(spark.createDataFrame(list(enumerate(seats)), "grp int, seats array<struct<cell: int, side: int>>"))
    placed = rows.join(dealt, "len").withColumn("grp", (F.col("first") + F.pmod(F.xxhash64("norm"), F.col("parts"))).cast("int")).join(seated, "grp")
    placed = placed.select(F.explode("seats").alias("seat"), F.col("ordinal").cast("long").alias("ordinal"), "norm").select("seat.cell", "seat.side", "ordinal", "norm")

    def compare(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("ordinal")
        side = lambda k: (x := p[p["side"] == k]) is not None and (x["ordinal"].tolist(), x["norm"].tolist())
        both, left, right = side(2), side(0), side(1)
        found = [*pairs_between(both, both, threshold), *pairs_between(left, right, threshold), *pairs_between(right, left, threshold)]
        return pd.DataFrame(found, columns=["later", "earlier"], dtype="int64")

    # few bytes but much work a cell: adaptive execution would gather them in a few tasks
    return placed.repartition(min(max(cells, cores), 4096), "cell").groupBy("cell").applyInPandas(compare, "later long, earlier long")


def greedy_kept(rows: DataFrame, pairs: DataFrame, rounds: int = 100, cut: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The ordinals that a pass in order keeps, a row going where an earlier kept one is similar.

    A row goes as soon as an earlier neighbour is kept and stays as soon as all of them have gone; each round decides
    at least the earliest open row, in practice nearly all. The state is cut off from its history every round.
    """
    cut = cut or (lambda df: df.checkpoint(eager=True))
    pairs = cut(pairs)
    later = pairs.select(F.col("later").alias("ordinal")).distinct()
    kept = rows.select("ordinal").join(later, "ordinal", "left_anti")
    open_ = cut(pairs)
    settled = cut(kept)
    for _ in range(rounds):
        if open_.isEmpty():
            return settled
        gone = open_.join(settled.select(F.col("ordinal").alias("earlier")), "earlier", "left_semi").select(F.col("later").alias("ordinal")).distinct()
        rest = open_.join(gone.select(F.col("ordinal").alias("later")), "later", "left_anti")
        waiting = rest.select("later").distinct()
        live = rest.join(gone.select(F.col("ordinal").alias("earlier")), "earlier", "left_anti")
        fresh = waiting.join(live.select("later").distinct(), "later", "left_anti").select(F.col("later").alias("ordinal"))
        settled, open_ = cut(settled.union(fresh)), cut(live)
    raise RuntimeError(f"not settled after {rounds} rounds")


def near_dedupe(new: DataFrame, existing: DataFrame | None = None, text_col: str = "description", ordinal: str = "ordinal", threshold: float = THRESHOLD, cut=None) -> DataFrame:
    """New rows that resemble neither an earlier kept one nor an existing one. Rows without a letter or digit go.

    Existing rows stay, whatever they resemble, and stand before all new ones.
    """
    rows = new.select(F.col(ordinal).alias("ordinal"), normalise(F.col(text_col)).alias("norm")).where("norm != ''")
    rows = (cut or (lambda df: df.checkpoint(eager=True)))(first_wins(rows, ["norm"]))
    if existing is not None:
        old = existing.select(normalise(F.col(text_col)).alias("norm")).where("norm != ''").distinct()
        rows = rows.join(old, "norm", "left_anti")
        old = old.select((-1 - F.pmod(F.xxhash64("norm"), F.lit(1 << 62))).alias("ordinal"), "norm")  # before all new ones
        pairs = similar_pairs(rows.unionByName(old), threshold).where("later >= 0")
        hit = pairs.where("earlier < 0").select(F.col("later").alias("ordinal")).distinct()
        rows = rows.join(hit, "ordinal", "left_anti")
        pairs = pairs.where("earlier >= 0").join(hit.select(F.col("ordinal").alias("later")), "later", "left_anti").join(hit.select(F.col("ordinal").alias("earlier")), "earlier", "left_anti")
    else:
        pairs = similar_pairs(rows, threshold)
    kept = greedy_kept(rows, pairs, cut=cut)
    return new.join(kept.select(F.col("ordinal").alias("__kept")), new[ordinal] == F.col("__kept"), "left_semi")
