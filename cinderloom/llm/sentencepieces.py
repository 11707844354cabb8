"""N-best SentencePiece encoding and decoding over the piece lattice.

Forward Viterbi scores of every lattice node are exact heuristics for a backward A-star search,
which therefore takes complete segmentations off its queue in order of score. No piece of the
vocabulary holds a word mark behind another character, and none crosses a line feed where the
vocabulary has none, so the lattice falls into chunks (a word with the marks before it) joined at
nodes that every path takes. Forward scores and the gap to the second-best path are kept per
distinct chunk; the backward search runs in those chunks alone that the N best paths of the text can
change (the N - 1 with the least gaps), and a search over their alternatives, again in order of score, joins them.

Scores are integers (millionths), so sums are exact. Equal scores: in a chunk, the path whose ids
are lexically smallest read from the end; over chunks, the change at the later place. A BPE model has merge ranks,
not probabilities: its scores are then Zipf-Mandelbrot log probabilities of the ranks; other
models' own log probabilities are taken. Characters without a piece fall back to byte pieces
at the library's penalty (10 below the lowest score).

Nulls are encoded as empty texts: no ids, one path of score 0. Repeated rows give repeated
results, an empty table an empty result; other columns of the input are ignored. Texts of fewer than N
segmentations have fewer paths.
"""

from __future__ import annotations

import heapq
import math
import re
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, documents, map_rows

MARK, N_BEST, UNIT, PENALTY, SHIFT = "▁", 3, 1_000_000, 10, 2.7
NO_GAP = 1 << 62
NONE = -(1 << 62)
#: A word with the spaces before it; the same where line feeds stand alone.
_WORDS, _CHUNKS = re.compile(" *[^ ]+| +"), re.compile(" *[^ \n]+| +|\n")
_LOADED: dict[tuple, Lattice] = {}


def pack(ids) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Lattice:
    def __init__(self, path: str, n: int = N_BEST):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.n = n
        self.bytes = {}
        plain, scores = [], {}
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                plain.append((i, piece))
                scores[i] = sp.get_score(i)
        if all(s == int(s) for s in scores.values()):  # merge ranks
            total = math.log(sum(1 / (-s + SHIFT) for s in scores.values()))
            scores = {i: -math.log(-s + SHIFT) - total for i, s in scores.items()}
        self.pieces = {piece: ((i,), round(UNIT * scores[i])) for i, piece in plain}
        self.unknown = min(s for _, s in self.pieces.values()) - PENALTY * UNIT
        self.longest = max(map(len, self.pieces))
        self.ends: dict = {}  # last character to (the characters before it, likewise, ids or None, score); word marks are spaces here
        for piece, (ids, score) in self.pieces.items():
            kids = self.ends
            for k, c in enumerate(piece.replace(MARK, " ")[::-1], 1):
                node = kids.get(c) or ({}, None, 0)
                kids[c] = node = (node[0], ids, score) if k == len(piece) else node
                kids = node[0]
        self.unk_id = sp.unk_id()
        for c, (kids, ids, _) in self.ends.items():
            if not ids:
                self.ends[c] = (kids, *self.alone(c)[1:])
        text = {i: piece.replace(MARK, " ").encode() for i, piece in plain} | {i: bytes([b]) for b, i in self.bytes.items()} | {self.unk_id: " ⁇ ".encode()}
        self.text = [text.get(i) for i in range(size)]  # None of control pieces, which no path has
        self.whole_words = not any(MARK in p.lstrip(MARK) for p in self.pieces)
        self.whole_lines = not any("\n" in p for p in self.pieces)
        joined = {b for p in self.pieces for a, b in zip(p, p[1:], strict=False) if a.isalpha()}
        self.stops = "".join(c for c in ".,!?;:" if c not in joined)
        self.chunks = Memo(self.forward, 400_000)
        self.stems = Memo(self.part, 300_000)
        self.searched = Memo(lambda chunk: self.backward(chunk, self.n), 20_000)

    def fallback(self, char: str) -> tuple[int, ...]:
        char = MARK if char == " " else char
        return tuple(self.bytes[b] for b in char.encode()) if self.bytes else (self.unk_id,)

    def edges(self, chunk: str, i: int) -> list[tuple]:
        """(end, ids, score) of the pieces that begin at i."""
        get, ahead, out = self.pieces.get, chunk[i : i + self.longest].replace(" ", MARK), []
        for k in range(1, len(ahead) + 1):
            if found := get(ahead[:k]):
                out.append((i + k, *found))
        if not out or out[0][0] > i + 1:
            out.append((i + 1, self.fallback(chunk[i]), self.unknown))
        return out

    def viterbi(self, chunk: str):
        """The best score of each node, and (score of the next best edge into it, start and ids of the best one)."""
        n, ends, longest, back = len(chunk), self.ends, self.longest, chunk[::-1]
        best, into = [0], [(NONE, 0, ())]
        for j in range(1, n + 1):  # over the edges that edges() gives
            at, start = n - j, j - 1
            kids, got, score = ends.get(back[at]) or self.alone(back[at])
            i, top, second = start, best[start] + score, NONE
            for c in back[at + 1 : at + longest]:
                node = kids.get(c)
                if node is None:  # no piece ends like this
                    break
                i -= 1
                kids, ids, score = node
                if ids:
                    x = best[i] + score
                    if x > second:
                        if x > top:
                            second, top, start, got = top, x, i, ids
                        else:
                            second = x
                            if x == top and ids[::-1] < got[::-1]:
                                start, got = i, ids
            best.append(top)
            into.append((second, start, got))
        return best, into

    def alone(self, char: str) -> tuple:
        """The node of a character that ends no piece."""
        return {}, self.fallback(char), self.unknown

    def forward(self, chunk: str):
        """(ids as bytes, score, gap to the second-best path, NO_GAP without one) of a chunk.

        Where no piece joins a letter and the marks that end the chunk, all paths pass between them, and the two parts are known apart.
        """
        stem = chunk.rstrip(self.stops)
        if len(stem) < len(chunk) and stem[-1:].isalpha():
            (a, x, g), (b, y, h) = self.stems[stem], self.stems[chunk[len(stem) :]]
            return a + b, x + y, min(g, h)
        return self.stems[chunk] if stem[-1:].isalpha() else self.part(chunk)

    def part(self, chunk: str):
        """The second-best path leaves the best one, read from the end, at the node where the next best edge loses least."""
        best, into = self.viterbi(chunk)
        ids, at, gap = [], len(chunk), NO_GAP
        while at:
            second, start, got = into[at]
            if best[at] - second < gap:
                gap = best[at] - second
            ids.append(got)
            at = start
        return pack([x for got in ids[::-1] for x in got]), best[-1], gap if gap < -NONE // 2 else NO_GAP

    def backward(self, chunk: str, n: int):
        """The n best (score, ids) of a chunk: A-star from its end, the forward scores as exact heuristics."""
        best = self.viterbi(chunk)[0]
        into: list[list] = [[] for _ in range(len(chunk) + 1)]
        for i in range(len(chunk)):
            for j, ids, score in self.edges(chunk, i):
                into[j].append((i, ids[::-1], score))
        queue, found = [(-best[-1], (), len(chunk), 0)], []
        while queue and len(found) < n:
            f, suffix, at, g = heapq.heappop(queue)
            if not at:
                found.append((-f, suffix[::-1]))
                continue
            for i, ids, score in into[at]:
                heapq.heappush(queue, (-(best[i] + g + score), suffix + ids, i, g + score))
        return found

    def split(self, text: str) -> list[str]:
        """The chunks of a text, spaces standing for word marks and one before it."""
        text = " " + (text.replace(MARK, " ") if MARK in text else text)
        if not self.whole_words:
            return [text]
        if not self.whole_lines or "\0" in text:
            chunks = _WORDS.findall(text)
            if self.whole_lines:
                chunks = [x for chunk in chunks for x in (_CHUNKS.findall(chunk) if "\0" not in chunk else (chunk,))]
            return chunks
        return _CHUNKS.findall(text)

    def encode(self, text: str | None) -> list[tuple[int, bytes]]:
        """The n best (score, ids as bytes) of a text, best first."""
        if not text:
            return [(0, b"")]
        chunks = self.split(text)
        parts, scores, gaps = zip(*map(self.chunks.__getitem__, chunks), strict=True)
        score = sum(scores)
        out = [(score, b"".join(parts))]
        places, gaps = [], list(gaps[::-1])
        for _ in range(self.n - 1):  # the least gaps, of equal ones the later
            if (gap := min(gaps)) == NO_GAP:
                break
            k = gaps.index(gap)
            gaps[k] = NO_GAP
            places.append(len(gaps) - 1 - k)
        places.sort()
        options = [self.searched[chunks[k]] for k in places]
        start = (0,) * len(places)
        queue, seen = [(0, start)], {start}
        while queue and len(out) < self.n:
            loss, at = heapq.heappop(queue)
            if loss or any(at):
                changed = list(parts)
                for k, o, i in zip(places, options, at, strict=True):
                    changed[k] = pack(o[i][1])
                out.append((score - loss, b"".join(changed)))
            for d, o in enumerate(options):
                if at[d] + 1 < len(o) and (to := (*at[:d], at[d] + 1, *at[d + 1 :])) not in seen:
                    seen.add(to)
                    heapq.heappush(queue, (loss + o[at[d]][0] - o[at[d] + 1][0], to))
        return out

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.text.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return text.decode(errors="replace")[1:]


def loaded(path: str, n: int) -> Lattice:
    return _LOADED.get((path, n)) or _LOADED.setdefault((path, n), Lattice(path, n))


def encode_nbest(df: DataFrame, path: str, n: int = N_BEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, nbest: array of (score, ids), round_trip): the paths, best first, and whether the best one decodes to the text."""
    path_type = T.StructType([T.StructField("score", T.LongType()), T.StructField("ids", T.BinaryType())])
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("nbest", T.ArrayType(path_type)), T.StructField("round_trip", T.BooleanType())])

    def make():
        lattice = loaded(path, n)

        def row(key, text):
            paths = lattice.encode(text)
            return key, [{"score": s, "ids": ids} for s, ids in paths], lattice.decode(paths[0][1]) == (text or "")

        return row

    return map_rows(df.select(F.col(id_col), F.col(text_col)), make, schema)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of ids as binary; null ids decode to an empty text."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def make():
        lattice = loaded(path, 1)
        return lambda key, ids: (key, lattice.decode(ids or b""))

    return map_rows(df.select(F.col(id_col), F.col(ids_col)), make, schema)


def op1_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = encode_nbest(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select(
        "doc_id",
        (F.length(F.col("nbest")[0]["ids"]) / 4).cast("long").alias("n_pieces"),
        F.transform("nbest", lambda x: x["score"]).alias("scores"),
        F.transform("nbest", lambda x: F.crc32(x["ids"])).alias("ids_crc32"),
        "round_trip",
    )
