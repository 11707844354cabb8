"""Packing of documents into token windows by Karmarkar-Karp multiway differencing.

Each partition is packed by itself, as a stream, so nothing is shuffled and no task holds more
than one block of windows. A document's ids end with ``end_id`` and are cut into full windows,
which stand alone, and a rest, which is cut into pieces of at most ``piece`` ids. The pieces of a
block are given to its windows by largest differencing: partial partitions into ``k`` ways are
merged, the largest sums of one against the smallest of the other, always the two with the
largest spread, until one is left. If a window exceeds the capacity the window count rises.

Cutting rests into pieces makes sums near-equal, and a block leaves ``FREE`` ids a window free, so the count seldom rises; tests
make it rise.

Ids are those of the ``tokenizers`` library for the vocabulary at ``path``. With ``ranks_path`` texts go through ``tiktoken``, which
reads the same vocabulary as merge ranks and splits by the same pattern, so its merges are the same; the tests compare ids
over whole tables. Texts with odd white space, special strings or other scripts, where the libraries could differ, take the first one.

Nulls count as empty texts, which still have the end id. Repeated rows are packed again each;
an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import heapq
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import SLICE_ROWS, Memo, documents, give_back

WINDOW, PIECE, BLOCK, END_ID = 2048, 256, 128, 1
#: Ids that a block leaves free in each of its windows, so that near-equal sums seldom exceed the capacity.
FREE = 4
#: White space but for spaces and line feeds, what may be white space elsewhere, and all beyond Latin letters.
_ODD = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0ɐ-\U0010ffff]")
_LOADED: dict[tuple, ByteEncoder] = {}


class ByteEncoder:
    """Ids of the byte-level tokenizer, as little-endian unsigned 32-bit integers.

    Texts with other white space than single spaces and line feeds, special strings or other scripts take the
    tokenizer itself. For the rest the same vocabulary is read as ranks, which is faster, a call a text. Without
    ranks a word and the space before it are encoded once and kept: the pre-tokenizer splits there and at single line feeds.
    """

    def __init__(self, path: str, ranks_path: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_ranks = None
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.by_ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
        self.first = Memo(self.by_library, 100_000)
        self.rest = Memo(lambda w: self.by_library(" " + w))
        self.feed = self.by_library("\n")

    def by_library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def forget(self) -> None:
        """Empties the memos: a worker that goes on with another operator's tasks should not hold them."""
        self.first.forget()
        self.rest.forget()

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(x in text for x in ("  ", "\n\n", " \n", "\n ", "<|")) or _ODD.search(text):
            return self.by_library(text)
        if self.by_ranks:
            return self.by_ranks(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        first, rest, out = self.first.__getitem__, self.rest.__getitem__, []
        for line in text.split("\n"):
            words = line.split(" ")
            out.append(self.feed + first(words[0]))
            out.extend(map(rest, words[1:]))
        return b"".join(out)[len(self.feed) :]


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """The items of each of k ways, near-equal in sum, by multiway differencing.

    A partial partition is its sums less the least of them, in falling order, and a tree for each sum;
    sums that it does not list are zero and empty.
    """
    heap = [(-size, i, np.array([size]), [(i,)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    turn = len(heap)
    while len(heap) > 1:
        _, _, a, ta = heapq.heappop(heap)
        _, _, b, tb = heapq.heappop(heap)
        over = len(a) + len(b) - k
        if over <= 0:
            sums, trees = np.concatenate((a, b)), ta + tb
        else:  # the last of a, the smallest, meet the largest of b
            free = len(a) - over
            mixed = a[free:] + b[over - 1 :: -1][:over]
            sums = np.concatenate((a[:free], mixed, b[over:]))
            trees = ta[:free] + [(x, y) for x, y in zip(ta[free:], tb[over - 1 :: -1], strict=True)] + tb[over:]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        if len(sums) == k:
            sums = sums - sums[-1]
        heapq.heappush(heap, (-int(sums[0]), turn, sums, [trees[i] for i in order]))
        turn += 1
    trees = heap[0][3] if heap else []
    ways = []
    for tree in trees:
        items, todo = [], [tree]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo.extend(x)
            else:
                items.append(x)
        ways.append(sorted(items))
    return ways + [[]] * (k - len(ways))


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Ways of at most the capacity, as few as differencing finds: the count rises while one exceeds it."""
    k = max(1, math.ceil(sum(sizes) / capacity))
    while True:
        ways = difference(sizes, k)
        if all(sum(sizes[i] for i in way) <= capacity for way in ways):
            return [way for way in ways if way]
        k += 1


def pack(df: DataFrame, path: str, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, piece: int = PIECE, block: int = BLOCK, end_id: int = END_ID) -> DataFrame:
    """A row per piece: id, start, length, ids (binary), doc_tokens, sequence_id, offset."""
    long = T.LongType()
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("start", long), T.StructField("length", long), T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", long), T.StructField("sequence_id", long), T.StructField("offset", long)])
    arrow = to_arrow_schema(schema)
    end = np.array([end_id], "<u4").tobytes()
    full = block * (window - FREE)

    def run(batches):
        from pyspark import TaskContext

        encoder = _LOADED.get((path, ranks_path)) or _LOADED.setdefault((path, ranks_path), ByteEncoder(path, ranks_path))
        sequence = TaskContext.get().partitionId() << 40
        out, held, room = [], [], full

        def settle():
            nonlocal sequence, held, room
            for way in windows([x[2] for x in held], window):
                at = 0
                for i in way:
                    key, start, length, ids, tokens = held[i]
                    out.append((key, start, length, ids, tokens, sequence, at))
                    at += length
                sequence += 1
            held, room = [], full

        def flush():
            nonlocal out
            cols = list(zip(*out, strict=True))
            out = []
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE_ROWS):
                for key, text in zip(*(c.to_pylist() for c in batch.slice(lo, SLICE_ROWS).columns), strict=True):
                    ids = encoder.ids(text) + end
                    n, start = len(ids) // 4, 0
                    while start < n:
                        length = window if n - start >= window else min(piece, n - start, room)
                        got = (key, start, length, ids[4 * start : 4 * (start + length)], n)
                        if length == window:
                            out.append((*got, sequence, 0))
                            sequence += 1
                        else:
                            held.append(got)
                            room -= length
                            if not room:
                                settle()
                        start += length
                    if len(out) >= 2048:
                        yield flush()
        if held:
            settle()
        if out:
            yield flush()
        encoder.forget()
        held = None
        give_back()

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def pack_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return digest(pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
