"""Token counts of whole texts, with overlap resynchronisation for huge documents.

A text of up to ``chunk`` characters is encoded at once. A longer one is encoded in overlapping
chunks with offsets; two neighbours are spliced at a token boundary that both encodings share
and that is proven stable: the character before it is a space or a line feed, which no token
of this tokenizer crosses and at which its normaliser and its pre-tokenizer start afresh, and
the tokens that follow agree in both. Where the overlap holds no such boundary it is widened
twofold, if need be to the end of the text.

Nulls count as empty texts; an empty text has no tokens. Repeated rows give repeated results,
an empty table an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, documents, map_rows

CHUNK, OVERLAP, AGREE = 32_768, 512, 4
_WIDE = re.compile("[^\x00-ſ]")
_LOADED: dict[str, WordCounter] = {}


def splice(n: int, encode, stable, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """The number of tokens of a text of n characters.

    ``encode(lo, hi)`` gives (ids, starts) of the characters from lo to hi, starts in the whole text;
    ``stable(at)`` tells whether a boundary before the character at is proven.
    """
    total, lo, since = 0, 0, 0
    hi = min(n, chunk)
    ids, starts = encode(lo, hi)
    while hi < n:
        wide, joined = overlap, None
        while joined is None:
            from_, to = max(since, hi - wide), min(n, max(hi - wide, since) + chunk + wide)
            if from_ <= since and to >= n:  # widened over all that is left
                ids, starts = encode(since, n)
                return total + len(ids)
            next_ids, next_starts = encode(from_, to)
            joined = _boundary(ids, starts, next_ids, next_starts, from_, hi, since, stable)
            wide *= 2
        left, right, since = joined
        total += left
        ids, starts, hi = next_ids[right:], next_starts[right:], to
    return total + len(ids)


def _boundary(ids, starts, next_ids, next_starts, lo, hi, since, stable):
    """(tokens on the left, tokens of the next chunk to skip, place) of the last proven common boundary."""
    places = {}
    for k, at in enumerate(starts):
        if at > max(lo, since) and at < hi and (k == 0 or starts[k - 1] != at):
            places[at] = k
    found = None
    for k, at in enumerate(next_starts):
        if at >= hi:
            break
        if at in places and stable(at) and (k == 0 or next_starts[k - 1] != at):
            mine, theirs = ids[places[at] : places[at] + AGREE], next_ids[k : k + AGREE]
            m = len(mine) - 1  # the last token of a chunk may be cut
            if m > 0 and mine[:m] == theirs[:m]:
                found = (places[at], k, at)
    return found


class WordCounter:
    """Counts of a tokenizer that drops white space; memoises the counts of the words between spaces."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.chunk, self.overlap = chunk, overlap
        self.words = Memo(lambda w: len(self.tokenizer.encode(w, add_special_tokens=False).ids))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if len(text) > self.chunk:
            return self.huge(text)
        if "<|" not in text and not _WIDE.search(text) and len(low := text.lower()) == len(text):
            text = low  # the normaliser lowers case too; fewer words to keep
        return sum(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))

    def huge(self, text: str) -> int:
        def encode(lo, hi):
            e = self.tokenizer.encode(text[lo:hi], add_special_tokens=False)
            return e.ids, [lo + a for a, _ in e.offsets]

        return splice(len(text), encode, lambda at: text[at - 1] in " \n", self.chunk, self.overlap)


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, chunk: int = CHUNK) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def make():
        counter = _LOADED.get((path, chunk)) or _LOADED.setdefault((path, chunk), WordCounter(path, chunk))

        def row(key, text):
            n = counter.count(text)
            return key, len((text or "").encode()), n, n > limit

        return row

    return map_rows(df.select(F.col(id_col), F.col(text_col)), make, schema)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
