import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cinderloom.llm.packing import ByteEncoder, difference, digest, pack, windows
from cinderloom.llm.sentencepieces import MARK, Lattice, decode, encode_nbest
from cinderloom.llm.token_counts import WordCounter, count_tokens

ODD = [None, "", " ", "\n", "  a  b ", "a\r\nb", "don't <|endoftext|> x<|startoftext|>", "é" * 700, "a" * 5000, "1" * 1000, " " * 900 + "x", ". " * 1000, "\x1c\x1d \x85a", "İΣσς", "日本語 テキスト 😀", "x\n\n\ny"]


def texts(spark, sf, seed):
    rnd = random.Random(seed)
    parts = ["ab", " ", "1", ".", "\n", "\t", "\x1c", "é", "İ", "'s", "<|endoftext|>", "  ", "!", "Σ"]
    made = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 80))) for _ in range(300)]
    return ODD + made + [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, i) for i, t in enumerate(rows)], "doc_id long, text string, n_tokens int").repartition(3)


def test_counts_are_the_librarys(spark, sf):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = texts(spark, sf, 1)
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(rows)}
    got = count_tokens(frame(spark, rows), path).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want
    assert all(r.n_bytes == len((rows[r.doc_id] or "").encode()) and r.over_limit == (r.n_tokens > 2048) for r in got)
    small = WordCounter(path, chunk=200, overlap=8)  # everything longer is spliced
    assert {i: small.count(t) for i, t in enumerate(rows)} == want
    assert count_tokens(frame(spark, rows).limit(0), path).count() == 0


def test_ids_are_the_librarys(spark, sf):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, mine = Tokenizer.from_file(path), ByteEncoder(path, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for t in texts(spark, sf, 2):
        assert np.frombuffer(mine.ids(t), "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids, repr(t)[:100]


def test_packing_is_whole_and_tight(spark, sf):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, rows = Tokenizer.from_file(path), texts(spark, sf, 3)
    packed = digest(pack(frame(spark, rows), path, public_tokenizers.path("byte_bpe_50k.tiktoken"))).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in packed:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for i, t in enumerate(rows):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    total = sum(p.length for p in packed)
    assert len(by_sequence) <= total / 2048 * 1.02 + 3 * 2


@pytest.mark.parametrize("k", [1, 2, 7, 40])
def test_differencing_gives_near_equal_sums(k):
    rnd = random.Random(k)
    sizes = [rnd.randint(1, 256) for _ in range(15 * k)]
    ways = difference(sizes, k)
    assert sorted(i for w in ways for i in w) == list(range(len(sizes))) and len(ways) == k
    sums = [sum(sizes[i] for i in w) for w in ways]
    assert max(sums) - min(sums) <= 20
    assert all(sum(sizes[i] for i in w) <= 300 for w in windows(sizes, 300))
    assert windows([], 10) == [] and windows([10], 10) == [[0]] and len(windows([6, 6, 6], 10)) == 3


def all_paths(lattice, text):
    whole = MARK + text.replace(" ", MARK)
    out = []

    def walk(i, score, ids):
        if i == len(whole):
            out.append((score, ids))
            return
        for j, more, s in lattice.edges(whole, i):
            walk(j, score + s, ids + more)

    walk(0, 0, ())
    return out


def test_n_best_against_all_paths():
    lattice, rnd = Lattice(public_tokenizers.path("piece_bpe_32k.model"), 4), random.Random(2)
    for _ in range(400):
        text = "".join(rnd.choice(["th", "e", " ", "on", "a", "in", "\n", "é", "x", ".", "²."]) for _ in range(rnd.randint(1, 6)))
        paths = all_paths(lattice, text)
        got = lattice.encode(text)
        assert [s for s, _ in got] == sorted((s for s, _ in paths), reverse=True)[:4], repr(text)
        known = {(s, np.array(ids, "<u4").tobytes()) for s, ids in paths}
        assert set(got) <= known and len(set(got)) == len(got)


def test_round_trip(spark, sf):
    path, rows = public_tokenizers.path("piece_bpe_32k.model"), texts(spark, sf, 4)
    enc = encode_nbest(frame(spark, rows), path).cache()
    assert enc.where("not round_trip").count() == 0 and enc.count() == len(rows)
    assert enc.where((F.size("nbest") > 1) & (F.col("nbest")[0]["score"] < F.col("nbest")[1]["score"])).count() == 0
    back = {r.doc_id: r.text for r in decode(enc.select("doc_id", F.col("nbest")[0]["ids"].alias("ids")), path).collect()}
    assert back == {i: t or "" for i, t in enumerate(rows)}
    assert encode_nbest(frame(spark, rows).limit(0), path).count() == 0


def test_clashing_columns_nulls_and_unbroken_texts(spark):
    """Columns named like the results' own, nulls, repeated rows, and texts of 60,000 characters without a space."""
    rnd = random.Random(5)
    long = ["a" * 60_000, "".join(rnd.choice("abcdefghij0123456789") for _ in range(60_000)), "字" * 20_000]
    rows = [(None, None), (1, ""), (2, "two words"), (2, "two words"), *((10 + i, x) for i, x in enumerate(long))]
    own = {"start": "x", "length": "y", "ids": "z", "doc_tokens": 1, "sequence_id": 2, "offset": 3, "nbest": 4, "round_trip": 5, "n_bytes": 6, "n_tokens": 7, "over_limit": 8}
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({k: F.lit(v) for k, v in own.items()})
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = ByteEncoder(path)
    want = sorted((i or 0, len(encoder.ids(t)) // 4 + 1) for i, t in rows)
    got = defaultdict(int)
    for p in pack(df, path).collect():
        got[p.doc_id or 0] += p.length
    assert got == {i: n * sum(r[0] == i for r in rows) if i else n for i, n in want}
    found = encode_nbest(df, public_tokenizers.path("piece_bpe_32k.model"), 2).collect()
    assert len(found) == len(rows) and all(r.round_trip for r in found if r.doc_id != 12) and found[0].__fields__ == ["doc_id", "nbest", "round_trip"]
    words = public_tokenizers.path("word_bpe_49k.json")
    counter = WordCounter(words, 1 << 60)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in count_tokens(df, words).collect()) == sorted((i or 0, counter.count(t)) for i, t in rows)
    for op in (lambda x: pack(x, path), lambda x: encode_nbest(x, public_tokenizers.path("piece_bpe_32k.model"), 2), lambda x: count_tokens(x, words)):
        assert op(df.limit(0)).count() == 0


def test_nodes_are_worked_out_from_the_edges_into_them():
    """Marks and spaces are one, in chunks and literally; the gap of a chunk is that of its two best paths; equal scores go by ids from the end."""
    lattice, rnd = Lattice(public_tokenizers.path("piece_bpe_32k.model"), 3), random.Random(9)
    assert lattice.split("a  b\n c ") == [" a", "  b", "\n", " c", " "] and lattice.split("a" + MARK + "b") == [" a", " b"]
    assert lattice.encode("in" + MARK + "the on") == lattice.encode("in the on")
    for _ in range(300):
        chunk = " " * rnd.randint(0, 2) + "".join(rnd.choice(["th", "e", "on", "a", "²", "in", "é", "字", "."]) for _ in range(rnd.randint(1, 6)))
        paths = sorted(((-s, ids[::-1]) for s, ids in all_paths(lattice, chunk)))
        want = [(-s, np.array(ids[::-1], "<u4").tobytes()) for s, ids in paths[:2]]
        chunk = " " + chunk
        ids, score, gap = lattice.part(chunk)
        assert (score, ids) == want[0] and (len(paths) < 2 or gap == score - want[1][0]), repr(chunk)
        best, into = lattice.viterbi(chunk)
        assert len(best) == len(into) == len(chunk) + 1 and best[-1] == score


def test_a_plain_text_is_one_call_and_keeps_no_words(spark, sf):
    """With ranks a text's ids come from one call of the library that reads them; odd texts still take the other one."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, mine = Tokenizer.from_file(path), ByteEncoder(path, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    calls, by_ranks = [], mine.by_ranks
    mine.by_ranks = lambda *a, **k: calls.append(a[0]) or by_ranks(*a, **k)
    plain = ["a", " a", "a ", "\n", "a\nb\n", "\na b", "Don't, we'll: it's 12ab34'd.", "é%&&& x***\n-- y", "ab " * 5_000 + "c", "word" * 20_000]
    odd = ["a  b", "a\n\nb", "a \nb", "x\ty", "x\xa0y", "日本", "a <|endoftext|> b"]
    for t in plain + odd:
        assert np.frombuffer(mine.ids(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)[:100]
    assert calls == plain and not mine.first and not mine.rest
