import re
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from test_line_templates import views
from test_near_duplicates import brute as components_of
from test_personal_data import scored
from test_quality_rules import brute as base_counts
from test_quality_rules import normalised
from tokenizers import Tokenizer

import corpus_pipeline
from __spark_entry__ import queries


def redacted(text):
    out, at = "", 0
    for span, _ in scored(text):
        kind, start, end = span.split(":")
        if int(start) >= at:
            out, at = out + text[at : int(start)] + f"<{kind}>", int(end)
    return out + text[at:]


def brute(rows):
    """{doc_id: text} after the first four stages, by plain loops; groups of near copies are supposed to be under the limits."""
    on = {}
    for _, text, host in rows:
        for x in {normalised(x) for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)}:
            on.setdefault((host, x), set()).add(text)
    docs = {}
    for i, text, host in rows:
        n, *_, failed = base_counts(text)
        lines = [(x, len(on.get((host, normalised(x)), ())) >= 20) for x in (text or "").split("\n")]
        if not failed and n - sum(len(x.split()) for x, gone in lines if gone) >= 0.3 * n:
            docs[i] = "\n".join(x for x, gone in lines if not gone)
    seen = {}
    for text in docs.values():
        for v in {v for x in text.split("\n") if x.split() for v in views(x)}:
            seen.setdefault(v, set()).add(text)
    often = {v for v, texts in seen.items() if len(texts) >= 20}
    for i, text in list(docs.items()):
        lines = text.split("\n")
        left = [x for x in lines if not x.split() or not often.intersection(views(x))]
        docs[i] = "\n".join(left)
        if any(x.split() for x in lines) and not any(x.split() for x in left):
            del docs[i]
    one = components_of(list(docs.items()))
    return {i: redacted(text) for i, text in docs.items() if one[i][2]}


def test_against_plain_loops(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    want = brute(rows)
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    tokens = {i: len(tokenizer.encode(text, add_special_tokens=False).ids) + 1 for i, text in want.items()}
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert {p.doc_id: p.doc_tokens for p in pieces} == tokens
    got = Counter()
    for p in pieces:
        got[p.doc_id] += p.length
    assert got == tokens and 100 < len(want) < len(rows)


def test_nulls_in_any_column(spark):
    rows = [(None, None, None, None, None), (1, "a b c d e f g h i j k l", None, None, None), (None, "m n o p q r s t u v w x", "en", None, 3), (2, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"_text": F.lit("x"), "_key": F.lit(None).cast("int"), "__key": F.lit(7), "_gone": F.lit(0), "pii": F.lit("p"), "_digit": F.lit("d")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        was, docs = docs.columns, stage(spark, docs, None)
        assert docs.columns == was
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert sorted(((r.doc_id or 0), r.text) for r in docs.collect()) == [(0, "m n o p q r s t u v w x"), (1, "a b c d e f g h i j k l")]
    assert {(p.doc_id, p.doc_tokens) for p in corpus_pipeline.STAGES[-1][1](spark, docs, None).collect()} == {(None, 12 + 1), (1, 12 + 1)}
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, None)
        assert empty.count() == 0


def test_stages_hand_on_columns_and_pack_what_is_left(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = docs.columns
    seen = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == want
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 100
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert {tuple(r) for r in corpus_pipeline.run(spark, sf).select("doc_id", "doc_tokens").collect()} == {(p.doc_id, p.doc_tokens) for p in pieces}


def test_registered():
    names = queries()
    assert "pipeline" in names
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
