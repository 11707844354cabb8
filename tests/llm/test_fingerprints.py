import hashlib
import re
from collections import Counter

from cinderloom.llm.fingerprints import fingerprint_pairs


def weights(text):
    return Counter(re.findall("[^\x20\x09-\x0d]+", text))


def jaccard(a, b):
    a, b = weights(a), weights(b)
    keys = a.keys() | b.keys()
    return sum(min(a[k], b[k]) for k in keys) / max(1, sum(max(a[k], b[k]) for k in keys))


def test_edits_and_likeness(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(rows)
    got = {r.doc_id: r for r in fingerprint_pairs(docs).collect()}
    assert len(got) == len(ids)
    off = []
    for at, i in enumerate(ids):
        t, after = rows[i], rows[ids[(at + 1) % len(ids)]]
        q = len(t) // 4
        e = t[: len(t) - q] + after[:q]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        off.append(got[i].near_edited - jaccard(t, e))
        off.append(got[i].near_next - jaccard(t, after))
    assert abs(sum(off) / len(off)) < 0.01
    assert max(map(abs, off)) < 0.45
    same = {}
    for i in ids:
        assert same.setdefault(rows[i], got[i].fingerprint) == got[i].fingerprint


def test_nulls_repeats_one_and_empty(spark):
    rows = [(None, "x y z w", 1), (1, None, 2), (1, "b b b b", 3), (1, "b b b b", 3), (7, "", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key int")
    got = sorted((r.doc_id or 0, r.n_chars, r.near_edited, r.near_next) for r in fingerprint_pairs(df).collect())
    assert got[0][:2] == (0, 7) and got[1] == (1, 0, 1.0, 1.0) and got[3][:3] == (7, 0, 1.0) and len(got) == 4
    one = fingerprint_pairs(spark.createDataFrame([(5, "a b c d e f g h")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprint_pairs(df.limit(0)).count() == 0
