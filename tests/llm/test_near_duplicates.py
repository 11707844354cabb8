import random
import re

import numpy as np

from cinderloom.llm import near_duplicates as nd
from cinderloom.llm.common import Tables, sieve
from cinderloom.llm.components import components


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))


def brute(rows):
    """n_shingles and the least id reachable, by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w)} if len(w) == 1 else {(a, b) for a, b in zip(w, w[1:], strict=False)}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {(a, b) for ids in by.values() for a in ids for b in ids if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def result(df, **options):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.find(df, **options).collect()}


def test_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert result(docs) == brute([tuple(r) for r in docs.collect()])


def test_copies_edits_and_chains(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdef") for _ in range(5))
    rows, i = [], 0
    for n in (5, 12, 30, 80, 300):
        text = [word() for _ in range(n)]
        for _ in range(40):  # edits of one text
            t = list(text)
            for _ in range(rnd.randrange(0, max(2, n // 12))):
                t[rnd.randrange(n)] = word()
            rows.append((i := i + 1, " ".join(t)))
        for _ in range(30):  # a chain of edits
            text[rnd.randrange(n)] = word()
            rows.append((i := i + 1, " ".join(text).upper() if rnd.random() < 0.3 else "\n".join(text)))
    common = [word() for _ in range(40)]
    for _ in range(200):  # a passage in common
        own = [word() for _ in range(rnd.randrange(0, 30))]
        rows.append((i := i + 1, " ".join(common + own)))
    rows += [(i + 1, "x"), (i + 2, "X"), (i + 3, ""), (i + 4, None), (i + 5, " \n "), (i + 6, "x y"), (i + 7, "x\xa0y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df) == brute(rows)
    assert result(df, block=16, exact_block=8, block_bytes=1 << 14) == brute(rows)  # groups and clusters fall into many cells


def test_nulls_repeats_empty_and_clashes(spark):
    rows = [(None, "a b c d", 1), (3, "a b c d", 2), (3, "a b c d", 2), (4, "q r s", 3), (5, None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted(((r.doc_id or 0), r.n_shingles, r.component_id or 0, r.kept) for r in nd.find(df).collect())
    assert got == [(0, 3, 0, True), (3, 3, 0, False), (3, 3, 0, False), (4, 2, 4, True), (5, 0, 5, True)]
    kept = nd.drop_copies(df)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 4, 5]
    assert nd.find(df.limit(0)).count() == 0


def test_overlaps():
    rnd = np.random.default_rng(5)
    sets = [np.unique(rnd.integers(0, 500, n).astype(np.uint64)) for n in (1, 5, 50, 300, 300)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets[1:4]]
    assert nd.overlaps(sets[1:4], sets, 64).tolist() == want
    assert nd.overlaps([], sets).shape == (0, 5)


def test_rows_with_equal_ids_and_other_texts(spark):
    a, b = "a b c d e f g h i j k l m n", "q r s t u v w x y z"
    df = spark.createDataFrame([(1, a, {"k": 1}), (2, a, None), (2, b, None), (3, b + " one", None)], "doc_id long, text string, m map<string,int>")
    got = sorted((r.doc_id, r.component_id) for r in nd.find(df).collect())
    assert got == [(1, 1), (2, 1), (2, 1), (3, 1)]
    assert [tuple(r)[:2] for r in nd.drop_copies(df).collect()] == [(1, a)]
    rows = [(1, b, 1), (1, a, 2), (1, a, 2)]
    assert [tuple(r) for r in nd.drop_copies(spark.createDataFrame(rows, "doc_id long, text string, kept int")).collect()] == [(1, a, 2)]


def test_estimate_is_unbiased():
    rnd = np.random.default_rng(1)
    off = []
    for n in (3, 20, 200, 3000):
        for _ in range(40):
            x = rnd.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            a, b = np.unique(x[: int(1.5 * n)]), np.unique(x[n // 2 :])
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            agree = (nd.registers(a) == nd.registers(b)).sum()
            off.append(nd.estimate(np.array([agree]), np.array([len(a)]), np.array([len(b)]))[0] - j)
    assert abs(np.mean(off)) < 0.01 and np.abs(off).max() < 0.15


def test_components(spark):
    rnd = random.Random(2)
    links = [(i, i + 1) for i in range(100, 140)] + [(rnd.randrange(50), rnd.randrange(50)) for _ in range(30)] + [(7, 7)]
    up = list(range(200))
    for _ in range(200):
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    tables = Tables(spark)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long"), tables).collect()}
    assert got == {x: up[x] for a, b in links if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "u long, v long"), tables).count() == 0
    tables.drop()


def test_sieve_lets_all_keys_through(spark):
    rows = spark.range(-500, 500).selectExpr("id * id * id * 7919 AS k", "'x' AS word")
    keys = rows.where("k % 3 = 0").selectExpr("k AS key")
    got = {r.k for r in sieve(rows, "k", keys, "key").collect()}
    assert {r.key for r in keys.collect()} <= got and len(got) < 500
    assert sieve(rows, "k", keys, "key", 64).count() >= len(got) and sieve(rows, "k", keys.limit(0), "key").count() == 0
