import random
import re
from collections import Counter

from cinderloom.llm.quality_rules import keep, verdicts


def brute(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    inside = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    failed = len(w) < 10 or 100 * len(inside) > 20 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed)


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_base_counts(spark, sf):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(["a", "b", "c d", " ", "\n", "\t", "é", "#", "\x0b", "\xa0", "😀"]) for _ in range(rnd.randint(0, 60))) for _ in range(600)]
    texts += [None, "", "a " * 5000, "\n" * 50, "a b c d e", "a b c d e a b c d e"]
    texts += [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in verdicts(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t), repr(t)[:200]


def corpus():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    line = lambda n: " ".join(word() for _ in range(n))
    foot = ["Terms of use apply to all of this page now", "Copyright 2024 by us all of our rights are reserved", "Share this page with your friends on all of these sites"]
    docs = []
    for i in range(60):  # boilerplate only, but for a word
        rnd.shuffle(foot)
        docs.append((i, "\n".join([line(1), *foot, line(1)]), "h1", "x"))
    for i in range(60, 120):  # with boilerplate
        docs.append((i, "\n".join([line(30), foot[0], line(30)]), "h1", "x"))
    body = [line(12) for _ in range(6)]
    docs += [(i, "\n".join(body), "h1", "x") for i in range(120, 180)]  # exact copies
    for i in range(180, 260):  # copies with edits
        b = [x.split(" ") for x in body]
        b[rnd.randrange(6)][rnd.randrange(3, 12)] = word()
        docs.append((i, "\n".join(" ".join(x) for x in b), "h1", "x"))
    return docs


def test_depleted_documents_go_and_copies_stay(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, source string, _line string")
    kept = {r.doc_id for r in keep(df).collect()}
    assert kept == set(range(60, 260))
    got = {r.doc_id: r.n_removed_words for r in verdicts(df).collect()}
    assert got[60] > 0 and got[120] == 0 and got[200] == 0


def test_nulls_repeats_and_empty(spark):
    rows = [(None, None, None), (None, "a b c d e f g h i j", None), (1, "a b c d e f g h i j", "s"), (1, "a b c d e f g h i j", "s"), (1, "x", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((r.doc_id or 0, r.n_words, r.kept) for r in verdicts(df).collect())
    assert got == [(0, 0, False), (0, 10, True), (1, 1, False), (1, 10, True), (1, 10, True)]
    assert keep(df).count() == 3
    assert verdicts(df.limit(0)).count() == 0


def test_blocks_in_fixed_order_deplete(spark):
    rnd = random.Random(12)
    line = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    block = [line(8) for _ in range(5)]
    docs = [(i, "\n".join([*block, line(5)]), "h1") for i in range(60)]  # the block heads the text
    docs += [(i, "\n".join([line(20), *block[:3], line(20)]), "h1") for i in range(60, 80)]
    docs += [(i, "\n".join([*block, line(5)]), "h2") for i in range(80, 90)]  # too few on this host
    body = [line(12) for _ in range(6)]
    for i in range(100, 200):  # copies with an edit each, without their original
        b = [x.split(" ") for x in body]
        b[rnd.randrange(6)][rnd.randrange(3, 12)] = line(1)
        docs.append((i, "\n".join(" ".join(x) for x in b), "h1"))
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in verdicts(df).collect()}
    assert all(got[i].n_removed_words == 40 and not got[i].kept for i in range(60))
    assert all(got[i].n_removed_words == 24 and got[i].kept for i in range(60, 80))
    assert all(got[i].n_removed_words == 0 and got[i].kept for i in got if i >= 80)
    texts = {i: t for i, t, _ in docs}
    left = {r.doc_id: r.text for r in keep(df).collect()}
    assert left.keys() == {i for i in got if got[i].kept}
    assert all(left[i] == ("\n".join(x for x in texts[i].split("\n") if x not in block) if i < 80 else texts[i]) for i in left)


def normalised(line):
    return re.sub(r"\s+", " ", re.sub("[0-9]", "0", line.strip(" ").lower()))


def test_verdicts_by_a_plain_count_of_lines(spark):
    """Texts without near copies, so that documents are texts."""
    rnd = random.Random(31)
    line = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    heads = [line(rnd.randrange(2, 9)) + rnd.choice(["", " 1", " 22"]) for _ in range(12)]
    rows = []
    for i in range(500):
        parts = [line(rnd.randrange(3, 20)), *(rnd.choice(heads).replace("1", str(rnd.randrange(10))).upper() for _ in range(rnd.randrange(0, 6))), " \t", ""]
        rnd.shuffle(parts)
        rows.append((i, "\n".join(parts), rnd.choice(["h1", "h1", "h2", "h3", None])))
    rows += rnd.sample(rows, 30)
    on = {}
    for _, text, host in rows:
        for x in text.split("\n"):
            if x.split():
                on.setdefault((host, normalised(x)), set()).add(text)
    often = {k for k, texts in on.items() if len(texts) >= 20}
    got = {r.doc_id: r for r in verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    gone = 0
    for i, text, host in rows:
        removed = sum(len(x.split()) for x in text.split("\n") if x.split() and (host, normalised(x)) in often)
        n, *_, failed = brute(text)
        assert got[i].n_removed_words == removed and got[i].kept == (not failed and n - removed >= 0.3 * n), i
        gone += not failed and not got[i].kept
    assert gone > 10
