import random
import re

from cinderloom.llm.line_templates import Lines, clean_lines, drop_lines


def views(line):
    """The templates of a line as tuples of tokens, by their rule: its own, then runs and combs of free positions."""
    tokens = line.split()
    masked = ["<*>" if re.search("[0-9]", t) else t for t in tokens]
    if all(t == "<*>" for t in masked):
        masked = tokens
    n, free = len(masked), int(len(masked) * 0.2 + 1e-9)
    free = min(free, max(0, n - 3))
    out = [("own", *masked)]
    if free:
        parts = -(-(n - 3) // free)
        for k in range(parts):
            out.append((f"run {k}", *("?" if i >= 3 and (i - 3) // free == k else t for i, t in enumerate(masked))))
        for k in range(parts):
            out.append((f"comb {k}", *("?" if i >= 3 and (i - 3) % parts == k else t for i, t in enumerate(masked))))
    return out


def brute(rows, limit=20):
    """What is left of each text, texts without near copies supposed."""
    seen = {}
    for _, text in rows:
        for x in (text or "").split("\n"):
            if x.split():
                for v in views(x):
                    seen.setdefault(v, set()).add(text)
    often = {v for v, texts in seen.items() if len(texts) >= limit}
    return {i: text and "\n".join(x for x in text.split("\n") if not x.split() or not often.intersection(views(x))) for i, text in rows}


def test_templates_are_those_of_the_rule():
    rnd = random.Random(9)
    lines = [" ".join(rnd.choice(["a", "b", "c", "d7", "8", "é"]) for _ in range(rnd.randrange(1, 30))) for _ in range(3000)]
    numbers, tokens, leaves = Lines().leaves("\n".join(lines) + "\n \n")
    found = Lines().templates(tokens, leaves)
    assert numbers == list(range(3000))
    by, back = {}, {}
    for x, hashes in zip(lines, found, strict=True):
        for v, h in zip(views(x), hashes.tolist(), strict=True):
            assert by.setdefault(v, h) == h and back.setdefault(h, v) == v
    assert len({(len(v), *v[1:4]) for v in by}) >= len(set(leaves))


def test_templates_generalise_variable_fields():
    of = lambda x: set(Lines().templates(*Lines().leaves(x)[1:])[0].tolist())
    assert of("user logged in here as anna from the office") & of("user logged in here as bert from the office")
    assert of("page 3 of 4 today") == of("page 17 of 21 today")
    assert not of("user logged in as anna out of the office") & of("user logged in to bert from the system")
    assert not of("1 2 3") & of("1 2 4")


def test_against_a_plain_count_of_all_lines(spark):
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    heads = [[word() for _ in range(rnd.randrange(3, 14))] for _ in range(14)]
    rows = []
    for i in range(400):
        lines = [" ".join(word() for _ in range(30))]
        for _ in range(rnd.randrange(0, 6)):
            t = list(rnd.choice(heads))
            for _ in range(rnd.randrange(0, 3)):
                t[rnd.randrange(len(t))] = rnd.choice([word(), "7", "x9"])
            lines.insert(rnd.randrange(len(lines) + 1), " ".join(t))
        rows.append((i, "\n".join(lines)))
    got = {r.doc_id: r.clean_text for r in clean_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    want = brute(rows)
    assert got == want and sum(want[i] != t for i, t in rows) > 100


def corpus():
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    line = lambda n: " ".join(word() for _ in range(n))
    rows, foot = [], {}
    for i in range(80):  # a template in its own surroundings each
        own = [line(20), line(25)]
        foot[i] = [f"Page {i} of {i + 7} printed for customer {word()} at our site today"]
        rows.append((i, "\n".join([own[0], *foot[i], own[1]]), "x"))
    body = [line(12) for _ in range(6)]
    rows += [(i, "\n".join(body), "x") for i in range(80, 140)]  # copies
    for i in range(140, 240):  # copies with edits
        b = [x.split(" ") for x in body]
        b[rnd.randrange(6)][rnd.randrange(3, 12)] = word()
        rows.append((i, "\n".join(" ".join(x) for x in b), "x"))
    rows += [(i, "\n\n" + line(9) + "\n \n", "x") for i in range(240, 260)]
    return rows


def test_templates_go_and_copies_keep_their_lines(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, _key string")
    got = {r.doc_id: r for r in clean_lines(df).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        lines = text.split("\n")
        if i < 80:
            lines = [lines[0], lines[2]]
        assert got[i].clean_text == "\n".join(lines), i
        assert got[i].n_dropped == (i < 80)
        assert got[i].n_lines == sum(bool(x.strip()) for x in text.split("\n"))
    kept = drop_lines(df)
    assert kept.columns == df.columns and kept.count() == len(rows)


def test_edge_cases(spark):
    rnd = random.Random(1)
    rows = [(None, None), (1, ""), (2, "\n"), (3, "x\n" * 3000), (3, "x\n" * 3000), (3, "y")]
    rows += [(10 + i, f"{rnd.random()}a b\nAll rights are reserved by us\n{rnd.random()}") for i in range(30)] + [(99, "All rights are reserved by us")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = clean_lines(df)
    by = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(rows) and by[None].clean_text is None and by[1].clean_text == "" and by[99].n_dropped == 1
    assert {r.doc_id for r in df.join(drop_lines(df), "doc_id", "left_anti").collect()} == {99, None}
    assert clean_lines(df.limit(0)).count() == 0


def test_fixed_passages_go_from_different_documents(spark):
    rnd = random.Random(11)
    line = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    block, head = [line(9) for _ in range(5)], line(7)
    rows = [(i, "\n".join([head, "second line of all", line(20), *block, line(20)])) for i in range(60)]
    rows += [(i, "\n".join([line(20), *block[:3], line(20)])) for i in range(60, 80)]
    body = [line(12) for _ in range(6)]
    for i in range(100, 200):  # copies with an edit each, without their original
        b = [x.split(" ") for x in body]
        b[rnd.randrange(6)][rnd.randrange(3, 12)] = line(1)
        rows.append((i, "\n".join(" ".join(x) for x in b)))
    got = {r.doc_id: r for r in clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        own = [x for x in text.split("\n") if x not in (*block, head, "second line of all")]
        assert got[i].clean_text == "\n".join(own), i
