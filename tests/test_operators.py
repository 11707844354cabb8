import difflib
import random
import re
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from cinderloom import schemas
from cinderloom.operators import cascade, dedupe, evaluate, gates, order, prompts, report, split
from cinderloom.sources import jsonl, store

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests


@pytest.fixture(scope="module")
def cut(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return lambda df: df.checkpoint(eager=True)


# --- near duplicates -------------------------------------------------------------------------------------------------


def greedy(new, existing, threshold=0.82):
    norm = lambda t: re.sub(r"\W+", " ", t.lower()).strip()
    seen, kept = [norm(e) for e in existing], []
    for i, t in new:
        n = norm(t)
        if n and not any(n == e or difflib.SequenceMatcher(None, n, e).ratio() >= threshold for e in seen):
            kept.append(i)
            seen.append(n)
    return kept


def near(spark, cut, new, existing=()):
    df = spark.createDataFrame(new, "ordinal long, description string")
    old = spark.createDataFrame([(e,) for e in existing], "description string") if existing else None
    return sorted(r.ordinal for r in dedupe.near_dedupe(df, old, cut=cut).collect())


def test_near_duplicates_as_in_order(spark, cut):
    assert near(spark, cut, [(1, "A ring spins slowly."), (2, "a ring spins slowly"), (3, "A dot jumps twice over the line")], ["A ring spins slowly"]) == [3]
    assert near(spark, cut, [(1, "same"), (2, "same"), (3, "other text"), (4, "!!!")]) == [1, 3]
    rnd = random.Random(3)
    base = ["the quick brown fox jumps over the lazy dog again and again " * k for k in (1, 2, 4)]
    new = []
    for i in range(60):
        t = list(rnd.choice(base))
        for _ in range(rnd.randrange(0, 30)):
            t[rnd.randrange(len(t))] = rnd.choice("abcdefgh ")
        new.append((i, "".join(t)))
    assert near(spark, cut, new, [base[0]]) == greedy(new, [base[0]])


def edited(rnd, texts, n):
    out = list(texts)
    while len(out) < n:
        t = list(rnd.choice(texts))
        for _ in range(rnd.randrange(1 + len(t) // 5)):
            k = rnd.randrange(len(t))
            t[k : k + rnd.randrange(3)] = rnd.choice(["", "a", "zq", "\u4e2d", "\U0001f600"])
        out.append("".join(t) or "x")
    rnd.shuffle(out)
    return out


def test_no_similar_pair_is_missed_and_few_are_compared(spark, monkeypatch):
    rnd = random.Random(8)
    pieces = "the on and tion er ing ha ou re wh ly ed".split()
    prose = lambda n: "".join(rnd.choice(pieces) + rnd.choice(["", " "]) for _ in range(n)).strip()
    wide = "".join(chr(0x4E00 + rnd.randrange(400)) for _ in range(230))  # nothing is frequent in it
    texts = edited(rnd, [*(prose(n) for n in (2, 12, 45, 70, 80, 110, 130)), wide, "a" * 250, "ab" * 90, prose(9) + wide[:199]], 110)
    texts += ["one opening for all of them " + prose(70) for _ in range(6)]
    want = {(i, j) for j, b in enumerate(texts) for i in range(j + 1, len(texts)) if texts[i] != b and difflib.SequenceMatcher(None, texts[i], b).ratio() >= 0.82}
    differing = lambda pairs: {(i, j) for i, j in pairs if texts[i] != texts[j]}
    side = (list(range(len(texts))), texts)
    assert len(want) > 50 and differing(dedupe.pairs_between(side, side, 0.82)) == want
    monkeypatch.setattr(dedupe.Earlier, "COMMON", 1)
    assert differing(dedupe.pairs_between(side, side, 0.82, at_once=3)) == want
    rows = spark.createDataFrame(list(enumerate(texts)), "ordinal long, norm string")
    assert differing(dedupe.similar_pairs(rows, room=25).collect()) == want
    unlike, asked = [prose(60) for _ in range(150)], []
    monkeypatch.setattr(dedupe, "ratios", lambda a, b, f=dedupe.ratios: (asked.append(len(a)), f(a, b))[1])
    assert dedupe.pairs_between((list(range(150)), unlike), (list(range(150)), unlike), 0.82) == [] and sum(asked) < 150


def test_no_limit_on_briefs(spark, cut, monkeypatch):
    monkeypatch.setattr(dedupe, "MOST_BRIEFS", 2, raising=False)  # over 200,000 were an error
    assert near(spark, cut, [(1, "one text"), (2, "another of them"), (3, "something else"), (4, "one texts")]) == [1, 2, 3]
    assert near(spark, cut, [(1, "..."), (2, "")]) == []


def test_groups_of_lengths_have_room():
    lengths, groups = dedupe.length_groups([(10, 5), (70, 2), (100, 30), (101, 1), (9000, 1)], 10)
    assert lengths == [(10, 0, 1), (70, 0, 1), (100, 1, 6), (101, 7, 1), (9000, 8, 1)] and groups == [(10, 70), *[(100, 100)] * 6, (101, 101), (9000, 9000)]


def test_a_row_like_only_a_dropped_one_stays(spark, cut):
    rows = spark.createDataFrame([(i,) for i in range(4)], "ordinal long")
    pairs = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "later long, earlier long")
    assert sorted(r.ordinal for r in dedupe.greedy_kept(rows, pairs, cut=cut).collect()) == [0, 2]


def test_first_wins_with_nulls(spark):
    df = spark.createDataFrame([(3, "a", None), (1, "a", None), (2, "b", "x"), (4, "b", "x")], "ordinal long, p string, c string")
    assert sorted(r.ordinal for r in dedupe.first_wins(df, ["p", "c"]).collect()) == [1, 2]


# --- cascade ---------------------------------------------------------------------------------------------------------


def block(n):
    return f'<animation index="{n}">@keyframes k{n}{{}}</animation>'


def run(spark, cut, n, tiers, size, call, ok=lambda rows: F.lit(True)):
    briefs = spark.createDataFrame([(i, f"brief {i}") for i in range(n)], "ordinal long, description string")
    calls = []

    def generate(tier, batched):
        calls.append((tier, sorted(r.n for r in batched.groupBy("batch_id").agg(F.count("*").alias("n")).collect())))
        return cascade.generator(call)(tier, batched)

    kept, stats, usage = cascade.run_cascade(briefs, tiers, size, generate, lambda rows: rows.withColumn("ok", ok(rows)), cut=cut)
    return kept, stats, usage, calls


def good(tier, briefs):
    return "\n".join(block(i + 1) for i in range(len(briefs))), {"in": 10, "out": 5}


def test_all_pass_in_the_first_tier(spark, cut):
    kept, stats, _, calls = run(spark, cut, 4, ["a", "b", "c"], 2, good)
    assert kept.count() == 4 and stats == [{"tier": "a", "attempted": 4, "kept": 4, "failed": 0}] and [t for t, _ in calls] == ["a"]


def test_unparsed_answers_escalate(spark, cut):
    kept, stats, usage, _ = run(spark, cut, 4, ["a", "b"], 2, lambda t, b: ("sorry", {"in": 1, "out": 1}) if t == "a" else good(t, b))
    assert [(s["kept"], s["failed"]) for s in stats] == [(0, 4), (4, 0)] and {r.tier for r in kept.collect()} == {"b"}
    assert {r.model for r in usage.collect()} == {"a", "b"}


def test_rejected_rows_escalate(spark, cut):
    _, stats, _, _ = run(spark, cut, 3, ["a", "b"], 2, lambda t, b: (good(t, b)[0].replace("k", "blank") if t == "a" else good(t, b)[0], {}), lambda rows: ~F.col("code").contains("blank"))
    assert [(s["kept"], s["failed"]) for s in stats] == [(0, 3), (3, 0)]


def test_only_failures_escalate(spark, cut):
    def call(tier, briefs):
        return "\n".join(block(i + 1) for i, b in enumerate(briefs) if tier == "b" or not b.endswith("0")), {}

    _, stats, _, _ = run(spark, cut, 4, ["a", "b"], 4, call)
    assert stats == [{"tier": "a", "attempted": 4, "kept": 3, "failed": 1}, {"tier": "b", "attempted": 1, "kept": 1, "failed": 0}]


def test_the_last_tier_drops(spark, cut):
    kept, stats, _, _ = run(spark, cut, 2, ["a", "b"], 2, lambda t, b: ("junk", {}))
    assert kept.count() == 0 and stats[-1]["failed"] == 2


def test_a_short_last_batch(spark, cut):
    kept, _, _, calls = run(spark, cut, 5, ["a"], 2, good)
    assert kept.count() == 5 and calls == [("a", [1, 2, 2])]


def shuffled(spark):
    """Bytes that this session has shuffled so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    return sc.statusStore().executorList(False).head().totalShuffleWrite()


def long_text(i):
    rnd = random.Random(i)
    return "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789 ") for _ in range(5000))


def test_descriptions_are_hardly_shuffled(spark, cut):
    n = 300
    briefs = spark.createDataFrame([(i, long_text(i % 290)) for i in range(n)], "ordinal long, description string")
    got = []

    def generate(tier, batched):
        got.append(batched.columns)
        said = F.when((F.lit(tier) == "a") & (F.col("origin") % 3 == 0), "").otherwise(F.concat(F.lit('<animation index="'), F.col("idx").cast("string"), F.lit('">@keyframes x{}'), F.col("origin").cast("string"), F.lit("</animation>")))
        zero = F.lit(0).cast("long")
        return batched.groupBy("batch_id").agg(F.array_join(F.collect_list(said), "").alias("text"), *(zero.alias(c) for c in ("in", "out", "cw", "cr")))

    def check(rows):
        return gates.validate(rows, lambda r: r.select("row_id", F.lit(True).alias("ok")), lambda r: r.select("row_id", (~F.col("code").endswith("5")).alias("ok")), cut=cut)

    before = shuffled(spark)
    kept, stats, _ = cascade.run_cascade(briefs, ["a", "b"], 8, generate, check, cut=cut)
    took = shuffled(spark) - before
    first = {i for i in range(n) if i % 3 and i % 10 != 5}
    second = {i for i in range(n) if i % 10 != 5} - first
    assert [(s["attempted"], s["kept"], s["failed"]) for s in stats] == [(n, len(first), n - len(first)), (n - len(first), len(second), n - len(first) - len(second))]
    texts = dict(briefs.collect())
    rows = kept.collect()
    assert {(r.tier, r.code.partition("}")[2]) for r in rows} == {("a", str(i)) for i in first} | {("b", str(i)) for i in second}
    assert all(r.description == texts[int(r.code.partition("}")[2])] for r in rows) and got[0] == ["ordinal", "origin", "description", "batch_id", "idx"]
    assert took < n * 5000 / 2


def test_a_repeated_description_fails_with_neither_parsed(spark, cut):
    rows = [(0, "same"), (1, "same"), (2, "other"), (3, None)]
    briefs = spark.createDataFrame(rows, "ordinal long, description string")
    _, stats, _ = cascade.run_cascade(briefs, ["a"], 4, lambda t, b: b.groupBy("batch_id").agg(F.lit(block(1)).alias("text"), *(F.lit(0).cast("long").alias(c) for c in ("in", "out", "cw", "cr"))), lambda r: r.withColumn("ok", F.lit(True)), cut=cut)
    assert stats == [{"tier": "a", "attempted": 4, "kept": 1, "failed": 2}]


def test_first_rows_are_found_by_digests(spark):
    df = spark.createDataFrame([(i, long_text(i % 40)) for i in range(200)], "ordinal long, t string").repartition(4).cache()
    df.count()
    before = shuffled(spark)
    assert sorted(r.ordinal for r in dedupe.first_wins(df, ["t"]).collect()) == list(range(40))
    assert shuffled(spark) - before < 200 * 5000 * 1.3


def test_prices(spark):
    usage = spark.createDataFrame([("cheap", 1_000_000, 0, 0, 0), ("dear", 1_000_000, 0, None, None), ("cached", 0, 0, 1_000_000, 1_000_000)], "model string, `in` long, out long, cw long, cr long")
    prices = spark.createDataFrame([("cheap", 1.0, 5.0)], "model string, in_price double, out_price double")
    got = {r.model: r.cost for r in cascade.cost(usage, prices).collect()}
    assert got["cheap"] + got["dear"] == pytest.approx(6.0) and got["cached"] == pytest.approx(5 * 1.35)


def test_top_up():
    said = iter([None, [], list("abc"), list("cde"), list("xyz")])
    asked = []
    out = cascade.top_up({}, 6, lambda n, turn: (asked.append(n), next(said))[1], lambda new, have: [x for x in new if x not in have], chunk=4)
    assert out["kept"] == list("abcdexyz") and asked == [4, 2, 2, 2, 1]
    assert cascade.top_up({}, 3, lambda n, t: [], lambda new, have: new, stall=4) == {"kept": [], "turns": 4, "stalled": True}


# --- gates -----------------------------------------------------------------------------------------------------------


def test_judge_sees_what_renders(spark, cut):
    rows = spark.createDataFrame([(1, True), (2, False), (3, True), (4, None)], "row_id long, r boolean")
    seen = []

    def judge(df):
        seen.extend(r.row_id for r in df.collect())
        return df.select("row_id", (F.col("row_id") != 3).alias("ok"))

    render = lambda df: df.select("row_id", F.col("r").alias("ok"))
    assert {r.row_id: r.ok for r in gates.validate(rows, render, judge, cut=cut).collect()} == {1: True, 2: False, 3: False, 4: False}
    assert sorted(set(seen)) == [1, 3]
    assert {r.row_id: r.ok for r in gates.validate(rows, render, cut=cut).collect()} == {1: True, 2: False, 3: True, 4: False}


def frame(visible, changed=0, base=0):
    return [base + 21] * changed + [base] * (100 - changed) if visible else [255] * 100


@pytest.mark.parametrize("frames, ok", [([frame(i < 3, i) for i in range(6)], False), ([frame(i < 4, i) for i in range(6)], True), ([frame(True)] * 6, False), ([frame(True), [20] * 100] * 3, False), ([frame(True), [21] * 100] * 3, True)])
def test_render_gate(spark, frames, ok):
    rows = spark.createDataFrame([(1, i, f) for i, f in enumerate(frames)], schemas.FRAMES)
    assert gates.render_verdicts(rows).first().passed == ok


# --- split -----------------------------------------------------------------------------------------------------------


def test_quantile_edges(spark):
    rnd = np.random.default_rng(0)
    for values in (rnd.integers(0, 100, 1000), np.array([5] * 10), np.array([1, 2])):
        df = spark.createDataFrame([(int(v),) for v in values], "v int")
        assert split.quantile_edges(df, "v") == pytest.approx(np.unique(np.percentile(values, [25, 50, 75])).tolist())
    assert split.quantile_edges(spark.createDataFrame([], "v int"), "v") == []


def test_split_keeps_shares(spark):
    rnd = random.Random(8)
    rows = [(i, [f"bucket:{rnd.randrange(8)}", f"source:{rnd.randrange(2)}", f"plen:{rnd.randrange(4)}", f"clen:{rnd.randrange(4)}"]) for i in range(2000)]
    df = spark.createDataFrame(rows, "key long, labels array<string>")
    out = split.stratified_split(df, "key").collect()
    assert sorted(r.key for r in out) == list(range(2000))
    assert {r.key for r in out if r.is_val} == {r.key for r in split.stratified_split(df.repartition(7), "key").collect() if r.is_val}
    shares = split.val_share(split.stratified_split(df, "key")).collect()
    achieved = sum(r.is_val for r in out) / 2000
    assert 0.15 < achieved < 0.27 and all(abs(r.share - achieved) < 0.12 and not r.skewed for r in shares if r.total >= 20)


# --- evaluation ------------------------------------------------------------------------------------------------------

GOLDEN = [  # counts of a run's records, and the rates that they must give
    (dict(n=130, raw=59, raw_ok=28, ext=52, ext_ok=22), dict(raw=(0.4538, 0.4746, 0.7846), ext=(0.4, 0.4231, 0.8308))),
    (dict(n=130, raw=62, raw_ok=43, ext=62, ext_ok=42), dict(raw=(0.4769, 0.6935, 0.6692), ext=(0.4769, 0.6774, 0.6769))),
]


@pytest.mark.parametrize("counts, want", GOLDEN)
def test_metrics(spark, counts, want):
    c = counts
    rows = [(f"d{i}", "@keyframes x{}", 2.0, 4, i < c["raw"], i < c["ext"], i < c["raw_ok"], True if i < c["ext_ok"] else None) for i in range(c["n"])]
    df = spark.createDataFrame(rows, "description string, output string, nll double, n_tokens long, render_raw boolean, render_ext boolean, match_raw boolean, match_ext boolean")
    m = evaluate.metrics(df).first()
    for got, rates in ((m.raw, want["raw"]), (m.extracted, want["ext"])):
        assert (got.render_rate, got.match_of_rendered, got.knockout_rate) == pytest.approx(rates, abs=1e-4)
    assert m.perplexity == pytest.approx(np.exp(0.5)) and m.format_valid_rate == 1.0
    plain = evaluate.metrics(df, judged=False).first()
    assert plain.raw.match_of_rendered is None and plain.raw.valid_and_match is None and plain.raw.knockout_rate == pytest.approx(1 - c["raw"] / c["n"])
    empty = evaluate.metrics(df.limit(0)).first()
    assert empty.n == 0 and empty.perplexity is None and empty.raw.render_rate is None
    shown = {r.label: r.shown for r in evaluate.compare(evaluate.metrics(df), evaluate.metrics(df.limit(0))).collect()}
    assert shown["perplexity"] == "1.649 -> n/a"


def test_cache_merge(spark):
    val = spark.createDataFrame([("a", "r1", 0), ("b", "r2", 1), ("a", "r3", 2)], "description string, reference string, ordinal long")
    cache = spark.createDataFrame([("a", 1.0, "x", 0), ("a", None, "y", 1), ("zzz", 9.0, "z", 2)], "description string, nll double, output string, ordinal long")
    got = {r.description: (r.reference, r.nll, r.output, r.ordinal) for r in evaluate.merge_cache(val, cache, ("nll", "output")).collect()}
    assert got == {"a": ("r3", 1.0, "y", 0), "b": ("r2", None, None, 1)}


def test_outcomes_and_sample(spark):
    schema = "description string, ordinal long, output string, code_ext string, render_ext boolean, match_ext boolean"
    base = spark.createDataFrame([(f"d{i}", i, "o", "", i % 2 == 0, i % 4 < 2) for i in range(40)], schema)
    tuned = spark.createDataFrame([(f"d{i}", i, None, None, i % 3 == 0, None if i % 5 == 0 else True) for i in range(1, 40)], schema)
    joined = evaluate.ab_join(base, tuned)
    counts = {r.outcome: r.n for r in evaluate.outcome_counts(joined).collect()}
    assert sum(counts.values()) == 39 and set(counts) == set(schemas.OUTCOMES)
    picked = order.sample_per_stratum(joined, "outcome", {"ftw": 3, "bop": 100, "baw": 0, "bof": 2}, "description").collect()
    by = {k: sum(r.outcome == k for r in picked) for k in schemas.OUTCOMES}
    assert by == {"ftw": 3, "bop": counts["bop"], "baw": 0, "bof": 2}
    page = report.comparison_page(joined, {"ftw": 3, "bof": 2})
    assert page.count("<figure data-outcome=") == 5 and "39 pairs, 5 shown" in page


# --- sources, order, reports -----------------------------------------------------------------------------------------


def test_jsonl(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"description": "a", "source": "own"}\n\n{"description": "b"}\n  \n')
    got = jsonl.read_jsonl(spark, str(path), schemas.struct(description=schemas.S, source=schemas.S), "hub").orderBy("ordinal").collect()
    assert [tuple(r) for r in got] == [("a", "hub", 0), ("b", "hub", 1)]
    assert jsonl.read_jsonl(spark, str(tmp_path / "none"), schemas.BRIEF, "hub").columns == ["description", "techniques", "source", "ordinal"]
    path.write_text('{"description": "a"}\n{broken\n')
    with pytest.raises(Exception, match="FAILFAST|MALFORMED|malformed"):
        jsonl.read_jsonl(spark, str(path), schemas.BRIEF).collect()
    assert jsonl.read_jsonl(spark, str(path), schemas.BRIEF, strict=False).count() == 2
    out = str(tmp_path / "out")
    jsonl.write_jsonl(spark.createDataFrame([(2, "y", None), (1, "x", 1)], "ordinal long, a string, b int"), out, "ordinal", single=True)
    assert [r.value for r in spark.read.text(out).collect()] == ['{"a":"x","b":1}', '{"a":"y"}']


def test_batches_and_reports(spark, cut):
    df = spark.range(0, 103).withColumnRenamed("id", "ordinal").repartition(5)
    got = {r.ordinal: (r.batch_id, r.idx) for r in order.batches(df, 10).collect()}
    assert got == {i: (i // 10, i % 10 + 1) for i in range(103)}
    assert [r.ordinal for r in order.tail(df, 3).collect()] == [100, 101, 102]
    rows = spark.createDataFrame([(1, ["rotate"], "t")], "ordinal long, buckets array<string>, text string")
    bars = {r.bucket: (r.n, r.bar) for r in report.bucket_report(rows).collect()}
    assert len(bars) == 16 and bars["rotate"] == (1, "") and bars["scale"] == (0, "")
    assert report.bucket_summary(rows.limit(0)).first().avg_buckets is None
    total = {r.split: r.share for r in report.profile(spark.createDataFrame([], "split string, text string")).collect()}
    assert total in ({}, {"TOTAL": None})


# --- requests, judges, stores ----------------------------------------------------------------------------------------


def test_quotas_are_those_of_single_steps():
    rnd = random.Random(17)
    for _ in range(400):
        n, val, train = rnd.randrange(1, 60), rnd.choice([rnd.randrange(-8, 30), rnd.random() * 30]), rnd.choice([rnd.randrange(-8, 30), rnd.random() * 30])
        val_all, train_all = rnd.randrange(-5, 40), rnd.randrange(-5, 40)
        wants, all_, k = {"v": val, "t": train}, {"v": val_all, "t": train_all}, 0
        for _ in range(n):
            side = "v" if (wants["v"], all_["v"]) > (wants["t"], all_["t"]) else "t"
            k += side == "v"
            wants[side] -= 1
            all_[side] -= 1
        assert split.to_val(n, val, val_all, train, train_all) == k, (n, val, train, val_all, train_all)
    assert split.quotas([(("a",), 10**9), (("b",), 5 * 10**8)], 0.2) == {("a",): 2 * 10**8, ("b",): 10**8}


def test_ranks_of_a_hot_group(spark):
    df = spark.range(5000).selectExpr("id", "CASE WHEN id % 10 < 8 THEN 'hot' ELSE 'cold' END AS g").repartition(6)
    rows = split.ranked(df, "g", order.drawn("id", 3), "rank").collect()
    for g in ("hot", "cold"):
        own = sorted((r["rank"], r.id) for r in rows if r.g == g)
        assert [x for x, _ in own] == list(range(1, len(own) + 1))
        import hashlib

        assert [i for _, i in own] == sorted((i for _, i in own), key=lambda i: hashlib.md5(f"3:{i}".encode()).hexdigest())


def test_versions_and_phases(spark, cut, tmp_path):
    schema = schemas.struct(description=schemas.S, reference=schemas.S, ordinal=schemas.L, nll=schemas.D, ok=schemas.B)
    table = store.VersionedTable(spark, str(tmp_path / "run"), schema)
    assert table.load().count() == 0 and table.versions() == []
    phases = store.PhaseStore(table)
    phases.seed(spark.createDataFrame([("a", "r1", 0), ("b", "r2", 1)], "description string, reference string, ordinal long"))
    asked = []
    produce = lambda rows: (asked.append(sorted(r.description for r in rows.collect())), rows.select("description", F.lit(1.5).alias("nll")))[1]
    phases.run("nll", produce)
    phases.run("nll", produce)
    assert asked == [["a", "b"]]
    phases.seed(spark.createDataFrame([("b", "r2", 0), ("c", "r3", 1)], "description string, reference string, ordinal long"))  # other rows, the same store
    store.PhaseStore(store.VersionedTable(spark, table.path, schema)).run("nll", produce)
    assert asked[1:] == [["c"]]
    assert {r.description: r.nll for r in table.load().collect()} == {"b": 1.5, "c": 1.5} and len(table.versions()) == 2
    broken = tmp_path / "run" / f"version={table.versions()[-1] + 1}"
    broken.mkdir()  # a writer that died
    assert table.load().count() == 2 and table.save(table.load()).count() == 2


def test_a_phase_shuffles_descriptions_once(spark, cut, tmp_path):
    n = 200
    schema = schemas.struct(description=schemas.S, reference=schemas.S, ordinal=schemas.L, nll=schemas.D)
    phases = store.PhaseStore(store.VersionedTable(spark, str(tmp_path / "run"), schema))
    rows = [(long_text(i), f"r{i}", i) for i in range(n)] + [(long_text(0), "last", n), (None, "none", n + 1)]
    phases.seed(spark.createDataFrame(rows, "description string, reference string, ordinal long"))
    before = shuffled(spark)
    with_joins = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as over large tables
    try:
        out = phases.run("nll", lambda r: r.select("description", F.col("ordinal").cast("double").alias("nll"))).collect()
        took = shuffled(spark) - before
        known = spark.createDataFrame([(long_text(1), 5, 0.5)], "description string, ordinal long, nll double")
        by_digest = known.select(F.unhex(F.sha2("description", 256)).alias("digest"), "ordinal", "nll")
        merged = [evaluate.merge_cache(phases.table.load(), c, ("nll",)).orderBy("ordinal").collect() for c in (known, by_digest)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_joins)
    assert sorted((r.ordinal, r.reference, r.nll, r.description) for r in out if r.description) == sorted((i, "last" if i == 0 else f"r{i}", float(i), long_text(i)) for i in range(n))
    assert [(r.reference, r.nll) for r in out if r.description is None] == [("none", None)]
    assert took < n * 5000 * 1.3
    assert merged[0] == merged[1] and [r.nll for r in merged[0]] == [0.5 if i == 1 else None for i in range(n + 1)]


def test_metrics_object(spark, tmp_path):
    m = spark.createDataFrame([(3, None, 0.25)], "n long, perplexity double, format_valid_rate double").withColumns({v: F.struct(F.lit(0.5).alias("render_rate"), F.lit(None).cast("double").alias("match_of_rendered"), F.lit(1.0).alias("knockout_rate")) for v in ("raw", "extracted")})
    store.write_object(m, str(tmp_path / "m"))
    back = jsonl.read_object(spark, str(tmp_path / "m"), m.schema)
    assert back.collect() == m.collect()
    assert [r.line for r in store.printed(back, "base").orderBy("line_no").collect()] == ["=== base (n=3) ===", "  perplexity n/a", "  format-valid rate 25.0%", "  [raw] render-pass 50.0%  match-of-rendered n/a  knockout 100.0%", "  [extracted] render-pass 50.0%  match-of-rendered n/a  knockout 100.0%"]


def test_judge_numbers_chunks_from_one(spark, cut, tmp_path):
    import json

    said = str(tmp_path)

    def call(request):
        import os
        import re
        import uuid

        found = re.findall(r"--- index (\d+) ---\nBRIEF: (\d+)", request)
        with open(os.path.join(said, uuid.uuid4().hex), "w") as f:
            json.dump(found, f)
        if found[0][1] == "10":
            return "not json"
        return json.dumps({"results": [{"index": int(i), "matches": int(n) % 3 == 0} for i, n in found if int(n) % 5]})

    rows = spark.createDataFrame([(i, str(i), f"code {i}") for i in range(23)], "row_id long, description string, code string").repartition(4)
    got = {r.row_id: r.ok for r in gates.judge(call, cut=cut)(rows).collect()}
    assert got == {i: i // 10 == 1 or i % 5 == 0 or i % 3 == 0 for i in range(23)}
    chunks = sorted((json.loads(p.read_text()) for p in tmp_path.iterdir()), key=lambda x: int(x[0][1]))
    assert [[int(i) for i, _ in c] for c in chunks] == [list(range(1, 11)), list(range(1, 11)), [1, 2, 3]]
    assert gates.judge(call, cut=cut)(rows.limit(0)).count() == 0


def test_requests_say_only_what_there_is(spark):
    counts = spark.createDataFrame([("rotate", 5), ("skew", 2), ("clip", 1)], "bucket string, n long")
    rows = spark.createDataFrame([(3, None, [], None), (2, "skew", ["rings", "gears"], ["one", "two"])], "n int, emphasis string, motifs array<string>, avoid array<string>")
    plain, full = (r.prompt.split("\n") for r in prompts.idea_requests(rows, counts).orderBy("n", ascending=False).collect())
    assert len(plain) == 4 and plain[0] == "Write 3 different briefs for keyframe animations."
    assert "rotate=5, translate=0" in plain[1] and plain[2].endswith("order: stroke, border_radius, color, shadow, size, background_position, staggered, clip, skew.")
    assert full[3:8] == ["In this request the kind skew should lead.", "Take subjects from: rings, gears.", "Briefs that exist and must not come again:", "- one", "- two"]
    none = spark.createDataFrame([], "ordinal long, code string, buckets array<string>")
    assert prompts.system_text("Do.", none).first().system == "Do."


def test_cascade_logs_and_retries(spark, cut, tmp_path):
    said = []
    calls = str(tmp_path)

    def call(tier, briefs):
        import os

        if not os.path.exists(f"{calls}/{briefs[0]}"):
            open(f"{calls}/{briefs[0]}", "w").close()
            raise TimeoutError
        return good(tier, briefs)

    briefs = spark.createDataFrame([(i, f"brief {i}") for i in range(5)], "ordinal long, description string")
    generate = cascade.generator(call, first_wait=0.01, retry_on=(TimeoutError,))
    _, stats, _ = cascade.run_cascade(briefs, ["a", "b"], 2, generate, lambda rows: rows.withColumn("ok", F.lit(True)), cut=cut, log=said.append)
    assert stats == [{"tier": "a", "attempted": 5, "kept": 5, "failed": 0}] and said == ["a: 5 briefs in 3 batches", "a: kept 5, failed 0"]
    with pytest.raises(Exception, match="RuntimeError"):
        cascade.generator(lambda t, b: 1 / 0 if False else (_ for _ in ()).throw(RuntimeError("no")), attempts=2, first_wait=0.01, retry_on=(RuntimeError,))("a", order.batches(briefs, 2)).collect()


def test_ungated_rows(spark):
    rows, verdicts = spark.createDataFrame([(1,), (2,)], "snippet_id long"), spark.createDataFrame([(1, True), (2, False)], "snippet_id long, passed boolean")
    assert [r.snippet_id for r in gates.rendered(rows, verdicts).collect()] == [1] and gates.rendered(rows, verdicts, check=False).count() == 2


def test_lines_keep_their_order_over_files(spark, tmp_path):
    for name, lo in (("b.jsonl", 500), ("a.jsonl", 0)):
        (tmp_path / name).write_text("".join(f'{{"description": "{i}"}}\n' for i in range(lo, lo + 500)))
    got = jsonl.read_jsonl(spark, str(tmp_path), schemas.struct(description=schemas.S)).orderBy("ordinal").collect()
    assert [(r.description, r.ordinal) for r in got] == [(str(i), i) for i in range(1000)]
