import numpy as np
from pyspark.sql import functions as F

from cinderloom.llm.quality_classifier import classify, expectation_maximisation, figures, quality_votes, toxic_votes, train


def test_estimates_the_labellers():
    rnd = np.random.default_rng(3)
    truth = rnd.random(20000) < 0.7
    right = [0.95, 0.8, 0.65, 0.9]
    votes = np.stack([np.where(rnd.random(20000) < 0.2, -1, np.where(rnd.random(20000) < r, truth, ~truth)) for r in right], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    post, p = expectation_maximisation(patterns, counts)
    for k, r in enumerate(right):
        assert abs(p[k, 1, 2] / p[k, 1, 1:].sum() - r) < 0.03
    by = {tuple(x): y for x, y in zip(patterns, post, strict=True)}
    guess = np.array([by[tuple(v)] > 0.5 for v in votes])
    best = np.mean([(truth[i] if len(set(v)) else 0) == guess[i] for i, v in enumerate(votes)])
    assert best > 0.93


def test_linear_scorer():
    rnd = np.random.default_rng(4)
    x = [np.unique(np.concatenate([rnd.integers(10, 1000, 50), [y, y + 2]])) for y in (0, 1) * 300]
    w, b = train(x, np.array([0.1, 0.9] * 300), 1024)
    score = np.array([w[f].sum() + b for f in x])
    assert ((score > 0) == (np.arange(600) % 2 == 1)).all()
    assert train([], np.zeros(0), 16)[1] == 0.0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = classify(docs, labels.where("doc_id % 2 = 0").select("doc_id", "toxic"))
    r = out.join(labels.where("doc_id % 2 = 1"), "doc_id").select((F.col("quality_score") >= 0.5).cast("int").alias("guess"), "quality", "toxic", "kept", "toxic_score").collect()
    assert np.mean([x.guess == x.quality for x in r]) > 0.93
    clean = [x for x in r if x.quality and not x.toxic]
    assert np.mean([x.kept for x in clean]) > 0.97
    assert out.count() == docs.count()


def test_edge_cases(spark):
    rows = [(None, None, 1), (1, "", 2), (2, "A plain sentence that says what it says. And another one.", 3), (2, "A plain sentence that says what it says. And another one.", 3), (3, "You pathetic idiot.", 4), (4, "x" * 100000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    got = classify(df).collect()
    assert len(got) == 6 and all(x.kept is not None for x in got)
    assert classify(df.limit(0)).count() == 0
    assert len(classify(df, spark.createDataFrame([(2, 0), (2, 1), (None, 1)], "doc_id long, toxic int")).collect()) == 6


def plain_posteriors(votes, known, silent):
    """Expectation-maximisation by loops over dictionaries, a document at a time."""
    labellers = range(len(votes[0]))
    given = [None if k < 0 else 0.98 if k else 0.02 for k in known]
    post = []
    for v, g in zip(votes, given, strict=True):
        said = [x for x in v if x >= 0]
        post.append(g if g is not None else 0.02 + 0.96 * (sum(said) / len(said) if said else silent))
    for _ in range(60):
        prior = (sum(post) + 1) / (len(post) + 2)
        table = {}
        for k in labellers:
            for c in (0, 1):
                n = {-1: 0.01, 0: 1 + (c == 0), 1: 1 + (c == 1)}
                for v, p in zip(votes, post, strict=True):
                    n[v[k]] += p if c else 1 - p
                total = sum(n.values())
                table[k, c] = {x: y / total for x, y in n.items()}
        new = []
        for v, g in zip(votes, given, strict=True):
            odds = np.log(prior / (1 - prior)) + sum(np.log(table[k, 1][v[k]] / table[k, 0][v[k]]) for k in labellers)
            new.append(g if g is not None else 1 / (1 + np.exp(-max(-50, min(50, odds)))))
        moved = max(abs(a - b) for a, b in zip(new, post, strict=True))
        if moved < 1e-7:
            break
        post = new
    return post


def test_query_by_plain_loops_and_layouts(spark, sf):
    """Posteriors of the whole table by loops; and equal results whatever the layout, with samples smaller and larger than the table."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    known = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [(r.doc_id, r.text, r.text.split()) for r in docs.collect()]
    quality = plain_posteriors([quality_votes(figures(t, w), len(w)) if w else [-1] * 9 for _, t, w in rows], [-1] * len(rows), 0.7)
    toxic = plain_posteriors([toxic_votes(t, w) if w else [-1] * 4 for _, t, w in rows], [known.get(i, -1) for i, _, _ in rows], 0.05)
    out = {r.doc_id: r for r in classify(docs, labels).collect()}
    for (i, _, _), q, t in zip(rows, quality, toxic, strict=True):
        assert abs(out[i].quality_posterior - q) < 1e-6 and abs(out[i].toxic_posterior - t) < 1e-6
        assert out[i].kept == (max(out[i].quality_score, q) >= 0.5 and max(out[i].toxic_score, t) < 0.5)
    for fit_rows in (60, 100_000):
        one, two = ({tuple(r) for r in classify(docs.repartition(n, "text"), labels.repartition(n), fit_rows).collect()} for n in (1, 7))
        assert one == two and len(one) == len(rows)
