"""A quality classifier from weak labels.

Heuristic labellers vote good (1), bad (0) or not at all (-1) on every document: for quality by symbols, repetition,
capitals, shouting, distinct words and what marks plain prose; for toxicity by a list of insults: any of them, several of them, many
for the text's length, and none in a text of plain English. Expectation-maximisation estimates each labeller's accuracy
from how the votes agree, over the counts of all vote patterns of all documents (at most 3 to the number of labellers, so the
driver's part is bounded); where a document has a label for toxicity, that is its class there, but for a small doubt. The
posterior of a document's pattern is its weak label. Posterior labels of a sample of at most ``fit_rows`` documents train a linear scorer over
hashed features, each there or not: words, their beginnings of 4, 5 and 7 letters, and the labellers' figures in
steps. Its weights are log ratios of the features' rates in the two classes, if marked and significant, under a scale and a bias
that are fitted as a logistic regression. The sample is that of the least hashes of id and text: for up to a third of it
among the documents that are likely toxic, else among those with a vote or label on toxicity, then among all; its rows weigh what
they stand for. It doesn't depend on how the rows are dealt out, nor does anything else, so equal tables give equal results.
The model (two vectors of 2^18 weights) scores every document's whole text; a document is rejected if score and posterior
both say that it is bad, or if either says that it is toxic.

Nulls count as empty texts. Documents without words get no votes; their score is the model's bias. Repeated rows give
repeated results and are in the sample once; of several labels of one id the greatest counts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, cut, documents, map_rows, table

FIT_ROWS, DIMENSIONS, LEAST, MARKED, SIGNIFICANT, DOUBT = 12_000, 1 << 18, 4, 1.5, 4.0, 0.02
#: Insults.
INSULTS = frozenset("idiot moron scum loser clown worthless pathetic trash disgusting stupid".split())
QUALITY = ("symbols", "marks", "repeats", "variety", "capitals", "shouts", "plain", "letters", "prose")
HEURISTICS = ("insults", "several", "dense", "civil")
TOXIC = (*HEURISTICS, "label")
#: Words that tell plain English, in which the insults are.
ENGLISH = frozenset("the of and to in is that it for was with are this from by".split())
_EDGES = ".,;:!?\"'()#*$%&|<>"
_SYMBOL, _MARK, _END = re.compile(r"[#*$%&|<>]"), re.compile(r"[^\w\s]"), re.compile(r"[.!?。](?:\s|$)")


def figures(text: str, words: list[str]) -> tuple[float, ...]:
    """Shares of symbols a word, marks a character, repeated windows, same words, capital words, shouts, letters a character, sentence ends a word."""
    n = len(words)
    windows = max(0, n - 4)
    repeats = 1 - len(set(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))) / windows if windows else 0.0
    symbols = len(_SYMBOL.findall(text))
    capitals = sum(map(str.isupper, words)) / n
    letters = 1 - len(_MARK.findall(text)) / len(text)
    return symbols / n, symbols / len(text), repeats, 1 - len(set(words)) / n, capitals, text.count("!!") / n, letters, len(_END.findall(text)) / n


def quality_votes(f: tuple[float, ...], n: int) -> list[int]:
    """1 good, 0 bad, -1 no vote."""
    symbols, marks, repeats, same, capitals, shouts, letters, ends = f
    bad = lambda x: 0 if x else -1
    good = lambda x: 1 if x else -1
    return [
        bad(symbols > 0.2),
        bad(marks > 0.03),
        bad(repeats > 0.2),
        bad(same > 0.65 and n < 2000),
        bad(capitals > 0.5 and n > 3),
        bad(shouts > 0.2),
        good(symbols < 0.05 and repeats < 0.05 and shouts < 0.05),
        good(letters > 0.93 and capitals < 0.2 and repeats < 0.1),
        good(0.01 < ends < 0.5 and same < 0.6 and symbols < 0.1),
    ]


def _hashed(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature.encode("utf-8", "surrogatepass")) % DIMENSIONS


def word_features(word: str) -> tuple[int, ...]:
    plain = word.strip(_EDGES)
    return (_hashed("w " + plain), _hashed("4 " + plain[:4]), _hashed("5 " + plain[:5]), *([_hashed("7 " + plain[:7])] if len(plain) > 7 else [])) if plain else (_hashed("-"),)


def document_features(f: tuple[float, ...]) -> list[int]:
    return [_hashed(f"{name} {min(9, int(10 * x))} {x > 0.05}") for name, x in enumerate(f)]


def votes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _text: its hash, the quality votes, the votes on toxicity)."""
    schema = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), T.StructField("_text", T.LongType()), *(T.StructField(c, T.IntegerType()) for c in (*QUALITY, *HEURISTICS))])

    def row(key, code, text):
        words = (text or "").split()
        if not words:
            return (key, code, *[-1] * (len(QUALITY) + len(HEURISTICS)))
        return (key, code, *quality_votes(figures(text, words), len(words)), *toxic_votes(text, words))

    return map_rows(docs.select(id_col, F.xxhash64(text_col), text_col), lambda: row, schema)


def toxic_votes(text: str, words: list[str]) -> list[int]:
    """1 toxic, 0 civil, -1 no vote."""
    small, found = text.lower(), Counter()
    if any(x in small for x in INSULTS):  # else no word is one
        found.update(x for x in (w.lower().strip(_EDGES) for w in words) if x in INSULTS)
    civil = not found and len(words) >= 20 and len(ENGLISH.intersection(words)) >= 4
    return [1 if found else -1, 1 if len(found) > 1 else -1, 1 if 200 * found.total() >= len(words) else -1, 0 if civil else -1]


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, silent: float = 0.5, rounds: int = 60, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The posterior of class 1 for each pattern (rows of votes -1, 0, 1), and p(vote | class) as [labeller, class, vote + 1].

    Not to vote is an outcome like the others. It begins with the share of votes for class 1, ``silent`` where there are none.
    ``known``: the class where it is given, else -1; its posterior stays.
    """
    patterns, counts = np.asarray(patterns, int), np.asarray(counts, float)
    n, m = patterns.shape
    said = patterns >= 0
    post = np.where(said.any(1), (patterns * said).sum(1) / np.maximum(1, said.sum(1)), silent)
    post = 0.02 + 0.96 * post
    given = np.zeros(n, bool) if known is None else known >= 0
    fixed = np.zeros(n) if known is None else np.where(known == 1, 1 - DOUBT, DOUBT)
    post = np.where(given, fixed, post)
    p = np.zeros((m, 2, 3))
    for _ in range(rounds):
        prior = ((post * counts).sum() + 1) / (counts.sum() + 2)
        for k in range(m):
            for c, w in ((0, (1 - post) * counts), (1, post * counts)):
                p[k, c] = np.bincount(patterns[:, k] + 1, w, 3) + (0.01, 1 + (c == 0), 1 + (c == 1))
                p[k, c] /= p[k, c].sum()
        log = np.tile(np.log([1 - prior, prior]), (n, 1))
        for k in range(m):
            log += np.log(p[k][:, patterns[:, k] + 1]).T
        new = np.where(given, fixed, 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50))))
        if np.abs(new - post).max() < 1e-7:
            break
        post = new
    return post, p


def posteriors(spark: SparkSession, rows: DataFrame, labellers: tuple[str, ...], out: str, silent: float, known: str | None = None) -> DataFrame:
    """A row per vote pattern with its posterior; there are at most 3 ** len(labellers). ``known``: the labeller that gives the class."""
    found = sorted(rows.groupBy(*labellers).agg(F.count("*").alias("n")).collect())
    schema = T.StructType([*(T.StructField(c, T.IntegerType()) for c in labellers), T.StructField(out, T.DoubleType())])
    if not found:
        return spark.createDataFrame([], schema)
    said = np.array([[r[c] for c in labellers if c != known] for r in found])
    post, _ = expectation_maximisation(said, np.array([r["n"] for r in found]), silent, known=np.array([r[known] for r in found]) if known else None)
    return spark.createDataFrame([(*(r[c] for c in labellers), float(x)) for r, x in zip(found, post, strict=True)], schema)


def train(features: list[np.ndarray], target: np.ndarray, dimensions: int = DIMENSIONS, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear scorer over sets of features; target: probabilities of class 1; weight: how many rows a row stands for.

    A feature weighs the log of the ratio of its rates in the two classes, if it is in enough documents and the
    ratio is marked and significant; scale and bias are then fitted as a logistic regression on the sums.
    """
    w = np.zeros(dimensions)
    if not len(features):
        return w, 0.0
    at, x = np.repeat(np.arange(len(features)), [len(f) for f in features]), np.concatenate(features)
    seen = np.bincount(x, minlength=dimensions)
    yes = np.bincount(x, target[at], dimensions)
    share = min(max(target.mean(), 1e-6), 1 - 1e-6)
    weight = np.ones(len(features)) if weight is None else weight / weight.mean()
    ratio = np.log((yes + 0.5) / (target.sum() + 1)) - np.log((seen - yes + 0.5) / ((1 - target).sum() + 1))
    z = (yes - share * seen) / np.sqrt(share * (1 - share) * seen + 1e-9)
    use = (seen >= LEAST) & (np.abs(ratio) >= MARKED) & (np.abs(z) >= SIGNIFICANT)
    w[use] = ratio[use]
    sums = np.bincount(at, w[x], len(features))
    base = np.average(target, weights=weight)
    a, b = 0.5, float(np.log((base + 1e-3) / (1 - base + 1e-3)))
    for _ in range(100):  # Newton's method, held near the start by a weak prior
        p = 1 / (1 + np.exp(-np.clip(a * sums + b, -30, 30)))
        v, e = weight * p * (1 - p), weight * (p - target)
        g = np.array([(e * sums).sum() + 0.1 * (a - 0.5), e.sum() + 0.1 * b])
        h = np.array([[(v * sums * sums).sum() + 0.1, (v * sums).sum()], [(v * sums).sum(), v.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 0.5 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return a * w, float(b)


def features_of(text: str, memo: Memo, f: tuple[float, ...]) -> set[int]:
    return set(chain.from_iterable(map(memo.__getitem__, set(text.lower().split())))).union(document_features(f))


def sample_features(docs: DataFrame, text_col: str, extra: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField("features", T.ArrayType(T.IntegerType())), *(T.StructField(c, docs.schema[c].dataType) for c in extra)])

    def make():
        memo = Memo(word_features, 100_000)

        def row(text, *rest):
            words = (text or "").split()
            if not words:
                return ([], *rest)
            return (sorted(features_of(text, memo, figures(text, words))), *rest)

        return row

    return map_rows(docs.select(text_col, *extra), make, schema)


def scored(docs: DataFrame, model: list[tuple[np.ndarray, float]], names: list[str], id_col: str, text_col: str) -> DataFrame:
    """(_id, votes, a score for each model) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), *(T.StructField(c, T.IntegerType()) for c in (*QUALITY, *HEURISTICS)), *(T.StructField(c, T.DoubleType()) for c in names)])

    def make():
        model = shared.value
        memo = Memo(word_features, 200_000)

        def row(key, text):
            words = (text or "").split()
            if not words:
                return (key, *[-1] * (len(QUALITY) + len(HEURISTICS)), *(float(1 / (1 + np.exp(-b))) for _, b in model))
            f = figures(text, words)
            x = np.sort(np.fromiter(features_of(text, memo, f), np.int64))  # in order, so that sums don't depend on the worker
            scores = (np.clip(float(w[x].sum()) + b, -30, 30) for w, b in model)
            return (key, *quality_votes(f, len(words)), *toxic_votes(text, words), *(float(1 / (1 + np.exp(-s))) for s in scores))

        return row

    return map_rows(docs.select(id_col, text_col), make, schema)


def classify(docs: DataFrame, labels: DataFrame | None = None, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, quality_posterior, quality_score, toxic_posterior, toxic_score, kept) of every row. labels: (id, toxic 0 or 1)."""
    spark = docs.sparkSession
    docs = docs.select(id_col, text_col)
    if labels is None:
        labels = spark.createDataFrame([], T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("toxic", T.IntegerType())]))
    known = labels.where(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_known")).agg(F.max("toxic").cast("int").alias("label"))
    labelled = lambda df: df.join(known, F.col("_id") == F.col("_known"), "left").drop("_known").fillna(-1, ["label"])
    rows = cut(labelled(votes(docs, id_col, text_col)))
    tables = [(F.broadcast(posteriors(spark, rows, QUALITY, "quality_posterior", 0.7)), QUALITY), (F.broadcast(posteriors(spark, rows, TOXIC, "toxic_posterior", 0.05, "label")), TOXIC)]
    judged = lambda df: df.join(tables[0][0], list(QUALITY)).join(tables[1][0], list(TOXIC))

    # the sample: a documented bound, the least hashes of each stratum
    heard = F.greatest(*HEURISTICS, "label") >= 0
    stratum = F.when(heard & (F.col("toxic_posterior") >= 0.5), 0).when(heard, 1).otherwise(2)
    pool = judged(rows).select("_id", "_text", stratum.alias("stratum"), "quality_posterior", F.when(heard, F.col("toxic_posterior")).alias("toxic_posterior"))
    sizes = {r["stratum"]: r["n"] for r in pool.groupBy("stratum").agg(F.count("*").alias("n")).collect()}
    chosen, room = None, fit_rows
    for k, most in ((0, fit_rows // 3), (1, fit_rows), (2, fit_rows)):
        part = pool.where(F.col("stratum") == k).groupBy("_id", "_text").agg(F.first("stratum").alias("stratum"), F.first("quality_posterior").alias("quality_posterior"), F.first("toxic_posterior").alias("toxic_posterior"))
        part = part.orderBy(F.xxhash64("_id", "_text"), "_id", "_text").limit(min(most, room))
        chosen = part if chosen is None else chosen.union(part)
        room -= min(most, room, sizes.get(k, 0))
    chosen = F.broadcast(cut(chosen))
    texts = docs.withColumn("_text", F.xxhash64(text_col)).join(chosen.withColumnRenamed("_id", "_of"), ["_text"]).where(F.col(id_col).eqNullSafe(F.col("_of")))
    extra = ["_text", "_of", "stratum", "quality_posterior", "toxic_posterior"]
    fit = sample_features(texts.select(text_col, *extra).dropDuplicates(["_of", "_text"]), text_col, extra).orderBy("_of", "_text").toArrow()
    features = [np.asarray(x.values, np.int64) if len(x) else np.empty(0, np.int64) for c in fit["features"].chunks for x in c]
    strata = fit["stratum"].to_numpy() if len(features) else np.zeros(0, int)
    stands = np.array([sizes.get(k, 0) / max(1, (strata == k).sum()) for k in range(3)])
    model = []
    for name in ("quality_posterior", "toxic_posterior"):
        target = fit[name].to_numpy().astype(float) if len(features) else np.zeros(0)
        use = [i for i, x in enumerate(target) if x == x and len(features[i])]
        model.append(train([features[i] for i in use], target[use], weight=stands[strata[use]] if use else None))
    done = judged(labelled(scored(docs, model, ["quality_score", "toxic_score"], id_col, text_col)))
    kept = (F.greatest("quality_score", "quality_posterior") >= 0.5) & (F.greatest("toxic_score", "toxic_posterior") < 0.5)
    return done.select(F.col("_id").alias(id_col), "quality_posterior", "quality_score", "toxic_posterior", "toxic_score", kept.alias("kept"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
