"""Datasets of the engine's shape, derived from the driver's tables by expressions that Spark and DuckDB read alike.

No document holds keyframes or fences, so code is put together from fragments chosen by divisibility of the id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.css import RULES, WHOLE_RULES
from ..schemas import BUCKETS

FRAGMENTS = (
    (2, "@keyframes spin{from{transform:rotate(0)}to{transform:scaleX(2)}}"),
    (3, "@keyframes fade{0%{opacity:0;width:1px}100%{opacity:1}}"),
    (5, ".a{color:red;animation-delay:1s}"),
    (7, ".a:hover {top:0}"),
    (13, "@keyframes go{from{transform:translateX(1px) skewY(2deg)}to{box-shadow:0 0 1px #000}}"),
    (17, "@keyframes mask{from{clip-path:none;stroke-dasharray:4}to{background-position:0 0;border-radius:4px}}"),
    (29, "<button>x</button>"),
)
OPEN = "@KEYFRAMES tint{from{background-color:red}to{background-color:blue}"


def case(k: int, text: str, other: str = "''", key: str = "doc_id") -> str:
    return f"CASE WHEN {key} % {k} = 0 THEN '{text}' ELSE {other} END"


def code_sql(key: str = "doc_id") -> str:
    parts = [case(19, "<!DOCTYPE html><html><head><title>t</title></head><body>", key=key), "'<div></div><style>'", *(case(k, x, key=key) for k, x in FRAGMENTS), case(11, OPEN, "'</style>'", key)]
    return "(" + " || ".join(parts) + ")"


def output_sql(key: str = "doc_id") -> str:
    """A model's answer: in a fence for every third, empty for every 31st."""
    code = code_sql(key)
    return f"(CASE WHEN {key} % 31 = 0 THEN '' WHEN {key} % 3 = 1 THEN 'Here:' || chr(10) || '```html' || chr(10) || {code} || chr(10) || '```' || chr(10) ELSE {code} END)"


B = "[^{}]*"
for _ in range(3):
    B = rf"(?:[^{{}}]|\{{{B}\}})*"
BLOCK = rf"(?is)@keyframes[^{{]*\{{{B}(?:\}}|\z)"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def blocks_sql(code: str) -> str:
    """For DuckDB."""
    return f"regexp_extract_all({code}, {quoted(BLOCK)})"


def buckets_sql(code: str, blocks: str) -> str:
    """For DuckDB: a list, ['other'] if nothing is found."""
    inner = f"array_to_string({blocks}, ' ')"
    found = [f"CASE WHEN regexp_matches({inner}, {quoted('(?i)' + p)}) THEN '{n}' END" for n, p in RULES]
    found += [f"CASE WHEN regexp_matches({code}, {quoted('(?i)' + p)}) THEN '{n}' END" for n, p in WHOLE_RULES] + [f"CASE WHEN len({blocks}) > 1 THEN 'multi_keyframe' END"]
    return f"list_filter([{', '.join(found)}], lambda x: x IS NOT NULL)"


def dim_sql(names, key: str = "bucket") -> str:
    return "(VALUES " + ", ".join(f"('{x}', {i})" for i, x in enumerate(names)) + f") AS dim({key}, dim_ordinal)"


CORPUS = f"corpus AS (SELECT doc_id AS ordinal, text AS description, lang AS category, source, n_chars, text, {code_sql()} AS code FROM documents)"
CLASSIFIED = f"""{CORPUS}, blocked AS (SELECT *, {blocks_sql("code")} AS blocks FROM corpus),
classified AS (SELECT * EXCLUDE (found), CASE WHEN len(found) = 0 THEN ['{BUCKETS[-1]}'] ELSE found END AS buckets FROM (SELECT *, {buckets_sql("code", "blocks")} AS found FROM blocked))"""
TURN = "conv_id * 1000 + turn"
BRIEFS = f"briefs AS (SELECT {TURN} AS ordinal, text AS description FROM conversations WHERE role = 'user')"
CHAT = f"""turns AS (SELECT u.conv_id * 1000 + u.turn AS ordinal, u.conv_id, u.text AS prompt, a.text AS reply FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant'),
chat AS (SELECT ordinal, prompt, {code_sql("ordinal")} || reply AS answer, CASE WHEN conv_id % 3 = 0 THEN 'made' ELSE 'hub' END AS source FROM turns WHERE prompt IS NOT NULL AND reply IS NOT NULL),
chat_blocked AS (SELECT *, {blocks_sql("answer")} AS blocks FROM chat),
chats AS (SELECT * EXCLUDE (found), CASE WHEN len(found) = 0 THEN ['{BUCKETS[-1]}'] ELSE found END AS buckets FROM (SELECT *, {buckets_sql("answer", "blocks")} AS found FROM chat_blocked))"""
LABELLED = "lab AS (SELECT d.doc_id, d.text, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def run_sql(name: str, twist: int) -> str:
    """An evaluation run; twist makes runs differ."""
    return f"""{name} AS (SELECT doc_id AS ordinal, text || '#' || CAST(doc_id AS VARCHAR) AS description, {output_sql()} AS output,
CAST(n_chars AS DOUBLE) * 0.37e0 AS nll, n_chars AS n_tokens, quality = 1 AND doc_id % {twist} <> 0 AS render_raw, quality = 1 OR doc_id % {twist + 1} = 0 AS render_ext,
toxic = 0 AND doc_id % {twist} <> 1 AS match_raw, toxic = 0 AS match_ext FROM lab)"""


RUNS = f"{LABELLED}, {run_sql('base', 2)}, {run_sql('tuned', 5)}"
USAGE = "usage AS (SELECT event_type AS model, CAST(floor(value * 10e0) AS BIGINT) AS tin, CAST(floor(value) AS BIGINT) AS tout, CASE WHEN event_id % 2 = 0 THEN user_id END AS cw, CASE WHEN event_id % 3 = 0 THEN event_id % 7 END AS cr FROM events)"
PRICING = "(VALUES ('view', 1e0, 5e0), ('click', 3e0, 15e0), ('error', 0.8e0, 4e0)) AS pricing(model, in_price, out_price)"
LOG = "log AS (SELECT event_id AS step, CASE WHEN event_type = 'view' THEN value END AS loss, CASE WHEN event_type = 'click' THEN value END AS eval_loss, CASE WHEN event_type = 'error' THEN value END AS learning_rate FROM events)"
FRAMES = "frames AS (SELECT vec_id // 6 AS snippet_id, vec_id % 6 AS frame_idx, list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) + 1e0) * 170e0) AS INTEGER)) AS pixels FROM embeddings)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("ordinal"), F.col("text").alias("description"), F.col("lang").alias("category"), "source", "n_chars", "text", F.expr(code_sql()).alias("code"))


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ordinal, prompt, answer, source): every user's turn with the answer that follows it."""
    said = read(spark, sf_dir, "conversations")
    asked = said.where("role = 'user'").select("conv_id", "turn", F.expr(TURN).alias("ordinal"), F.col("text").alias("prompt"))
    answered = said.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return asked.join(answered, ["conv_id", "turn"]).where("prompt is not null and reply is not null").select(
        "ordinal", "prompt", F.concat(F.expr(code_sql("ordinal")), "reply").alias("answer"), F.expr("CASE WHEN conv_id % 3 = 0 THEN 'made' ELSE 'hub' END").alias("source")
    )


def briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ordinal, description): every user's turn."""
    return read(spark, sf_dir, "conversations").where("role = 'user'").select(F.expr(TURN).alias("ordinal"), F.col("text").alias("description"))


RUN_KEY = "text || '#' || CAST(doc_id AS STRING)"


def run(spark: SparkSession, sf_dir: str, twist: int, by_digest: bool = False) -> DataFrame:
    """An evaluation run; ``by_digest`` with digests in place of the descriptions, for readers that only tell these apart."""
    from ..functions.text import digest, fenced_code

    docs = read(spark, sf_dir, "documents")
    if by_digest:  # before the join, which shuffles what it is given
        docs = docs.select("doc_id", "n_chars", digest(F.expr(RUN_KEY)).alias("digest"))
    lab = docs.join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return lab.select(
        F.col("doc_id").alias("ordinal"),
        F.col("digest") if by_digest else F.expr(RUN_KEY).alias("description"),
        F.expr(output_sql()).alias("output"),
        F.expr("CAST(n_chars AS DOUBLE) * 0.37e0").alias("nll"),
        F.col("n_chars").alias("n_tokens"),
        F.expr(f"quality = 1 AND doc_id % {twist} <> 0").alias("render_raw"),
        F.expr(f"quality = 1 OR doc_id % {twist + 1} = 0").alias("render_ext"),
        F.expr(f"toxic = 0 AND doc_id % {twist} <> 1").alias("match_raw"),
        F.expr("toxic = 0").alias("match_ext"),
    ).withColumn("code_ext", fenced_code(F.col("output")))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("event_type").alias("model"),
        F.expr("CAST(floor(value * 10e0) AS BIGINT)").alias("in"),
        F.expr("CAST(floor(value) AS BIGINT)").alias("out"),
        F.expr("CASE WHEN event_id % 2 = 0 THEN user_id END").alias("cw"),
        F.expr("CASE WHEN event_id % 3 = 0 THEN event_id % 7 END").alias("cr"),
    )


def pricing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("view", 1.0, 5.0), ("click", 3.0, 15.0), ("error", 0.8, 4.0)], "model string, in_price double, out_price double")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = lambda kind, name: F.expr(f"CASE WHEN event_type = '{kind}' THEN value END").alias(name)
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("step"), value("view", "loss"), value("click", "eval_loss"), value("error", "learning_rate"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.expr("vec_id div 6").alias("snippet_id"), F.expr("cast(vec_id % 6 as int)").alias("frame_idx"), F.expr("transform(embedding, x -> cast(floor((cast(x as double) + 1e0) * 170e0) as int))").alias("pixels"))
