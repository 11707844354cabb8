"""The registered queries: each applies an operator to a whole table, beside its SQL for DuckDB where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import chat as C
from ..functions import css, html, text
from ..operators import cascade, dedupe, evaluate, gates, order, prompts, report, split
from ..sources import jsonl, store
from . import fixtures as X
from .fixtures import BRIEFS, CHAT, CLASSIFIED, CORPUS, FRAMES, LOG, PRICING, RUNS, USAGE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


def join_list(x: str, by: str = "|") -> str:
    return f"array_to_string({x}, '{by}')"


def classified(spark, sf):
    return css.classified(X.corpus(spark, sf))


def chats(spark, sf):
    """Chat rows: ordinal, messages, buckets, source."""
    rows = css.classified(X.chat(spark, sf), "answer")
    return rows.select("ordinal", C.pair(F.col("prompt"), F.col("answer")).alias("messages"), "buckets", "source")


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the session's folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; a local session without one (tests) gets one of this machine."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        found = tempfile.mkdtemp(prefix="cinderloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def fresh(spark: SparkSession) -> str:
    """A folder of its own for a query's files."""
    import uuid

    return f"{shared_folder(spark)}/query-{uuid.uuid4().hex}"


# --- sources and sinks ----------------------------------------------------------------------------------------------


@query("s1_o1_union_of_splits", "SELECT 'train' AS split, doc_id AS ordinal, lang FROM documents UNION ALL SELECT 'validation', doc_id + 1000000000, lang FROM documents")
def s1(spark, sf):
    docs = X.read(spark, sf, "documents")
    part = lambda name, shift: docs.select(F.lit(name).alias("split"), (F.col("doc_id") + shift).alias("ordinal"), "lang")
    return part("train", 0).unionByName(part("validation", 1_000_000_000))


@query("s2_s3_jsonl_records", "SELECT doc_id AS ordinal, text AS description, 'prior' AS source FROM documents WHERE doc_id % 5 <> 0")
def s2(spark, sf):
    line = F.when(F.col("doc_id") % 5 == 0, " ").otherwise(F.to_json(F.struct(F.col("text").alias("description"), F.lit("own").alias("source"))))
    lines = X.read(spark, sf, "documents").select(F.col("doc_id").alias("ordinal"), line.alias("value"))
    return jsonl.parse_lines(lines, schemas.struct(description=schemas.S, source=schemas.S), "prior").select("ordinal", "description", "source")


@query("s4_validation_rows", f"WITH {CHAT} SELECT prompt AS description, answer AS reference, ordinal FROM chat")
def s4(spark, sf):
    return evaluate.validation_rows(chats(spark, sf))


@query("s5_w2_last_wins", "SELECT source AS description, arg_max(lang, doc_id) AS lang, arg_max(n_chars, doc_id) AS n_chars, min(doc_id) AS ordinal FROM documents GROUP BY source")
def s5(spark, sf):
    docs = X.read(spark, sf, "documents").select(F.col("source").alias("description"), "lang", "n_chars", F.col("doc_id").alias("ordinal"))
    return jsonl.last_wins(docs, "description")


@query("s7_s8_a18_done_briefs", f"WITH {CHAT} SELECT DISTINCT prompt AS description FROM chat")
def s8(spark, sf):
    return cascade.done_briefs(chats(spark, sf))


@query("s9_a1_bucket_counts", f"WITH {CLASSIFIED} SELECT bucket, count(*) AS n FROM (SELECT unnest(buckets) AS bucket FROM classified) GROUP BY bucket")
def s9(spark, sf):
    return report.bucket_counts(classified(spark, sf))


@query("s12_structured_output", "SELECT doc_id, text AS description, lang AS technique FROM documents WHERE doc_id % 4 <> 0")
def s12(spark, sf):
    good = F.to_json(F.struct(F.array(F.struct(F.col("text").alias("description"), F.array("lang").alias("techniques"))).alias("prompts")))
    answer = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("{"), "lang")).otherwise(good)
    parsed = X.read(spark, sf, "documents").select("doc_id", C.parsed_json(answer, schemas.PROMPTS_OUTPUT)["prompts"].alias("p")).where("p is not null")
    return parsed.select("doc_id", F.explode("p").alias("p")).select("doc_id", "p.description", F.get("p.techniques", F.lit(0)).alias("technique"))


@query("k1_k2_lines", "SELECT lang, n_chars, count(*) AS n, '{\"lang\":\"' || lang || '\",\"n_chars\":' || CAST(n_chars AS VARCHAR) || '}' AS line FROM documents GROUP BY lang, n_chars")
def k1(spark, sf):
    """Written as lines in order, appended to, and read again with their order."""
    docs, path = X.read(spark, sf, "documents").select("doc_id", "lang", "n_chars"), fresh(spark)
    jsonl.write_jsonl(docs.where("doc_id % 2 = 0"), path, "doc_id")
    jsonl.write_jsonl(docs.where("doc_id % 2 = 1").withColumn("n_chars", F.col("n_chars") + 0), path, "doc_id", mode="append")
    back = jsonl.read_jsonl(spark, path, schemas.struct(lang=schemas.S, n_chars=schemas.L))
    return cut(back.groupBy("lang", "n_chars").agg(F.count("*").alias("n"), F.max_by(jsonl.as_lines(back, "ordinal"), "ordinal").alias("line")))


def colour_sql(bucket: str) -> str:
    return f"CASE {bucket} {' '.join(f'WHEN {X.quoted(k)} THEN {X.quoted(v)}' for k, v in html.BUCKET_COLOURS.items())} ELSE '{html.OTHER_COLOUR}' END"


def escaped_sql(x: str) -> str:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = f"replace({x}, {X.quoted(raw)}, '{name}')"
    return x


WRAPPED = f"CASE WHEN regexp_matches(code, '(?i)<!doctype|<html[\\s>]') THEN code ELSE {X.quoted(html.WRAP_HEAD)} || code || '</body></html>' END"


@query("k6_f5_gallery_cards", f"""WITH {CLASSIFIED} SELECT ordinal, coalesce(category, '') AS category,
array_to_string(list_transform(buckets, lambda b: '<mark data-bucket="' || b || '" style="--tint:' || {colour_sql("b")} || '">' || b || '</mark>'), '') AS bucket_spans,
coalesce(description, '') AS description, replace(replace({WRAPPED}, '&', '&amp;'), '"', '&quot;') AS srcdoc,
replace(replace(CASE WHEN len(blocks) > 0 THEN array_to_string(blocks, chr(10) || chr(10)) ELSE '(none extracted)' END, '&', '&amp;'), '<', '&lt;') AS keyframes
FROM classified ORDER BY ordinal LIMIT 40""")
def k6(spark, sf):
    return report.cards(classified(spark, sf))


def pane_sql(code: str) -> str:
    document = f"(contains(lower(substr({code}, 1, 256)), '<html') OR starts_with(lower(substr({code}, 1, 64)), '<!doctype'))"
    head = f"CASE WHEN {document} THEN regexp_extract({code}, '(?is)<head[^>]*>(.*?)</head>', 1) ELSE '' END"
    body = f"CASE WHEN {document} AND regexp_matches({code}, '(?is)<body[^>]*>(.*?)</body>') THEN regexp_extract({code}, '(?is)<body[^>]*>(.*?)</body>', 1) ELSE {code} END"
    whole = f"({X.quoted(html.PANE_HEAD)} || {head} || {X.quoted(html.PANE_STYLE)} || {body} || '</body></html>')"
    return f"'<iframe srcdoc=\"' || {escaped_sql(whole)} || '\" sandbox=\"allow-scripts\" scrolling=\"no\"></iframe>'"


def badge_sql(ok: str, label: str) -> str:
    return f"'<span class=\"badge ' || CASE WHEN {ok} IS NULL THEN 'unknown\">?' WHEN {ok} THEN 'pass\">✓' ELSE 'fail\">✗' END || ' {label}</span>'"


def half_sql(side: str, title: str) -> str:
    code = f"{side}.shown"
    return f"'<section><h3>{title}</h3>' || {badge_sql(side + '.render_ext', 'Render')} || ' ' || {badge_sql(side + '.match_ext', 'Match')} || CASE WHEN trim({code}) <> '' THEN {pane_sql(code)} ELSE '<p>No output</p>' END || '<details><summary>Source</summary><pre>' || {escaped_sql(code)} || '</pre></details></section>'"


SHOWN = "SELECT *, coalesce(nullif(trim(CASE WHEN regexp_matches(output, '(?s)```[\\w-]*\\s*\\n?(.*?)```') THEN regexp_extract(output, '(?s)```[\\w-]*\\s*\\n?(.*?)```', 1) ELSE output END, chr(10) || ' '), ''), nullif(output, ''), '') AS shown, coalesce(render_ext AND match_ext, false) AS ok FROM"


@query("k7_f9_comparison_cards", f"""WITH {RUNS}, b AS ({SHOWN} base), t AS ({SHOWN} tuned),
j AS (SELECT b.description, CASE WHEN t.ok AND NOT b.ok THEN 'ftw' WHEN t.ok THEN 'bop' WHEN b.ok THEN 'baw' ELSE 'bof' END AS outcome, {half_sql("b", "Base")} || {half_sql("t", "Fine-tuned")} AS halves FROM b JOIN t ON b.description = t.description)
SELECT description, outcome, '<figure data-outcome="' || outcome || '"><figcaption>' || {escaped_sql("description")} || '</figcaption>' || halves || '</figure>' AS card FROM j""")
def k7(spark, sf):
    return report.comparison_cards(evaluate.ab_join(X.run(spark, sf, 2), X.run(spark, sf, 5)))


# --- projections and filters -----------------------------------------------------------------------------------------


@query("p1_keyframe_filter", f"WITH {CORPUS} SELECT ordinal, code FROM corpus WHERE regexp_matches(code, '(?i)@keyframes\\b')")
def p1(spark, sf):
    return X.corpus(spark, sf).where(css.has_keyframes(F.col("code"))).select("ordinal", "code")


@query("p2_row_text", "SELECT doc_id, concat_ws(chr(10), text, lang, source) AS row_text FROM documents")
def p2(spark, sf):
    docs = X.read(spark, sf, "documents")
    return docs.select("doc_id", text.row_text(docs).alias("row_text"))


@query("p3_chat_projection", f"WITH {CLASSIFIED} SELECT ordinal, description AS user_turn, code AS assistant_turn, {join_list('buckets')} AS buckets, coalesce(category, '') AS category, source FROM classified")
def p3(spark, sf):
    rows = classified(spark, sf).withColumn("messages", C.pair(F.col("description"), F.col("code")))
    return rows.select("ordinal", C.turn(F.col("messages"), 0).alias("user_turn"), C.turn(F.col("messages"), 1).alias("assistant_turn"), F.array_join("buckets", "|").alias("buckets"), F.coalesce("category", F.lit("")).alias("category"), "source")


@query("p4_generated_projection", f"WITH {CLASSIFIED} SELECT ordinal, description AS user_turn, {join_list('buckets')} AS buckets, 'generated' AS category, 'model' AS source FROM classified")
def p4(spark, sf):
    return classified(spark, sf).select("ordinal", F.col("description").alias("user_turn"), F.array_join("buckets", "|").alias("buckets"), F.lit("generated").alias("category"), F.lit("model").alias("source"))


@query("p5_inverse_projection", f"WITH {CHAT} SELECT ordinal, answer AS code, {join_list('buckets')} AS buckets, prompt AS description, 'generated' AS category FROM chats")
def p5(spark, sf):
    m = F.col("messages")
    return chats(spark, sf).select("ordinal", C.turn(m, 1).alias("code"), F.array_join(F.coalesce("buckets", F.array().cast("array<string>")), "|").alias("buckets"), C.turn(m, 0).alias("description"), F.lit("generated").alias("category"))


@query("p6_system_turn", f"WITH {CHAT} SELECT ordinal, 3 AS turns, 'system' AS first_role, 'Be brief.' AS first_content, answer AS last_content FROM chat")
def p6(spark, sf):
    m = C.with_system("Be brief.", F.col("messages"))
    return chats(spark, sf).select("ordinal", F.size(m).alias("turns"), F.get(m, F.lit(0))["role"].alias("first_role"), C.turn(m, 0).alias("first_content"), C.turn(m, 2).alias("last_content"))


@query("p7_build_messages", f"WITH {CHAT} SELECT ordinal, CASE WHEN ordinal % 2 = 0 THEN 2 ELSE 3 END AS turns, CASE WHEN ordinal % 2 = 0 THEN 'user' ELSE 'assistant' END AS last_role FROM chat")
def p7(spark, sf):
    m = C.build_messages("Be brief.", F.col("prompt"), F.when(F.col("ordinal") % 2 == 1, ""))
    return X.chat(spark, sf).select("ordinal", F.size(m).alias("turns"), F.get(m, F.size(m) - 1)["role"].alias("last_role"))


@query("p8_p9_mask_filter", f"WITH {FRAMES}, dark AS (SELECT snippet_id, avg(CASE WHEN len(list_filter(pixels, lambda p: p < 245)) / len(pixels) > 0.01 THEN 1e0 ELSE 0e0 END) AS v FROM frames GROUP BY snippet_id) SELECT snippet_id FROM dark WHERE v >= 0.6")
def p8(spark, sf):
    return gates.render_verdicts(X.frames(spark, sf)).where(F.col("visible_share") >= gates.VISIBLE).select("snippet_id")


@query("p9_gate_or_not", f"WITH {FRAMES}, m AS (SELECT snippet_id, len(list_filter(pixels, lambda p: p < 245)) / len(pixels) AS dark, pixels, lag(pixels) OVER (PARTITION BY snippet_id ORDER BY frame_idx) AS was FROM frames), g AS (SELECT snippet_id, avg(CASE WHEN dark > 0.01 THEN 1e0 ELSE 0e0 END) AS v, coalesce(max(CASE WHEN was IS NOT NULL THEN len(list_filter(list_transform(list_zip(was, pixels), lambda x: abs(x[1] - x[2])), lambda d: d > 20)) / len(pixels) END), 0) AS motion FROM m GROUP BY snippet_id) SELECT 'checked' AS mode, snippet_id FROM g WHERE v >= 0.6 AND motion >= 0.005 UNION ALL SELECT 'all', snippet_id FROM g")
def p9(spark, sf):
    frames = X.frames(spark, sf)
    rows, verdicts = frames.select("snippet_id").distinct(), gates.render_verdicts(frames)
    of = lambda mode, check: gates.rendered(rows, verdicts, check).select(F.lit(mode).alias("mode"), "snippet_id")
    return of("checked", True).union(of("all", False))


@query("p10_format_valid", f"WITH {RUNS} SELECT ordinal, regexp_matches(output, '(?i)@keyframes\\b') AND NOT contains(output, '```') AS valid FROM base")
def p10(spark, sf):
    return X.run(spark, sf, 2).select("ordinal", evaluate.format_valid(F.col("output")).alias("valid"))


DRESSED = "CASE WHEN {key} % 4 = 1 THEN {code} || '<div class=\"big btn\">' || '</div>' WHEN {key} % 4 = 2 THEN {code} || '<i class=''tiny card''></i>' ELSE {code} END"


@query("p11_ui_markers", f"SELECT ordinal AS doc_id, regexp_matches({DRESSED.format(key='ordinal', code='code')}, {X.quoted(css.UI_MARKERS)}) AS ui FROM (WITH {CORPUS} SELECT * FROM corpus)")
def p11(spark, sf):
    dressed = X.corpus(spark, sf).withColumn("dressed", F.when(F.col("ordinal") % 4 == 1, F.concat("code", F.lit('<div class="big btn"></div>'))).when(F.col("ordinal") % 4 == 2, F.concat("code", F.lit("<i class='tiny card'></i>"))).otherwise(F.col("code")))
    return dressed.select(F.col("ordinal").alias("doc_id"), css.is_interface(F.col("dressed")).alias("ui"))


@query("p12_multi_keyframe", f"WITH {CLASSIFIED} SELECT ordinal FROM classified WHERE list_contains(buckets, 'multi_keyframe')")
def p12(spark, sf):
    return classified(spark, sf).where(F.array_contains("buckets", "multi_keyframe")).select("ordinal")


@query("p13_needs_work", f"WITH {RUNS} SELECT ordinal, 'match_ext' AS field FROM base WHERE match_ext IS NULL AND coalesce(render_ext, false) UNION ALL SELECT ordinal, 'render_raw' FROM base WHERE render_raw IS NULL")
def p13(spark, sf):
    base = X.run(spark, sf, 2)
    of = lambda field, gate=None: evaluate.needed(base, field, gate).select("ordinal", F.lit(field).alias("field"))
    return of("match_ext", "render_ext").union(of("render_raw"))


@query("p14_outcome", f"WITH {RUNS} SELECT ordinal, coalesce(render_ext, false) AND coalesce(match_ext, false) AS ok FROM tuned")
def p14(spark, sf):
    return X.run(spark, sf, 5).select("ordinal", evaluate.passed(F.col("render_ext"), F.col("match_ext")).alias("ok"))


@query("p15_a12_log_series", f"WITH {LOG} SELECT 'loss' AS series, step, loss AS value FROM log WHERE loss IS NOT NULL UNION ALL SELECT 'eval_loss', step, eval_loss FROM log WHERE eval_loss IS NOT NULL UNION ALL SELECT 'learning_rate', step, learning_rate FROM log WHERE learning_rate IS NOT NULL")
def p15(spark, sf):
    return report.log_series(X.log(spark, sf))


@query("a12_loss_range", f"WITH {LOG}, v AS (SELECT unnest([loss, eval_loss]) AS x FROM log) SELECT greatest(0e0, min(x) * 0.9e0) AS low, max(x) * 1.05e0 AS high FROM v")
def a12(spark, sf):
    return report.loss_range(report.log_series(X.log(spark, sf)))


@query("p16_description_fallback", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang || ' / ' || source WHEN doc_id % 3 = 1 THEN '' ELSE text END AS description FROM documents WHERE length(text) > 0")
def p16(spark, sf):
    tags = F.when(F.col("doc_id") % 3 == 0, F.array("lang", "source")).otherwise(F.array().cast("array<string>"))
    given = F.when(F.col("doc_id") % 3 == 2, F.col("text")).when(F.col("doc_id") % 3 == 0, "")
    return X.read(spark, sf, "documents").where(F.length("text") > 0).select("doc_id", html.described(given, tags).alias("description"))


@query("p17_f11_code_fallback", f"WITH {RUNS} SELECT ordinal, coalesce(nullif(regexp_extract(output, '(?s)```[\\w-]*\\s*\\n?(.*?)\\s*```', 1), ''), output, '') AS code FROM base")
def p17(spark, sf):
    return X.run(spark, sf, 2).select("ordinal", text.first_filled(F.col("code_ext"), F.col("output")).alias("code"))


# --- joins -----------------------------------------------------------------------------------------------------------


@query("j1_o4_w7_resume", "WITH pool AS (SELECT doc_id AS ordinal, text AS description FROM documents), first AS (SELECT * FROM pool ORDER BY ordinal LIMIT 500) SELECT ordinal, description FROM first WHERE description NOT IN (SELECT description FROM pool WHERE ordinal % 3 = 0)")
def j1(spark, sf):
    pool = X.corpus(spark, sf).select("ordinal", "description")
    return cascade.resume(pool, pool.where("ordinal % 3 = 0"), 500).select("ordinal", "description")


@query("j2_s6_cache_merge", f"""WITH {RUNS}, val AS (SELECT description, output AS reference, ordinal FROM base),
cache AS (SELECT description, ordinal, CASE WHEN ordinal % 2 = 0 THEN nll END AS nll, render_ext FROM tuned UNION ALL SELECT description, ordinal + 1000000000, NULL, match_ext FROM tuned WHERE ordinal % 3 = 0),
known AS (SELECT description, arg_max(nll, ordinal) FILTER (WHERE nll IS NOT NULL) AS nll, arg_max(render_ext, ordinal) FILTER (WHERE render_ext IS NOT NULL) AS render_ext FROM cache GROUP BY description)
SELECT v.description, v.reference, v.ordinal, k.nll, k.render_ext FROM val v LEFT JOIN known k ON v.description = k.description""")
def j2(spark, sf):
    val = X.run(spark, sf, 2).select("description", F.col("output").alias("reference"), "ordinal")
    tuned = X.run(spark, sf, 5)
    cache = tuned.select("description", "ordinal", F.expr("CASE WHEN ordinal % 2 = 0 THEN nll END AS nll"), "render_ext").union(tuned.where("ordinal % 3 = 0").select("description", F.col("ordinal") + 1_000_000_000, F.lit(None).cast("double"), "match_ext"))
    return evaluate.merge_cache(val, cache, ("nll", "render_ext"))


@query("j3_o3_ab_join", f"""WITH {RUNS} SELECT b.ordinal, b.description, CASE WHEN t_ok AND NOT b_ok THEN 'ftw' WHEN t_ok THEN 'bop' WHEN b_ok THEN 'baw' ELSE 'bof' END AS outcome
FROM (SELECT *, coalesce(render_ext, false) AND coalesce(match_ext, false) AS b_ok FROM base) b JOIN (SELECT description, coalesce(render_ext, false) AND coalesce(match_ext, false) AS t_ok FROM tuned) t ON b.description = t.description""")
def j3(spark, sf):
    return evaluate.ab_join(X.run(spark, sf, 2), X.run(spark, sf, 5)).select("ordinal", "description", "outcome")


COUNTS = "counts AS (SELECT bucket, count(*) AS n FROM (SELECT unnest(buckets) AS bucket FROM classified) GROUP BY bucket)"
BUCKET_REPORT = f"WITH {CLASSIFIED}, {COUNTS} SELECT d.bucket, d.dim_ordinal, coalesce(c.n, 0) AS n, repeat('#', CAST(coalesce(c.n, 0) // 2 AS INTEGER)) AS bar FROM {X.dim_sql(schemas.BUCKETS).replace('AS dim', 'AS d')} LEFT JOIN counts c ON c.bucket = d.bucket"


@query("j4_a2_k8_bucket_report", BUCKET_REPORT)
def j4(spark, sf):
    return report.bucket_report(classified(spark, sf))


@query("a2_bucket_summary", f"WITH {CLASSIFIED} SELECT count(*) AS total, round(avg(len(buckets)), 6) AS avg_buckets FROM classified")
def a2(spark, sf):
    return report.bucket_summary(classified(spark, sf)).select("total", F.round("avg_buckets", 6).alias("avg_buckets"))


@query("j5_a9_a10_cost", f"""WITH {USAGE}, by_model AS (SELECT model, sum(tin) AS tin, sum(tout) AS tout, sum(coalesce(cw, 0)) AS cw, sum(coalesce(cr, 0)) AS cr FROM usage GROUP BY model)
SELECT u.model, round((tin * coalesce(in_price, 5e0) + cw * coalesce(in_price, 5e0) * 1.25e0 + cr * coalesce(in_price, 5e0) * 0.1e0 + tout * coalesce(out_price, 25e0)) / 1e6, 6) AS cost FROM by_model u LEFT JOIN {PRICING} ON pricing.model = u.model""")
def j5(spark, sf):
    return cascade.cost(X.usage(spark, sf), X.pricing(spark)).select("model", F.round("cost", 6).alias("cost"))


@query("a9_f26_usage_lines", f"""WITH {USAGE}, u AS (SELECT model, sum(tin) AS tin, sum(tout) AS tout, sum(coalesce(cw, 0)) AS cw, sum(coalesce(cr, 0)) AS cr FROM usage GROUP BY model)
SELECT model, '  [' || model || '] in=' || CAST(tin AS VARCHAR) || ' cache_write=' || CAST(cw AS VARCHAR) || ' cache_read=' || CAST(cr AS VARCHAR) || ' out=' || CAST(tout AS VARCHAR) AS line FROM u""")
def a9(spark, sf):
    u = cascade.usage_by_model(X.usage(spark, sf))
    return u.select("model", F.format_string("  [%s] in=%d cache_write=%d cache_read=%d out=%d", "model", "in", "cw", "cr", "out").alias("line"))


def answers(spark, sf, size: int = 8):
    """Batches of briefs, and an answer each: no block for every sixth brief, a second block for every seventh."""
    batched = cut(order.batches(X.corpus(spark, sf).select("ordinal", "description", "code"), size))
    block = lambda n, body: F.concat(F.lit('<animation index="'), n, F.lit('">\n'), body, F.lit("\n</animation>\n"))
    one = F.when(F.col("ordinal") % 6 == 0, "").otherwise(F.concat(block(F.lpad(F.col("idx").cast("string"), 2, "0"), F.col("code")), F.when(F.col("ordinal") % 7 == 0, block(F.col("idx").cast("string"), F.concat(F.lit("@keyframes z{}"), F.col("code")))).otherwise("")))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", one.alias("t")))), lambda x: x["t"]), "")
    return batched.select("ordinal", "description", "batch_id", "idx"), batched.groupBy("batch_id").agg(listed.alias("text"))


PARSED = f"""{CORPUS}, batched AS (SELECT *, (row_number() OVER (ORDER BY ordinal) - 1) // 8 AS batch_id, (row_number() OVER (ORDER BY ordinal) - 1) % 8 + 1 AS idx FROM corpus),
parsed AS (SELECT ordinal, batch_id, idx, description, CASE WHEN ordinal % 7 = 0 THEN '@keyframes z{{}}' ELSE '' END || code AS code FROM batched WHERE ordinal % 6 <> 0)"""


@query("j6_f18_index_join", f"WITH {PARSED} SELECT ordinal, batch_id, idx, code FROM parsed WHERE regexp_matches(code, '(?i)@keyframes\\b')")
def j6(spark, sf):
    batched, said = answers(spark, sf)
    return cascade.parse_answers(said, batched).select("ordinal", "batch_id", "idx", "code")


@query("j8_not_parsed", f"WITH {PARSED}, ok AS (SELECT * FROM parsed WHERE regexp_matches(code, '(?i)@keyframes\\b')) SELECT b.ordinal, b.batch_id FROM batched b WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.batch_id = b.batch_id AND ok.description = b.description)")
def j8(spark, sf):
    batched, said = answers(spark, sf)
    return cascade.not_parsed(batched, cascade.parse_answers(said, batched)).select("ordinal", "batch_id")


@query("j7_verdict_default", "WITH b AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 10 AS batch_id, (row_number() OVER (ORDER BY doc_id) - 1) % 10 + 1 AS idx FROM documents) SELECT doc_id, batch_id, idx, CASE WHEN idx % 3 = 0 THEN true WHEN idx % 2 = 0 THEN false ELSE true END AS ok FROM b")
def j7(spark, sf):
    rows = cut(order.batches(X.read(spark, sf, "documents").select("doc_id"), 10, "doc_id"))
    said = rows.where("idx % 2 = 0").select("batch_id", F.col("idx").alias("index"), F.lit(False).alias("matches"), F.lit(0).alias("at")).union(rows.where("idx % 3 = 0").select("batch_id", "idx", F.lit(True), F.lit(1)))
    return gates.judged_in_chunks(rows, said)


METRICS = """SELECT count(*) AS n, sum(nll) / sum(n_tokens) AS mean_loss, avg(CASE WHEN regexp_matches(output, '(?i)@keyframes\\b') AND NOT contains(output, '```') THEN 1e0 ELSE 0e0 END) AS format_valid,
count(*) FILTER (WHERE coalesce(render_raw, false)) AS raw_n, count(*) FILTER (WHERE coalesce(render_ext, false)) AS ext_n, count(*) FILTER (WHERE coalesce(render_raw AND match_raw, false)) AS raw_both, count(*) FILTER (WHERE coalesce(render_ext AND match_ext, false)) AS ext_both"""


@query("a5_a6_metrics", f"""WITH {RUNS}, m AS ({METRICS} FROM base) SELECT n, round(exp(mean_loss), 6) AS perplexity, round(mean_loss, 6) AS mean_loss, round(format_valid, 6) AS format_valid_rate,
raw_n AS raw_pass, raw_both, round(raw_both / raw_n, 6) AS raw_match, round(1 - raw_both / n, 6) AS raw_knockout, ext_n AS ext_pass, ext_both, round(ext_both / ext_n, 6) AS ext_match, round(1 - ext_both / n, 6) AS ext_knockout FROM m""")
def a5(spark, sf):
    m = evaluate.metrics(X.run(spark, sf, 2))
    r = lambda c, name: F.round(c, 6).alias(name)
    side = lambda v, p: [F.col(f"{v}.render_pass").alias(f"{p}_pass"), F.col(f"{v}.valid_and_match").alias(f"{p}_both"), r(f"{v}.match_of_rendered", f"{p}_match"), r(f"{v}.knockout_rate", f"{p}_knockout")]
    return m.select("n", r("perplexity", "perplexity"), r("mean_loss", "mean_loss"), r("format_valid_rate", "format_valid_rate"), *side("raw", "raw"), *side("extracted", "ext"))


def _tidy(run: str) -> str:
    return f"SELECT unnest([0, 1, 2, 3, 4, 5]) AS label_no, unnest([exp(mean_loss), format_valid, raw_n / n, 1 - raw_both / n, ext_n / n, 1 - ext_both / n]) AS value FROM ({METRICS} FROM {run})"


@query("j10_metric_compare", f"WITH {RUNS} SELECT b.label_no, round(b.value, 6) AS base, round(t.value, 6) AS tuned, round(t.value - b.value, 6) AS delta FROM ({_tidy('base')}) b JOIN ({_tidy('tuned')}) t ON b.label_no = t.label_no")
def j10(spark, sf):
    found = evaluate.compare(evaluate.metrics(X.run(spark, sf, 2)), evaluate.metrics(X.run(spark, sf, 5)))
    return found.select("label_no", *(F.round(c, 6).alias(c) for c in ("base", "tuned", "delta")))


@query("a13_pass_rates", f"WITH {RUNS} SELECT round(100 * format_valid, 6) AS format_valid, round(100 * ext_n / n, 6) AS render_extracted, round(100 * ext_both / n, 6) AS pass_extracted, round(100 * raw_n / n, 6) AS render_raw, round(100 * raw_both / n, 6) AS pass_raw FROM ({METRICS} FROM tuned)")
def a13(spark, sf):
    rates = evaluate.pass_rates(evaluate.metrics(X.run(spark, sf, 5)))
    return rates.select(*(F.round(c, 6).alias(c) for c in rates.columns))


# --- aggregates ------------------------------------------------------------------------------------------------------


@query("a3_profile", f"WITH {CORPUS} SELECT coalesce(source, 'TOTAL') AS split, count(*) AS rows, count(*) FILTER (WHERE regexp_matches(code, '(?i)@keyframes\\b')) AS matching, round(count(*) FILTER (WHERE regexp_matches(code, '(?i)@keyframes\\b')) / count(*), 6) AS share FROM corpus GROUP BY ROLLUP (source)")
def a3(spark, sf):
    return report.profile(X.corpus(spark, sf), "source", "code").withColumn("share", F.round("share", 6))


@query("a4_quantile_edges", "SELECT unnest(list_distinct([quantile_cont(n_chars, 0.25), quantile_cont(n_chars, 0.5), quantile_cont(n_chars, 0.75)])) AS edge FROM documents")
def a4(spark, sf):
    return spark.createDataFrame([(x,) for x in split.quantile_edges(X.read(spark, sf, "documents"), "n_chars", 4)], "edge double")


LABELS = f"""{CHAT}, sized AS (SELECT *, length(prompt) AS p, length(answer) AS c FROM chats),
edges AS (SELECT [quantile_cont(p, 0.25), quantile_cont(p, 0.5), quantile_cont(p, 0.75)] AS pe, [quantile_cont(c, 0.25), quantile_cont(c, 0.5), quantile_cont(c, 0.75)] AS ce FROM sized),
labelled AS (SELECT ordinal, list_distinct(list_concat(list_transform(buckets, lambda b: 'bucket:' || b), ['source:' || source, 'plen:' || CAST(len(list_filter(list_distinct(pe), lambda e: e <= p)) AS VARCHAR), 'clen:' || CAST(len(list_filter(list_distinct(ce), lambda e: e <= c)) AS VARCHAR), 'complexity:' || CAST(least(len(buckets), 5) AS VARCHAR)])) AS labels FROM sized, edges)"""


@query("f16_f17_labels", f"WITH {LABELS} SELECT ordinal, unnest(labels) AS label FROM labelled")
def f17(spark, sf):
    return split.labelled(chats(spark, sf)).select("ordinal", F.explode("labels").alias("label"))


@query("a7_label_totals", f"WITH {LABELS} SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM labelled) GROUP BY label")
def a7(spark, sf):
    return split.label_totals(split.labelled(chats(spark, sf)))


@query("a8_j11_val_share", f"""WITH {LABELS}, v AS (SELECT unnest(labels) AS label, ordinal % 5 = 0 AS is_val FROM labelled), t AS (SELECT avg(CASE WHEN ordinal % 5 = 0 THEN 1e0 ELSE 0e0 END) AS target FROM labelled)
SELECT label, count(*) AS total, count(*) FILTER (WHERE is_val) AS val, round(count(*) FILTER (WHERE is_val) / count(*), 6) AS share, abs(count(*) FILTER (WHERE is_val) / count(*) - any_value(target)) > 0.12 AS skewed FROM v, t GROUP BY label""")
def a8(spark, sf):
    rows = split.labelled(chats(spark, sf)).withColumn("is_val", F.col("ordinal") % 5 == 0)
    return split.val_share(rows).withColumn("share", F.round("share", 6))


@query("x3_o5_stratified_split")
def x3(spark, sf):
    return split.stratified_split(split.labelled(chats(spark, sf)), "ordinal").select("ordinal", "is_val")


@query("a14_outcome_counts", f"""WITH {RUNS}, j AS (SELECT coalesce(b.render_ext AND b.match_ext, false) AS b_ok, coalesce(t.render_ext AND t.match_ext, false) AS t_ok FROM base b JOIN tuned t ON b.description = t.description),
o AS (SELECT CASE WHEN t_ok AND NOT b_ok THEN 'ftw' WHEN t_ok THEN 'bop' WHEN b_ok THEN 'baw' ELSE 'bof' END AS outcome FROM j)
SELECT d.outcome, d.dim_ordinal, count(o.outcome) AS n FROM {X.dim_sql(schemas.OUTCOMES, 'outcome').replace('AS dim', 'AS d')} LEFT JOIN o ON o.outcome = d.outcome GROUP BY ALL""")
def a14(spark, sf):
    return evaluate.outcome_counts(evaluate.ab_join(X.run(spark, sf, 2), X.run(spark, sf, 5)))


@query("a15_nonwhite", f"WITH {FRAMES} SELECT snippet_id, frame_idx, round(len(list_filter(pixels, lambda p: p < 245)) / len(pixels), 6) AS dark FROM frames")
def a15(spark, sf):
    return X.frames(spark, sf).select("snippet_id", "frame_idx", F.round(gates.nonwhite(F.col("pixels")), 6).alias("dark"))


@query("a16_a17_w4_render_gate", f"""WITH {FRAMES}, m AS (SELECT snippet_id, len(list_filter(pixels, lambda p: p < 245)) / len(pixels) AS dark, pixels, lag(pixels) OVER (PARTITION BY snippet_id ORDER BY frame_idx) AS was FROM frames),
g AS (SELECT snippet_id, avg(CASE WHEN dark > 0.01 THEN 1e0 ELSE 0e0 END) AS v, coalesce(max(CASE WHEN was IS NOT NULL THEN len(list_filter(list_transform(list_zip(was, pixels), lambda x: abs(x[1] - x[2])), lambda d: d > 20)) / len(pixels) END), 0) AS motion FROM m GROUP BY snippet_id)
SELECT snippet_id, round(v, 6) AS visible_share, round(motion, 6) AS motion, v >= 0.6 AND motion >= 0.005 AS passed FROM g""")
def a16(spark, sf):
    return gates.render_verdicts(X.frames(spark, sf)).select("snippet_id", F.round("visible_share", 6).alias("visible_share"), F.round("motion", 6).alias("motion"), "passed")


@query("a20_dropped_rows", "SELECT count(*) AS before, count(DISTINCT text) AS after, count(*) - count(DISTINCT text) AS dropped FROM documents")
def a20(spark, sf):
    docs = X.read(spark, sf, "documents")
    kept = dedupe.first_wins(docs, ["text"], "doc_id").agg(F.count("*").alias("after"))
    return docs.agg(F.count("*").alias("before")).join(F.broadcast(kept)).withColumn("dropped", F.col("before") - F.col("after"))


# --- order -----------------------------------------------------------------------------------------------------------


@query("w1_x1_exact_dedupe", "SELECT min(doc_id) AS doc_id, text AS prompt, lang FROM documents GROUP BY 2, 3")
def w1(spark, sf):
    rows = X.read(spark, sf, "documents").select("doc_id", F.col("text").alias("prompt"), "lang")
    return dedupe.first_wins(rows, ["prompt", "lang"], "doc_id")


@query("w3_f20_batches", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 25 AS batch_id, (row_number() OVER (ORDER BY doc_id) - 1) % 25 + 1 AS idx FROM documents")
def w3(spark, sf):
    return order.batches(X.read(spark, sf, "documents").select("doc_id"), 25, "doc_id")


@query("w5_few_shot", f"WITH {CLASSIFIED} SELECT ordinal, len(buckets) AS n_buckets FROM classified WHERE list_contains(buckets, 'multi_keyframe') AND NOT regexp_matches(code, {X.quoted(css.UI_MARKERS)}) ORDER BY len(buckets) DESC, ordinal LIMIT 2")
def w5(spark, sf):
    return report.few_shot(classified(spark, sf)).select("ordinal", F.size("buckets").alias("n_buckets"))


@query("w6_underrepresented", f"WITH {CLASSIFIED}, {COUNTS} SELECT d.bucket, d.dim_ordinal, coalesce(c.n, 0) AS n FROM {X.dim_sql(schemas.FOCUS_BUCKETS).replace('AS dim', 'AS d')} LEFT JOIN counts c ON c.bucket = d.bucket")
def w6(spark, sf):
    return report.underrepresented(report.bucket_counts(classified(spark, sf)))


@query("w8_tail", "SELECT doc_id, lang FROM documents ORDER BY doc_id DESC LIMIT 60")
def w8(spark, sf):
    return order.tail(X.read(spark, sf, "documents").select("doc_id", "lang"), 60, "doc_id")


@query("w9_stratified_sample", f"""WITH {RUNS}, j AS (SELECT b.description, coalesce(b.render_ext AND b.match_ext, false) AS b_ok, coalesce(t.render_ext AND t.match_ext, false) AS t_ok FROM base b JOIN tuned t ON b.description = t.description),
o AS (SELECT description, CASE WHEN t_ok AND NOT b_ok THEN 'ftw' WHEN t_ok THEN 'bop' WHEN b_ok THEN 'baw' ELSE 'bof' END AS outcome FROM j),
r AS (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY md5('42:' || description), description) AS k FROM o)
SELECT r.description, r.outcome, CAST(s.rank AS INTEGER) AS stratum_rank FROM r JOIN (VALUES ('ftw', 10, 0), ('bop', 5, 1), ('baw', 0, 2), ('bof', 5, 3)) AS s(outcome, n, rank) ON r.outcome = s.outcome AND r.k <= s.n""")
def w9(spark, sf):
    joined = evaluate.ab_join(X.run(spark, sf, 2), X.run(spark, sf, 5)).select("description", "outcome")
    return order.sample_per_stratum(joined, "outcome", {"ftw": 10, "bop": 5, "baw": 0, "bof": 5}, "description")


@query("w10_motif_sample", "SELECT DISTINCT text AS description FROM documents ORDER BY md5('7:' || text), text LIMIT 8")
def w10(spark, sf):
    return order.sample(X.corpus(spark, sf).select("description").distinct(), 8, "description", 7)


@query("w11_emphasis", f"SELECT doc_id, d.bucket AS emphasis FROM documents JOIN {X.dim_sql(schemas.FOCUS_BUCKETS).replace('AS dim', 'AS d')} ON d.dim_ordinal = doc_id % 9")
def w11(spark, sf):
    dim = schemas.dimension(spark, schemas.FOCUS_BUCKETS)
    return X.read(spark, sf, "documents").join(F.broadcast(dim), F.pmod("doc_id", F.lit(9)) == F.col("dim_ordinal")).select("doc_id", F.col("bucket").alias("emphasis"))


@query("w12_sample_blocks", f"WITH {CLASSIFIED} SELECT ordinal, substr(blocks[1], 1, 3000) AS block FROM classified WHERE len(blocks) > 0 ORDER BY ordinal LIMIT 20")
def w12(spark, sf):
    return report.sample_blocks(classified(spark, sf))


@query("o2_union_of_sources", f"WITH {CORPUS} SELECT ordinal, description, source FROM corpus UNION ALL SELECT ordinal, prompt, source FROM ({'WITH ' + CHAT} SELECT * FROM chat)")
def o2(spark, sf):
    return X.corpus(spark, sf).select("ordinal", "description", "source").unionByName(X.chat(spark, sf).select("ordinal", F.col("prompt").alias("description"), "source", "answer"), allowMissingColumns=True).select("ordinal", "description", "source")


# --- functions -------------------------------------------------------------------------------------------------------


@query("f1_keyframe_blocks", f"WITH {CLASSIFIED} SELECT ordinal, len(blocks) AS n_blocks, {join_list('blocks', '~')} AS blocks FROM blocked")
def f1(spark, sf):
    return X.corpus(spark, sf).select("ordinal", css.keyframe_blocks(F.col("code")).alias("b")).select("ordinal", F.size("b").alias("n_blocks"), F.array_join("b", "~").alias("blocks"))


@query("f2_buckets", f"WITH {CLASSIFIED} SELECT ordinal, {join_list('buckets')} AS buckets FROM classified")
def f2(spark, sf):
    return classified(spark, sf).select("ordinal", F.array_join("buckets", "|").alias("buckets"))


@query("f3_f4_source_document", f"WITH {CORPUS} SELECT ordinal, replace(replace({WRAPPED}, '&', '&amp;'), '\"', '&quot;') AS srcdoc FROM corpus")
def f3(spark, sf):
    return X.corpus(spark, sf).select("ordinal", html.source_document(F.col("code")).alias("srcdoc"))


@query("f6_escape", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM pages")
def f6(spark, sf):
    return X.read(spark, sf, "pages").select("page_id", text.escape_html(F.col("html")).alias("escaped"))


@query("f7_f8_document_parts", "SELECT page_id, true AS is_document, regexp_extract(html, '(?is)<head[^>]*>(.*?)</head>', 1) AS head, CASE WHEN regexp_matches(html, '(?is)<body[^>]*>(.*?)</body>') THEN regexp_extract(html, '(?is)<body[^>]*>(.*?)</body>', 1) ELSE html END AS body FROM pages")
def f7(spark, sf):
    h = F.col("html")
    return X.read(spark, sf, "pages").select("page_id", html.is_document(h).alias("is_document"), html.head_inner(h).alias("head"), html.body_inner(h).alias("body"))


@query("f10_badges", f"WITH {RUNS} SELECT ordinal, '<span class=\"badge ' || CASE WHEN render_ext IS NULL THEN 'unknown\">?' WHEN render_ext THEN 'pass\">✓' ELSE 'fail\">✗' END || ' Render</span>' AS badge FROM base")
def f10(spark, sf):
    return X.run(spark, sf, 2).select("ordinal", html.badge(F.col("render_ext"), "Render").alias("badge"))


@query("f12_f13_normalise", "SELECT doc_id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS norm FROM documents")
def f13(spark, sf):
    return X.corpus(spark, sf).select(F.col("ordinal").alias("doc_id"), text.normalise(F.col("description")).alias("norm"))


@query("f15_length", "SELECT doc_id, length(text) AS chars FROM documents")
def f15(spark, sf):
    return X.read(spark, sf, "documents").select("doc_id", F.length("text").alias("chars"))


@query("f19_requests", "WITH b AS (SELECT text AS description, (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS batch_id, (row_number() OVER (ORDER BY doc_id) - 1) % 8 + 1 AS idx FROM documents) SELECT batch_id, 'Generate one animation per brief below.' || chr(10) || chr(10) || string_agg(CAST(idx AS VARCHAR) || '. ' || description, chr(10) ORDER BY idx) AS prompt FROM b GROUP BY batch_id")
def f19(spark, sf):
    return cascade.requests(order.batches(X.corpus(spark, sf).select("ordinal", "description"), 8))


@query("f21_f24_rates", "SELECT event_type, printf('%.1f%%', 100 * count(*) FILTER (WHERE value > 50) / count(*)) AS share, round(sum(value) / nullif(max(event_id), 0), 6) AS per_second FROM events GROUP BY event_type")
def f21(spark, sf):
    events = X.read(spark, sf, "events").groupBy("event_type").agg((F.count_if(F.col("value") > 50) / F.count("*")).alias("s"), F.round(F.try_divide(F.sum("value"), F.max("event_id")), 6).alias("per_second"))
    return events.select("event_type", text.percent(F.col("s")).alias("share"), "per_second")


@query("f23_json_round_trip", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def f23(spark, sf):
    return X.read(spark, sf, "events").select("event_id", C.parsed_json(F.col("props"), schemas.struct(k=schemas.L))["k"].alias("k"))


@query("f25_bucket_colours", f"WITH {CLASSIFIED} SELECT DISTINCT bucket, CASE bucket {' '.join(f'WHEN {X.quoted(k)} THEN {X.quoted(v)}' for k, v in html.BUCKET_COLOURS.items())} ELSE '#444' END AS colour FROM (SELECT unnest(buckets) AS bucket FROM classified)")
def f25(spark, sf):
    return classified(spark, sf).select(F.explode("buckets").alias("bucket")).distinct().select("bucket", html.bucket_colour(F.col("bucket")).alias("colour"))


# --- iterative operators ---------------------------------------------------------------------------------------------


@query("x2_exact_normalised", "SELECT min(doc_id) AS ordinal, norm FROM (SELECT doc_id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS norm FROM documents) WHERE norm <> '' GROUP BY norm")
def x2_exact(spark, sf):
    rows = X.corpus(spark, sf).select("ordinal", text.normalise(F.col("description")).alias("norm")).where("norm != ''")
    return dedupe.first_wins(rows, ["norm"])


@query("x2_j9_f14_near_dedupe")
def x2(spark, sf):
    return dedupe.near_dedupe(X.briefs(spark, sf), cut=cut)


GATED = f"""{CORPUS}, pool AS (SELECT min(ordinal) AS ordinal, description FROM corpus WHERE description IS NOT NULL GROUP BY description),
asked AS (SELECT p.ordinal, p.description, c.code, regexp_matches(c.code, '(?i)@keyframes\\b') AND NOT regexp_matches(c.code, {X.quoted(css.UI_MARKERS)}) AS good FROM pool p JOIN corpus c ON c.ordinal = p.ordinal)"""


def cascaded(spark, sf):
    """Two tiers over the corpus's own code: the first answers two of three briefs, the gate wants keyframes and no parts of an interface."""
    source = dedupe.first_wins(X.corpus(spark, sf).where("description is not null").select("ordinal", "description"), ["description"])
    known = X.corpus(spark, sf).select(F.col("ordinal").alias("origin"), "code", F.length("description").alias("size"))
    shared_folder(spark)

    def generate(tier, batched):
        rows = batched.select("origin", "batch_id", "idx").join(known, "origin")
        body = F.when((F.lit(tier) == "small") & (F.col("origin") % 3 == 0), "").otherwise(F.concat(F.lit('<animation index="'), F.col("idx").cast("string"), F.lit('">'), F.col("code"), F.lit("</animation>")))
        listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", body.alias("t")))), lambda x: x["t"]), "")
        zero = F.lit(0).cast("long")
        return rows.groupBy("batch_id").agg(listed.alias("text"), F.sum("size").cast("long").alias("in"), F.sum(F.length("code")).cast("long").alias("out"), zero.alias("cw"), zero.alias("cr"))

    def render(rows):
        return rows.select("row_id", css.has_keyframes(F.col("code")).alias("ok"))

    def validate(rows):
        return gates.validate(rows, render, lambda r: r.select("row_id", (~css.is_interface(F.col("code"))).alias("ok")), cut=lambda df: df)  # cheap verdicts need no table

    return cascade.run_cascade(source, ["small", "large"], 16, generate, validate, cut=cut)


@query("x4_x5_cascade", f"WITH {GATED} SELECT CASE WHEN ordinal % 3 <> 0 THEN 'small' ELSE 'large' END AS tier, description, code FROM asked WHERE good")
def x4(spark, sf):
    return cascaded(spark, sf)[0].select("tier", "description", "code")


@query("a11_tier_stats", f"""WITH {GATED}, n AS (SELECT count(*) AS n, count(*) FILTER (WHERE good AND ordinal % 3 <> 0) AS first_kept, count(*) FILTER (WHERE good AND ordinal % 3 = 0) AS second_kept FROM asked)
SELECT 'small' AS tier, n AS attempted, first_kept AS kept, n - first_kept AS failed FROM n UNION ALL SELECT 'large', n - first_kept, second_kept, n - first_kept - second_kept FROM n WHERE n > first_kept""")
def a11(spark, sf):
    return spark.createDataFrame([tuple(x[k] for k in schemas.TIER_STAT.names) for x in cascaded(spark, sf)[1]], schemas.TIER_STAT)


@query("x7_k3_phases", f"WITH {RUNS} SELECT ordinal, coalesce(match_ext, CASE WHEN coalesce(render_ext, false) THEN length(output) % 2 = 0 END) AS match_ext FROM base")
def x7(spark, sf):
    base = X.run(spark, sf, 2)
    judge = lambda rows: rows.select("description", (F.length("output") % 2 == 0).alias("match_ext"))
    return evaluate.run_phase(base, "match_ext", judge, "render_ext", cut=cut).select("ordinal", "match_ext")


# --- requests to models, stores, logs --------------------------------------------------------------------------------

W = prompts.WORDING


def sentence_sql(sentence: str, value: str) -> str:
    head, _, tail = sentence.partition("{}")
    return f"{X.quoted(head)} || {value} || {X.quoted(tail)}"


TURNS = "turns AS (SELECT event_id AS turn, event_id % 25 + 1 AS n FROM events)"


@query("f19_idea_requests", f"""WITH {CLASSIFIED}, {COUNTS}, {TURNS},
full_ AS (SELECT string_agg(d.bucket || '=' || CAST(coalesce(c.n, 0) AS VARCHAR), ', ' ORDER BY d.dim_ordinal) AS coverage FROM {X.dim_sql(schemas.BUCKETS).replace('AS dim', 'AS d')} LEFT JOIN counts c ON c.bucket = d.bucket),
few AS (SELECT string_agg(d.bucket, ', ' ORDER BY coalesce(c.n, 0), d.dim_ordinal) AS wanted FROM {X.dim_sql(schemas.FOCUS_BUCKETS).replace('AS dim', 'AS d')} LEFT JOIN counts c ON c.bucket = d.bucket),
drawn AS (SELECT turn, array_to_string(list_transform(list_sort(list_transform(['rings', 'gears', 'a flame', 'a comet'], lambda x: md5('7:' || CAST(turn AS VARCHAR) || ':' || x) || x))[1:2], lambda y: substr(y, 33)), ', ') AS motifs FROM turns)
SELECT t.turn, concat_ws(chr(10), {sentence_sql(W.count, "CAST(t.n AS VARCHAR)")}, {sentence_sql(W.coverage, "coverage")}, {sentence_sql(W.wanted, "wanted")},
CASE WHEN t.turn % 2 = 0 THEN {sentence_sql(W.emphasis, "['" + "', '".join(schemas.FOCUS_BUCKETS) + f"'][t.turn % {len(schemas.FOCUS_BUCKETS)} + 1]")} END,
CASE WHEN t.turn % 3 <> 0 THEN {sentence_sql(W.motifs, "d.motifs")} END,
CASE WHEN t.turn % 5 = 0 THEN {sentence_sql(W.avoid, "'- brief ' || CAST(t.turn AS VARCHAR) || chr(10) || '- another'")} END,
{X.quoted(W.kinds.format(', '.join(schemas.BUCKETS)))}) AS prompt FROM turns t JOIN drawn d ON d.turn = t.turn, full_, few""")
def f19_ideas(spark, sf):
    turn = F.col("turn")
    emphasis, motifs = prompts.turn_plan(turn, F.array(*map(F.lit, ("rings", "gears", "a flame", "a comet"))), 2)
    none = F.array().cast("array<string>")
    rows = X.read(spark, sf, "events").select(F.col("event_id").alias("turn")).select(
        "turn",
        (turn % 25 + 1).alias("n"),
        F.when(turn % 2 == 0, emphasis).alias("emphasis"),
        F.when(turn % 3 != 0, motifs).otherwise(none).alias("motifs"),
        F.when(turn % 5 == 0, F.array(F.concat(F.lit("brief "), turn.cast("string")), F.lit("another"))).alias("avoid"),
    )
    return prompts.idea_requests(rows, report.bucket_counts(classified(spark, sf))).select("turn", "prompt")


@query("f19_system_text", f"""WITH {CLASSIFIED}, best AS (SELECT * FROM classified WHERE list_contains(buckets, 'multi_keyframe') AND NOT regexp_matches(code, {X.quoted(css.UI_MARKERS)}) ORDER BY len(buckets) DESC, ordinal LIMIT 2)
SELECT 'Be brief.' || CASE WHEN count(*) > 0 THEN chr(10) || chr(10) || {sentence_sql(W.examples, "string_agg('<animation index=\"1\">' || chr(10) || code || chr(10) || '</animation>', chr(10) || chr(10) ORDER BY len(buckets) DESC, ordinal)")} ELSE '' END AS system FROM best""")
def f19_system(spark, sf):
    return prompts.system_text("Be brief.", classified(spark, sf))


JUDGED = f"{CORPUS}, b AS (SELECT ordinal, code, description, (row_number() OVER (ORDER BY ordinal) - 1) % 10 + 1 AS idx, (row_number() OVER (ORDER BY ordinal) - 1) // 10 AS batch_id FROM corpus)"


def _opinion(request: str) -> str:
    """A judge that likes code with a rotation, says nothing on every fourth pair and gives broken answers to some requests."""
    import json
    import re

    pairs = re.findall(r"--- index (\d+) ---\nBRIEF: .*?\nCODE:\n(.*?)(?=\n--- index|\Z)", request, re.S)
    if "@KEYFRAMES tint" in pairs[0][1]:
        return "{"
    return json.dumps({"results": [{"index": int(i), "matches": "rotate" in code} for i, code in pairs if int(i) % 4]})


@query("u2_judge_in_chunks", f"WITH {JUDGED}, firsts AS (SELECT batch_id, contains(code, '@KEYFRAMES tint') AS broken FROM b WHERE idx = 1) SELECT b.ordinal AS row_id, firsts.broken OR b.idx % 4 = 0 OR contains(b.code, 'rotate') AS ok FROM b JOIN firsts ON firsts.batch_id = b.batch_id")
def u2(spark, sf):
    rows = X.corpus(spark, sf).select(F.col("ordinal").alias("row_id"), F.coalesce("description", F.lit("")).alias("description"), "code")
    return gates.judge(_opinion, cut=cut)(rows)


@query("k3_phase_store", f"WITH {RUNS} SELECT ordinal, length(output) AS nll, CASE WHEN coalesce(render_ext, false) THEN length(output) % 2 = 0 END AS match_ext, 2 AS versions, 3 AS made FROM base")
def k3(spark, sf):
    """Seeded, filled by two phases of which each is asked twice, the second time in a new store on the same folder."""
    schema = schemas.struct(description=schemas.S, reference=schemas.S, ordinal=schemas.L, output=schemas.S, render_ext=schemas.B, nll=schemas.D, match_ext=schemas.B)
    path, made = fresh(spark), []
    base = X.run(spark, sf, 2, by_digest=True).select("digest", F.lit("r").alias("reference"), "ordinal", "output", "render_ext")
    val = X.read(spark, sf, "documents").select(F.expr(X.RUN_KEY).alias("description"), F.lit("r").alias("reference"), F.col("doc_id").alias("ordinal"))
    open_ = lambda: store.PhaseStore(store.VersionedTable(spark, path, schema))

    def produce(field, value):
        def run(rows):
            made.append(field)
            return rows.select("description", value.alias(field))

        return run

    first = open_()
    first.seed(val)
    first.table.save(evaluate.merge_cache(first.table.load(), base, ("output", "render_ext")).withColumns({"nll": F.lit(None).cast("double"), "match_ext": F.lit(None).cast("boolean")}))
    made.append("seed")
    for _ in range(2):
        again = open_()
        again.run("nll", produce("nll", F.length("output").cast("double")))
        again.run("match_ext", produce("match_ext", F.length("output") % 2 == 0), "render_ext")
    table = open_().table
    return table.load().select("ordinal", "nll", "match_ext", F.lit(len(table.versions())).alias("versions"), F.lit(len(made)).alias("made"))


@query("k5_s10_metrics_object", f"WITH {RUNS}, m AS ({METRICS} FROM base) SELECT n, round(exp(mean_loss), 6) AS perplexity, round(ext_n / n, 6) AS ext_rate, round(1 - raw_both / n, 6) AS raw_knockout, '  perplexity ' || printf('%.3f', exp(mean_loss)) AS line FROM m")
def k5(spark, sf):
    path = fresh(spark)
    store.write_object(evaluate.metrics(X.run(spark, sf, 2)), path)
    m = jsonl.read_object(spark, path, schemas.struct(n=schemas.L, perplexity=schemas.D, mean_loss=schemas.D, format_valid_rate=schemas.D, raw=schemas.VARIANT, extracted=schemas.VARIANT))
    r = lambda c: F.round(c, 6)
    rows = m.select("n", r("perplexity").alias("perplexity"), r("extracted.render_rate").alias("ext_rate"), r("raw.knockout_rate").alias("raw_knockout"))
    return rows.join(F.broadcast(store.printed(m).where("line_no = 1").select("line")))  # a row each


@query("k4_append_log", f"WITH {LOG} SELECT step, loss, eval_loss, learning_rate FROM log")
def k4(spark, sf):
    """Three writers of differing fields, one after the other; a step's fields meet again when the log is read."""
    path, log = fresh(spark), X.log(spark, sf)
    for c in ("loss", "eval_loss", "learning_rate"):
        jsonl.append_log(log.select("step", c), path)
    back = spark.read.schema(schemas.TRAIN_LOG).json(path)
    return back.groupBy("step").agg(*(F.max(c).alias(c) for c in ("loss", "eval_loss", "learning_rate")))


@query("s11_missing_file", "SELECT 0 AS n, 4 AS columns")
def s11(spark, sf):
    rows = jsonl.read_jsonl(spark, fresh(spark), schemas.BRIEF, "prior")
    return rows.agg(F.count("*").alias("n")).withColumn("columns", F.lit(len(rows.columns)))


@query("x6_top_up", "WITH t AS (SELECT text, min(item_id) AS first_id FROM benchmark GROUP BY text), r AS (SELECT text, row_number() OVER (ORDER BY first_id) AS k FROM t) SELECT text FROM r WHERE k <= 30")
def x6(spark, sf):
    """Briefs until there are 30, from answers of which the first is cut short and every third does not parse; exact repeats don't count."""
    said = iter(X.read(spark, sf, "benchmark").orderBy("item_id").select("text").toLocalIterator())

    def ask(n, turn):
        return None if turn == 0 else [] if turn % 3 == 2 else [r.text for _, r in zip(range(n), said, strict=False)]

    def accept(answer, have):
        return [x for i, x in enumerate(answer) if x not in have and x not in answer[:i]]

    found = cascade.top_up({}, 30, ask, accept)["kept"]
    return spark.createDataFrame([(x,) for x in found], "text string")


def _unsteady(tier: str, briefs: list[str]):
    """A model whose first call for a batch is refused."""
    key = (tier, *briefs)
    _REFUSED[key] = _REFUSED.get(key, 0) + 1
    if _REFUSED[key] == 1:
        raise ConnectionError("slow down")
    return f"{tier} {len(briefs)} {sum(map(len, briefs))}", {"in": len(briefs), "out": _REFUSED[key]}


_REFUSED: dict[tuple, int] = {}


@query("x8_u3_retries", "WITH b AS (SELECT text, (row_number() OVER (ORDER BY item_id) - 1) // 8 AS batch_id FROM benchmark) SELECT batch_id, 'small ' || CAST(count(*) AS VARCHAR) || ' ' || CAST(sum(length(text)) AS VARCHAR) AS text, count(*) AS asked FROM b GROUP BY batch_id")
def x8(spark, sf):
    rows = cut(order.batches(X.read(spark, sf, "benchmark").select(F.col("item_id").alias("ordinal"), F.col("text").alias("description")), 8))
    return cut(cascade.generator(_unsteady, first_wait=0.01, retry_on=(ConnectionError,))("small", rows)).select("batch_id", "text", F.col("in").alias("asked"))
