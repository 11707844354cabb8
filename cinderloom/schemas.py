"""Declared schemas and dimensions of the datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

S, L, D, B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


MESSAGE = struct(role=S, content=S)
SOURCE_ROW = struct(instruction=S, code=S, category=S, description=S, tags=T.ArrayType(S))
CHAT_EXAMPLE = struct(messages=T.ArrayType(MESSAGE), buckets=T.ArrayType(S), category=S, source=S)
BRIEF = struct(description=S, techniques=T.ArrayType(S))
PARSED_ROW = struct(description=S, code=S)
EVAL_RECORD = struct(description=S, reference=S, output=S, code_ext=S, nll=D, n_tokens=L, render_raw=B, render_ext=B, match_raw=B, match_ext=B)
TRAIN_LOG = struct(step=L, epoch=D, loss=D, eval_loss=D, learning_rate=D, grad_norm=D)
VARIANT = struct(render_pass=L, render_rate=D, match_of_rendered=D, valid_and_match=L, knockout_rate=D)
METRICS = struct(tag=S, adapter=S, n=L, judged=B, perplexity=D, mean_loss=D, format_valid_rate=D, raw=VARIANT, extracted=VARIANT)
USAGE = struct(**{"model": S, "in": L, "out": L, "cw": L, "cr": L})
TIER_STAT = struct(tier=S, attempted=L, kept=L, failed=L)
FRAMES = struct(snippet_id=L, frame_idx=T.IntegerType(), pixels=T.ArrayType(T.ShortType()))
PROMPTS_OUTPUT = struct(prompts=T.ArrayType(BRIEF))
JUDGE_OUTPUT = struct(results=T.ArrayType(struct(index=T.IntegerType(), matches=B)))

#: The animation buckets in order, those to push for, and the outcomes of a comparison.
BUCKETS = ("rotate", "translate", "scale", "skew", "opacity", "color", "size", "stroke", "shadow", "clip", "background_position", "border_radius", "staggered", "hover", "multi_keyframe", "other")
FOCUS_BUCKETS = ("stroke", "border_radius", "clip", "skew", "color", "shadow", "size", "background_position", "staggered")
OUTCOMES = ("ftw", "bop", "baw", "bof")
#: Dollars a million tokens, in and out, where a model has no price of its own.
DEFAULT_PRICE = (5.0, 25.0)


def dimension(spark: SparkSession, names, key: str = "bucket") -> DataFrame:
    """A small table of names with their order."""
    return spark.createDataFrame([(x, i) for i, x in enumerate(names)], f"{key} string, dim_ordinal int")
