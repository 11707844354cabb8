"""Keyframe blocks and animation kinds of CSS in HTML snippets, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import BUCKETS
from .text import let

#: A rule each, in the order of the buckets; the last two look at the whole code, not at the blocks alone.
RULES = (
    ("rotate", r"rotate\s*\("),
    ("translate", r"translate(?:X|Y|Z|3d)?\s*\("),
    ("scale", r"\bscale\s*\(|scale[XYZ]\s*\("),
    ("skew", r"skew(?:X|Y)?\s*\(|scale3d\s*\("),
    ("opacity", r"\bopacity\s*:"),
    ("color", r"(?:background-color|border-color|(?:^|[^a-z-])color)\s*:"),
    ("size", r"\b(?:width|height)\s*:"),
    ("stroke", r"stroke-(?:dasharray|dashoffset)\s*:"),
    ("shadow", r"box-shadow\s*:"),
    ("clip", r"clip-path\s*:"),
    ("background_position", r"background-position\s*:"),
    ("border_radius", r"border-radius\s*:"),
)
WHOLE_RULES = (("staggered", r"animation-delay\s*:|nth-child\s*\("), ("hover", r":hover\s*\{"))
KEYFRAMES = r"(?i)@keyframes\b"
#: Fixed value: what marks parts of an interface.
UI_MARKERS = r"(?i)<button|<input|<form|<textarea|<select\b|<nav\b|<a\s|class=[\"'][^\"']*\b(?:btn|button|card|menu|modal|navbar|tooltip|dropdown|toggle|switch)\b"


def has_keyframes(code: Column) -> Column:
    return code.rlike(KEYFRAMES)


def is_interface(code: Column) -> Column:
    return code.rlike(UI_MARKERS)


def keyframe_blocks(code: Column) -> Column:
    """array<string>: each at-rule with its balanced braces; one that is not closed runs to the end.

    The code's tokens are folded over a state: outside, waiting for the first brace, or inside at some depth.
    """
    parts = F.regexp_extract_all(code, F.lit(r"(?is)(@keyframes|[{}]|@|[^@{}]+)"), F.lit(1))
    outside, waiting, inside = 0, 1, 2
    state = lambda at, depth, block, done: F.struct(at.alias("at"), depth.alias("depth"), block.alias("block"), done.alias("done"))
    start = state(F.lit(outside), F.lit(0), F.lit(""), F.array().cast("array<string>"))

    def step(s: Column, x: Column) -> Column:
        longer, depth = F.concat(s["block"], x), s["depth"] + F.when(x == "{", 1).when(x == "}", -1).otherwise(0)
        return (
            F.when((s["at"] == outside) & (F.lower(x) == "@keyframes"), state(F.lit(waiting), F.lit(0), x, s["done"]))
            .when((s["at"] == waiting) & (x == "{"), state(F.lit(inside), F.lit(1), longer, s["done"]))
            .when(s["at"] == waiting, state(F.lit(waiting), F.lit(0), longer, s["done"]))
            .when((s["at"] == inside) & (depth == 0), state(F.lit(outside), F.lit(0), F.lit(""), F.concat(s["done"], F.array(longer))))
            .when(s["at"] == inside, state(F.lit(inside), depth, longer, s["done"]))
            .otherwise(s)
        )

    return F.aggregate(parts, start, step, lambda s: F.when(s["at"] == inside, F.concat(s["done"], F.array(s["block"]))).otherwise(s["done"]))


def buckets(code: Column, blocks: Column) -> Column:
    """array<string>: the kinds of animation, in the order of the buckets."""
    whole = [F.when(code.rlike("(?i)" + p), name) for name, p in WHOLE_RULES] + [F.when(F.size(blocks) > 1, "multi_keyframe")]
    found = lambda inner: F.filter(F.array(*(F.when(inner.rlike("(?i)" + p), name) for name, p in RULES), *whole), lambda x: x.isNotNull())
    named = let(F.array_join(blocks, " "), found)
    return let(named, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.lit(BUCKETS[-1]))))


def classified(df, code_col: str = "code"):
    """With ``blocks`` and ``buckets``; the blocks are folded once for both."""
    both = let(keyframe_blocks(F.col(code_col)), lambda b: F.struct(b.alias("blocks"), buckets(F.col(code_col), b).alias("buckets")))
    return df.withColumn("__found", both).withColumns({"blocks": F.col("__found.blocks"), "buckets": F.col("__found.buckets")}).drop("__found")
