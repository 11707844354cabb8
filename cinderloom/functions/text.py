"""Text functions as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRIP = r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"
_FENCE = r"(?s)```[\w-]*\s*\n?(.*?)```"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, wherever the optimizer puts the expression."""
    return F.element_at(F.transform(F.array(value), lambda x: use(x)), 1)


def strip(text: Column) -> Column:
    """Without white space at either end, by Unicode's notion of it and the separators U+001C to U+001F."""
    return F.regexp_replace(text, _STRIP, "")


def normalise(text: Column) -> Column:
    """Lower case, runs of anything but letters, digits and underscores as one space, stripped."""
    return strip(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))


def fenced_code(text: Column) -> Column:
    """What the first fence holds, else the text; stripped."""
    return strip(F.when(text.rlike(_FENCE), F.regexp_extract(text, _FENCE, 1)).otherwise(text))


def has_fence(text: Column) -> Column:
    return text.contains("```")


def digest(text: Column) -> Column:
    """SHA-256, which stands for a text where texts are only told apart; null of null."""
    return F.unhex(F.sha2(text, 256))


def row_text(df) -> Column:
    """All string columns joined by line feeds; nulls are skipped."""
    return F.concat_ws("\n", *(F.col(f.name) for f in df.schema if f.dataType.simpleString() == "string"))


def escape_attribute(text: Column) -> Column:
    """For a double-quoted attribute: ampersands, then double quotes."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))


def escape_card(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def escape_html(text: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(name))
    return text


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty, else an empty text."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def bin_index(value: Column, edges: Column) -> Column:
    """How many edges are not above the value."""
    return F.size(F.filter(edges, lambda e: e <= value))


def formatted(pattern: str, x: Column) -> Column:
    return F.when(x.isNotNull(), F.format_string(pattern, x)).otherwise("n/a")


def percent(x: Column, digits: int = 1) -> Column:
    return formatted(f"%.{digits}f%%", x * 100)
