"""Chat records, prompts and the model's answers, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .css import has_keyframes
from .text import strip

_BLOCK = r"(?is)<animation\s+index=\"(\d+)\"\s*>(.*?)</animation>"


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def pair(prompt: Column, answer: Column) -> Column:
    return F.array(message("user", prompt), message("assistant", answer))


def build_messages(system: str, description: Column, response: Column | None = None) -> Column:
    """System and user turns, and the assistant's where there is a response, be it empty."""
    turns = F.array(message("system", F.lit(system)), message("user", description))
    return turns if response is None else F.when(response.isNull(), turns).otherwise(F.concat(turns, F.array(message("assistant", response))))


def with_system(system: str, messages: Column) -> Column:
    return F.concat(F.array(message("system", F.lit(system))), messages)


def turn(messages: Column, n: int) -> Column:
    return F.get(messages, F.lit(n))["content"]


def numbered(items: Column, head: str) -> Column:
    """The head, then the items on lines of their own with their numbers."""
    return F.concat(F.lit(head), F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n"))


def animation_blocks(text: Column) -> Column:
    """array<struct<idx, code, at>>: the numbered blocks of an answer, in order."""
    numbers, codes = F.regexp_extract_all(text, F.lit(_BLOCK), F.lit(1)), F.regexp_extract_all(text, F.lit(_BLOCK), F.lit(2))
    return F.transform(F.arrays_zip(numbers.alias("n"), codes.alias("c")), lambda x, i: F.struct(x["n"].cast("int").alias("idx"), strip(x["c"]).alias("code"), i.alias("at")))


def usable(code: Column) -> Column:
    return (code != "") & has_keyframes(code)


def parsed_json(text: Column, schema) -> Column:
    """A structured answer, null where it does not parse."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})
