"""Personal data in texts: patterns propose spans, checksums confirm them, context words weigh the rest.

All native: a pattern's matches and the text between them give the spans' places. Patterns that
need a repeated group are turned into runs of one character class first (separators that cannot
belong to a match are masked by a character of the same length), so very long runs neither
recurse nor backtrack.

Kinds, in order: email, ip, card (Luhn), phone, which are exact and always kept; then iban
(mod-97) and ssn (three-two-four digits), which the method adds. A span's score begins with what its kind's pattern and validator
are worth (``WORTH``: 0.6 where a checksum or a full address confirms it, 0.4 for plain digits), gains 0.3 for a word of its own
context among the ``near`` characters before it, and loses 0.3 for a word of another one (part, serial and order numbers,
versions). Added spans are kept at ``THRESHOLD`` 0.5 or more: a valid iban goes after "serial number" and stays
after "account", an ssn needs its context. The others are kept whatever they score. Spans carry their scores, in tenths.

Nulls count as empty texts, without spans. Repeated rows give repeated results, an empty table an
empty result; other columns of the input are ignored by ``report`` and carried along by ``find`` and ``redact``. Spans of different kinds may overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .native import let

#: The patterns of the result's contract, in forms that cannot backtrack.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9][0-9 -]{11,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
CONTEXT = {
    "email": "(?i)mail|contact|kontakt|write to|correo",
    "ip": r"(?i)\bip\b|address|host|server|client|adresse",
    "card": r"(?i)card|visa|master|amex|credit|karte|carte|tarjeta",
    "phone": "(?i)phone|call|tel|mobil|fax|dial|whatsapp",
    "iban": "(?i)iban|account|bank|konto|cuenta|compte",
    "ssn": "(?i)ssn|social|security|sozial|seguro|sécu",
}
OTHER = r"(?i)\b(?:serial|part|order|item|invoice|version|build|sku|isbn|article|ticket|hash)\b"
#: In tenths, as all scores.
WORTH = {"email": 6, "ip": 6, "card": 6, "phone": 4, "iban": 6, "ssn": 4}
NEAR, THRESHOLD, STEP = 40, 5, 3


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, found>> of the leftmost matches that do not overlap, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), F.length)
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,found:string>>").alias("out"))
    step = lambda s, x: F.struct(
        (s["at"] + x["before"] + F.length(x["found"])).alias("at"),
        F.concat(s["out"], F.array(F.struct((s["at"] + x["before"]).alias("start"), (s["at"] + x["before"] + F.length(x["found"])).alias("end"), x["found"].alias("found")))).alias("out"),
    )
    pairs = F.zip_with(found, F.slice(between, 1, F.greatest(F.size(found), F.lit(1))), lambda f, b: F.struct(f.alias("found"), b.alias("before")))
    return F.aggregate(F.filter(pairs, lambda p: p["found"].isNotNull()), state, step, lambda s: s["out"])


def when_any(hint: Column, spans: Column) -> Column:
    return F.when(hint, spans).otherwise(F.array().cast("array<struct<start:int,end:int,found:string>>"))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def at_most_255(part: Column) -> Column:
    plain = F.regexp_replace(part, "^0+", "")
    return (F.length(plain) < 3) | (F.length(plain) == 3) & (plain <= "255")


def luhn(number: Column) -> Column:
    """Whether the last digit checks the others."""
    places = F.sequence(F.lit(1), F.length(number))
    value = lambda i: F.substr(number, F.length(number) + 1 - i, F.lit(1)).cast("int") * (2 - i % 2)
    return F.aggregate(places, F.lit(0), lambda s, i: s + value(i) - F.when(value(i) > 9, 9).otherwise(0)) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether the rearranged number leaves 1, letters as two digits."""
    moved = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    chars = F.transform(F.sequence(F.lit(1), F.length(moved)), lambda i: value(F.substr(moved, i, F.lit(1))))
    return F.aggregate(chars, F.lit(0), lambda s, v: (s * F.when(v > 9, 100).otherwise(10) + v) % 97) == 1


def find(df: DataFrame, text_col: str = "text", out: str = "pii", near: int = NEAR) -> DataFrame:
    """The input with ``out``: array of (start, no, end, kind, score), by start, then kind as listed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    digit = F.col("__pii_digit")
    # a separator that has no digit on either side ends a card
    masked = F.regexp_replace(F.regexp_replace(text, "[ -](?![0-9])", "x"), "(?<![0-9])[ -]", "x")
    d = digits
    before = lambda x: F.substr(text, F.greatest(x["start"] + 1 - near, F.lit(1)), F.least(x["start"], F.lit(near)))
    score = lambda x, kind: let(before(x), lambda c: F.lit(WORTH[kind]) + F.when(c.rlike(CONTEXT[kind]), STEP).otherwise(0) - F.when(c.rlike(OTHER), STEP).otherwise(0))
    added = lambda x, kind, good: good & (score(x, kind) >= THRESHOLD)
    found = {
        "email": when_any(text.contains("@"), matches(text, EMAIL)),
        "ip": F.filter(when_any(digit & text.contains("."), matches(text, IP)), lambda x: F.forall(F.split(x["found"], r"\."), at_most_255)),
        "card": F.filter(when_any(text.rlike("[0-9](?:[ -]?[0-9]){11}"), matches(masked, CARD)), lambda x: F.length(d(x["found"])).between(12, 19) & luhn(d(x["found"]))),
        "phone": F.filter(when_any(digit & text.contains("+"), matches(text, PHONE)), lambda x: F.length(d(x["found"])).between(9, 15)),
        "iban": F.filter(when_any(digit, matches(text, IBAN)), lambda x: added(x, "iban", mod97(x["found"]))),
        "ssn": F.filter(when_any(digit & text.contains("-"), matches(text, SSN)), lambda x: added(x, "ssn", ~F.substring(x["found"], 1, 3).isin("000", "666") & ~x["found"].startswith("9") & (F.substring(x["found"], 5, 2) != "00") & (F.substring(x["found"], 8, 4) != "0000"))),
    }
    as_span = lambda no, kind: lambda x: F.struct(x["start"].alias("start"), F.lit(no).alias("no"), x["end"].alias("end"), F.lit(kind).alias("kind"), score(x, kind).alias("score"))
    as_spans = [F.transform(spans, as_span(no, kind)) for no, (kind, spans) in enumerate(found.items())]
    return df.withColumn("__pii_digit", text.rlike("[0-9]")).withColumn(out, F.array_sort(F.concat(*as_spans))).drop("__pii_digit")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(df: DataFrame, text_col: str = "text", spans_col: str = "pii") -> DataFrame:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first one counts."""
    text = F.col(text_col)
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda s, x: F.when(x["start"] < s["at"], s).otherwise(
        F.struct(x["end"].alias("at"), F.concat(s["out"], F.substr(text, s["at"] + 1, x["start"] - s["at"]), F.lit("<"), x["kind"], F.lit(">")).alias("out"))
    )
    done = F.aggregate(F.col(spans_col), state, step, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1, F.length(text))))
    return df.withColumn(text_col, F.when(F.size(spans_col) > 0, done).otherwise(text))


def report(df: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("pii", lambda x: x["no"] < 4)
    return df.select("doc_id", *map(count, KINDS[:4]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), *map(count, KINDS[4:]), F.array_join(F.transform("pii", lambda x: x["score"].cast("string")), ",").alias("scores"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(find(documents(spark, sf_dir).select("doc_id", "text")))
