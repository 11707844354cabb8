import html as H
import random
import re

import pytest
from pyspark.sql import functions as F

from cinderloom.functions import chat, css, html, text
from cinderloom.schemas import BUCKETS


def col(spark, values, f, type_="string"):
    """The values of a column expression, in order."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {type_}")
    return [r[1] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def spec_blocks(code):
    """By scanning characters."""
    out, at, low = [], 0, code.lower()
    while (start := low.find("@keyframes", at)) >= 0:
        depth, end = 0, start
        while end < len(code) and not (depth == 0 and code[end] == "{"):
            end += 1
        if end == len(code):
            break
        while end < len(code):
            depth += {"{": 1, "}": -1}.get(code[end], 0)
            end += 1
            if not depth:
                break
        out.append(code[start:end])
        at = end
    return out


def test_blocks(spark):
    rnd = random.Random(1)
    made = ["".join(rnd.choice(["@keyframes", "@KeyFrames ", "@", "{", "}", "a", " ", "\n", "x:y;", "é"]) for _ in range(rnd.randint(0, 25))) for _ in range(2000)]
    made += ["", "@keyframes", "@keyframesX{", "@keyframes a{b{c}d}e@keyframes f{g", "}}{@keyframes q{{}}"]
    assert col(spark, made, css.keyframe_blocks) == [spec_blocks(x) for x in made]
    assert col(spark, [None], css.keyframe_blocks) == [None]


CASES = {
    "rotate": "rotate (1deg)", "translate": "translate3d(0)", "scale": "scaleX(2)", "skew": "scale3d(1)", "opacity": "opacity : 1", "color": "{color:red", "size": "width:1px", "stroke": "stroke-dashoffset:1",
    "shadow": "box-shadow:none", "clip": "clip-path:none", "background_position": "background-position:0", "border_radius": "border-radius:1px",
}


def test_buckets(spark):
    codes = [f"@keyframes a{{from{{{x}}}}}" for x in CASES.values()]
    codes += [".a{animation-delay:1s}", "a:hover {}", "@keyframes a{}@keyframes b{}", ".a{color:red}", "@keyframes a{from{accent-color:red}}", "@keyframes a{from{scale3d(1)}}", ""]
    df = spark.createDataFrame(list(enumerate(codes)), "i int, code string")
    got = [r.buckets for r in css.classified(df).orderBy("i").collect()]
    assert got == [[k] for k in CASES] + [["staggered"], ["hover"], ["multi_keyframe"], ["other"], ["other"], ["skew"], ["other"]]
    assert set(BUCKETS) >= {b for bs in got for b in bs}


@pytest.mark.parametrize(
    "given, want",
    [("```html\n<a>\n```", "<a>"), ("x ```\ny\n``` z", "y"), ("```abc```", ""), ("```css\nopen", "```css\nopen"), ("\n\t plain \n", "plain"), ("", ""), ("a ```x y``` b ```z```", "y")],
)
def test_fenced_code(spark, given, want):
    assert col(spark, [given], text.fenced_code) == [want]


def test_strip_and_normalise(spark):
    chars = [chr(c) for c in range(1, 0x3100)]
    assert col(spark, [c + "a" + c for c in chars], text.strip) == [(c + "a" + c).strip() for c in chars]
    words = ["A  b!c", "Ünï_co-dé 12", "...", "日本 語", ""]
    assert col(spark, words, text.normalise) == [re.sub(r"\W+", " ", w.lower()).strip() for w in words]


def test_escapes(spark):
    values = ["<a href=\"x\">'&amp;'</a>", ""]
    assert col(spark, values, text.escape_html) == [H.escape(v) for v in values]
    assert col(spark, ['&"'], text.escape_attribute) == ["&amp;&quot;"]
    assert col(spark, ["<&>"], text.escape_card) == ["&lt;&amp;>"]
    assert col(spark, ["", None, "x"], lambda x: text.first_filled(x, F.lit("y"))) == ["y", "y", "x"]


def test_documents(spark):
    values = ["<b>", "<!DOCTYPE html><p>", "x<HTML lang>", "<htmlx>", " " * 300 + "<html >"]
    wrapped = col(spark, values, html.wrap)
    assert [w == v for w, v in zip(wrapped, values, strict=True)] == [False, True, True, False, True]
    assert col(spark, values, html.is_document) == [False, True, True, True, False]
    doc = "<html><HEAD a><style>s</style></head><body b>inner\n</body></html>"
    assert col(spark, [doc, "frag"], html.head_inner) == ["<style>s</style>", ""]
    assert col(spark, [doc, "frag", "<html>no body"], html.body_inner) == ["inner\n", "frag", "<html>no body"]
    assert col(spark, [True, False, None], lambda x: html.badge(x, "R"), "boolean") == ['<span class="badge pass">✓ R</span>', '<span class="badge fail">✗ R</span>', '<span class="badge unknown">? R</span>']
    assert col(spark, ["rotate", "none"], html.bucket_colour) == ["#5c4a8a", "#444"]


def test_chat(spark):
    said = '<animation index="01">\n a @keyframes x{} </animation>junk<ANIMATION  index="2" >b</animation><animation index="1">c</animation>'
    (got,) = col(spark, [said], chat.animation_blocks)
    assert [(x.idx, x.code) for x in got] == [(1, "a @keyframes x{}"), (2, "b"), (1, "c")]
    assert [len(x) for x in col(spark, [None, "", "r"], lambda x: chat.build_messages("s", F.lit("d"), x))] == [2, 3, 3]
    assert col(spark, [["a", "b"]], lambda x: chat.numbered(x, "H\n"), "array<string>") == ["H\n1. a\n2. b"]
    assert col(spark, [0, 5, 9], lambda v: text.bin_index(v, F.array(F.lit(1), F.lit(5))), "int") == [0, 2, 2]
