"""Scalar functions: FIXTURES §4 tables."""

import html

import pytest
from pyspark.sql import functions as F

from crowdrank.fixed_values import EXCLUDE_WORDS
from crowdrank.functions.durations import duration_hhmmss, duration_seconds, hhmmss_seconds
from crowdrank.functions.labels import label_score, label_word, stars_label
from crowdrank.functions.relevance import title_relevance
from crowdrank.functions.text import (
    NAMED_ENTITIES,
    decode_entities,
    truncate_chars,
    with_clean_text,
)
from crowdrank.operators.filters import filter_min_duration, is_performance_title


def _one_col(spark, values, expr, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {dtype}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


DURATIONS = [
    ("PT1H2M3S", "01:02:03", 3723), ("PT0S", "00:00:00", 0), ("PT75M", "00:75:00", 4500),
    ("PT100H", "100:00:00", 360000), ("PT1M5Sjunk", "00:01:05", 65), ("PT3S2M", "00:00:03", 3),
    ("P1DT2H", "00:00:00", 0), ("junk", "00:00:00", 0), ("", "00:00:00", 0), (None, "00:00:00", 0),
]


def test_durations(spark):
    values = [d[0] for d in DURATIONS]
    assert _one_col(spark, values, duration_hhmmss) == [d[1] for d in DURATIONS]
    assert _one_col(spark, values, duration_seconds) == [d[2] for d in DURATIONS]
    assert _one_col(spark, [d[1] for d in DURATIONS], hhmmss_seconds) == [d[2] for d in DURATIONS]


def test_min_duration_boundary(spark):
    df = spark.createDataFrame([(65,), (64,)], "duration_seconds bigint")
    assert [r[0] for r in filter_min_duration(df, 65).collect()] == [65]
    assert filter_min_duration(df, None).count() == 2


TITLES_DROP = ["Piano Lesson 1", "MASTERCLASS", "A master class", "Preview", "How To Play Chopin",
               "Op.1-tutorial", "YouTube Shorts"]
TITLES_KEEP = ["reviewed", "how  to play", "guide2", "re_review", "Short"]


def test_title_filter(spark):
    kept = _one_col(spark, TITLES_DROP + TITLES_KEEP, lambda c: is_performance_title(c, EXCLUDE_WORDS))
    assert kept == [False] * len(TITLES_DROP) + [True] * len(TITLES_KEEP)
    assert _one_col(spark, ["Piano Lesson"], lambda c: is_performance_title(c, [])) == [True]


RELEVANCE = [
    ("Mozart: Violin Sonata in E minor, K. 304", "Mozart Violin Sonata in E minor", 0.666667),
    ("Op. 9 No. 2", "op. 9 no.", 0.75),
    ("a.b", "A b", 1.0),
    ("anything", "", 0.0),
    ("the", "the the", 1.0),
    ("red widget", "widget blue", 0.5),
]


def test_relevance(spark):
    df = spark.createDataFrame(RELEVANCE, "title string, query string, expected double")
    for r in df.select(title_relevance(F.col("title"), F.col("query")).alias("got"), "expected").collect():
        assert r["got"] == pytest.approx(r["expected"], abs=1e-6)


CLEANING = [
    ("Love <b>it</b>!<br>Bravo", "Love it!Bravo"),
    ('See <a href="x?a=1&amp;b=2">1:23 <i>here</i></a> now', "See now"),
    ("I &amp;lt;3 this", "I <3 this"),
    ("go https://a.b/c?d now", "go now"),
    ("www.x.y", ""),
    ("HTTP://x", "HTTP://x"),
    ("  a  b\n", " a b "),
    ("&#39;ok&#39; &quot;q&quot;", "'ok' \"q\""),
    ("a&lt;b&gt;c", "a<b>c"),
    ("https&amp;#58;//x", "https://x"),
    ("<!-- c -->x<script>var a='<p>';</script><style>p{}</style>y", "xy"),
    (None, None),
]


def test_clean_text_table(spark):
    df = spark.createDataFrame([(a,) for a, _ in CLEANING], "text string")
    got = [r["clean_text"] for r in with_clean_text(df).collect()]
    assert got == [b for _, b in CLEANING]


def test_entity_decoding_matches_python(spark):
    samples = ["&" + k for k in NAMED_ENTITIES] + [
        "&amp", "&ampx;", "&notit;", "&#x20AC;", "&#8364", "&#0;", "&#128;", "&#129;", "&#xD800;",
        "&#1114112;", "&#99999999999999999999;", "&#x0000041;", "&#1;", "&#65534;", "&copy2024",
        "&foo;", "& x", "&#;", "&#x;", "a&b", "&&amp;", "&#13;", "&#x1F600;",
    ]
    got = _one_col(spark, samples, decode_entities)
    bad = [(s, g) for s, g in zip(samples, got) if g != html.unescape(s)]
    assert bad == []


def test_label_maps(spark):
    labels = ["Very Positive", "positive", "Neutral", "negative", "Very Negative", "other", None]
    assert _one_col(spark, labels, label_score) == [1, 1, 0, -1, -1, 0, 0]
    assert _one_col(spark, labels, label_word) == ["positive", "positive", "neutral", "negative",
                                                   "negative", None, None]
    stars = _one_col(spark, [5, 4, 3, 2, 1], stars_label, "int")
    assert stars == ["5 stars", "4 stars", "3 stars", "2 stars", "1 star"]
    assert _one_col(spark, stars, lambda c: label_score(c, "stars")) == [1, 1, 0, -1, -1]


def test_truncation_counts_code_points(spark):
    text = "\U0001F600" * 600
    assert _one_col(spark, [text], lambda c: F.length(truncate_chars(c, 512))) == [512]


def test_decoder_registers_in_each_session(spark):
    other = spark.newSession()  # temporary functions are per session
    df = other.createDataFrame([("a &amp;lt; b &#8364;",)], "text string")
    assert with_clean_text(df).collect()[0]["clean_text"] == "a < b €"
    assert other.catalog.functionExists("crowdrank_decode_entities")
