"""Per-video scores: golden micro-table (FIXTURES §2) and properties."""

import math

import pytest
from pyspark.sql import functions as F

from crowdrank.operators import scoring as S

SCHEMA = "video_id string, sentiment_label int, sentiment_score double, like_count bigint"
ROWS = [
    ("v1", 1, 0.9, 10), ("v1", -1, 0.8, 10), ("v1", 1, 0.7, 0), ("v1", 0, 0.6, 5),
    ("v2", 1, 0.95, 3),
    ("v3", 1, 0.5, 1), ("v3", 1, 0.5, 1), ("v3", 0, 0.99, 100),
    ("v4", -1, 0.9, 2), ("v4", 1, 0.9, 2),
    ("v5", 0, 0.3, 0), ("v5", 0, 0.4, 7),
    ("v6", 1, 0.8, 4), ("v6", None, 0.0, 1), ("v6", -1, 0.5, None),
]
# id: (total, std or None, polarization)
EXPECTED = {
    "v1": (3.0, 0.129099, 0.442907),
    "v2": (0.95, None, 0.0),
    "v3": (1.99, 0.282902, 0.0),
    "v4": (1.8, 0.0, 0.285714),
    "v5": (0.7, 0.070711, 0.0),
    "v6": (1.3, 0.404145, 0.0),
}


def _scores(spark, rows=ROWS, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r["video_id"]: r for r in S.video_scores(df, **kw).collect()}


def test_golden_scores(spark):
    got = _scores(spark)
    assert set(got) == set(EXPECTED)
    for vid, (total, std, pol) in EXPECTED.items():
        r = got[vid]
        assert r["total_score"] == pytest.approx(total, abs=1e-6)
        assert r["relevance_score"] == pytest.approx(1.0)
        if std is None:
            assert r["std_deviation"] is None
        else:
            assert r["std_deviation"] == pytest.approx(std, abs=1e-6)
        assert r["polarization_score_with_pseudo_count"] == pytest.approx(pol, abs=1e-6)


def test_relevance_adjustment(spark):
    rows = [r + (0.25,) for r in ROWS]
    df = spark.createDataFrame(rows, SCHEMA + ", relevance_score double")
    v1 = {r["video_id"]: r for r in S.video_scores(df).collect()}["v1"]
    assert v1["total_score"] == pytest.approx(0.75, abs=1e-6)
    assert v1["std_deviation"] == pytest.approx(0.064550, abs=1e-6)
    assert v1["polarization_score_with_pseudo_count"] == pytest.approx(0.221453, abs=1e-6)


def test_relevance_from_videos_equals_copied_relevance(spark):
    comments = spark.createDataFrame(ROWS, SCHEMA)
    videos = spark.createDataFrame([(v, 0.25) for v in EXPECTED], "video_id string, relevance_score double")
    a = {r["video_id"]: r for r in S.video_scores_with_relevance(comments, videos).collect()}
    copied = comments.join(videos, "video_id")
    b = {r["video_id"]: r for r in S.video_scores(copied).collect()}
    for vid in EXPECTED:
        for col in ("total_score", "std_deviation", "polarization_score_with_pseudo_count"):
            if b[vid][col] is None:
                assert a[vid][col] is None
            else:
                assert a[vid][col] == pytest.approx(b[vid][col], abs=1e-9)


def test_total_modes(spark):
    signed = _scores(spark, total="signed")
    assert signed["v1"]["total_score"] == pytest.approx(0.9 - 0.8 + 0.7, abs=1e-9)
    weighted = _scores(spark, total="weighted")
    assert weighted["v1"]["total_score"] == pytest.approx(9.0 - 8.0, abs=1e-9)


def test_properties_swap_scale_and_partitions(spark):
    base = _scores(spark)
    swapped = [(v, -l if l in (1, -1) else l, s, c) for v, l, s, c in ROWS]
    scaled = [(v, l, s, None if c is None else c * 3) for v, l, s, c in ROWS]
    for variant in (swapped, scaled):
        got = _scores(spark, variant)
        for vid in EXPECTED:
            assert got[vid]["polarization_score_with_pseudo_count"] == pytest.approx(
                base[vid]["polarization_score_with_pseudo_count"], abs=1e-9
            )
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(7)
    again = {r["video_id"]: r for r in S.video_scores(df).collect()}
    for vid in EXPECTED:
        assert again[vid]["total_score"] == pytest.approx(base[vid]["total_score"], abs=1e-9)
    for r in base.values():
        assert 0.0 <= r["polarization_score_with_pseudo_count"] < 1.0


def test_null_key_dropped_and_empty_input(spark):
    rows = ROWS + [(None, 1, 0.5, 1)]
    assert None not in _scores(spark, rows)
    empty = spark.createDataFrame([], SCHEMA)
    assert S.video_scores(empty).count() == 0


def test_weighted_column(spark):
    df = S.with_weighted_score(spark.createDataFrame(ROWS, SCHEMA))
    vals = [r["weighted_sentiment_score"] for r in df.filter(F.col("video_id") == "v1").collect()]
    assert sorted(vals) == pytest.approx(sorted([9.0, -8.0, 0.0, 0.0]))
    assert math.isclose(sum(vals), 1.0)
