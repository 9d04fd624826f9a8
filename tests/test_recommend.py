"""Recommendation: FIXTURES §3, worked by hand."""

import pytest

from crowdrank.operators import recommend as R

SCHEMA = ("video_id string, total_score double, relevance_score double, std_deviation double, "
          "polarization_score_with_pseudo_count double")


def _scores(spark, rows):
    return spark.createDataFrame(
        [(i, None if t is None else float(t), 1.0, 0.1, float(p)) for i, t, p in rows], SCHEMA
    )


CASES = [
    ([("a", 10, .1), ("b", 1, .9), ("c", 2, .8), ("d", 3, .7), ("e", 0, .95)], "a", ["e", "b", "c"], "c"),
    ([("b", 5, .5), ("a", 5, .5)], "a", ["a", "b"], "a"),
    ([("a", 5, 0.0), ("b", 4, 0.0)], "a", ["a", "b"], None),
    ([("a", None, .5), ("b", 1, .2)], "b", ["a", "b"], "b"),
    ([], None, [], None),
]


@pytest.mark.parametrize("rows,best,top3,polarized", CASES)
def test_recommendation_cases(spark, rows, best, top3, polarized):
    scores = _scores(spark, rows)
    rec = R.recommendation(scores).collect()
    assert len(rec) == 1
    assert rec[0]["best_video_id"] == best
    assert rec[0]["most_polarized_video_id"] == polarized
    assert [r["video_id"] for r in R.top_polarized(scores).collect()] == top3


def test_report_columns(spark):
    rec = R.recommendation_report(R.recommendation(_scores(spark, [("x1", 8.454, 0.781)])))
    row = rec.collect()[0]
    assert row["best_score_text"] == "8.45"
    assert row["best_video_url"].endswith("watch?v=x1")
    assert row["polarization_text"] == "0.78"
