"""The whole flow on a small landed fixture, checked by hand."""

import pytest

from crowdrank.operators import sentiment as SE
from crowdrank.plans import ranker as RK


@pytest.fixture()
def sources(spark):
    listing = spark.createDataFrame(
        [
            ("q1", 0, "a", "Great performance"), ("q1", 1, "b", "Piano lesson 3"), ("q1", 2, "c", "Live concert"),
            ("q1", 3, "d", "Short clip"), ("q2", 0, "e", "Another one"),
        ],
        "query string, position bigint, video_id string, title string",
    )
    details = spark.createDataFrame(
        [("a", "Great performance", "PT10M", 1, 1, 1), ("b", "Piano lesson 3", "PT10M", 1, 1, 1),
         ("c", "Live concert", "PT1H", 1, 1, 1), ("d", "Short clip", "PT30S", 1, 1, 1),
         ("e", "Another one", "PT5M", 1, 1, 1)],
        "video_id string, title string, iso_duration string, view_count bigint, like_count bigint, comment_count bigint",
    )
    comments = spark.createDataFrame(
        [
            ("a", 0, 0, "a1", "u", "<b>good</b> good", 3), ("a", 0, 1, "a2", "u", "bad", 1),
            ("a", 0, 2, "a3", "u", "good https://x.y", 2),
            ("b", 0, 0, "b1", "u", "good", 5),
            ("c", 0, 0, "c1", "u", "good", 1), ("c", 0, 1, "c2", "u", "bad bad", 4),
            ("d", 0, 0, "d1", "u", "good", 1),
        ],
        "video_id string, page bigint, item_pos bigint, comment_id string, author string, text string, like_count bigint",
    )
    return listing, details, comments


def test_rank_from_sources(spark, sources):
    listing, details, comments = sources
    lex = SE.LexiconScorer({"good": 1.0, "bad": -1.0})
    res = RK.rank_from_sources(listing, details, comments, {"*": lex}, RK.RankerParams(num_comments=2))
    videos = {(r["query"], r["video_id"]) for r in res.videos.collect()}
    assert videos == {("q1", "a"), ("q1", "c"), ("q2", "e")}  # b: title word; d: 30 s
    kept = {r["comment_id"]: r for r in res.comments.collect()}
    assert set(kept) == {"a1", "a2", "c1", "c2"}  # cap 2 per video, b/d dropped
    assert kept["a1"]["clean_text"] == "good good"
    scores = {r["video_id"]: r for r in res.video_scores.collect()}
    assert scores["a"]["total_score"] == pytest.approx(2.0)  # two confident comments
    rec = {r["query"]: r for r in res.recommendation.collect()}
    assert set(rec) == {"q1", "q2"}
    assert rec["q2"]["best_video_id"] is None  # q2 kept a video without comments
    assert rec["q1"]["best_video_id"] in {"a", "c"}


def test_rank_with_stage_checkpoints(spark, sources):
    listing, details, comments = sources
    lex = SE.LexiconScorer({"good": 1.0, "bad": -1.0})
    a = RK.rank_from_sources(listing, details, comments, {"*": lex}, RK.RankerParams())
    b = RK.rank_from_sources(listing, details, comments, {"*": lex}, RK.RankerParams(stage_checkpoints=True))
    assert sorted(map(tuple, a.recommendation.collect())) == sorted(map(tuple, b.recommendation.collect()))


def test_token_overlap_relevance(spark, sources):
    listing, details, comments = sources
    lex = SE.LexiconScorer({"good": 1.0, "bad": -1.0})
    res = RK.rank_from_sources(listing, details, comments, {"*": lex}, RK.RankerParams(relevance="token_overlap"))
    rel = {r["video_id"]: r["relevance_score"] for r in res.videos.collect()}
    assert rel["a"] == 0.0  # 'q1' shares no token with the title


def test_tree_cap_equals_single_level_on_a_hot_key(spark):
    from pyspark.sql import functions as F

    from crowdrank.operators.candidates import cap_per_group

    # one video holds a third of all rows
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("v"), (F.col("id") % 50).cast("string"))).alias("video_id"),
        (F.col("id") * 7919 % 3001).alias("position"),
        F.col("id"),
    ).repartition(16)
    single = cap_per_group(df, 20, ["video_id"], ["position", "id"], buckets=1)
    tree = cap_per_group(df, 20, ["video_id"], ["position", "id"], buckets=4)
    auto = cap_per_group(df, 20, ["video_id"], ["position", "id"])
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(single) == rows(tree) == rows(auto)
    assert tree.filter(F.col("video_id") == "hot").count() == 20


def test_stage_counts_are_observed_in_one_action(spark, sources):
    listing, details, comments = sources
    lex = SE.LexiconScorer({"good": 1.0, "bad": -1.0})
    params = RK.RankerParams(num_comments=2, stage_counts=True)
    res = RK.rank_from_sources(listing, details, comments, {"*": lex}, params)
    res.recommendation.collect()
    counts = RK.stage_counts(res)
    assert counts == {
        "candidates": 4,        # q1: a, c, d (b has a title word); q2: e
        "videos": 3,            # d is 30 s
        "comments": 4,          # a1, a2, c1, c2 (cap 2)
        "comments-scored": 4,
        "video-scores": 2,      # e has no comments
    }
    # Off by default: the plan carries no observation.
    plain = RK.rank_from_sources(listing, details, comments, {"*": lex}, RK.RankerParams(num_comments=2))
    assert plain.extras["counts"] == {}
