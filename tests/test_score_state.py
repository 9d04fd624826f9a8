"""Mergeable scores and comments stored by video."""

import math
import random

import pytest
from pyspark.sql import functions as F

from crowdrank.operators import score_state as ST
from crowdrank.operators import scoring as S
from crowdrank.sources.comment_store import PART, SLICE, CommentStore

SCHEMA = "video_id string, sentiment_label int, sentiment_score double, like_count long, relevance_score double"


def rows(n=300, seed=2):
    rng = random.Random(seed)
    out = [
        (rng.choice(["a", "b", "c", "hot", "hot", "hot", None, f"v{k}"]), rng.choice([1, 0, -1, None]),
         rng.choice([None, float("nan"), 1e2 + rng.random(), 1e2 + rng.random()]), rng.choice([None, 0, 3, 7]),
         rng.choice([None, 0.5, 1.0]))
        for k in range(n)
    ]
    return out + [("one", 1, 0.5, 1, 1.0), ("none", None, None, None, None)]


def table(scores):
    def near(v):
        return None if v is None else float(f"{v:.9e}") if isinstance(v, float) else v

    return sorted((tuple(near(v) for v in r) for r in scores.collect()), key=str)


@pytest.mark.parametrize("total", S.TOTAL_MODES)
def test_states_of_parts_merge_to_the_scores_of_all(spark, total):
    comments = spark.createDataFrame(rows(), SCHEMA).withColumn("n", F.monotonically_increasing_id())
    want = table(S.video_scores(comments.drop("n"), total=total))
    state = None
    for part in range(5):
        state = ST.add_comments(state, comments.where(F.col("n") % 5 == part).drop("n"), total=total)
    assert table(ST.scores_of_state(state)) == want
    assert table(ST.scores_of_state(ST.add_comments(None, comments, total=total))) == want


def test_moments_keep_their_digits(spark):
    values = [1e9 + x for x in (0.1, 0.2, 0.4, 0.8)]
    comments = spark.createDataFrame([("v", 1, x, 1) for x in values], "video_id string, sentiment_label int, sentiment_score double, like_count long")
    halves = ST.score_state(comments.limit(2)).unionByName(ST.score_state(comments.subtract(comments.limit(2))))
    got = ST.scores_of_state(ST.merge_states(halves)).first().std_deviation
    mean = sum(x - 1e9 for x in values) / 4
    want = math.sqrt(sum((x - 1e9 - mean) ** 2 for x in values) / 3)
    assert got == pytest.approx(want, rel=1e-6)


def test_states_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame(rows(20), SCHEMA)
    assert ST.scores_of_state(ST.add_comments(None, none)).count() == 0
    both = ST.add_comments(ST.add_comments(None, none), some)
    assert table(ST.scores_of_state(both)) == table(S.video_scores(some))


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_store_scores_without_moving_comments(spark, tmp_path):
    comments = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    store = CommentStore.write(comments, str(tmp_path / "store"), buckets=4, parts=3, slice_rows=10)
    assert table(store.scores()) == table(S.video_scores(comments))
    hot = store.comments.where("video_id = 'hot'").groupBy(SLICE).count().collect()
    assert len(hot) > 5 and max(r["count"] for r in hot) <= 20
    plan = plan_of(store.scores())
    # Below the first whole aggregate, which is per (video, slice), nothing is moved.
    lines = plan.split("== Initial Plan ==")[0].split("\n")
    scan = max(i for i, line in enumerate(lines) if "FileScan" in line)
    aggregates = [i for i, line in enumerate(lines) if "Aggregate(keys=[video_id" in line and SLICE in line and i < scan]
    assert len(aggregates) == 2 and not any("Exchange" in line for line in lines[aggregates[0]:scan])
    assert "Bucketed: true" in plan
    # Another session finds the layout in the folder.
    again = CommentStore.open(spark.newSession(), str(tmp_path / "store"))
    assert again.scores().count() == store.scores().count()
    again.close()


def test_few_videos_read_few_partitions(spark, tmp_path):
    comments = spark.createDataFrame(rows(600), SCHEMA)
    store = CommentStore.write(comments, str(tmp_path / "store"), buckets=2, parts=8, slice_rows=25)
    catalog = tmp_path / "videos"
    spark.createDataFrame([(f"v{k}", k) for k in range(600)] + [("hot", -1)], "video_id string, n int").write.parquet(str(catalog))
    kept = spark.read.parquet(str(catalog)).where("n in (-1, 5)")
    of_kept = store.comments_of(kept)
    want = comments.where(F.col("video_id").isin("hot", "v5"))
    assert sorted(map(str, of_kept.drop(PART, SLICE).collect())) == sorted(map(str, want.collect()))
    assert table(store.scores(of_kept)) == table(S.video_scores(want))
    assert "dynamicpruning" in plan_of(of_kept)
    store.close()


def test_a_store_of_nothing(spark, tmp_path):
    store = CommentStore.write(spark.createDataFrame([], SCHEMA), str(tmp_path / "store"), buckets=2)
    assert store.scores().count() == 0
    store.close()
