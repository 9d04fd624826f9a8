"""The streaming scores equal the batch scores over the same files."""

import pytest

from crowdrank import schemas as SC
from crowdrank.operators import scoring as S
from crowdrank.session import scratch_path
from crowdrank.streaming import latest_video_scores, start_video_scores


def test_stream_equals_batch(spark):
    rows = [
        ("v1", f"c{i}", "a", "t", "t", "en", i % 3, 1.0, 1 - 2 * (i % 2), "x", 0.5 + (i % 5) / 10)
        for i in range(40)
    ] + [("v2", "d", "a", "t", "t", "fr", 2, 1.0, 0, "x", 0.9)]
    df = spark.createDataFrame(rows, SC.COMMENTS_SCORED)
    src = scratch_path(spark, "stream-src")
    df.repartition(4).write.parquet(src)
    q = start_video_scores(spark, src, "scores_stream_test", sink="memory")
    q.awaitTermination(120)
    streamed = {r["video_id"]: r for r in spark.sql("SELECT * FROM scores_stream_test").collect()}
    batch = {r["video_id"]: r for r in S.video_scores(df).collect()}
    assert set(streamed) == set(batch)
    for vid, r in batch.items():
        for col in ("total_score", "polarization_score_with_pseudo_count"):
            assert streamed[vid][col] == pytest.approx(r[col])


def test_changelog_sink_over_two_runs_equals_batch(spark):
    def rows(vids, start):
        return [
            (v, f"{v}-{i}", "a", "t", "t", "en", i % 4, 1.0, 1 - (i % 3), "x", 0.4 + (i % 6) / 10)
            for v in vids for i in range(start, start + 7)
        ]

    first = spark.createDataFrame(rows(["v1", "v2"], 0), SC.COMMENTS_SCORED)
    second = spark.createDataFrame(rows(["v2", "v3"], 100), SC.COMMENTS_SCORED)
    src, ckpt, log = (scratch_path(spark, n) for n in ("cl-src", "cl-ckpt", "cl-log"))
    first.write.parquet(f"{src}/part=1")
    start_video_scores(spark, src, "cl_a", checkpoint=ckpt, sink_path=log).awaitTermination(120)
    second.write.parquet(f"{src}/part=2")
    start_video_scores(spark, src, "cl_b", checkpoint=ckpt, sink_path=log).awaitTermination(120)
    got = {r["video_id"]: r for r in latest_video_scores(spark, log).collect()}
    want = {r["video_id"]: r for r in S.video_scores(first.unionByName(second)).collect()}
    assert set(got) == set(want) == {"v1", "v2", "v3"}
    for vid, r in want.items():
        for col in ("total_score", "std_deviation", "polarization_score_with_pseudo_count"):
            assert got[vid][col] == pytest.approx(r[col])
