"""Candidate selection: listing cap, title filter, details semi-join,
duration filter, per-video comment cap, comments of kept videos.

Caps are ``row_number() <= n`` over a per-query / per-video window; Spark
plans them as a partial ``WindowGroupLimit`` before the shuffle and a final
one after, so a query or video holding a third of all rows ships at most
``n`` rows per map task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crowdrank.fixed_values import EXCLUDE_WORDS, MIN_DURATION_SECONDS, NUM_CANDIDATES, NUM_COMMENTS
from crowdrank.functions.durations import duration_hhmmss, duration_seconds
from crowdrank.operators.filters import filter_min_duration, filter_titles

__all__ = [
    "NUM_CANDIDATES", "NUM_COMMENTS", "cap_per_group", "cap_listing", "cap_comments",
    "with_durations", "kept_candidates", "candidate_details", "comments_of",
    "comment_counts", "filter_titles",
]


def _first_n(df: DataFrame, n: int, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def cap_per_group(
    df: DataFrame, n: int | None, group: Sequence[str], order: Sequence[str], buckets: int | None = None
) -> DataFrame:
    """First ``n`` rows of each group in ``order`` (ties need a full order
    to be deterministic).

    One window limit already keeps ≤ ``n`` rows per group and map task
    before the shuffle, but the task that finishes a hot group (a third of
    all rows) still receives ``n`` rows from every map task.  So the limit
    runs as a tree: first per (group, bucket of map tasks), then per group;
    each level sees about √tasks × n rows of a group.  Any bucketing gives
    the same exact result (the top ``n`` of a union is the top ``n`` of the
    per-bucket tops).  ``buckets`` defaults to ⌈√(input partitions)⌉; 1
    switches the tree off.  ``n=None`` keeps all rows.
    """
    if n is None:
        return df
    if buckets is None:
        buckets = tree_buckets(df)
    if buckets <= 1:
        return _first_n(df, n, group, order)
    bucketed = df.withColumn("_bucket", F.spark_partition_id() % F.lit(buckets))
    level1 = _first_n(bucketed, n, [*group, "_bucket"], order).drop("_bucket")
    return _first_n(level1, n, group, order)


def tree_buckets(df: DataFrame) -> int:
    """⌈√(partitions of ``df``)⌉.  Call it on a source (a scan): on a plan
    with exchanges, adaptive execution has to run them to know the count."""
    return math.isqrt(max(df.rdd.getNumPartitions() - 1, 0)) + 1


def cap_listing(listing: DataFrame, n: int | None = NUM_CANDIDATES, query: str = "query", position: str = "position") -> DataFrame:
    """T4: at most ``n`` listing entries per query, in source order."""
    return cap_per_group(listing, n, [query], [position])


def cap_comments(
    comments: DataFrame,
    n: int | None = NUM_COMMENTS,
    key: str = "video_id",
    order: Sequence[str] = ("position",),
    buckets: int | None = None,
) -> DataFrame:
    """W1: at most ``n`` comments per video, in source order."""
    return cap_per_group(comments, n, [key], list(order), buckets)


def with_durations(details: DataFrame, iso: str = "iso_duration") -> DataFrame:
    """D1, D2: ``duration`` text and ``duration_seconds`` from the ISO text."""
    return details.withColumns(
        {"duration": duration_hhmmss(F.col(iso)), "duration_seconds": duration_seconds(F.col(iso))}
    ).drop(iso)


def kept_candidates(
    listing: DataFrame,
    n: int | None = NUM_CANDIDATES,
    exclude_words: Sequence[str] = EXCLUDE_WORDS,
) -> DataFrame:
    """Cap first (on the raw listing), then the title filter."""
    return filter_titles(cap_listing(listing, n), exclude_words)


def candidate_details(
    details: DataFrame,
    kept: DataFrame,
    min_seconds: int | None = MIN_DURATION_SECONDS,
    key: str = "video_id",
) -> DataFrame:
    """J1 + F2: details of the kept ids only, then the duration filter."""
    ids = kept.select(key).distinct()
    return filter_min_duration(with_durations(details.join(ids, key, "left_semi")), min_seconds)


def comments_of(comments: DataFrame, videos: DataFrame, key: str = "video_id") -> DataFrame:
    """Comments of the given videos only (semi-join; one row per comment)."""
    return comments.join(videos.select(key).distinct(), key, "left_semi")


def comment_counts(videos: DataFrame, comments: DataFrame, key: str = "video_id") -> DataFrame:
    """J3 + A10: every video keeps its row; count of comments, 0 for none.

    Comments are counted per video first (partial aggregate), so the join
    sees one row per video on both sides.
    """
    per_video = comments.groupBy(key).agg(F.count(F.lit(1)).alias("n_comments"))
    return videos.join(per_video, key, "left").withColumn(
        "n_comments", F.coalesce(F.col("n_comments"), F.lit(0).cast("bigint"))
    )
