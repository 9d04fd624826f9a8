"""Per-video scores from scored comments.

One ``groupBy(video_id)`` with decomposable aggregates only (sums, counts and
the second moment), so Spark runs a partial aggregate before the shuffle and
a viral video with a third of all comments costs one partial row per map
task, not a hot reducer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdrank.fixed_values import PSEUDO_COUNT

TOTAL_MODES = ("confidence", "signed", "weighted")


def number(value: Column) -> Column:
    """A double in which NaN is missing (NULL), so that it wins no maximum."""
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def weighted_sentiment(label: Column, score: Column, likes: Column) -> Column:
    """label × score × likes (NULL when any part is NULL)."""
    return number(label) * number(score) * number(likes)


def with_weighted_score(comments_scored: DataFrame) -> DataFrame:
    """Add ``weighted_sentiment_score`` (the comments_weighted table)."""
    return comments_scored.withColumn(
        "weighted_sentiment_score",
        weighted_sentiment(
            F.col("sentiment_label"), F.col("sentiment_score"), F.col("like_count")
        ),
    )


def _total_term(mode: str) -> Column:
    label = F.col("sentiment_label").cast("double")
    score = number(F.col("sentiment_score"))
    if mode == "confidence":
        return score
    if mode == "signed":
        return label * score
    if mode == "weighted":
        return label * score * number(F.col("like_count"))
    raise ValueError(f"total must be one of {TOTAL_MODES}, got {mode!r}")


def polarization(pos: Column, neg: Column) -> Column:
    """4 · p/(p+n) · n/(p+n); 0 when there is no polar weight."""
    both = pos + neg
    return F.when(both == 0, F.lit(0.0)).otherwise(
        F.lit(4.0) * F.try_divide(pos, both) * F.try_divide(neg, both)
    )


def video_score_aggregates(
    comments_scored: DataFrame, key: str = "video_id", total: str = "confidence"
) -> DataFrame:
    """Raw per-video aggregates: sums, moments, polar weights and count.

    Works with or without a ``relevance_score`` column (constant 1 when it
    is absent).
    """
    label = F.col("sentiment_label")
    score = number(F.col("sentiment_score"))
    weighted = weighted_sentiment(label, score, F.col("like_count"))
    relevance = (
        number(F.col("relevance_score"))
        if "relevance_score" in comments_scored.columns
        else F.lit(1.0)
    )
    return (
        comments_scored.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.coalesce(F.sum(_total_term(total)), F.lit(0.0)).alias("score_sum"),
            F.avg(relevance).alias("relevance_score"),
            F.stddev_samp(score).alias("score_std"),
            F.abs(F.coalesce(F.sum(F.when(label == 1, weighted)), F.lit(0.0))).alias(
                "positive_sum"
            ),
            F.abs(F.coalesce(F.sum(F.when(label == -1, weighted)), F.lit(0.0))).alias(
                "negative_sum"
            ),
            F.count(F.lit(1)).alias("n_comments"),
        )
    )


def finish_scores(
    aggregates: DataFrame,
    key: str = "video_id",
    pseudo_count: float = PSEUDO_COUNT,
    relevance: Column | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Apply shrinkage and the relevance adjustment to raw aggregates.

    ``relevance`` overrides the aggregated mean relevance (used when the
    relevance comes from a per-video table joined after aggregation);
    ``keep`` names extra columns to carry along (e.g. the query).
    """
    rel = relevance if relevance is not None else F.col("relevance_score")
    n = F.col("n_comments").cast("double")
    shrunk = (n / (n + F.lit(float(pseudo_count)))) * polarization(
        F.col("positive_sum"), F.col("negative_sum")
    )
    root = F.sqrt(rel)
    return aggregates.select(
        *[F.col(c) for c in keep],
        F.col(key),
        (F.col("score_sum") * rel).alias("total_score"),
        rel.alias("relevance_score"),
        (F.col("score_std") * root).alias("std_deviation"),
        (shrunk * root).alias("polarization_score_with_pseudo_count"),
    )


def video_scores(
    comments_scored: DataFrame,
    key: str = "video_id",
    pseudo_count: float = PSEUDO_COUNT,
    total: str = "confidence",
) -> DataFrame:
    """comments_scored → video_scores (one row per non-NULL key)."""
    return finish_scores(
        video_score_aggregates(comments_scored, key=key, total=total),
        key=key,
        pseudo_count=pseudo_count,
    )


def video_scores_with_relevance(
    comments_scored: DataFrame,
    videos: DataFrame,
    key: str = "video_id",
    pseudo_count: float = PSEUDO_COUNT,
    total: str = "confidence",
) -> DataFrame:
    """Scores where the relevance is a per-video column of ``videos``.

    Aggregates the (large) comments first, then joins the one-row-per-video
    result with ``videos`` (inner, like copying the relevance onto every
    comment and dropping comments of unknown videos), so the join moves one
    row per video instead of one per comment.
    """
    aggregates = video_score_aggregates(
        comments_scored.drop("relevance_score"), key=key, total=total
    ).drop("relevance_score")
    per_video = videos.select(F.col(key), number(F.col("relevance_score")).alias("_rel"))
    joined = aggregates.join(per_video, key, "inner")
    return finish_scores(joined, key=key, pseudo_count=pseudo_count, relevance=F.col("_rel"))
