"""A1–A9 as mergeable state: scores that grow with new comments.

A state is one row per video of what its comments add up to: counts, the
confidences' mean and second moment (M2), the total's sum, the polar sums and
the relevance sum.  States of disjoint sets of comments merge exactly: counts
and sums add up, and the moments by the parallel rule

    mean = mean_a + d · n_b / n,   M2 = M2_a + M2_b + d² · n_a · n_b / n,   d = mean_b − mean_a,

which never subtracts large numbers from each other.  A day's comments become
one small table that is merged with the stored one; the comments of the days
before are not read again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdrank.fixed_values import PSEUDO_COUNT
from crowdrank.operators.scoring import _total_term, finish_scores, number, weighted_sentiment

SUMS = ("n_comments", "total_sum", "relevance_sum", "relevance_n", "positive_sum", "negative_sum")
MOMENTS = ("score_n", "score_mean", "score_m2")


def score_state(
    comments_scored: DataFrame, key: str = "video_id", total: str = "confidence", within: Sequence[str] = ()
) -> DataFrame:
    """comments_scored → state, one row per non-NULL key (and per value of the
    columns ``within``, for states that are merged afterwards).  Only
    decomposable aggregates: partial before any shuffle."""
    label, score = F.col("sentiment_label"), number(F.col("sentiment_score"))
    weighted = weighted_sentiment(label, score, F.col("like_count"))
    relevance = number(F.col("relevance_score")) if "relevance_score" in comments_scored.columns else F.lit(1.0)

    def summed(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0.0))

    return comments_scored.where(F.col(key).isNotNull()).groupBy(key, *within).agg(
        F.count(F.lit(1)).alias("n_comments"),
        summed(_total_term(total)).alias("total_sum"),
        summed(relevance).alias("relevance_sum"),
        F.count(relevance).alias("relevance_n"),
        summed(F.when(label == 1, weighted)).alias("positive_sum"),
        summed(F.when(label == -1, weighted)).alias("negative_sum"),
        F.count(score).alias("score_n"),
        F.coalesce(F.avg(score), F.lit(0.0)).alias("score_mean"),
        F.coalesce(F.var_pop(score) * F.count(score), F.lit(0.0)).alias("score_m2"),
    )


def merge_states(states: DataFrame, key: str = "video_id") -> DataFrame:
    """One row per key from a union of states (one row per key and part, a
    handful per key)."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def join(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        apart = b["mean"] - a["mean"]
        share = F.when(n > 0, b["n"].cast("double") / n).otherwise(F.lit(0.0))
        return F.struct(
            n.alias("n"), (a["mean"] + apart * share).alias("mean"),
            (a["m2"] + b["m2"] + apart * apart * a["n"] * share).alias("m2"),
        )

    parts = F.array_sort(F.collect_list(F.struct(
        F.col("score_n").alias("n"), F.col("score_mean").alias("mean"), F.col("score_m2").alias("m2")
    )))
    added = states.groupBy(key).agg(*[F.sum(c).alias(c) for c in SUMS], parts.alias("_parts"))
    merged = added.withColumn("_all", F.aggregate("_parts", zero, join))
    return merged.select(
        key, *SUMS, F.col("_all.n").alias("score_n"), F.col("_all.mean").alias("score_mean"), F.col("_all.m2").alias("score_m2")
    )


def add_comments(
    stored: DataFrame | None, comments_scored: DataFrame, key: str = "video_id", total: str = "confidence"
) -> DataFrame:
    """The stored state with new comments merged in (``stored`` None: the
    first ones).  ``total`` must be that of the stored state."""
    new = score_state(comments_scored, key, total)
    return new if stored is None else merge_states(stored.unionByName(new), key)


def scores_of_state(state: DataFrame, key: str = "video_id", pseudo_count: float = PSEUDO_COUNT) -> DataFrame:
    """state → video_scores."""
    n = F.col("score_n")
    aggregates = state.select(
        key, F.col("total_sum").alias("score_sum"),
        F.when(F.col("relevance_n") > 0, F.col("relevance_sum") / F.col("relevance_n")).alias("relevance_score"),
        F.when(n > 1, F.sqrt(F.greatest(F.col("score_m2"), F.lit(0.0)) / (n - 1))).alias("score_std"),
        F.abs("positive_sum").alias("positive_sum"), F.abs("negative_sum").alias("negative_sum"), "n_comments",
    )
    return finish_scores(aggregates, key, pseudo_count)
