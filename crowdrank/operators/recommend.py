"""Best and most polarized video from video_scores.

All picks are global top-k (``orderBy(...).limit(k)``), which Spark plans as
``TakeOrderedAndProject``: every task keeps its own k best rows and one task
merges k × tasks rows, so nothing grows with the data.  Floating sums differ
in their last bits with partition order, so ranking keys are rounded first
and ties go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdrank.fixed_values import SCORE_FORMAT, TOP_POLARIZED, WATCH_URL_PREFIX

POL = "polarization_score_with_pseudo_count"
RANK_DIGITS = 9


def _rank_key(col: str | Column, digits: int = RANK_DIGITS) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c, digits)


# NULL keys sort last, so "drop NULLs, then take k" equals "take k, then
# drop NULLs"; filtering after the limit keeps every branch's input the same
# plan (a filter before would be pushed into the scores and defeat reuse).


def best_video(scores: DataFrame, key: str = "video_id") -> DataFrame:
    """Row with the highest total score; NULL never wins; ties → smaller id."""
    return (
        scores.orderBy(_rank_key("total_score").desc_nulls_last(), F.col(key).asc())
        .limit(1)
        .filter(F.col("total_score").isNotNull())
    )


def top_polarized(scores: DataFrame, k: int = TOP_POLARIZED, key: str = "video_id") -> DataFrame:
    """The k rows with the highest polarization; ties → smaller id."""
    return (
        scores.orderBy(_rank_key(POL).desc_nulls_last(), F.col(key).asc())
        .limit(k)
        .filter(F.col(POL).isNotNull())
    )


def most_polarized(scores: DataFrame, k: int = TOP_POLARIZED, key: str = "video_id") -> DataFrame:
    """Among the top-k polarized, the one with the largest positive
    polarization × total; ties → earlier in the top-k order.  Empty when no
    product is above zero."""
    product = F.col(POL) * F.col("total_score")
    return (
        top_polarized(scores, k, key)
        .withColumn("_product", product)
        .filter(F.col("_product") > 0)
        .orderBy(_rank_key("_product").desc(), _rank_key(POL).desc(), F.col(key).asc())
        .limit(1)
        .drop("_product")
    )


def _tagged(df: DataFrame, role: str, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The same columns for every branch, so that the scores' shuffle is
    one subplan shared by all branches (Spark reuses the exchange instead of
    running everything before it once per branch)."""
    return df.select(
        F.lit(role).alias("_role"), *[F.col(c) for c in keep], F.col(key).alias("_id"),
        F.col("total_score").alias("_total"), F.col(POL).alias("_pol"),
        F.col("std_deviation").alias("_std"),
    )


def _pick(role: str, col: str) -> Column:
    return F.max(F.when(F.col("_role") == role, F.col(col)))


def result_columns() -> list[Column]:
    return [
        _pick("best", "_id").alias("best_video_id"),
        _pick("best", "_total").alias("best_score"),
        _pick("polarized", "_id").alias("most_polarized_video_id"),
        _pick("polarized", "_pol").alias("most_polarized_polarization_score"),
        _pick("polarized", "_std").alias("most_polarized_std_deviation"),
    ]


def recommendation(scores: DataFrame, k: int = TOP_POLARIZED, key: str = "video_id") -> DataFrame:
    """Always exactly one row with the five result columns (NULLs when a
    side has no answer, e.g. on empty input)."""
    tagged = _tagged(best_video(scores, key), "best", key).unionByName(
        _tagged(most_polarized(scores, k, key), "polarized", key)
    )
    return tagged.agg(*result_columns())


def recommendation_report(rec: DataFrame, url_prefix: str = WATCH_URL_PREFIX) -> DataFrame:
    """Add the printed result fields: scores with two decimals and watch
    URLs built from the ids."""

    def fmt(col: str) -> Column:
        return F.when(F.col(col).isNotNull(), F.format_string(SCORE_FORMAT, F.col(col)))

    def url(col: str) -> Column:
        return F.when(
            F.col(col).isNotNull(), F.concat(F.lit(url_prefix), F.col(col).cast("string"))
        )

    return rec.select(
        "*",
        fmt("best_score").alias("best_score_text"),
        url("best_video_id").alias("best_video_url"),
        fmt("most_polarized_polarization_score").alias("polarization_text"),
        fmt("most_polarized_std_deviation").alias("std_deviation_text"),
        url("most_polarized_video_id").alias("most_polarized_video_url"),
    )
