"""Driver tables and their bindings to the roles of the ranking flow.

The driver tables are not keyed like listings, videos and comments, so each
role is bound by a projection (column pruning reaches the Parquet scan):

* B1 — ``lineitem`` as scored comments: item ``l_partkey``; label from
  ``l_returnflag`` (A → 1, N → 0, R → −1); confidence ``1 − l_discount``;
  likes ``l_quantity``.  ``part`` as the video/details table.
* B2 — ``documents`` as comments: item ``source``, comment ``doc_id``,
  language ``lang``, likes ``doc_id % 10``; ``labels`` as gold labels.
* B3 — ``pages.html`` as raw comment markup.
* B4 — ``part`` as search listing: query ``p_brand``, source order
  ``p_partkey``, title ``p_name``, duration ``PT{h}H{m}M{s}S`` made from
  ``p_size`` and ``p_partkey``.
* B5 — ``conversations`` as landed comment threads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


# Tables whose rows carry whole texts: per-row work (regexes) dominates.
TEXT_TABLES = ("documents", "pages", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


UNDER_SPLIT = 16  # scan tasks from which on a table is never moved


def spread(df: DataFrame, tasks_per_core: int = 2) -> DataFrame:
    """Spread rows over the cluster when the scan yields a handful of tasks.

    Parquet splits only at row-group boundaries, so a file written as one
    row group is read by one task; CPU-heavy per-row work (text cleaning,
    language, sentiment) would then run on one core.  Only a scan of fewer
    than ``UNDER_SPLIT`` tasks is repartitioned round-robin (sorted before the
    repartition by Spark, so a retried task gets the same rows), whatever the
    number of cores; any larger table stays as its scan splits it.
    """
    target = df.sparkSession.sparkContext.defaultParallelism * tasks_per_core
    if df.rdd.getNumPartitions() >= min(target, UNDER_SPLIT):
        return df
    return df.repartition(target)


def returnflag_label(flag: Column) -> Column:
    return (
        F.when(flag == "A", F.lit(1))
        .when(flag == "N", F.lit(0))
        .when(flag == "R", F.lit(-1))
        .cast("int")
    )


def lineitem_comments_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: one scored comment per lineitem row."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_partkey").alias("video_id"),
        returnflag_label(F.col("l_returnflag")).alias("sentiment_label"),
        (F.lit(1.0) - F.col("l_discount")).alias("sentiment_score"),
        F.col("l_quantity").cast("bigint").alias("like_count"),
    )


LINEITEM_ORDER = (
    "l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
)


def lineitem_comments_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1 scored comments plus every column of the source order (needed by
    the per-item cap, as (orderkey, linenumber) is not unique)."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_partkey").alias("video_id"),
        returnflag_label(F.col("l_returnflag")).alias("sentiment_label"),
        (F.lit(1.0) - F.col("l_discount")).alias("sentiment_score"),
        F.col("l_quantity").cast("bigint").alias("like_count"),
        *[F.col(c) for c in LINEITEM_ORDER],
    )


def lineitem_comment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1 with every lineitem column kept (for the per-item cap, whose
    source order needs all columns as (orderkey, linenumber) is not unique)."""
    return read_table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "video_id")


def part_iso_duration(partkey: Column, size: Column) -> Column:
    """B4 duration text: hours from the key, minutes from the size, seconds
    from the key; every 13th part gets a day part (parsed as zero)."""
    hours = (partkey % 3).cast("string")
    seconds = (partkey % 60).cast("string")
    regular = F.concat(F.lit("PT"), hours, F.lit("H"), size.cast("string"), F.lit("M"), seconds, F.lit("S"))
    with_day = F.concat(F.lit("P1DT"), size.cast("string"), F.lit("H"))
    return F.when(partkey % 13 == 0, with_day).otherwise(regular)


def part_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4: search listing rows (query, position, video_id, title)."""
    part = read_table(spark, sf_dir, "part")
    return part.select(
        F.col("p_brand").alias("query"),
        F.col("p_partkey").alias("position"),
        F.col("p_partkey").alias("video_id"),
        F.col("p_name").alias("title"),
    )


def part_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4: the catalogue that is searched (video_id, title, position), titles
    of name, type and brand."""
    part = read_table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("video_id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("title"),
        F.col("p_partkey").alias("position"),
    )


def part_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4: search queries, every name with every brand it is sold under."""
    part = read_table(spark, sf_dir, "part")
    return part.select(F.concat_ws(" ", "p_name", "p_brand").alias("query")).distinct()


def part_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4: video details rows (video_id, title, ISO duration, statistics)."""
    part = read_table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("video_id"),
        F.col("p_name").alias("title"),
        part_iso_duration(F.col("p_partkey"), F.col("p_size")).alias("iso_duration"),
        F.col("p_retailprice").cast("bigint").alias("view_count"),
        F.col("p_size").cast("bigint").alias("like_count"),
        F.lit(None).cast("bigint").alias("comment_count"),
    )


def documents_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: documents as comments of the video ``source``."""
    docs = read_table(spark, sf_dir, "documents")
    return docs.select(
        F.col("source").alias("video_id"),
        F.col("doc_id").alias("comment_id"),
        F.col("text"),
        F.col("lang").alias("language"),
        (F.col("doc_id") % 10).alias("like_count"),
    )


def gold_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: raw label text from ``labels``: toxic → 'Very Negative',
    quality → 'Positive', else 'Neutral'."""
    labels = read_table(spark, sf_dir, "labels")
    raw = (
        F.when(F.col("toxic") == 1, F.lit("Very Negative"))
        .when(F.col("quality") == 1, F.lit("Positive"))
        .otherwise(F.lit("Neutral"))
    )
    return labels.select(F.col("doc_id"), raw.alias("original_sentiment_label"))
