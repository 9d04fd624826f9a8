"""Landed source responses (JSON) → flat DataFrames.

The source answers in pages (a search page holds ≤ 50 items, a comment
page ≤ 100).  Landed responses are stored one JSON document per page and
read with an explicit schema (no inference); ``posexplode`` keeps each
item's position, so source order is ``(page, item_pos)``.  ``multi_line=True`` reads
files that hold one pretty-printed page each.  Pages that do not parse give no
rows; ``rejected_pages`` lists them.

The writers turn flat tables into that layout (used to land driver tables
and in tests).  A page is keyed by ``position div page_size`` with
positions unique per parent, so no page — however hot its parent — holds
more than ``page_size`` items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crowdrank import schemas as SC

SEARCH_PAGE = 50
DETAILS_PAGE = 50
COMMENTS_PAGE = 100


def _pages(df: DataFrame, parent: list[str], position: str, page_size: int, item) -> DataFrame:
    page = F.floor(F.col(position) / F.lit(page_size)).cast("bigint")
    return (
        df.withColumn("page", page)
        .groupBy(*parent, "page")
        .agg(F.sort_array(F.collect_list(F.struct(F.col(position).alias("_p"), item.alias("_i")))).alias("_items"))
        .select(*parent, "page", F.transform("_items", lambda x: x["_i"]).alias("items"))
    )


# --- writers -----------------------------------------------------------------------


def land_search(listing: DataFrame, path: str, page_size: int = SEARCH_PAGE) -> None:
    """listing (query, position, video_id, title) → search pages."""
    item = F.struct(
        F.struct(F.col("video_id").cast("string").alias("videoId")).alias("id"),
        F.struct(F.col("title").alias("title")).alias("snippet"),
    )
    _pages(listing, ["query"], "position", page_size, item).write.mode("overwrite").json(path)


def land_details(details: DataFrame, path: str, page_size: int = DETAILS_PAGE) -> None:
    """details (video_id, title, iso_duration, view/like/comment counts) →
    video detail pages (statistics as text, like the source)."""
    item = F.struct(
        F.col("video_id").cast("string").alias("id"),
        F.struct(F.col("title").alias("title")).alias("snippet"),
        F.struct(
            F.col("view_count").cast("string").alias("viewCount"),
            F.col("like_count").cast("string").alias("likeCount"),
            F.col("comment_count").cast("string").alias("commentCount"),
        ).alias("statistics"),
        F.struct(F.col("iso_duration").alias("duration")).alias("contentDetails"),
    )
    # Pages by number; ids that are no numbers are dealt out by their hash.
    position = F.coalesce(F.col("video_id").try_cast("bigint"), F.xxhash64(F.col("video_id").cast("string")))
    paged = _pages(details.withColumn("_pos", position), [], "_pos", page_size, item)
    paged.drop("page").write.mode("overwrite").json(path)


def land_comments(comments: DataFrame, path: str, page_size: int = COMMENTS_PAGE) -> None:
    """comments (video_id, position, comment_id, author, text, like_count)
    → comment-thread pages per video."""
    item = F.struct(
        F.struct(
            F.struct(
                F.col("comment_id").cast("string").alias("id"),
                F.struct(
                    F.col("author").alias("authorDisplayName"),
                    F.col("text").alias("textDisplay"),
                    F.col("like_count").cast("bigint").alias("likeCount"),
                ).alias("snippet"),
            ).alias("topLevelComment")
        ).alias("snippet")
    )
    df = comments.withColumn("video_id", F.col("video_id").cast("string"))
    _pages(df, ["video_id"], "position", page_size, item).write.mode("overwrite").json(path)


# --- readers (S1–S3) and flat projections (P1–P3) ------------------------------------

CORRUPT = "_corrupt_page"


def _read_pages(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool) -> DataFrame:
    kept = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType(), True)])
    return (
        spark.read.schema(kept).option("columnNameOfCorruptRecord", CORRUPT)
        .option("multiLine", multi_line).json(path)
    )


def rejected_pages(
    spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False
) -> DataFrame:
    """(file, page): the raw text of every landed page that does not parse, for
    a report or a second landing; the readers give no rows for them.
    ``schema`` is that of the reader (``SEARCH_RAW``, ``VIDEOS_RAW``, ``COMMENTS_RAW``)."""
    pages = _read_pages(spark, path, schema, multi_line)
    parsed = F.coalesce(F.size("items"), F.lit(0)) >= -1  # Spark wants a parsed column to be read as well
    return pages.where(F.col(CORRUPT).isNotNull() & parsed).select(
        F.col("_metadata.file_path").alias("file"), F.col(CORRUPT).alias("page")
    )


def read_search(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """S1 + P1: (query, page, item_pos, video_id, title)."""
    raw = _read_pages(spark, path, SC.SEARCH_RAW, multi_line)
    items = raw.select("query", "page", F.posexplode("items").alias("item_pos", "i"))
    return items.select(
        "query", "page", "item_pos",
        F.col("i.id.videoId").alias("video_id"),
        F.col("i.snippet.title").alias("title"),
    )


def read_details(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """S2 + P2: (video_id, title, iso_duration, view/like/comment counts);
    counts that are not numbers become NULL, a missing duration PT0S."""
    raw = _read_pages(spark, path, SC.VIDEOS_RAW, multi_line)
    items = raw.select(F.explode("items").alias("i"))
    return items.select(
        F.col("i.id").alias("video_id"),
        F.col("i.snippet.title").alias("title"),
        F.coalesce(F.col("i.contentDetails.duration"), F.lit("PT0S")).alias("iso_duration"),
        F.col("i.statistics.viewCount").try_cast("bigint").alias("view_count"),
        F.col("i.statistics.likeCount").try_cast("bigint").alias("like_count"),
        F.col("i.statistics.commentCount").try_cast("bigint").alias("comment_count"),
    )


def read_comments(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """S3 + P3: (video_id, page, item_pos, comment_id, author, text, like_count)."""
    raw = _read_pages(spark, path, SC.COMMENTS_RAW, multi_line)
    items = raw.select("video_id", "page", F.posexplode("items").alias("item_pos", "i"))
    c = "i.snippet.topLevelComment"
    return items.select(
        "video_id", "page", "item_pos",
        F.col(f"{c}.id").alias("comment_id"),
        F.col(f"{c}.snippet.authorDisplayName").alias("author"),
        F.col(f"{c}.snippet.textDisplay").alias("text"),
        F.col(f"{c}.snippet.likeCount").try_cast("bigint").alias("like_count"),
    )
