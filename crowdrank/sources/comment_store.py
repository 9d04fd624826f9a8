"""S3 / J2 / A1: comments stored by video.

Comments are written once, bucketed by (video, slice) and partitioned by a
hash of the video.  What is computed per video then needs no exchange of
comments: a video's rows lie in its bucket, and a join with other tables moves
only these.  A video with more than ``SLICE_ROWS`` comments is dealt to slices of about that size
that lie in buckets of their own, so no bucket holds a hot video; per-video
results are computed per (video, slice) and merged, one small row each.

The partition column lets a join with few videos skip the partitions that hold
none of them (dynamic partition pruning), on top of Parquet's own statistics.

The store is a folder.  Opening it declares its layout to Spark under a name
made of the path (Spark takes bucketing from a table declaration only); ``close``
takes the name back, the folder stays.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crowdrank.operators.score_state import merge_states, score_state, scores_of_state
from crowdrank.session import scratch_path

SLICE_ROWS = 1_000_000
PARTS = 16
PART, SLICE = "video_part", "video_slice"


def part_of(video: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(video.cast("string")), F.lit(parts)).cast("int")


@dataclass(frozen=True)
class CommentStore:
    """comments (the stored columns, ``video_part``, ``video_slice``) and
    videos (video_id, n_comments, slices)."""

    comments: DataFrame
    videos: DataFrame
    parts: int
    name: str

    @staticmethod
    def write(
        comments: DataFrame, path: str | None = None, buckets: int | None = None, parts: int = PARTS,
        slice_rows: int = SLICE_ROWS, order: Sequence[str] = (),
    ) -> CommentStore:
        """Store ``comments`` (with ``video_id``; NULL ids are left out) in the
        new folder ``path``.  ``buckets`` defaults to the shuffle partitions;
        ``order`` are columns that rows of a video are sorted by."""
        spark = comments.sparkSession
        path = path or scratch_path(spark, "comment-store")
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        known = comments.where(F.col("video_id").isNotNull())
        videos = known.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_comments")).withColumn(
            "slices", F.ceil(F.col("n_comments") / slice_rows).cast("int")
        )
        videos.write.parquet(f"{path}/videos")
        # Only videos of several slices are looked up: they are few.
        hot = spark.read.parquet(f"{path}/videos").where("slices > 1").select("video_id", "slices")
        dealt = F.pmod(F.monotonically_increasing_id(), F.coalesce("slices", F.lit(1)).cast("long")).cast("int")
        laid = known.join(hot, "video_id", "left").withColumn(SLICE, dealt).drop("slices").withColumn(
            PART, part_of(F.col("video_id"), parts)
        )
        name = f"comment_store_{uuid.uuid4().hex}"
        (
            laid.repartition(buckets, "video_id", SLICE)  # the hash of the buckets: each task writes one
            .write.partitionBy(PART).bucketBy(buckets, "video_id", SLICE).sortBy("video_id", SLICE, *order)
            .option("path", f"{path}/comments").saveAsTable(name)
        )
        spark.sql(f"DROP TABLE {name}")
        layout = {"buckets": buckets, "parts": parts, "order": list(order), "schema": json.loads(laid.schema.json())}
        spark.createDataFrame([(json.dumps(layout),)], "layout string").coalesce(1).write.text(f"{path}/layout")
        return CommentStore.open(spark, path)

    @staticmethod
    def open(spark: SparkSession, path: str) -> CommentStore:
        """A store written before, by this or another session."""
        layout = json.loads(spark.read.text(f"{path}/layout").first().value)
        schema = T.StructType.fromJson(layout["schema"])
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        name = f"comment_store_{hashlib.md5(path.encode()).hexdigest()}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet PARTITIONED BY ({PART}) "
            f"CLUSTERED BY (video_id, {SLICE}) SORTED BY ({', '.join(['video_id', SLICE, *layout['order']])}) "
            f"INTO {layout['buckets']} BUCKETS LOCATION '{path}/comments'"
        )
        spark.catalog.recoverPartitions(name)
        return CommentStore(spark.table(name), spark.read.parquet(f"{path}/videos"), layout["parts"], name)

    def close(self) -> None:
        """Forget the declaration; what reads from it must have run."""
        self.comments.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")

    def scores(self, comments: DataFrame | None = None, **how) -> DataFrame:
        """video_scores of the stored comments (or of ``comments_of``'s):
        states per (video, slice) where they lie, then merged per video."""
        states = score_state(self.comments if comments is None else comments, within=[SLICE])
        return scores_of_state(merge_states(states.drop(SLICE)), **how)

    def comments_of(self, kept: DataFrame) -> DataFrame:
        """The stored comments of the videos in ``kept`` (video_id).  ``kept``
        is moved to the comments: one row per video and slice."""
        places = kept.select("video_id").distinct().join(self.videos, "video_id").select(
            "video_id", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias(SLICE),
            part_of(F.col("video_id"), self.parts).alias(PART),
        )
        return self.comments.join(places, [PART, "video_id", SLICE], "left_semi")
