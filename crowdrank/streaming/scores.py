"""Structured Streaming form of the per-video scores.

The aggregation state is one row per video (sums, counts and moments, all
decomposable).  Each micro-batch emits only the videos it changed (output
mode ``update``); the default sink appends them, tagged with the batch id,
to a Parquet changelog in the shared checkpoint folder, and
``latest_video_scores`` reads the newest row per video from it.  A batch
that is retried after a failure first removes what an earlier attempt of
the same batch id wrote, so the changelog holds each batch once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from crowdrank import schemas as SC
from crowdrank.fixed_values import PSEUDO_COUNT
from crowdrank.operators import scoring as S
from crowdrank.session import scratch_path

BATCH = "batch_id"


def video_scores_stream(
    comments_scored: DataFrame, pseudo_count: float = PSEUDO_COUNT, total: str = "confidence"
) -> DataFrame:
    """Streaming DataFrame of video_scores (use output mode ``update`` or
    ``complete``); the aggregation state is one row per video."""
    return S.video_scores(comments_scored, pseudo_count=pseudo_count, total=total)


def _append_changelog(path: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        # Partitioned by batch id: a retried batch overwrites only its own
        # partition (dynamic partition overwrite), never earlier batches.
        (
            batch.withColumn(BATCH, F.lit(batch_id).cast("bigint"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(BATCH)
            .parquet(path)
        )

    return write


def start_video_scores(
    spark: SparkSession,
    source_dir: str,
    query_name: str,
    checkpoint: str | None = None,
    sink: str = "changelog",
    sink_path: str | None = None,
    trigger_available_now: bool = True,
) -> StreamingQuery:
    """Read landed scored-comment Parquet files from ``source_dir`` as a
    stream and keep per-video scores up to date.

    ``sink="changelog"`` (default) appends each micro-batch's changed videos
    to ``sink_path`` (default: a new folder under the shared checkpoint
    folder; read it with ``latest_video_scores``).  ``sink="memory"`` keeps
    the whole table in the driver under ``query_name`` — for tests only.
    The stream's own checkpoint lives in the shared checkpoint folder
    unless given."""
    stream = spark.readStream.schema(SC.COMMENTS_SCORED).parquet(source_dir)
    scores = video_scores_stream(stream)
    location = checkpoint or scratch_path(spark, f"stream-{query_name}")
    if sink == "memory":
        writer = scores.writeStream.outputMode("complete").format("memory").queryName(query_name)
    elif sink == "changelog":
        target = sink_path or scratch_path(spark, f"scores-{query_name}")
        writer = scores.writeStream.outputMode("update").foreachBatch(_append_changelog(target)).queryName(query_name)
    else:
        raise ValueError(f"unknown sink {sink!r}")
    writer = writer.option("checkpointLocation", location)
    if trigger_available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def latest_video_scores(spark: SparkSession, changelog: str, key: str = "video_id") -> DataFrame:
    """Newest row per video of a scores changelog (a per-video window
    limit: one row per video and map task leaves before the shuffle)."""
    log = spark.read.parquet(changelog)
    w = Window.partitionBy(key).orderBy(F.col(BATCH).desc())
    return log.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn", BATCH)
