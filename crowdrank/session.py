"""Spark session and shared scratch folders."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Session settings that matter at any scale: adaptive execution (coalesce
# small shuffle partitions, split skewed ones, switch join strategy from
# runtime sizes), Arrow for the few Python boundaries, UTC timestamps and no
# web UI.
SESSION_CONF: dict[str, str] = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    master: str | None = None,
    app_name: str = "crowdrank",
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or return) a session with the settings above.

    ``master`` and ``shuffle_partitions`` are for local runs; on a cluster
    leave them unset so the cluster's own values apply.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(SESSION_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf.setdefault("spark.driver.memory", os.environ.get("CROWDRANK_DRIVER_MEMORY", "16g"))
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the folder must be configured (it has to be visible to all
    executors and survive the loss of any of them).  Only a local-mode
    session without one gets a fresh folder of its own, as in tests.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; set it to a folder shared by the cluster"
        )
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="crowdrank-checkpoint-"))
    return sc.getCheckpointDir()


_SCRATCH: list[str] = []  # paths handed out by this process


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, not yet existing path under the shared checkpoint folder."""
    root = checkpoint_root(spark).rstrip("/")
    _SCRATCH.append(f"{root}/{name}-{uuid.uuid4().hex}")
    return _SCRATCH[-1]


def file_system(spark: SparkSession, path: str) -> tuple:
    """(Hadoop file system, path object) of a path on any storage Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def clear_scratch(spark: SparkSession) -> int:
    """Delete what this process wrote under ``scratch_path`` paths; returns how
    many there were.  For the end of a job: tables that still read from them
    can no longer be computed."""
    cleared = 0
    while _SCRATCH:
        fs, at = file_system(spark, _SCRATCH.pop())
        cleared += bool(fs.delete(at, True))
    return cleared
