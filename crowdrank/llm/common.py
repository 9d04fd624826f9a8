"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdrank.session import scratch_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table by Spark's own reader (any file system it knows)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


BATCH_ROWS = 1_000  # whole texts go to Python in batches of at most so many rows


def lean_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to ``BATCH_ROWS``, unless it is
    smaller: a Python worker holds one batch of whole texts at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names: extra columns
    of the input, whatever they are called, never meet internal ones."""
    lean_batches(df.sparkSession)
    return df.select(*[df[source].alias(name) for name, source in columns.items()])


def materialise(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: cuts
    lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (NULL id: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without_ids(df: DataFrame, ids: DataFrame, id_col: str, most: int = 1_000_000) -> DataFrame:
    """Rows of ``df`` whose ``id_col`` is not in the one column of ``ids``
    (NULL stays).  Up to ``most`` ids (8 MB) are broadcast; more are joined by
    a shuffle, with the same result."""
    gone = ids.toDF(id_col)
    gone = F.broadcast(gone) if gone.count() <= most else gone
    return df.join(gone, id_col, "left_anti").select(*df.columns)
