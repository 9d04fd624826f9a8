"""Stage files: CSV sink and scan, Parquet stage materialisation, names.

* ``write_csv`` — header, no index, quotes doubled inside quoted fields, no
  trimming; an empty input writes nothing; returns the row count, taken
  with an ``Observation`` during the write (no second pass).
* ``write_ordered_csv`` / ``read_ordered_csv`` — part files in key order with a
  manifest, and each row's place in the whole when read back.
* ``read_csv`` — explicit schema, multi-line fields, ``"`` as quote and
  escape (the usual exchange format); a missing path gives ``None`` or
  raises ``FileNotFoundError``.
* ``materialize`` — write a stage as Parquet into the shared checkpoint
  folder and read it back: cuts the lineage, so a lost executor costs a
  re-read, not a recomputation of every stage before.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crowdrank.session import file_system, scratch_path

CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "multiLine": "true",
}
CSV_WRITE_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


BOM = "\ufeff"


def write_csv(
    df: DataFrame,
    path: str,
    null_value: str | None = None,
    order_by: list[str] | None = None,
    bom: bool = False,
) -> int:
    """Write ``df`` as CSV into the directory ``path``; returns the rows
    written.  ``order_by`` sorts the output (a range-partitioned sort, part
    files in key order), as grouped outputs were sorted by their key.
    ``bom=True`` starts every part file with a UTF-8 byte-order mark (the
    first header name carries it), for readers that expect one; each part
    file is a complete CSV with its own header, so no single task has to
    write the whole table.  The count comes from the write itself.

    The rows are written beside ``path`` and moved there when they are
    complete, in place of an earlier output; an empty ``df`` writes nothing and
    leaves an earlier output as it is."""
    if order_by:
        df = df.orderBy(*order_by)
    if bom and df.columns:
        first = df.columns[0]
        df = df.withColumnRenamed(first, BOM + first)
    return _write_aside(df, path, {"nullValue": null_value} if null_value is not None else {})


def _write_aside(df: DataFrame, path: str, options: dict[str, str]) -> int:
    spark = df.sparkSession
    aside = f"{path.rstrip('/')}.writing-{uuid.uuid4().hex}"
    obs = Observation("csv_sink")
    counted = df.observe(obs, F.count(F.lit(1)).alias("rows"))
    fs, new = file_system(spark, aside)
    try:
        counted.write.options(**{**CSV_WRITE_OPTIONS, **options}).csv(aside)
        rows = int(obs.get["rows"])
        if rows:
            _, old = file_system(spark, path)
            fs.delete(old, True)
            if not fs.rename(new, old):
                raise OSError(f"{aside} could not be moved to {path}")
        return rows
    finally:
        fs.delete(new, True)


# --- the ordered sink -----------------------------------------------------------------

ORDER_MANIFEST = "_order.json"


def write_ordered_csv(df: DataFrame, path: str, order_by: list[str], null_value: str = "") -> int:
    """T5: ``df`` sorted by ``order_by`` (NULLs first), as part files in key order
    without headers, and a manifest that names them in that order with their
    rows, after the header line.  Header and parts, one after the other, are the
    one sorted CSV file; whoever needs that file joins the parts byte by byte, and
    no task here writes the whole.  An empty ``df`` writes nothing."""
    spark = df.sparkSession
    rows = _write_aside(df.orderBy(*order_by), path, {"header": "false", "nullValue": null_value})
    if not rows:
        return 0
    lines = _read_parts(spark, path, df.schema, null_value).groupBy("_file").agg(F.count(F.lit(1)).alias("rows"))
    parts = sorted((r["_file"].rsplit("/", 1)[1], r["rows"]) for r in lines.collect())  # a row per file
    quoted = ",".join('"' + name.replace('"', '""') + '"' for name in df.columns)
    manifest = {"header": quoted, "order_by": order_by, "rows": rows, "parts": parts, "null_value": null_value,
                "schema": json.loads(df.schema.json())}
    fs, at = file_system(spark, f"{path.rstrip('/')}/{ORDER_MANIFEST}")
    stream = fs.create(at)
    try:
        stream.write(bytearray(json.dumps(manifest).encode()))
    finally:
        stream.close()
    return rows


def _read_parts(spark: SparkSession, path: str, schema: T.StructType, null_value: str) -> DataFrame:
    reader = spark.read.schema(schema).options(**{**CSV_OPTIONS, "header": "false", "nullValue": null_value})
    return reader.csv(path).withColumn("_file", F.col("_metadata.file_path"))


def order_manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest of an ordered output; None where there is none."""
    fs, at = file_system(spark, f"{path.rstrip('/')}/{ORDER_MANIFEST}")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def read_ordered_csv(spark: SparkSession, path: str) -> DataFrame:
    """An ordered output with ``row_number``, each row's place in the whole,
    counted from 0: the rows of the parts before, and its place in its file."""
    manifest = order_manifest(spark, path)
    if manifest is None:
        raise FileNotFoundError(path)
    schema = T.StructType.fromJson(manifest["schema"])
    before, starts = 0, []
    for name, rows in manifest["parts"]:
        starts.append((name, before))
        before += rows
    part = F.element_at(F.split("_file", "/"), -1)
    at = F.row_number().over(Window.partitionBy("_file").orderBy("_at")) - 1
    rows = _read_parts(spark, path, schema, manifest["null_value"]).withColumn("_at", F.monotonically_increasing_id())
    first = F.broadcast(spark.createDataFrame(starts, "_part string, _before long"))  # a row per file
    return rows.withColumn("_in", at).join(first, part == F.col("_part")).select(
        (F.col("_before") + F.col("_in")).cast("long").alias("row_number"), *schema.names
    )


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    missing_ok: bool = False,
    null_value: str | None = None,
) -> DataFrame | None:
    reader = spark.read.schema(schema).options(**CSV_OPTIONS)
    if null_value is not None:
        reader = reader.option("nullValue", null_value)
    try:
        df = reader.csv(path)
        df.schema  # noqa: B018 - resolve the path now
        return df
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc):
            if missing_ok:
                return None
            raise FileNotFoundError(path) from exc
        raise


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and return
    the re-read table."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def stage_name(query: str, stage: str, ext: str = "") -> str:
    """File name of a stage's output: spaces in the query become '_'."""
    return f"{query.replace(' ', '_')}_{stage}{ext}"


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """The first rows (for display only)."""
    return df.limit(n)
