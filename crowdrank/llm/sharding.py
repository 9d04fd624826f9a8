"""Operator 13: shards by weighted rendezvous hashing.

Every shard bids for every record with ``-ln(u) / weight``, ``u`` in (0, 1)
being the MD5 of ``key:shard``; the lowest bid wins, ties go to the smaller
shard.  A record's bids do not depend on the other shards, so one more shard
takes records only into itself, and a shard that goes loses only its own; a
shard of weight two gets twice the records.  The law is ``key``: the key and
the shards alone decide, neither the text nor its copies (equal texts with
different keys may part).

All of it is native expressions.  ``assign_shards`` moves no row.
``number_rows`` numbers the rows of each shard by one range shuffle of narrow
rows: they are sorted by (shard, key, size, checksum), so a partition is a
stretch of the whole order, and a row's number is its place in the partition
plus the rows of the partitions before it.  No shard is ever one task.  A last
sort key that is unique splits a hot key, so rows under one key spread over
partitions as well; rows equal in every sort key are interchangeable.

Defined cases: a NULL key is a key of its own; NULL text has no bytes; repeated
rows get slots of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdrank.llm.common import materialise, narrow

LAW = "key"
HASH_DIGITS = 13  # hex digits of the MD5 that make u: 52 bits, exact in a double
NULL_KEY = "\x00"  # no decimal number reads like it


def bids(key: Column, weights: Mapping[int, float]) -> Column:
    """Array of (bid, shard), one per shard of ``weights`` (positive weights)."""
    if not weights or min(weights.values()) <= 0:
        raise ValueError("weights must be positive, for one shard or more")
    name = F.coalesce(key.cast("string"), F.lit(NULL_KEY))
    out = []
    for shard, weight in sorted(weights.items()):
        digest = F.md5(F.concat(name, F.lit(f":{shard}")).cast("binary"))
        drawn = F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("double")
        u = (drawn + F.lit(0.5)) / F.lit(float(16 ** HASH_DIGITS))
        out.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("bid"), F.lit(shard).alias("shard")))
    return F.array(*out)


def shard_of(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard with the lowest bid for ``key``."""
    return F.array_min(bids(key, weights))["shard"]


def text_bytes(text: Column) -> Column:
    """A text's UTF-8 bytes (NULL: none)."""
    return F.coalesce(text, F.lit("")).cast("binary")


def assign_shards(
    df: DataFrame, weights: Mapping[int, float], grown: Mapping[int, float] | None = None,
    key_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(key, size, text_crc32, shard, grown_shard) of every row of ``df``;
    ``grown`` are the weights after a change (NULL column without)."""
    rows = narrow(df, key=key_col, text=text_col)
    after = shard_of(F.col("key"), grown) if grown else F.lit(None).cast("int")
    return rows.select(
        "key",
        (F.length(text_bytes(F.col("text"))) + 1).cast("long").alias("size"),
        F.crc32(text_bytes(F.col("text"))).alias("text_crc32"),
        shard_of(F.col("key"), weights).alias("shard"),
        after.alias("grown_shard"),
    )


def number_rows(assigned: DataFrame) -> DataFrame:
    """``assigned`` with ``slot``, the rows of each shard counted from 0 in the
    order of (key, size, checksum), NULL keys first."""
    order = ["shard", "key", "size", "text_crc32"]
    names = assigned.columns
    spread = assigned.withColumn("unique", F.monotonically_increasing_id())
    placed = materialise(
        spread.repartitionByRange(*order, "unique").sortWithinPartitions(*order, "unique")
        .select(*names, F.monotonically_increasing_id().alias("at")),
        "shard-order",
    )
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    # One row per partition and shard: what each partition adds to each shard.
    held = placed.groupBy("shard", part.alias("part")).agg(
        F.count(F.lit(1)).alias("held"), F.min(within).alias("first")
    )
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select(
        "shard", "part", (F.coalesce(F.sum("held").over(before), F.lit(0)) - F.col("first")).alias("shift")
    )
    return (
        placed.withColumn("part", part).join(starts, ["shard", "part"])
        .select(*names, (within + F.col("shift")).alias("slot"))
    )
