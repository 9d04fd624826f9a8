"""Connected components of an edge list, by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdrank.llm.common import materialise

MAX_BROADCAST_ROWS = 1_000_000  # (key, value) rows of 16 to 32 bytes; more are joined by a shuffle
SALTS = 16


def looked_up(rows: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """``rows`` with the other columns of ``table``, which has one row a key
    and NULLs for keys it lacks.  A key may hold a third of the rows: a table of
    at most ``MAX_BROADCAST_ROWS`` (counted) is broadcast, a larger one is
    repeated ``SALTS`` times, so that a key's rows spread over as many tasks."""
    if table.count() <= MAX_BROADCAST_ROWS:
        return rows.join(F.broadcast(table), key, "left")
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")
    repeated = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", salt).join(repeated, [key, "salt"], "left").drop("salt")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every end of an edge.

    ``edges`` has the columns (a, b); loops, repeats and NULLs do no harm.
    Each round maps every node to the neighbour (or itself) with the smallest
    hash and contracts the edges by that map.  The hash changes with the round,
    so chains in id order also shrink by a constant factor on average.  Nothing
    but counts and a has-rows test reaches the driver.
    """
    left = materialise(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "edges",
    )
    labels: DataFrame | None = None
    salt = 0
    while not left.isEmpty():
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(
            left.select(F.col("b").alias("node"), F.col("a").alias("to"))
        )
        key = lambda c: F.struct(F.xxhash64(c, F.lit(salt)).alias("h"), F.col(c).alias("to"))
        parent = materialise(
            ends.groupBy("node").agg(F.min(key("to")).alias("best"))
            .select("node", F.least(F.col("best"), key("node"))["to"].alias("up")),
            "parents",
        )
        if labels is None:
            labels = parent.select("node", F.col("up").alias("label"))
        else:
            up = parent.select(F.col("node").alias("label"), "up")
            labels = materialise(
                looked_up(labels, "label", up).select("node", F.coalesce("up", "label").alias("label")), "labels"
            )
        named = looked_up(left, "a", parent.select(F.col("node").alias("a"), F.col("up").alias("ua")))
        left = materialise(
            looked_up(named, "b", parent.select(F.col("node").alias("b"), F.col("up").alias("ub")))
            .where("ua <> ub")
            .select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(),
            "edges",
        )
        salt += 1
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    smallest = materialise(labels.groupBy("label").agg(F.min("node").alias("component")), "smallest")
    return materialise(looked_up(labels, "label", smallest).select("node", "component"), "components")
