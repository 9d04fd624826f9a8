"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has ``bits`` bits: bit j is the sign of the sum of the dimensions
i with i mod bits = j, so one sign bit per dimension where there are ``bits`` of
them.  The code is cut into ``segments`` of 16 bits.  If two codes differ in at
most ``segments * (r + 1) - 1`` bits, some segment differs in at most r.  So round
r looks up every segment value at distance exactly r from the query's (radius
r - 1 was covered before), verifies the full Hamming distance of what it finds,
and a query ends as soon as its k-th verified distance is within the distance
covered.

A code is taken up once per query: in the round of its closest segment, and there
by the first such segment, which the two codes tell by themselves.  Codes beyond
the distance that a query has reached already are dropped before they move.
"""

from __future__ import annotations

import functools
import json
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdrank.llm.common import materialise, narrow

BITS = 64
SEGMENT_BITS = 16
K = 10


def codes_of(vectors: DataFrame, id_col: str, vector_col: str, bits: int = BITS) -> DataFrame:
    """Distinct (vec_id, code); rows with a NULL id, a NULL or empty vector or a
    NULL in it have no code.  A sum that is NaN counts as not positive.  Vectors
    may differ in length: a bit without a dimension is 0, longer vectors fold."""
    rows = (
        narrow(vectors, vec_id=id_col, vector=vector_col)
        .where("vec_id is not null and size(vector) > 0 and not exists(vector, x -> x is null)")
        .withColumn("vector", F.col("vector").cast("array<double>"))
    )
    folded = f"""transform(sequence(0, {bits - 1}), j -> if(j < size(vector),
        aggregate(sequence(j, greatest(j, size(vector) - 1), {bits}), 0D, (s, i) -> s + coalesce(get(vector, i), 0D)),
        0D))"""
    code = """aggregate(transform(sums, (s, j) -> if(s > 0 and not isnan(s), shiftleft(1L, j), 0L)),
        0L, (c, bit) -> c | bit)"""
    return rows.withColumn("sums", F.expr(folded)).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.expr(code).alias("code")
    ).distinct()


def _segment(code: Column, s: int) -> Column:
    """The 16 bits of segment ``s``; the sign bit of the number is a bit like the others."""
    return F.shiftrightunsigned(code, s * SEGMENT_BITS).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1).cast("long"))


def _segments(df: DataFrame, code: str, bits: int, *keep: str) -> DataFrame:
    parts = [
        F.struct(F.lit(s).alias("segment"), _segment(F.col(code), s).alias("value"))
        for s in range(bits // SEGMENT_BITS)
    ]
    return df.select(code, *keep, F.inline(F.array(*parts)))


def _first_found(apart: Column, radius: int, segments: int) -> Column:
    """True where a code whose differing bits are ``apart`` is found for the
    first time: no segment is nearer than ``radius``, and none before column
    ``segment`` as near."""
    nearer = [
        F.bit_count(_segment(apart, s)) < F.when(F.col("segment") > s, radius + 1).otherwise(radius)
        for s in range(segments)
    ]
    return ~functools.reduce(Column.__or__, nearer)


def search(
    vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id",
    vector_col: str = "embedding", bits: int = BITS,
) -> DataFrame:
    """(query_id, rank, vec_id, distance): for every row of ``queries`` (a
    filter of ``vectors``) the ``k`` nearest other vectors by Hamming distance,
    then id; fewer if there are fewer.

    Rows with equal codes are kept once in the index, with their ``k + 1``
    smallest ids (no more can be in an answer, one of them being the query).
    Repeated rows count once; an empty table gives no rows.
    """
    if bits % SEGMENT_BITS or not 0 < bits <= 64:
        raise ValueError("bits must be a multiple of 16 up to 64")
    segments = bits // SEGMENT_BITS
    coded = materialise(codes_of(vectors, id_col, vector_col, bits), "codes")
    by_id = Window.partitionBy("code").orderBy("vec_id")
    members = materialise(
        coded.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= k + 1), "code-members"
    )
    entries = members.groupBy("code").agg(F.count("*").alias("held"), F.min("vec_id").alias("low"))
    index = materialise(_segments(entries, "code", bits, "held", "low"), "segment-index")
    asked = materialise(
        queries.select(F.col(id_col).alias("query_id")).distinct()
        .join(coded.withColumnRenamed("vec_id", "query_id"), "query_id").withColumnRenamed("code", "asked"),
        "asked",
    )
    # bound: the distance that the k + 1 nearest rows found so far stay within
    active = asked.select("asked", F.lit(bits).alias("bound")).distinct()
    best: DataFrame | None = None
    finished: DataFrame | None = None
    nearest = Window.partitionBy("asked").orderBy("distance", "low", "code")
    for radius in range(SEGMENT_BITS + 1):
        masks = [sum(1 << b for b in c) for c in combinations(range(SEGMENT_BITS), radius)]
        listed = F.from_json(F.lit(json.dumps(masks)), "array<bigint>")  # at most 12,870 numbers
        probes = _segments(active, "asked", bits, "bound").select(
            "asked", "bound", "segment", F.explode(listed).alias("mask"), "value"
        ).select("asked", "bound", "segment", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
        apart = F.col("asked").bitwiseXOR(F.col("code"))
        # Spark's size estimate knows nothing of the masks: without the hint it
        # broadcasts all probes through the driver.
        fresh = (
            probes.hint("merge").join(index, ["segment", "value"])
            .where((F.bit_count(apart) <= F.col("bound")) & _first_found(apart, radius, segments))
            .select("asked", "code", "held", "low", F.bit_count(apart).alias("distance"))
        )
        if best is not None:
            fresh = fresh.unionByName(best.join(active, "asked", "left_semi"))
        ranked = fresh.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= k + 1).drop("place")
        best = materialise(ranked, "nearest-codes")
        covered = segments * (radius + 1) - 1
        reached = best.withColumn(
            "so_far", F.sum("held").over(nearest.rowsBetween(Window.unboundedPreceding, 0))
        ).where(F.col("so_far") >= k + 1).groupBy("asked").agg(F.min("distance").alias("kth"))
        done = reached.where(F.col("kth") <= covered).select("asked")
        if radius == SEGMENT_BITS:
            done = active
        ended = best.join(done, "asked", "left_semi")
        finished = ended if finished is None else finished.unionByName(ended)
        active = materialise(
            active.join(done, "asked", "left_anti").join(reached, "asked", "left")
            .select("asked", F.coalesce("kth", "bound").alias("bound")),
            "active-queries",
        )
        if active.isEmpty():
            break
    place = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return (
        asked.join(finished.select("asked", "code", "distance"), "asked")
        .join(members.select("code", "vec_id"), "code").where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "distance")
    )
