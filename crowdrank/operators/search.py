"""S1 + T4 + R1: finding the candidates of many queries in a catalogue.

An inverted index of title tokens with block maxima.  Titles are laid out so
that those with the same rare tokens lie together, and cut into blocks of
``BLOCK_TITLES``.  A posting is one token of one title with its impact, a whole
number; per token and block the index keeps the highest impact and the first
position.  The sum of the impacts over a query's tokens bounds every title of
the block, so blocks whose bound stays below the query's k-th score are never
read:

1. per query, bounds of the blocks that hold one of its tokens (the
   block table, at most one row per token and block);
2. the postings of the few blocks with the highest bounds give k titles and
   the k-th score;
3. only blocks whose bound passes that score are read as well, or equals it
   while the block begins at or before the k-th title's position.

The result is exact.  Queries are a table; all of them go through each step
together.  Joins are on (token) and (block, token); a frequent token is spread
over the blocks, and no query meets a title without sharing a token with it.
The bounds are one row per query and block: the blocks are dealt over as many
tasks as these rows need (counted first, ``TASK_BOUNDS`` a task), and the bounds
are never sorted as a whole.

Scores: ``bm25`` (impacts are BM25 weights times ``IMPACT_SCALE``, rounded) or
``overlap`` (each shared token counts one, the order of R1).  Ties go to the
smaller source position, then to the smaller id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crowdrank.fixed_values import NUM_CANDIDATES
from crowdrank.functions.relevance import SPLIT, tokens
from crowdrank.session import scratch_path
from crowdrank.sources.files import materialize

BLOCK_BITS = 7
BLOCK_TITLES = 1 << BLOCK_BITS
IMPACT_SCALE = 1000
TASK_TITLES = 1 << 17  # titles of one task while they are laid out
TASK_BOUNDS = 1 << 19  # (query, token, block) rows of one task
TASK_WANTED = 1 << 13  # (query, block, token) rows of one task, each of at most BLOCK_TITLES postings
MAX_BROADCAST_ROWS = 200_000  # largest table of tokens or blocks sent to every executor
SLICES = 16  # pieces of a token's blocks where the queries are not broadcast
K1, B = 1.2, 0.75  # the usual BM25 constants
SCORES = ("bm25", "overlap")


@dataclass(frozen=True)
class SearchIndex:
    """titles (video_id, title, position, block), postings (block, token,
    video_id, position, impact), blocks (token, block, best, first)."""

    titles: DataFrame
    postings: DataFrame
    blocks: DataFrame

    @staticmethod
    def load(spark: SparkSession, path: str) -> SearchIndex:
        return SearchIndex(*(spark.read.parquet(f"{path}/{part}") for part in ("titles", "postings", "blocks")))


def build_index(catalog: DataFrame, score: str = "bm25", path: str | None = None) -> SearchIndex:
    """Index of ``catalog`` (video_id, title, position), written to ``path``
    (default: the shared scratch folder).  A video listed twice keeps its first
    place; NULL and empty titles have no token and are never found."""
    if score not in SCORES:
        raise ValueError(f"score must be one of {SCORES}, got {score!r}")
    spark = catalog.sparkSession
    path = path or scratch_path(spark, "search-index")
    once = catalog.groupBy("video_id").agg(F.min(F.struct("position", "title")).alias("p")).select(
        "video_id", "p.position", "p.title"
    )
    words = F.array_remove(F.split(F.lower("title"), SPLIT, -1), "")
    listed = materialize(once.withColumn("words", words), "catalogue")
    n, length = listed.agg(F.count("title"), F.avg(F.size("words"))).first()
    counted = listed.select("video_id", F.size("words").alias("length"), F.explode("words").alias("token")).groupBy(
        "video_id", "length", "token"
    ).agg(F.count(F.lit(1)).alias("times"))
    held = _small(materialize(counted.groupBy("token").agg(F.count(F.lit(1)).alias("held")), "held-tokens"))
    tasks = max(spark.sparkContext.defaultParallelism, -(-listed.count() // TASK_TITLES))
    if score == "bm25":
        rarity = F.log(1 + (F.lit(n) - F.col("held") + 0.5) / (F.col("held") + 0.5))
        weight = F.col("times") * (K1 + 1) / (
            F.col("times") + K1 * (1 - B + B * F.col("length") / F.lit(float(length or 1)))
        )
        impact = F.floor(IMPACT_SCALE * rarity * weight + 0.5).cast("long")
    else:
        impact = F.lit(1).cast("long")
    # Rare tokens first: titles that share them become neighbours.
    held_by = counted.join(held, "token").repartition(tasks, "video_id").groupBy("video_id").agg(
        F.array_sort(F.collect_list(F.struct("held", "token", impact.alias("impact")))).alias("held_tokens")
    )
    placed = listed.repartition(tasks, "video_id").join(held_by.hint("merge"), "video_id").withColumn(
        "sign", F.transform("held_tokens", lambda t: t["token"])
    )
    in_order = placed.repartitionByRange(tasks, "sign", "video_id").sortWithinPartitions("sign", "video_id")
    block = F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)  # starts anew in every partition
    in_order.select("video_id", "title", "position", block.alias("block"), "held_tokens").write.parquet(f"{path}/titles")
    titles = spark.read.parquet(f"{path}/titles")
    postings = titles.select("block", "video_id", "position", F.explode("held_tokens").alias("t")).select(
        "block", "t.token", "video_id", "position", "t.impact"
    )
    postings.write.parquet(f"{path}/postings")
    spark.read.parquet(f"{path}/postings").groupBy("token", "block").agg(
        F.max("impact").alias("best"), _first_of("position").alias("first")
    ).write.parquet(f"{path}/blocks")
    return SearchIndex.load(spark, path)


def _first_of(position: str) -> Column:
    """The smallest position; NULL, which comes before all, if there is one."""
    return F.when(F.count(position) == F.count(F.lit(1)), F.min(position))


def _small(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast only within the checked bound."""
    return F.broadcast(table) if table.count() <= MAX_BROADCAST_ROWS else table.hint("merge")


def _postings_of(chosen: DataFrame, asked: DataFrame, index: SearchIndex) -> DataFrame:
    """Scores of the titles in the chosen (query, block) pairs."""
    wanted = materialize(chosen.select("query", "block").join(asked, "query"), "wanted-blocks")
    tasks = max(asked.sparkSession.sparkContext.defaultParallelism, -(-wanted.count() // TASK_WANTED))
    return (
        index.postings.join(_small(wanted), ["block", "token"]).repartition(tasks, "query", "video_id")
        .groupBy("query", "video_id", "position")
        .agg(F.sum("impact").alias("score"), F.count(F.lit(1)).alias("shared"))
    )


def block_bounds(index: SearchIndex, asked: DataFrame) -> DataFrame:
    """(query, block, bound, first): the blocks that share a token with a
    query, and the first position that such a title can have there."""
    by_token = [t.groupBy("token").agg(F.count(F.lit(1)).alias(n)) for t, n in ((asked, "asked"), (index.blocks, "held"))]
    sizes = by_token[0].join(by_token[1], "token", "left").agg(
        F.coalesce(F.sum("asked"), F.lit(0)).alias("asked"),
        F.coalesce(F.sum(F.col("asked") * F.col("held")), F.lit(0)).alias("met"),
    ).first()
    tasks = max(asked.sparkSession.sparkContext.defaultParallelism, -(-sizes["met"] // TASK_BOUNDS))
    if sizes["asked"] <= MAX_BROADCAST_ROWS:
        met = index.blocks.repartition(tasks, "block").join(F.broadcast(asked), "token")
    else:
        every = F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1)))
        met = (
            index.blocks.withColumn("slice", F.pmod("block", F.lit(SLICES)).cast("int"))
            .join(asked.withColumn("slice", every).hint("merge"), ["token", "slice"])
            .select("query", "block", "best", "first").repartition(tasks, "query", "block")
        )
    return met.groupBy("query", "block").agg(F.sum("best").alias("bound"), _first_of("first").alias("first"))


def _placed(bounds: DataFrame) -> DataFrame:
    order = Window.partitionBy("query").orderBy(
        F.col("bound").desc(), F.col("first").asc_nulls_first(), F.col("block").asc()
    )
    return bounds.withColumn("place", F.row_number().over(order))


def rank_blocks(index: SearchIndex, asked: DataFrame) -> DataFrame:
    """(query, block, bound, first, place): the blocks that share a token with
    a query, the highest bound first."""
    return _placed(block_bounds(index, asked))


def _top(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("position").asc(), F.col("video_id").asc())
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def blocks_to_read(ranked: DataFrame, first: DataFrame, k: int, first_blocks: int) -> DataFrame:
    """The blocks after the first ones that can hold a title which comes before
    their query's k-th among ``first``: by its score, or with that score by its
    position (all of them where that found fewer than k)."""
    kth = first.where(F.col("rank") == k).select("query", F.col("score").alias("kth"), F.col("position").alias("kth_at"))
    rest = ranked.where(F.col("place") > first_blocks).join(kth, "query", "left")
    in_time = F.coalesce(F.col("first") <= F.col("kth_at"), F.lit(True))
    return rest.where(
        F.col("kth").isNull() | (F.col("bound") > F.col("kth")) | ((F.col("bound") == F.col("kth")) & in_time)
    )


def query_tokens(queries: DataFrame) -> DataFrame:
    """(query, token) for the distinct non-empty tokens of distinct queries."""
    return _tokens_of(queries.select("query").where(F.col("query").isNotNull()).distinct(), "query")


def _tokens_of(queries: DataFrame, text: str) -> DataFrame:
    return queries.select("query", F.explode(F.array_remove(tokens(F.col(text)), "")).alias("token"))


def search(index: SearchIndex, queries: DataFrame, k: int = NUM_CANDIDATES) -> DataFrame:
    """(query, position, video_id, title, score, relevance_score): at most ``k``
    titles per distinct query, best first, ``position`` counted from 0; the
    relevance is R1's share of the query's tokens."""
    texts = queries.select(F.col("query").alias("text")).where(F.col("text").isNotNull()).distinct()
    numbered = materialize(texts.withColumn("query", F.monotonically_increasing_id()), "queries")
    asked = materialize(_tokens_of(numbered, "text"), "asked-tokens")
    first_blocks = 1 + -(-k // BLOCK_TITLES)
    bounds = block_bounds(index, asked)
    chosen = materialize(
        _placed(bounds).where(F.col("place") <= first_blocks).select("query", "block", "place"), "first-blocks"
    )
    scored = materialize(_postings_of(chosen, asked, index), "first-scores")
    kth = materialize(_top(scored, k).where(F.col("rank") == k), "kth-scores")
    ranked = bounds.join(_small(chosen), ["query", "block"], "left").withColumn(
        "place", F.coalesce("place", F.lit(first_blocks + 1))
    )
    more = _postings_of(blocks_to_read(ranked, _small(kth), k, first_blocks), asked, index)
    best = _top(scored.unionByName(more), k)
    divisor = F.size(tokens(F.col("text"))).cast("double")
    return best.join(numbered, "query").join(index.titles.select("video_id", "title"), "video_id").select(
        F.col("text").alias("query"), (F.col("rank") - 1).cast("long").alias("position"), "video_id", "title", "score",
        (F.col("shared").cast("double") / divisor).alias("relevance_score"),
    )
