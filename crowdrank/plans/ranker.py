"""The whole ranking flow as one lazy plan.

listing ─▶ cap per query ─▶ title filter ─▶ details (semi-join) ─▶ durations
─▶ duration filter ─▶ comments of kept videos (cap per video) ─▶ clean text
─▶ language ─▶ sentiment ─▶ per-video scores ─▶ recommendation (per query).

Entry points, the three ways the flow can be started, and one from queries:

* ``rank_from_sources`` — listing, details and raw comments;
* ``rank_from_scored`` — comments that already carry sentiment columns;
* ``recommend_from_scores`` — a video_scores table;
* ``rank_from_catalog`` — search queries and the catalogue they are asked of;
* ``rank_in_stages`` — the first one in named stages that a later run picks up.

With ``stage_checkpoints=True`` the comments, scored comments and scores
are written as Parquet into the shared checkpoint folder and re-read
(lineage cut; a lost executor re-reads the last stage).  With
``stage_counts=True`` each stage's row count is taken by an ``Observation``
while the final action runs (no extra pass); ``stage_counts(result)`` reads
them afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from crowdrank.fixed_values import (
    EXCLUDE_WORDS,
    MIN_DURATION_SECONDS,
    NUM_CANDIDATES,
    NUM_COMMENTS,
    PSEUDO_COUNT,
    TOP_POLARIZED,
)
from crowdrank.functions.relevance import title_relevance
from crowdrank.functions.text import with_clean_text
from crowdrank.operators import candidates as C
from crowdrank.operators import recommend as R
from crowdrank.operators import scoring as S
from crowdrank.operators.language import with_language
from crowdrank.operators.search import build_index, search
from crowdrank.operators.sentiment import LexiconScorer, PluginScorer, Scorer, observe_errors, score_sentiment
from crowdrank.sources.files import materialize
from crowdrank.sources.stages import StageStore

POL = R.POL


@dataclass(frozen=True)
class RankerParams:
    num_candidates: int | None = NUM_CANDIDATES
    num_comments: int | None = NUM_COMMENTS
    min_duration_seconds: int | None = MIN_DURATION_SECONDS
    exclude_words: tuple[str, ...] = EXCLUDE_WORDS
    relevance: str = "constant"          # or "token_overlap"
    total: str = "confidence"            # or "signed", "weighted"
    pseudo_count: float = PSEUDO_COUNT
    top_polarized: int = TOP_POLARIZED
    stage_checkpoints: bool = False
    stage_counts: bool = False
    comment_order: tuple[str, ...] = ("page", "item_pos")


@dataclass
class RankResult:
    videos: DataFrame
    comments: DataFrame | None = None
    comments_scored: DataFrame | None = None
    video_scores: DataFrame | None = None
    recommendation: DataFrame | None = None
    extras: dict = field(default_factory=dict)


def _stage(df: DataFrame, params: RankerParams, name: str, counts: dict | None = None) -> DataFrame:
    out = materialize(df, name) if params.stage_checkpoints else df
    return _observed(out, params, name, counts)


def _observed(df: DataFrame, params: RankerParams, name: str, counts: dict | None) -> DataFrame:
    """A11: count the rows of a stage during the action that computes it.
    Off by default, as Catalyst pushes no filter through an observed node."""
    if not params.stage_counts or counts is None:
        return df
    obs = Observation()
    counts[name] = obs
    return df.observe(obs, F.count(F.lit(1)).alias("rows"))


def stage_counts(result: "RankResult") -> dict[str, int]:
    """Row count per stage of a flow run with ``stage_counts=True``; call
    after an action on ``result.recommendation`` (blocks until then)."""
    return {name: int(obs.get["rows"]) for name, obs in result.extras.get("counts", {}).items()}


def select_videos(
    listing: DataFrame, details: DataFrame, params: RankerParams, counts: dict | None = None
) -> DataFrame:
    """Videos kept for each query: (query, video_id, title, duration,
    duration_seconds, counts, relevance_score).

    ``listing`` has (query, video_id, title) and an order column set
    (``position`` or ``page``/``item_pos``); ``details`` has (video_id,
    title, iso_duration, counts).  A video listed twice for a query counts
    once; a cap of None keeps all.
    """
    order = ["position"] if "position" in listing.columns else ["page", "item_pos"]
    capped = C.cap_per_group(listing, params.num_candidates, ["query"], order)
    kept = _observed(
        C.filter_titles(capped, params.exclude_words).select("query", "video_id").distinct(),
        params, "candidates", counts,
    )
    detailed = C.candidate_details(details, kept, params.min_duration_seconds)
    videos = _observed(kept.join(detailed, "video_id", "inner"), params, "videos", counts)
    if params.relevance == "token_overlap":
        rel = title_relevance(F.col("title"), F.col("query"))
    elif params.relevance == "constant":
        rel = F.lit(1.0)
    else:
        raise ValueError(f"unknown relevance mode {params.relevance!r}")
    return videos.withColumn("relevance_score", rel)


def prepare_comments(comments_raw: DataFrame, videos: DataFrame, params: RankerParams) -> DataFrame:
    """Comments of kept videos, ≤ ``num_comments`` per video in source
    order, with ``clean_text`` and ``language``.  Comments without text are
    dropped here, before the cleaning (they would be dropped by the
    sentiment stage anyway)."""
    # Semi-join first: the cap is per video and the semi-join keeps or drops
    # whole videos, so the order does not change the result, but the cap's
    # sort then sees only the comments of candidate videos.
    of_kept = C.comments_of(comments_raw, videos)
    capped = C.cap_comments(
        of_kept, params.num_comments, order=list(params.comment_order), buckets=C.tree_buckets(comments_raw)
    )
    capped = capped.filter(F.col("text").isNotNull())
    return with_language(with_clean_text(capped, "text", "clean_text"), "clean_text", "language", by_lookup=True)


def scores_per_query(comments_scored: DataFrame, videos: DataFrame, params: RankerParams) -> DataFrame:
    """(query, video_id, total_score, relevance_score, std_deviation,
    polarization): comments aggregated per video first, then joined with
    the per-(query, video) relevance."""
    aggregates = S.video_score_aggregates(
        comments_scored.drop("relevance_score"), key="video_id", total=params.total
    ).drop("relevance_score")
    per_query = videos.select("query", "video_id", F.col("relevance_score").cast("double").alias("_rel"))
    return S.finish_scores(
        aggregates.join(per_query, "video_id", "inner"),
        key="video_id", pseudo_count=params.pseudo_count, relevance=F.col("_rel"), keep=("query",),
    )


def recommend_per_query(scores: DataFrame, queries: DataFrame, k: int = TOP_POLARIZED) -> DataFrame:
    """One recommendation row per query of ``queries`` (NULLs when a query
    kept no video).  Every pick is a window limit (``row_number`` ≤ k),
    planned as a partial limit before the shuffle; both branches carry the
    same columns, so the scores are computed once."""
    rk = R._rank_key
    # NULLs sort last: filtering them after the limit is equivalent and
    # keeps both branches on the same input plan.
    best_w = Window.partitionBy("query").orderBy(rk("total_score").desc_nulls_last(), F.col("video_id").asc())
    best = (
        scores.withColumn("_rn", F.row_number().over(best_w))
        .filter(F.col("_rn") == 1)
        .filter(F.col("total_score").isNotNull())
    )
    pol_w = Window.partitionBy("query").orderBy(rk(POL).desc_nulls_last(), F.col("video_id").asc())
    top = (
        scores.withColumn("_rk", F.row_number().over(pol_w))
        .filter(F.col("_rk") <= k)
        .filter(F.col(POL).isNotNull())
        .withColumn("_product", F.col(POL) * F.col("total_score"))
        .filter(F.col("_product") > 0)
    )
    prod_w = Window.partitionBy("query").orderBy(rk("_product").desc(), F.col("_rk").asc())
    polarized = top.withColumn("_rn", F.row_number().over(prod_w)).filter(F.col("_rn") == 1)
    tagged = R._tagged(best, "best", "video_id", ("query",)).unionByName(
        R._tagged(polarized, "polarized", "video_id", ("query",))
    )
    picked = tagged.groupBy("query").agg(*R.result_columns())
    return queries.select("query").distinct().join(picked, "query", "left")


def rank_from_scored(
    listing: DataFrame,
    details: DataFrame,
    comments_scored: DataFrame,
    params: RankerParams = RankerParams(),
) -> RankResult:
    """Entry for comments that already carry sentiment columns."""
    counts: dict = {}
    videos = select_videos(listing, details, params, counts)
    of_kept = C.comments_of(comments_scored, videos)  # before the cap, as in prepare_comments
    capped = C.cap_comments(
        of_kept, params.num_comments, order=list(params.comment_order), buckets=C.tree_buckets(comments_scored)
    )
    scored = _stage(capped, params, "comments-scored", counts)
    scores = _stage(scores_per_query(scored, videos, params), params, "video-scores", counts)
    rec = recommend_per_query(scores, listing, params.top_polarized)
    return RankResult(
        videos=videos, comments_scored=scored, video_scores=scores, recommendation=rec,
        extras={"counts": counts},
    )


def rank_from_catalog(
    queries: DataFrame,
    catalog: DataFrame,
    details: DataFrame,
    comments: DataFrame,
    params: RankerParams = RankerParams(),
    scorers: Mapping[str, Scorer] | None = None,
    score: str = "bm25",
) -> RankResult:
    """Entry from search queries: the listing is what the search finds in
    ``catalog`` (video_id, title, position), ``num_candidates`` per query.
    Without ``scorers`` the comments must already be scored."""
    found = search(build_index(catalog, score), queries, params.num_candidates or NUM_CANDIDATES)
    listing = materialize(found.select("query", "position", "video_id", "title"), "found")
    if scorers is None:
        result = rank_from_scored(listing, details, comments, params)
    else:
        result = rank_from_sources(listing, details, comments, scorers, params)
    # A query that finds nothing keeps its row.
    result.recommendation = recommend_per_query(result.video_scores, queries, params.top_polarized)
    return result


def rank_from_sources(
    listing: DataFrame,
    details: DataFrame,
    comments_raw: DataFrame,
    scorers: Mapping[str, Scorer],
    params: RankerParams = RankerParams(),
) -> RankResult:
    """Entry from landed sources: the whole flow."""
    counts: dict = {}
    videos = select_videos(listing, details, params, counts)
    comments = _stage(prepare_comments(comments_raw, videos, params), params, "comments", counts)
    judged, extras = score_sentiment(comments, scorers, drop_missing=False), {"counts": counts}
    if params.stage_counts:  # U4: failing rows per route, counted with the stage's rows
        judged, extras["errors"] = observe_errors(judged)
    scored = _stage(judged, params, "comments-scored", counts)
    scores = _stage(scores_per_query(scored, videos, params), params, "video-scores", counts)
    rec = recommend_per_query(scores, listing, params.top_polarized)
    return RankResult(videos, comments, scored, scores, rec, extras=extras)


STAGES = ("queries", "videos", "comments", "comments_scored", "video_scores")


def _told_scorer(scorer: Scorer) -> list:
    """What a stage's fingerprint knows of a scorer: its name and settings, the
    code of a user function (not of what that calls: rename the scorer when it
    changes), the files of a lexicon table, the identity of a fitted model."""
    told = [type(scorer).__name__, scorer.name]
    if isinstance(scorer, LexiconScorer):
        files = [] if scorer.table is None else sorted(scorer.table.inputFiles())
        return [*told, sorted(scorer.weights.items()), scorer.neutral_score, files]
    if isinstance(scorer, PluginScorer):
        fn = scorer.fn or scorer.setup
        code = getattr(fn, "__code__", None)
        body = [] if code is None else [
            code.co_code.hex(), code.co_names, [c for c in code.co_consts if isinstance(c, str | int | float)]
        ]
        return [*told, getattr(fn, "__qualname__", ""), body, scorer.max_chars]
    return [*told, scorer.num_features, getattr(scorer.model, "uid", "")]


def rank_in_stages(
    store: StageStore,
    sources: Callable[[], tuple[DataFrame, DataFrame, DataFrame]],
    scorers: Mapping[str, Scorer],
    params: RankerParams = RankerParams(),
    inputs: Sequence[str] = (),
    until: str | None = None,
) -> RankResult:
    """The whole flow, each of ``STAGES`` written under its name in ``store``.

    ``sources()`` gives listing, details and raw comments; it is called only
    if a stage that reads them has to be built, so a run that finds these stages
    finished needs no source.  ``inputs`` are the sources' paths, whose files
    count in the fingerprints.  ``until`` ends the run after that stage; a later
    run goes on from there."""
    loaded: list = []

    def source(which: int) -> DataFrame:
        if not loaded:
            loaded.append(sources())
        return loaded[0][which]

    chosen = [
        params.num_candidates, params.min_duration_seconds, list(params.exclude_words), params.relevance,
    ]
    result = RankResult(videos=None)
    last = STAGES.index(until) if until is not None else len(STAGES)
    queries = store.stage("queries", lambda: source(0).select("query").distinct(), "distinct", inputs)
    if last >= 1:
        result.videos = store.stage(
            "videos", lambda: select_videos(source(0), source(1), params), chosen, inputs
        )
    if last >= 2:
        result.comments = store.stage(
            "comments", lambda: prepare_comments(source(2), result.videos, params),
            [params.num_comments, list(params.comment_order)], inputs, ["videos"],
        )
    if last >= 3:
        told = {route: _told_scorer(scorer) for route, scorer in scorers.items()}
        result.comments_scored = store.stage(
            "comments_scored", lambda: score_sentiment(result.comments, scorers, drop_missing=False), told,
            after=["comments"],
        )
    if last >= 4:
        result.video_scores = store.stage(
            "video_scores", lambda: scores_per_query(result.comments_scored, result.videos, params),
            [params.total, params.pseudo_count], after=["comments_scored", "videos"],
        )
        if until is None:
            result.recommendation = recommend_per_query(result.video_scores, queries, params.top_polarized)
    return result


def recommend_from_scores(video_scores: DataFrame, k: int = TOP_POLARIZED) -> DataFrame:
    """Entry for a single query's video_scores table: the one-row answer."""
    return R.recommendation(video_scores, k)
