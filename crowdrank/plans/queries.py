"""Registered queries: one per operator group, each over whole driver tables.

Every callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame.
Floating outputs are rounded to 6 places (``OUT_DIGITS``) so that results
from different summation orders compare equal; the library functions
themselves return full precision.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crowdrank.functions.labels import label_score, label_word, stars_label
from crowdrank.functions.relevance import title_relevance as relevance_of
from crowdrank.functions.text import collapse_whitespace, strip_urls, with_clean_text
from crowdrank.operators import candidates as C
from crowdrank.operators import count_model as CM
from crowdrank.operators import recommend as R
from crowdrank.operators import score_state as ST
from crowdrank.operators import scoring as S
from crowdrank.operators import search as SR
from crowdrank.operators.filters import filter_min_duration, filter_titles
from crowdrank.operators import language as LG
from crowdrank.operators import sentiment as SE
from crowdrank.plans import ranker as RK
from crowdrank.plans.lexicons import (
    ENGLISH_LEXICON, ENGLISH_PHRASES, MULTILINGUAL_LEXICON, MULTILINGUAL_PHRASES,
)
from crowdrank.functions.text import with_clean_text as _with_clean_text
from crowdrank.session import scratch_path
from crowdrank.sources import files as FS
from crowdrank.sources import landed as LD
from crowdrank.sources import tables as TB
from crowdrank.sources.comment_store import CommentStore
from crowdrank.sources.stages import StageStore

OUT_DIGITS = 6
QUERY_TEXT = "red widget"  # relevance query over part names (B1)
TITLE_QUERY = "blue widget."  # trailing '.' gives the empty token of the divisor
TITLE_WORDS = ("bolt", "ring", "hot plate")  # exclusion words over part names (B4)
CAP_COMMENTS = 20  # per-item comment cap for the W1 query (items have 14-60 rows)

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, digits: int = OUT_DIGITS) -> DataFrame:
    """Round every floating column; ``+ 0.0`` turns a rounded -0.0 into 0.0."""
    cols = [
        (F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*cols)


# --- B1: scoring and recommendation on lineitem -----------------------------


def item_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.video_scores(TB.lineitem_comments_scored(spark, sf_dir)))


def item_scores_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.video_scores(TB.lineitem_comments_scored(spark, sf_dir), total="signed"))


def item_scores_like_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.video_scores(TB.lineitem_comments_scored(spark, sf_dir), total="weighted"))


def item_scores_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores from a stored state of the earlier comments and the later ones,
    merged; must equal ``item_scores``."""
    dated = TB.lineitem_comments_ordered(spark, sf_dir)
    later = F.coalesce(F.col("l_shipdate") >= F.lit("1995-06-17").cast("date"), F.lit(False))
    store = StageStore(spark, "item scores", scratch_path(spark, "states"))
    first = store.stage("state", lambda: ST.add_comments(None, dated.where(~later)), "earlier")
    return rounded(ST.scores_of_state(ST.add_comments(first, dated.where(later))))


def stored_item_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of comments stored by video, with slices of about 25 comments;
    must equal ``item_scores``."""
    store = CommentStore.write(TB.lineitem_comments_scored(spark, sf_dir), slice_rows=25)
    return rounded(store.scores())


def stored_scores_of_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the stored comments of the parts that pass the title and
    duration filters."""
    store = CommentStore.write(TB.lineitem_comments_scored(spark, sf_dir))
    kept = C.candidate_details(
        TB.part_details(spark, sf_dir), filter_titles(TB.part_listing(spark, sf_dir), TITLE_WORDS)
    )
    return rounded(store.scores(store.comments_of(kept)))


def best_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = S.video_scores(TB.lineitem_comments_scored(spark, sf_dir))
    return rounded(R.best_video(scores).select("video_id", "total_score"))


def top3_polarized(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = S.video_scores(TB.lineitem_comments_scored(spark, sf_dir))
    return rounded(R.top_polarized(scores, 3))


def recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = S.video_scores(TB.lineitem_comments_scored(spark, sf_dir))
    return rounded(R.recommendation_report(R.recommendation(scores)))


def recommendation_none_polarized(spark: SparkSession, sf_dir: str) -> DataFrame:
    comments = TB.lineitem_comments_scored(spark, sf_dir).filter(F.col("sentiment_label") == 0)
    return rounded(R.recommendation(S.video_scores(comments)))


def item_scores_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos = TB.read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("video_id"),
        relevance_of(F.col("p_name"), QUERY_TEXT).alias("relevance_score"),
    )
    comments = TB.lineitem_comments_scored(spark, sf_dir)
    return rounded(S.video_scores_with_relevance(comments, videos))


# --- B4: titles, durations, candidates --------------------------------------


def title_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = TB.part_listing(spark, sf_dir)
    return filter_titles(listing, TITLE_WORDS).select("video_id", "title")


def title_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = TB.part_listing(spark, sf_dir)
    return rounded(
        listing.select(
            "video_id", "title", relevance_of(F.col("title"), TITLE_QUERY).alias("relevance_score")
        )
    )


def duration_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    details = TB.part_details(spark, sf_dir).select("video_id", "iso_duration")
    return C.with_durations(details.withColumn("iso", F.col("iso_duration")), iso="iso")


def duration_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    details = C.with_durations(TB.part_details(spark, sf_dir))
    return filter_min_duration(details).select("video_id", "duration", "duration_seconds")


def candidates_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = C.kept_candidates(TB.part_listing(spark, sf_dir), exclude_words=TITLE_WORDS)
    details = C.candidate_details(TB.part_details(spark, sf_dir), kept)
    return details.select("video_id", "title", "duration", "duration_seconds")


def comments_per_item_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = TB.lineitem_comment_rows(spark, sf_dir)
    order = [c for c in rows.columns if c != "video_id"]
    return C.cap_comments(rows, CAP_COMMENTS, order=order)


def items_with_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos = TB.part_listing(spark, sf_dir).select("video_id")
    comments = TB.lineitem_comments_scored(spark, sf_dir).select("video_id")
    counted = C.comment_counts(videos, comments)
    return counted.agg(
        F.count(F.lit(1)).alias("n_videos"),
        F.count(F.when(F.col("n_comments") > 0, True)).alias("videos_with_comments"),
        F.sum("n_comments").alias("n_comments"),
    )


def search_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a part name and a brand asked at once, against all parts
    (title: name, type and brand)."""
    index = SR.build_index(TB.part_catalog(spark, sf_dir))
    return rounded(SR.search(index, TB.part_queries(spark, sf_dir)))


def ranking_from_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow with its candidates found by the search, by title overlap: one
    recommendation per brand and noun, all comments of the found parts."""
    queries = TB.part_listing(spark, sf_dir).select(
        F.concat_ws(" ", F.element_at(F.split("title", " "), 2), "query").alias("query")
    ).distinct()
    params = RK.RankerParams(
        num_comments=None, exclude_words=TITLE_WORDS, relevance="token_overlap", comment_order=TB.LINEITEM_ORDER
    )
    result = RK.rank_from_catalog(
        queries, TB.part_catalog(spark, sf_dir), TB.part_details(spark, sf_dir),
        TB.lineitem_comments_ordered(spark, sf_dir), params, score="overlap",
    )
    return rounded(result.recommendation)


# --- label maps ---------------------------------------------------------------


def sentiment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = TB.read_table(spark, sf_dir, "documents").select("doc_id")
    raw = docs.join(TB.gold_labels(spark, sf_dir), "doc_id", "inner")
    label = F.col("original_sentiment_label")
    return raw.select(
        "doc_id",
        "original_sentiment_label",
        label_score(label).alias("sentiment_label"),
        label_word(label).alias("sentiment_word"),
    )


def star_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = TB.read_table(spark, sf_dir, "lineitem")
    stars = F.ceil(F.col("l_quantity") / 10).cast("int")
    labelled = li.select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("video_id"),
        stars_label(stars).alias("original_sentiment_label"),
    )
    label = F.col("original_sentiment_label")
    return labelled.select(
        "*",
        label_score(label, "stars").alias("sentiment_label"),
        label_word(label, "stars").alias("sentiment_word"),
    )


# --- B3: text cleaning ---------------------------------------------------------


def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = TB.read_table(spark, sf_dir, "pages")
    return with_clean_text(pages.select("page_id", "html"), "html").select("page_id", "clean_text")


def broken(html, number):
    """A page with one of eight faults, by its number: nested links, links
    never closed, quoted ``>``, an open comment, an open quote, missing and
    stray end tags, a CDATA section."""
    return F.element_at(F.array(
        F.concat(F.lit("<a>one<a>two</a>three</a>"), html),
        F.concat(F.lit("<div><a href=x>never closed</div>"), html),
        F.concat(F.lit("<p title=\"a>b\" data-x='c>d'>"), html),
        F.concat(html, F.lit("<!-- open "), html),
        F.concat(html, F.lit('<a href="quote>'), html),
        F.replace(html, F.lit("</a>"), F.lit("")),
        F.concat(F.lit("<![CDATA[x < y]]>"), html, F.lit("</a></b><A/>1 < 2")),
        F.replace(html, F.lit("<p>"), F.lit("<p><a name=q>")),
    ), (number % 8 + 1).cast("int"))


def clean_broken_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaning of pages that are all broken in one way or another."""
    pages = TB.read_table(spark, sf_dir, "pages")
    planted = pages.select("page_id", broken(F.col("html"), F.col("page_id")).alias("html"))
    return with_clean_text(planted, "html").select("page_id", "clean_text")


def strip_urls_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = TB.read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", collapse_whitespace(strip_urls(F.col("text"))).alias("text_stripped"))


# --- B2: sentiment and language on documents ----------------------------------

LEXICON_SCORERS = {
    "en": SE.LexiconScorer(ENGLISH_LEXICON),
    "*": SE.LexiconScorer(MULTILINGUAL_LEXICON),
}


def documents_scored(spark: SparkSession, sf_dir: str, scorers=None) -> DataFrame:
    comments = TB.documents_comments(spark, sf_dir).withColumnRenamed("text", "clean_text")
    return SE.score_sentiment(comments, scorers or LEXICON_SCORERS)


def lexicon_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(documents_scored(spark, sf_dir).drop("clean_text"))


JOIN_LEXICON_SCORERS = {
    "en": SE.LexiconScorer(ENGLISH_LEXICON, by_join=True),
    "*": SE.LexiconScorer(MULTILINGUAL_LEXICON, by_join=True),
}


def lexicon_sentiment_by_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexicon scores through the join path (tokens ⋈ lexicon table →
    sums per comment → left join back), as used for lexicons too large
    for one regular expression; must equal ``lexicon_sentiment``."""
    return rounded(documents_scored(spark, sf_dir, JOIN_LEXICON_SCORERS).drop("clean_text"))


def lexicon_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexicons with terms of several tokens, leftmost-longest matches."""
    scorers = {"en": SE.LexiconScorer(ENGLISH_PHRASES), "*": SE.LexiconScorer(MULTILINGUAL_PHRASES)}
    return rounded(documents_scored(spark, sf_dir, scorers).drop("clean_text"))


def lexicon_phrases_by_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by n-gram join; must equal ``lexicon_phrases``."""
    scorers = {
        "en": SE.LexiconScorer(ENGLISH_PHRASES, by_join=True), "*": SE.LexiconScorer(MULTILINGUAL_PHRASES, by_join=True)
    }
    return rounded(documents_scored(spark, sf_dir, scorers).drop("clean_text"))


def source_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.video_scores(documents_scored(spark, sf_dir)))


def source_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.recommendation(S.video_scores(documents_scored(spark, sf_dir))))


def trained_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spark ML scorers (one for English, one for the rest) fitted on the
    labelled documents, applied to every document."""
    comments = TB.documents_comments(spark, sf_dir).withColumnRenamed("text", "clean_text")
    gold = TB.gold_labels(spark, sf_dir).withColumnRenamed("doc_id", "comment_id")
    labelled = comments.join(gold, "comment_id").select(
        F.col("clean_text").alias("text"), "language",
        label_score(F.col("original_sentiment_label")).alias("label"),
    )
    scored = SE.score_sentiment(comments, SE.fit_routes(labelled))
    return rounded(scored.drop("clean_text"))


def trained_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closed-form scorer per route, every document scored by the counts of
    the labelled documents of the other fold."""
    comments = TB.documents_comments(spark, sf_dir).withColumnRenamed("text", "clean_text")
    gold = TB.gold_labels(spark, sf_dir).select(
        F.col("doc_id").alias("comment_id"), label_score(F.col("original_sentiment_label")).alias("label")
    )
    return rounded(CM.score_out_of_fold(comments, gold).drop("clean_text"))


def plugin_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's batch function as the scorer for every language (Arrow
    batches), made by a set-up once per worker; failing rows become error rows."""
    from crowdrank.plans.plugins import marks_model

    comments = TB.documents_comments(spark, sf_dir).withColumnRenamed("text", "clean_text")
    scored = SE.score_sentiment(comments, {"*": SE.PluginScorer(setup=marks_model)})
    return rounded(scored.drop("clean_text"))


def sentiment_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and failing rows per route of the plug-in sentiment, counted while
    the scored comments are written.  Every seventh text is one that fails."""
    from crowdrank.plans.plugins import pause_scorer, punctuation_scorer

    comments = TB.documents_comments(spark, sf_dir).withColumn(
        "clean_text", F.when(F.col("comment_id") % 7 == 0, F.lit("123 !?")).otherwise(F.col("text"))
    ).drop("text")
    scorers = {"en": SE.PluginScorer(punctuation_scorer), "*": SE.PluginScorer(pause_scorer)}
    scored, report = SE.observe_errors(SE.score_sentiment(comments, scorers))
    scored.write.parquet(scratch_path(spark, "scored"))
    found = report.errors()
    return spark.createDataFrame(
        [(route, found[route], report.rows()) for route in sorted(found)], "route string, errors long, all_rows long"
    )


def language_stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = TB.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return LG.with_language(docs, "text", "language").select("doc_id", "language")


def language_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram languages of all documents, cross-fitted: each half of the ids
    is scored by profiles that were trained on the other half."""
    docs = TB.read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    half = F.coalesce(F.pmod("doc_id", F.lit(2)), F.lit(0))
    even, odd = (
        LG.ngram_languages(docs.filter(half == i), "doc_id", "text", LG.train_ngram_profiles(docs.filter(half != i)))
        for i in (0, 1)
    )
    return even.unionByName(odd)


# --- B5: landed responses and stage files --------------------------------------


def landed_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations landed as comment-thread pages (turn = source position),
    read back with the fixed schema and flattened."""
    conv = TB.read_table(spark, sf_dir, "conversations")
    comments = conv.select(
        F.col("conv_id").cast("string").alias("video_id"),
        F.col("turn").alias("position"),
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("comment_id"),
        F.col("role").alias("author"),
        F.col("text"),
        F.col("turn").alias("like_count"),
    )
    path = scratch_path(spark, "landed-comments")
    LD.land_comments(comments, path)
    return LD.read_comments(spark, path)


def landed_listing_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part landed as search pages per brand and as video-detail pages,
    read back, title-filtered, semi-joined, durations."""
    search_path = scratch_path(spark, "landed-search")
    details_path = scratch_path(spark, "landed-details")
    LD.land_search(TB.part_listing(spark, sf_dir), search_path)
    LD.land_details(TB.part_details(spark, sf_dir), details_path)
    listing = LD.read_search(spark, search_path)
    kept = C.filter_titles(
        listing, TITLE_WORDS
    )
    details = C.candidate_details(LD.read_details(spark, details_path), kept)
    return details.select("video_id", "title", "duration", "duration_seconds", "view_count", "like_count")


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = TB.read_table(spark, sf_dir, "documents")
    path = scratch_path(spark, "csv")
    if not FS.write_csv(docs, path):
        return docs  # an empty table writes nothing
    return FS.read_csv(spark, path, docs.schema)


def ordered_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item scores written as one sorted sequence of part files and read back
    with each row's place in it; highest item first."""
    scores = item_scores(spark, sf_dir).select((-F.col("video_id")).alias("order"), "video_id", "total_score")
    path = scratch_path(spark, "ordered")
    if not FS.write_ordered_csv(scores, path, ["order"]):
        return scores.select(F.lit(0).cast("long").alias("row_number"), "video_id", "total_score")
    return FS.read_ordered_csv(spark, path).drop("order")


def missing_text_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """every fifth document has no text; those rows go before the scorer."""
    comments = TB.documents_comments(spark, sf_dir).withColumn(
        "clean_text", F.when(F.col("comment_id") % 5 != 0, F.col("text"))
    ).drop("text")
    scored = SE.score_sentiment(comments, LEXICON_SCORERS)
    return scored.groupBy("sentiment_label").agg(F.count(F.lit(1)).alias("n"))


def recommendation_of_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """no title passes the filter, so no query keeps a video: a row of
    NULLs per query."""
    params = RK.RankerParams(
        num_candidates=None, num_comments=None, exclude_words=("large", "hot", "blue", "old", "cold", "red", "new", "small"),
        comment_order=TB.LINEITEM_ORDER,
    )
    result = RK.rank_from_scored(
        TB.part_listing(spark, sf_dir), TB.part_details(spark, sf_dir),
        TB.lineitem_comments_ordered(spark, sf_dir), params,
    )
    return rounded(result.recommendation)


# --- end to end ---------------------------------------------------------------


def ranking_by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4 listing/details per brand + B1 scored comments: one recommendation
    per brand (title words, min 65 s, all candidates and comments)."""
    params = RK.RankerParams(
        num_candidates=None, num_comments=None, exclude_words=TITLE_WORDS, comment_order=TB.LINEITEM_ORDER
    )
    result = RK.rank_from_scored(
        TB.part_listing(spark, sf_dir), TB.part_details(spark, sf_dir),
        TB.lineitem_comments_ordered(spark, sf_dir), params,
    )
    return rounded(result.recommendation)


def ranking_by_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow with relevance by token overlap: a part is listed for its
    first word and "widget", so its title covers half or all of the query."""
    listing = TB.part_listing(spark, sf_dir).withColumn(
        "query", F.concat_ws(" ", F.element_at(F.split("title", " "), 1), F.lit("widget"))
    )
    params = RK.RankerParams(
        num_candidates=None, num_comments=None, exclude_words=TITLE_WORDS, relevance="token_overlap",
        comment_order=TB.LINEITEM_ORDER,
    )
    result = RK.rank_from_scored(
        listing, TB.part_details(spark, sf_dir), TB.lineitem_comments_ordered(spark, sf_dir), params
    )
    return rounded(result.recommendation)


def text_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2 texts: clean text → detected language → routed lexicon sentiment
    → scores per source → recommendation."""
    comments = TB.documents_comments(spark, sf_dir).drop("language").filter(F.col("text").isNotNull())
    prepared = LG.with_language(_with_clean_text(comments, "text", "clean_text"), "clean_text", "language", by_lookup=True)
    scored = SE.score_sentiment(prepared, LEXICON_SCORERS, drop_missing=False)
    return rounded(R.recommendation_report(R.recommendation(S.video_scores(scored))))


FLOW_PARAMS = RK.RankerParams(num_candidates=None, num_comments=None, exclude_words=TITLE_WORDS)


def _flow_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts as listing and details, documents as comments of parts 1 to 200."""
    docs = TB.read_table(spark, sf_dir, "documents")
    comments = docs.select(
        (F.col("doc_id") % 200 + 1).cast("string").alias("video_id"), F.col("doc_id").alias("comment_id"), "text",
        (F.col("doc_id") % 10).alias("like_count"),
    )
    named = F.col("video_id").cast("string")
    return (
        TB.part_listing(spark, sf_dir).withColumn("video_id", named),
        TB.part_details(spark, sf_dir).withColumn("video_id", named), comments,
    )


def _from_sources(spark: SparkSession, sf_dir: str, scorers) -> DataFrame:
    """The whole flow, all candidates and comments, one row per brand."""
    result = RK.rank_from_sources(*_flow_sources(spark, sf_dir), scorers, FLOW_PARAMS)
    return rounded(result.recommendation)


def ranking_from_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole flow with one user function for English and one for the rest."""
    from crowdrank.plans.plugins import pause_scorer, punctuation_scorer

    return _from_sources(
        spark, sf_dir, {"en": SE.PluginScorer(punctuation_scorer), "*": SE.PluginScorer(pause_scorer)}
    )


def ranking_from_sources_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole flow with routed lexicons."""
    return _from_sources(spark, sf_dir, LEXICON_SCORERS)


def _no_sources() -> tuple[DataFrame, DataFrame, DataFrame]:
    raise AssertionError("a finished stage reads no source")


def _restarted(spark: SparkSession, sf_dir: str) -> tuple[StageStore, RK.RankResult]:
    """The flow in named stages: one run ends after the sentiment stage, a
    second one, which has no source, goes on from there."""
    root = scratch_path(spark, "stages")
    inputs = [f"{sf_dir.rstrip('/')}/{name}.parquet" for name in ("part", "documents")]
    RK.rank_in_stages(
        StageStore(spark, "all brands", root), lambda: _flow_sources(spark, sf_dir), LEXICON_SCORERS, FLOW_PARAMS,
        inputs, until="comments_scored",
    )
    later = StageStore(spark, "all brands", root)
    return later, RK.rank_in_stages(later, _no_sources, LEXICON_SCORERS, FLOW_PARAMS, inputs)


def ranking_restarted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendations of a flow that was ended and taken up again by name."""
    return rounded(_restarted(spark, sf_dir)[1].recommendation)


def restarted_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of that flow as their manifests tell: rows, and whether the
    second run found them finished."""
    store, _ = _restarted(spark, sf_dir)
    return store.report(RK.STAGES).select("stage", "rows", F.col("stage").isin(store.reused).alias("reused"))


def all_queries() -> dict[str, Query]:
    return {
        "item_scores": item_scores,
        "item_scores_signed": item_scores_signed,
        "item_scores_like_weighted": item_scores_like_weighted,
        "item_scores_merged": item_scores_merged,
        "stored_item_scores": stored_item_scores,
        "stored_scores_of_kept": stored_scores_of_kept,
        "best_item": best_item,
        "top3_polarized": top3_polarized,
        "recommendation": recommendation,
        "recommendation_none_polarized": recommendation_none_polarized,
        "item_scores_relevance": item_scores_relevance,
        "title_filter": title_filter,
        "title_relevance": title_relevance,
        "duration_parse": duration_parse,
        "duration_filter": duration_filter,
        "candidates_semi_join": candidates_semi_join,
        "comments_per_item_capped": comments_per_item_capped,
        "items_with_comments": items_with_comments,
        "search_listing": search_listing,
        "ranking_from_search": ranking_from_search,
        "sentiment_labels": sentiment_labels,
        "star_labels": star_labels,
        "clean_pages": clean_pages,
        "clean_broken_pages": clean_broken_pages,
        "strip_urls_whitespace": strip_urls_whitespace,
        "lexicon_sentiment": lexicon_sentiment,
        "lexicon_sentiment_by_join": lexicon_sentiment_by_join,
        "lexicon_phrases": lexicon_phrases,
        "lexicon_phrases_by_join": lexicon_phrases_by_join,
        "source_scores": source_scores,
        "source_recommendation": source_recommendation,
        "trained_sentiment": trained_sentiment,
        "trained_counts": trained_counts,
        "plugin_sentiment": plugin_sentiment,
        "sentiment_errors": sentiment_errors,
        "language_stopwords": language_stopwords,
        "language_ngram": language_ngram,
        "landed_json_roundtrip": landed_json_roundtrip,
        "landed_listing_roundtrip": landed_listing_roundtrip,
        "csv_roundtrip": csv_roundtrip,
        "ordered_sink": ordered_sink,
        "missing_text_dropped": missing_text_dropped,
        "recommendation_of_nothing": recommendation_of_nothing,
        "ranking_by_brand": ranking_by_brand,
        "ranking_by_relevance": ranking_by_relevance,
        "text_ranking": text_ranking,
        "ranking_from_sources": ranking_from_sources,
        "ranking_from_sources_lexicon": ranking_from_sources_lexicon,
        "ranking_restarted": ranking_restarted,
        "restarted_stages": restarted_stages,
    }
