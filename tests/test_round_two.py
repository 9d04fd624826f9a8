"""Cases the first round got wrong: routing, lexicons, NaN, repeats, pages."""

import json
import math
import time

import pandas as pd
from pyspark.sql import functions as F

from crowdrank import schemas as SC
from crowdrank.functions.text import with_clean_text
from crowdrank.operators import recommend as R
from crowdrank.operators import scoring as S
from crowdrank.operators import sentiment as SE
from crowdrank.operators.language import with_language
from crowdrank.plans import ranker as RK
from crowdrank.plans.plugins import pause_scorer, punctuation_scorer
from crowdrank.sources import landed as LD


def letters_only(k: int) -> str:
    return "w" + "".join(chr(97 + (k // 26**i) % 26) for i in range(4))


def test_two_plugins_over_cleaned_text_plan_fast_and_scan_once(spark):
    rows = [(i, "the <b>cat</b> and the dog!" if i % 2 else "der Hund, und die Katze.") for i in range(40)]
    df = spark.createDataFrame(rows, "comment_id long, text string").where("comment_id >= 0")
    comments = with_language(with_clean_text(df, "text", "clean_text"), "clean_text", "language")
    started = time.time()
    scored = SE.score_sentiment(
        comments, {"en": SE.PluginScorer(punctuation_scorer), "*": SE.PluginScorer(pause_scorer)}, drop_missing=False
    )
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert time.time() - started < 10 and len(plan) < 500_000
    assert plan.count("ArrowEvalPython") <= 2 and "- Union" not in plan and "MapInPandas" not in plan
    got = {r.comment_id % 2: r.original_sentiment_label for r in scored.collect()}
    assert got == {1: "Positive", 0: "Neutral"}


def test_failing_texts_are_found_by_halving():
    calls = []

    def scorer(texts: pd.Series) -> pd.DataFrame:
        calls.append(len(texts))
        if (texts == "bad").any():
            raise ValueError
        return pd.DataFrame({"label": ["Positive"] * len(texts), "score": [1.0] * len(texts)})

    texts = ["ok"] * 20_000
    for at in (5, 9_000, 19_999):
        texts[at] = "bad"
    got = SE._score_batch(scorer, texts)
    assert len(calls) < 100 and [k for k, g in enumerate(got) if g[0] == "Error"] == [5, 9_000, 19_999]


def test_lexicons_with_many_weights_and_by_key_agree(spark):
    weights = {letters_only(k): (k % 901 - 450) / 100 for k in range(5_000)}
    words = list(weights)
    rows = [(i // 2 if i % 5 else None, " ".join(words[(i * 37 + j * 11) % 5_000] for j in range(1 + i % 9))) for i in range(60)]
    df = spark.createDataFrame([*rows, rows[3], (7, "")], "comment_id long, clean_text string").withColumn("language", F.lit("en"))
    plain = SE.score_sentiment(df, {"*": SE.LexiconScorer(weights)})
    joined = SE.score_sentiment(df, {"*": SE.LexiconScorer(weights, by_join=True)})
    rounded = lambda d: sorted((str(r.comment_id), r.clean_text, r.sentiment_label, round(r.sentiment_score, 9)) for r in d.collect())
    assert rounded(plain) == rounded(joined) and plain.count() == len(rows) + 2


def test_lexicon_table_with_one_term_twice(spark):
    table = spark.createDataFrame([("Good", 1.0), ("good", 1.0), ("bad", -0.5)], "term string, weight double")
    df = spark.createDataFrame([(1, "good bad", "en")], "comment_id long, clean_text string, language string")
    row = SE.score_sentiment(df, {"*": SE.LexiconScorer({}, table=table)}).first()
    assert math.isclose(row.sentiment_score, 1 / 3)


def test_nan_confidence_wins_nothing(spark):
    rows = [("a", 1, float("nan"), 5), ("a", 1, 0.5, 5), ("b", 1, 0.9, 3), ("b", -1, 0.8, 3)]
    scored = spark.createDataFrame(rows, "video_id string, sentiment_label int, sentiment_score double, like_count long")
    scores = S.video_scores(scored)
    assert {r.video_id: r.total_score for r in scores.collect()} == {"a": 0.5, "b": 1.7000000000000002}
    best = R.recommendation(scores).first()
    assert (best.best_video_id, best.most_polarized_video_id) == ("b", "b")


def test_a_video_listed_twice_counts_once_and_caps_are_optional(spark):
    listing = spark.createDataFrame([("q", k, f"v{k % 60}", "t") for k in range(130)], "query string, position long, video_id string, title string")
    details = spark.createDataFrame([(f"v{k}", "t", "PT5M", 1, 1, 1) for k in range(60)],
                                    "video_id string, title string, iso_duration string, view_count long, like_count long, comment_count long")
    params = RK.RankerParams(num_candidates=None, num_comments=None)
    assert RK.select_videos(listing, details, params).count() == 60


def page(likes, extra=0):
    item = lambda k: {"snippet": {"topLevelComment": {"id": f"c{k}", "snippet": {"authorDisplayName": "a", "textDisplay": "t", "likeCount": likes}}}}
    return {"video_id": "v", "page": 0, "items": [item(k) for k in range(1 + extra)]}


def test_landed_pages_pretty_broken_and_text_counts(spark, tmp_path):
    lines = tmp_path / "lines"
    lines.mkdir()
    (lines / "a.json").write_text(json.dumps(page("7")) + "\n" + json.dumps(page(8)) + "\n" + '{"video_id": "v", "items": [{"sni\n')
    got = sorted(r.like_count for r in LD.read_comments(spark, str(lines)).collect())
    assert got == [7, 8]
    assert [r.page for r in LD.rejected_pages(spark, str(lines), SC.COMMENTS_RAW).collect()] == ['{"video_id": "v", "items": [{"sni']
    pretty = tmp_path / "pretty"
    pretty.mkdir()
    (pretty / "a.json").write_text(json.dumps(page("many", 1), indent=2))
    (pretty / "b.json").write_text('{"video_id": ')
    rows = LD.read_comments(spark, str(pretty), multi_line=True).collect()
    assert len(rows) == 2 and rows[0].like_count is None
    assert LD.rejected_pages(spark, str(pretty), SC.COMMENTS_RAW, multi_line=True).count() == 1


def test_details_with_text_ids_are_landed(spark, tmp_path):
    details = spark.createDataFrame([(f"x{k}", "t", "PT5M", 1, 1, 1) for k in range(70)],
                                    "video_id string, title string, iso_duration string, view_count long, like_count long, comment_count long")
    LD.land_details(details, str(tmp_path / "d"))
    assert LD.read_details(spark, str(tmp_path / "d")).count() == 70
