"""Set-up once per worker, batches by bytes, failing rows, closed-form scorer."""

import math
import os
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from crowdrank.operators import count_model as CM
from crowdrank.operators import sentiment as SE
from crowdrank.plans import ranker as RK

SCHEMA = "comment_id long, clean_text string, language string"


def test_set_up_runs_once_per_worker(spark, tmp_path):
    folder = str(tmp_path)

    def setup():
        open(os.path.join(folder, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        return lambda texts: pd.DataFrame({"label": "Positive", "score": 1.0}, index=texts.index)

    df = spark.range(4000).select(F.col("id").alias("comment_id"), F.lit("t").alias("clean_text"), F.lit("en").alias("language"))
    for _ in range(2):
        scored = SE.score_sentiment(df.repartition(40), {"*": SE.PluginScorer(setup=setup)})
        assert scored.where("sentiment_label = 1").count() == 4000
    workers = [name.split("-")[0] for name in os.listdir(folder)]
    assert len(workers) == len(set(workers)) < 40


def test_a_set_up_that_fails_fails_the_job(spark):
    def setup():
        raise RuntimeError("no model here")

    df = spark.createDataFrame([(1, "t", "en")], SCHEMA)
    with pytest.raises(Exception, match="no model here"):
        SE.score_sentiment(df, {"*": SE.PluginScorer(setup=setup)}).collect()
    with pytest.raises(ValueError):
        SE.PluginScorer()
    with pytest.raises(ValueError):
        SE.PluginScorer(len, setup=setup)


def test_batches_are_bounded_by_bytes(spark):
    assert list(SE._by_bytes(["aa", "é", "b", "long text", "", None, "c"], 4)) == [["aa", "é"], ["b"], ["long text"], ["", None, "c"]]
    assert list(SE._by_bytes([], 4)) == []

    def scorer(texts):
        assert sum(len(t.encode()) for t in texts) <= 100 or len(texts) == 1
        return pd.DataFrame({"label": "Positive", "score": 1.0}, index=texts.index)

    df = spark.createDataFrame([(k, "x" * (k % 150), "en") for k in range(500)], SCHEMA)
    scored = SE.score_sentiment(df, {"*": SE.PluginScorer(scorer, batch_bytes=100)})
    assert scored.where("sentiment_label = 1").count() == 500


def picky(texts):
    if (texts == "bad").any():
        raise ValueError
    return pd.DataFrame({"label": "Positive", "score": 1.0}, index=texts.index)


def test_failing_rows_are_counted_per_route(spark, tmp_path):
    rows = [(k, "bad" if k % 5 == 0 else "fine", ["en", "fr", None][k % 3]) for k in range(300)]
    path = str(tmp_path / "comments")
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    comments = spark.read.parquet(path).where("comment_id < 200")
    scored, report = SE.observe_errors(SE.score_sentiment(comments, {"*": SE.PluginScorer(picky)}))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(comment_id), LessThan(comment_id,200)" in plan or "LessThan(comment_id,200)" in plan
    assert scored.count() == 200
    bad = [r for r in rows[:200] if r[1] == "bad"]
    assert report.errors() == {"en": sum(r[2] == "en" for r in bad), "*": sum(r[2] != "en" for r in bad)}
    assert report.rows() == 200


def test_the_flow_reports_its_failing_rows(spark):
    listing = spark.createDataFrame([("q", k, f"v{k}", "t") for k in range(3)], "query string, position long, video_id string, title string")
    details = spark.createDataFrame([(f"v{k}", "t", "PT5M", 1, 1, 1) for k in range(3)],
                                    "video_id string, title string, iso_duration string, view_count long, like_count long, comment_count long")
    comments = spark.createDataFrame(
        [(f"v{k % 3}", 0, k, f"c{k}", "bad" if k % 4 == 0 else "fine", 1) for k in range(40)],
        "video_id string, page long, item_pos long, comment_id string, text string, like_count long")
    result = RK.rank_from_sources(listing, details, comments, {"*": SE.PluginScorer(picky)}, RK.RankerParams(stage_counts=True))
    assert len(result.recommendation.collect()) == 1
    assert sum(result.extras["errors"].errors().values()) == 10 and RK.stage_counts(result)["comments-scored"] == 40


def test_count_model_equals_brute_force(spark):
    words = ["up", "down", "same", "very", "x", "y"]
    rows = [(k, " ".join(words[(k * j) % 6] for j in range(1, 5)) + (" up" if k % 3 == 0 else ""), "en" if k % 4 else "fr") for k in range(120)]
    rows += [(500, None, "en"), (501, "", "en"), (502, "12", "fr"), (503, "unseen words", "en")]
    gold = {k: (1 if k % 3 == 0 else -1 if k % 3 == 1 else 0) for k, *_ in rows[:100]}
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    labels = spark.createDataFrame([*gold.items(), (7, gold[7]), (9999, 1), (3, None)], "comment_id long, label int")
    out = CM.score_out_of_fold(df, labels)
    got = {r.comment_id: (r.sentiment_label, round(r.sentiment_score, 9)) for r in out.collect()}
    # Repeated rows without a label change nothing and score alike.
    again = CM.score_out_of_fold(df.unionByName(df.where("comment_id in (110, 111, 500)")), labels)
    assert {(r.comment_id, r.sentiment_label, round(r.sentiment_score, 9)) for r in again.collect()} == {
        (k, *v) for k, v in got.items()
    }

    def whole(share):
        return math.floor(1000 * math.log(share) + 0.5)

    bags = {k: (set((t or "").split()) - {"12"}, l == "en", k % 2) for k, t, l in rows}
    for k, (bag, english, fold) in bags.items():
        train = [j for j in gold if bags[j][1] == english and bags[j][2] != fold]
        sizes = [sum(gold[j] == c for j in train) for c in (-1, 0, 1)]
        totals = [whole((n + 1) / (len(train) + 3)) for n in sizes]
        for token in bag:
            held = [sum(gold[j] == c and token in bags[j][0] for j in train) for c in (-1, 0, 1)]
            weights = [whole((h + 1) / (n + 2)) for h, n in zip(held, sizes)]
            if sum(held) >= 3 and max(weights) - min(weights) >= 500:
                totals = [t + w for t, w in zip(totals, weights)]
        best = max(totals)
        share = 1 / sum(math.exp((t - best) / 1000) for t in totals)
        assert got[k] == (totals.index(best) - 1, round(share, 9))


def test_count_model_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "a b", "en"), (None, "a", "fr")], SCHEMA)
    none = spark.createDataFrame([], "comment_id long, label int")
    got = CM.score_out_of_fold(df, none).collect()
    assert len(got) == 2 and {round(r.sentiment_score, 6) for r in got} == {round(1 / 3, 6)}
    assert CM.score_out_of_fold(df.limit(0), none).count() == 0
