"""Scorer contract, routing, plug-in error rows, language detection."""

import dataclasses
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crowdrank.operators import language as LG
from crowdrank.operators import sentiment as SE

EN = SE.LexiconScorer({"good": 1.0, "bad": -1.0, "awful": -2.0})
MULTI = SE.LexiconScorer({"bien": 1.0, "mal": -1.0})
SCHEMA = "video_id string, comment_id string, clean_text string, language string, like_count bigint"
ROWS = [
    ("v", "1", "Good good bad", "en", 1),
    ("v", "2", "awful, just AWFUL", "en", 1),
    ("v", "3", "nothing here", "en", 1),
    ("v", "4", "bien bien mal", "fr", 1),
    ("v", "5", "good but in another language", "de", 1),
    ("v", "6", None, "en", 1),
    ("v", "7", "bien", None, 1),
]


def test_lexicon_routing_and_contract(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = {r["comment_id"]: r for r in SE.score_sentiment(df, {"en": EN, "*": MULTI}).collect()}
    assert "6" not in got  # NULL text dropped
    assert (got["1"]["original_sentiment_label"], got["1"]["sentiment_label"]) == ("positive", 1)
    assert got["1"]["sentiment_score"] == pytest.approx(1 / 3)
    assert (got["2"]["sentiment_label"], got["2"]["sentiment_score"]) == (-1, 1.0)
    assert (got["3"]["sentiment_label"], got["3"]["sentiment_score"]) == (0, 0.5)
    assert got["4"]["sentiment_label"] == 1
    assert got["5"]["original_sentiment_label"] == "neutral"  # routed to the multilingual lexicon
    assert got["7"]["sentiment_label"] == 1  # NULL language → multilingual
    for r in got.values():
        assert r["sentiment_label"] in (-1, 0, 1)
        assert 0.0 <= r["sentiment_score"] <= 1.0


def test_lexicon_join_path_equals_expression(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).filter(F.col("clean_text").isNotNull())
    lexicon = spark.createDataFrame(list(EN.weights.items()), "term string, weight double")
    a = {r["comment_id"]: (r["original_sentiment_label"], r["sentiment_score"])
         for r in EN.score_by_join(df, "comment_id", "clean_text", lexicon).collect()}
    routed = SE.score_sentiment(df, {"*": dataclasses.replace(EN, by_join=True)})
    assert {r["comment_id"]: (r["original_sentiment_label"], r["sentiment_score"]) for r in routed.collect()} == a
    b = {r["comment_id"]: (r["original_sentiment_label"], r["sentiment_score"])
         for r in SE.score_sentiment(df, {"*": EN}).collect()}
    assert a == pytest.approx(b) if False else a.keys() == b.keys()
    for k in a:
        assert a[k][0] == b[k][0]
        assert a[k][1] == pytest.approx(b[k][1])


def _flaky_scorer(texts: pd.Series) -> pd.DataFrame:
    if any("boom" in t for t in texts):
        raise RuntimeError("model failure")
    return pd.DataFrame({"label": ["Positive" if "good" in t else "Negative" for t in texts],
                         "score": [0.9] * len(texts)})


def test_plugin_scorer_error_rows(spark):
    df = spark.createDataFrame(
        [("v", "1", "good", "en", 1), ("v", "2", "boom", "en", 1), ("v", "3", "meh", "fr", 1)], SCHEMA
    ).repartition(1)
    scorer = SE.PluginScorer(_flaky_scorer)
    got = {r["comment_id"]: r for r in SE.score_sentiment(df, {"*": scorer}).collect()}
    assert (got["1"]["sentiment_label"], got["1"]["sentiment_score"]) == (1, 0.9)
    assert (got["2"]["original_sentiment_label"], got["2"]["sentiment_label"], got["2"]["sentiment_score"]) == (
        "Error", None, 0.0)
    assert got["3"]["sentiment_label"] == -1


def test_trained_scorer_runs(spark):
    rows = [("v", str(i), t, "en", 1) for i, t in enumerate(["good great", "bad awful", "fine ok"] * 10)]
    df = spark.createDataFrame(rows, SCHEMA)
    labelled = df.withColumn(
        "label", F.when(F.col("clean_text").contains("good"), 1).when(F.col("clean_text").contains("bad"), -1).otherwise(0)
    ).select(F.col("clean_text").alias("text"), "label")
    scorer = SE.TrainedScorer(num_features=1 << 10, max_iter=20).fit(labelled)
    got = SE.score_sentiment(df, {"*": scorer}).collect()
    assert len(got) == 30
    for r in got:
        assert r["sentiment_label"] in (-1, 0, 1)
        assert 0.0 <= r["sentiment_score"] <= 1.0
    by_text = {r["clean_text"]: r["sentiment_label"] for r in got}
    assert by_text["good great"] == 1 and by_text["bad awful"] == -1


def test_fit_routes_trains_each_route_on_its_rows(spark):
    # The same word means opposite things per route: a model that saw the
    # other route's rows would get one of them wrong.
    texts = [("good", "en", 1), ("bad", "en", -1), ("good", "fr", -1), ("bad", "fr", 1)] * 10
    rows = [("v", str(i), t, lang, 1) for i, (t, lang, _) in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    labelled = spark.createDataFrame(
        [(t, lang, y) for t, lang, y in texts], "text string, language string, label int"
    )
    scorers = SE.fit_routes(labelled, make=lambda: SE.TrainedScorer(num_features=1 << 8, max_iter=30))
    got = {(r["clean_text"], r["language"]): r["sentiment_label"]
           for r in SE.score_sentiment(df, scorers).collect()}
    assert got == {("good", "en"): 1, ("bad", "en"): -1, ("good", "fr"): -1, ("bad", "fr"): 1}


def test_stopword_language(spark):
    texts = ["The cat and the dog", "Le chat et le chien", "Der Hund und die Katze",
             "El perro y el gato", "12345", None, "la la"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(LG.stopword_language(F.col("t"))).collect()]
    assert got == ["en", "fr", "de", "es", "unknown", "unknown", "es"]  # 'la' tie es/fr → es


def test_ngram_language_on_documents(spark):
    from crowdrank.plans.queries import language_ngram
    from crowdrank.sources.tables import read_table
    docs = read_table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "lang")
    out = language_ngram(spark, "/root/testdata/sf0.001").join(docs, "doc_id")
    total = out.count()
    right = out.filter(F.col("language") == F.col("lang")).count()
    assert total == docs.count()
    assert right / total > 0.95


def test_ngram_lookup_and_join_give_the_same(spark):
    rows = [(1, "the cat sat on the mat", "en"), (2, "le chat est la", "fr"), (3, "die Katze", "de"),
            (4, "der Hund und die Katze", "de"), (5, "", "en"), (6, None, "fr"), (None, "the mat", None),
            (7, "1234", None), (8, "xyzzy", None), (8, "le chat", None), (8, "le chat", None)]
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    profiles = LG.train_ngram_profiles(df.filter("id < 5"))
    got = [
        sorted(map(tuple, LG.ngram_languages(df, "id", "text", profiles, bound).collect()), key=str)
        for bound in (LG.MAX_PROFILE_BYTES, 0)
    ]
    assert got[0] == got[1]
    assert (8, "unknown") in got[0] and got[0].count((8, "fr")) == 2 and (6, "unknown") in got[0]
    empty = LG.ngram_languages(df, "id", "text", profiles.limit(0))
    assert {r.language for r in empty.collect()} == {"unknown"}


def test_ngram_counts_make_no_row_per_occurrence(spark):
    """the training exploded every trigram; one that begins inside a character of two units was counted too."""
    from collections import Counter

    rows = [("en", "the the the"), ("en", ""), ("en", None), ("de", "\U0001d400\U0001d401\U0001d402 und"), (None, "le"), ("en", "12")]
    profiles = LG.train_ngram_profiles(spark.createDataFrame(rows, "lang string, text string"))
    assert "Generate" not in profiles._jdf.queryExecution().optimizedPlan().toString()
    want = Counter()
    for lang, padded in (("en", " the the the "), ("en", "  "), ("en", "   "), ("de", " \U0001d400\U0001d401\U0001d402 und ")):
        want.update((lang, padded[i:i + 3]) for i in range(len(padded) - 2))
    assert {(r.lang, r.gram): r.n for r in profiles.collect()} == want


@pytest.mark.parametrize("piece, dense", [(1, 0), (4, 1 << 22), (7, 0), (1 << 20, 1 << 22)])
def test_ngrams_of_pieces_are_those_of_the_texts(monkeypatch, piece, dense):
    from collections import Counter

    import numpy as np

    monkeypatch.setattr(LG, "PIECE_CHARS", piece)
    monkeypatch.setattr(LG, "DENSE_GRAMS", dense)
    texts = [" one two one ", None, "", "ab", "abc", " \u4e2d\u6587\U0001f600 x", "z" * 40]
    grams = [[(t or "")[i:i + 3] for i in range(len(t or "") - 2)] for t in texts]
    counts = Counter()
    for gram, n in LG._gram_counts(texts):
        counts[gram] += n
    assert counts == Counter(sum(grams, []))
    names = ["one", "zzz", "qqq", "\u6587\U0001f600 "]
    known = LG._code_points("".join(names)).reshape(-1, 3)
    found = Counter()
    for part in LG._pieces(texts):
        of_text, numbers, alphabet = LG._piece_grams(part)
        slots = LG._known_slots(numbers, alphabet, known)
        found.update((int(t), names[s]) for t, s in zip(of_text, slots) if s < len(names))
    assert found == Counter((i, g) for i, gs in enumerate(grams) for g in gs if g in names)
    assert not list(LG._pieces([None, "", "ab"])) and np.ndim(known) == 2


def test_lexicon_join_gives_the_same_without_a_broadcast(spark):
    rows = [("v", "1", "good good bad", "en", 1), ("v", "2", "bad", "en", 1), ("v", "3", "meh", "en", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [
        sorted((r.comment_id, r.original_sentiment_label, r.sentiment_score) for r in SE.score_sentiment(
            df, {"*": SE.LexiconScorer({"good": 1.0, "bad": -1.0}, by_join=True, max_broadcast_bytes=bound)}
        ).collect())
        for bound in (1 << 20, 0)
    ]
    assert got[0] == got[1]
    assert [label for _, label, _ in got[0]] == ["positive", "negative", "neutral"]


def test_language_and_lexicon_are_one_lookup_each(spark):
    """No regular expression per language or weight reads the text (F2, F4, F5)."""
    from crowdrank.functions.terms import count_tokens_in, normalized_tokens
    from crowdrank.operators.language import stopword_language, with_language
    from crowdrank.operators.sentiment import LexiconScorer

    rows = [(None,), ("",), ("the der le el",), ("la la la",), ("Die und 2the the",), ("y\u00a0es\x1cque",), ("12 !",)]
    df = spark.createDataFrame(rows, "text string")
    weights = {"the": 1.0, "la": -0.5, "und": 1.0, "es": 0.0}
    found = with_language(df, "text", "language", by_lookup=True).withColumn("tokens", normalized_tokens(F.col("text")))
    found = found.withColumn("s", LexiconScorer(weights).sums(F.col("tokens")))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_count" not in plan.lower() and "regexpcount" not in plan.lower()
    count = lambda w: count_tokens_in(F.col("tokens"), [w])
    want = found.select(
        "language", stopword_language(F.col("text")).alias("l"), "s.total", "s.absolute",
        (count("the") + count("und") - 0.5 * count("la")).alias("t"), (count("the") + count("und") + 0.5 * count("la")).alias("a"),
    ).collect()
    assert [r.language for r in want] == [r.l for r in want]
    assert [(float(r.total), float(r.absolute)) for r in want] == [(float(r.t), float(r.a)) for r in want]


def test_whitespace_collapse_touches_only_what_changes(spark):
    from crowdrank.functions.patterns import WS_CHANGED, WS_RUN

    marks = [chr(c) for c in range(0x3100) if chr(c).isspace()] + ["x", "\u200b", "\u180e", "\u2010"]
    rows = [(f"a{p}{q}b {p}c{q}",) for p in marks for q in marks]
    df = spark.createDataFrame(rows, "t string")
    bad = df.where(F.regexp_replace("t", WS_CHANGED, " ") != F.regexp_replace("t", WS_RUN, " "))
    assert bad.count() == 0 and df.where(F.regexp_like(F.lit("plain words only"), F.lit(WS_CHANGED))).count() == 0


def test_joined_phrases_are_made_without_nested_lambdas(spark):
    """n-grams come from rows of neighbouring tokens, in generated code."""
    from crowdrank.operators import sentiment as SE

    df = spark.createDataFrame([(1, "a b c a b"), (2, ""), (3, None), (4, "b c")], "k long, t string")
    scorer = SE.LexiconScorer({"a b": 1.0, "a b c": -3.0, "b": 0.5, "c": 0.25}, by_join=True)
    joined = SE.join_sums(df, "k", "t", [(scorer, F.lit(True))])
    got = {r.k: (r[SE.TOTAL], r[SE.ABSOLUTE]) for r in joined.collect()}
    assert got == {1: (-2.0, 4.0), 2: (0.0, 0.0), 3: (0.0, 0.0), 4: (0.75, 0.75)}
    assert "flatten(" not in joined._jdf.queryExecution().optimizedPlan().toString()
