"""Lexicon terms of several tokens: three ways, one result; nothing is dropped."""

import random
import re

import pytest
from pyspark.sql import functions as F

from crowdrank.functions.terms import PhraseTrie, phrase_of
from crowdrank.operators import language as LG
from crowdrank.operators import sentiment as SE
from crowdrank.plans import queries as Q

SF = "/root/testdata/sf0.001"
SCHEMA = "comment_id long, clean_text string, language string"


def verdicts(df, scorer, key="comment_id"):
    scored = SE.score_sentiment(df, scorer if isinstance(scorer, dict) else {"*": scorer})
    return sorted((str(r[key]), r.clean_text, r.sentiment_label, round(r.sentiment_score, 9)) for r in scored.collect())


def brute(text, lexicon):
    tokens = re.findall(r"[a-zé]+|[0-9]+", text.lower())
    phrases = {phrase_of(term): w for term, w in lexicon.items()}
    total = absolute = at = 0
    while at < len(tokens):
        fits = [n for n in range(1, 5) if tuple(tokens[at:at + n]) in phrases and at + n <= len(tokens)]
        if fits:
            weight = phrases[tuple(tokens[at:at + max(fits)])]
            total, absolute = total + weight, absolute + abs(weight)
        at += max(fits, default=1)
    return (total > 0) - (total < 0), round(abs(total) / absolute if absolute else 0.5, 9)


def test_a_phrase_scores_its_own_text(spark):
    lexicon = {"very good": 2.0, "not good": -2.0, "good": 1.0, "don't": -1.0, "24/7": 1.0, "10": 3.0}
    rows = [
        (1, "very good", "en"), (2, "NOT  good!", "en"), (3, "I don’t, don't", "en"), (4, "open 24/7", "en"),
        (5, "good, not", "en"), (6, "x10 100", "en"), (7, "", "en"), (8, None, "en"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for scorer in (SE.LexiconScorer(lexicon), SE.LexiconScorer(lexicon, by_join=True)):
        labels = {r.comment_id: r.sentiment_label for r in SE.score_sentiment(df, {"*": scorer}).collect()}
        assert labels == {1: 1, 2: -1, 3: -1, 4: 1, 5: 1, 6: 1, 7: 0}


def test_all_ways_equal_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    words = ["a", "b", "c", "dé", "7", "77", "e"]
    lexicon = {" ".join(rng.choices(words, k=rng.randint(1, 4))): rng.choice([-2.0, -1.0, 0.0, 0.5, 1.0]) for _ in range(40)}
    rows = [
        (k // 2 if k % 7 else None, "".join(rng.choice(words) + rng.choice([" ", "  ", ", ", "'", ""]) for _ in range(k)), "en")
        for k in range(1, 60)
    ]
    rows += [rows[10], rows[10], (500, "a b " * 4000, "en")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = sorted((str(c), t, *brute(t, lexicon)) for c, t, _ in rows)
    assert verdicts(df, SE.LexiconScorer(lexicon)) == want
    assert verdicts(df, SE.LexiconScorer(lexicon, by_join=True)) == want
    shuffled = SE.LexiconScorer(lexicon, by_join=True, max_broadcast_bytes=0)
    assert verdicts(df, shuffled) == want
    table = spark.createDataFrame(list(lexicon.items()), "term string, weight double")
    assert verdicts(df, SE.LexiconScorer({}, table=table)) == want
    monkeypatch.setattr(SE, "MAX_REGEX_WORDS", 3)  # the trie
    assert verdicts(df, SE.LexiconScorer(lexicon)) == want


def test_routes_share_one_pass(spark):
    df = spark.createDataFrame(
        [(1, "not good", "en"), (1, "not good", "fr"), (2, "bien", "fr"), (3, "bien", "en"), (4, "good", None)], SCHEMA
    )
    one, two = {"not good": -1.0, "good": 1.0}, {"bien": 2.0, "good": -3.0}
    plain = {"en": SE.LexiconScorer(one), "*": SE.LexiconScorer(two, neutral_score=0.1)}
    joined = {"en": SE.LexiconScorer(one, by_join=True), "*": SE.LexiconScorer(two, neutral_score=0.1, by_join=True)}
    mixed = {"en": SE.LexiconScorer(one), "*": SE.LexiconScorer(two, neutral_score=0.1, by_join=True)}
    assert verdicts(df, plain) == verdicts(df, joined) == verdicts(df, mixed)


def test_join_path_reads_the_texts_once(spark):
    df = Q.lexicon_sentiment_by_join(spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString() + "\n" + df._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan" in line]
    assert len(scans) == 2 and sum("clean_text" in line.split("ReadSchema")[1] for line in scans) == 1
    assert plan.count("Generate explode") == 2  # one, in each of the two plans


def test_terms_that_cannot_match_are_errors(spark):
    df = spark.createDataFrame([(1, "t", "en")], SCHEMA)
    with pytest.raises(ValueError, match=":\\)"):
        SE.score_sentiment(df, {"*": SE.LexiconScorer({":)": 1.0, "good": 1.0})})
    table = spark.createDataFrame([("!!", 1.0)], "term string, weight double")
    with pytest.raises(ValueError):
        SE.score_sentiment(df, {"*": SE.LexiconScorer({}, table=table)})


def test_trie_is_leftmost_longest():
    trie = PhraseTrie({("a",): 1, ("a", "b", "c"): 3, ("b", "c", "d"): 9, ("d",): 4})
    assert list(trie.found(list("abcd"))) == [3, 4]
    assert list(trie.found(list("abd"))) == [1, 4]
    assert list(trie.found(list("xbcd"))) == [9]
    assert list(trie.found([])) == []


def test_stop_lists_of_any_length(spark):
    def word(k):
        return "w" + "".join(chr(97 + (k // 26**i) % 26) for i in range(4))

    lists = {"en": ("the",), "xx": tuple(word(k) for k in range(4_500))}
    rows = [(1, "the the " + word(4_400), "en"), (2, f"the {word(3)} {word(2_500)}", "en"), (3, "none", "en")]
    df = spark.createDataFrame(rows, SCHEMA).drop("language")
    found = LG.with_language(df, "clean_text", "language", lists)
    assert {r.comment_id: r.language for r in found.select("comment_id", F.col("language")).collect()} == {
        1: "en", 2: "xx", 3: "unknown"
    }
    with pytest.raises(ValueError, match="l'"):
        LG.with_language(df, "clean_text", "language", {"fr": ("l'", "le")})
