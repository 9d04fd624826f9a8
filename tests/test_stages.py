"""Named stages: picked up by a later run, rebuilt when what goes in changes."""

import pytest
from pyspark.sql import functions as F

from crowdrank.operators.sentiment import LexiconScorer, PluginScorer
from crowdrank.plans import ranker as RK
from crowdrank.plans.plugins import pause_scorer, punctuation_scorer
from crowdrank.session import _SCRATCH, clear_scratch, scratch_path
from crowdrank.sources.stages import StageStore

LEXICON = {"*": LexiconScorer({"good": 1.0, "bad": -1.0})}


@pytest.fixture
def landed(spark, tmp_path):
    """Sources as Parquet folders, and a loader that counts its calls."""
    listing = [("q one", k, f"v{k}", "a title") for k in range(6)]
    details = [(f"v{k}", "a title", "PT5M", 1, 1, 1) for k in range(6)]
    comments = [(f"v{k % 6}", 0, k, f"c{k}", "a", "good" if k % 3 else "bad", 2) for k in range(40)]
    schemas = {
        "listing": "query string, position long, video_id string, title string",
        "details": "video_id string, title string, iso_duration string, view_count long, like_count long, comment_count long",
        "comments": "video_id string, page long, item_pos int, comment_id string, author string, text string, like_count long",
    }
    paths = []
    for (name, schema), rows in zip(schemas.items(), (listing, details, comments)):
        paths.append(str(tmp_path / name))
        spark.createDataFrame(rows, schema).write.parquet(paths[-1])
    calls = []

    def load():
        calls.append(1)
        return tuple(spark.read.parquet(p) for p in paths)

    return paths, load, calls


def answer(result):
    return sorted(map(tuple, result.recommendation.collect()))


def gone():
    raise AssertionError("no source is needed")


def test_a_run_goes_on_after_stage_two_without_the_sources(spark, landed, tmp_path):
    paths, load, calls = landed
    root = str(tmp_path / "stages")
    first = StageStore(spark, "q one", root)
    part = RK.rank_in_stages(first, load, LEXICON, inputs=paths, until="comments")
    assert first.built == ["queries", "videos", "comments"] and part.comments_scored is None and calls == [1]
    later = StageStore(spark, "q one", root)
    result = RK.rank_in_stages(later, gone, LEXICON, inputs=paths)
    assert later.reused == ["queries", "videos", "comments"] and later.built == ["comments_scored", "video_scores"]
    plain = RK.rank_from_sources(*load(), LEXICON)
    assert answer(result) == answer(plain)
    again = StageStore(spark, "q one", root)
    assert answer(RK.rank_in_stages(again, gone, LEXICON, inputs=paths)) == answer(plain) and not again.built
    # Sources that are gone: what was finished stands.
    moved = StageStore(spark, "q one", root)
    RK.rank_in_stages(moved, gone, LEXICON, inputs=[str(tmp_path / "nowhere")])
    assert not moved.built
    assert {r.stage: r.rows for r in again.report(RK.STAGES).collect()} == {
        "queries": 1, "videos": 6, "comments": 40, "comments_scored": 40, "video_scores": 6
    }
    assert (tmp_path / "stages" / "q_one_video_scores" / "manifest.json").exists()


def test_a_change_rebuilds_what_depends_on_it_and_replaces_the_data(spark, landed, tmp_path):
    paths, load, _ = landed
    root = str(tmp_path / "stages")
    RK.rank_in_stages(StageStore(spark, "q", root), load, LEXICON, inputs=paths)

    def built(scorers=LEXICON, params=RK.RankerParams()):
        store = StageStore(spark, "q", root)
        RK.rank_in_stages(store, load, scorers, params, inputs=paths)
        return store.built

    assert built() == []
    assert built({"*": LexiconScorer({"good": 1.0, "bad": -2.0})}) == ["comments_scored", "video_scores"]
    assert built({"*": PluginScorer(pause_scorer)}) == ["comments_scored", "video_scores"]
    assert built({"*": PluginScorer(punctuation_scorer)}) == ["comments_scored", "video_scores"]
    assert built({"*": PluginScorer(punctuation_scorer)}, RK.RankerParams(num_comments=2)) == [
        "comments", "comments_scored", "video_scores"
    ]
    spark.createDataFrame([("q two", 9, "v1", "new")], "query string, position long, video_id string, title string").write.mode(
        "append").parquet(paths[0])
    assert built({"*": PluginScorer(punctuation_scorer)}, RK.RankerParams(num_comments=2)) == list(RK.STAGES)
    for stage in RK.STAGES:
        folder = tmp_path / "stages" / f"q_{stage}"
        assert len([p for p in folder.iterdir() if p.name.startswith("data-")]) == 1


def test_a_stage_that_dies_leaves_the_old_one(spark, tmp_path):
    store = StageStore(spark, "q", str(tmp_path))
    numbers = spark.range(10)
    assert store.stage("s", lambda: numbers, 1).count() == 10
    fails = numbers.select(F.raise_error(F.lit("dead")).cast("long").alias("id"))
    with pytest.raises(Exception, match="dead"):
        store.stage("s", lambda: fails, 2).count()
    assert store.read("s").count() == 10 and store.manifest("s")["rows"] == 10
    assert store.clean("s") == 1 and store.read("s").count() == 10
    with pytest.raises(FileNotFoundError):
        store.read("never")
    with pytest.raises(FileNotFoundError):
        store.stage("t", lambda: numbers, 1, [str(tmp_path / "nowhere")])
    with pytest.raises(ValueError):
        store.stage("t", lambda: numbers, 1, after=["never"])
    empty = store.stage("none", lambda: spark.createDataFrame([], "a array<int>, b string"), 1)
    assert empty.count() == 0 and empty.columns == ["a", "b"]


def test_scratch_is_cleared(spark):
    kept = list(_SCRATCH)
    _SCRATCH.clear()  # other tests still read theirs
    try:
        spark.range(3).write.parquet(scratch_path(spark, "one"))
        scratch_path(spark, "never-written")
        assert clear_scratch(spark) == 1 and not _SCRATCH
    finally:
        _SCRATCH[:] = kept
