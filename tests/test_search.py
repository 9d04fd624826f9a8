"""Search: exact top k, blocks that are never read, odd catalogues."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from crowdrank.operators import search as SR
from crowdrank.plans import queries as Q
from crowdrank.sources import tables as TB

SF = "/root/testdata/sf0.001"


def words(text):
    return [w for w in re.split(r"[\s.]+", (text or "").lower()) if w]


def brute(catalog, queries, k, score):
    titles = {}
    for video, title, position in catalog:
        if video not in titles or position < titles[video][0]:
            titles[video] = (position, title)
    bags = {v: Counter(words(t)) for v, (_, t) in titles.items()}
    n = sum(t is not None for _, t in titles.values())
    lengths = [sum(b.values()) for v, b in bags.items() if titles[v][1] is not None]
    mean = sum(lengths) / max(len(lengths), 1)
    held = Counter(w for b in bags.values() for w in b)

    def impact(video, word):
        if score == "overlap":
            return 1
        times, length = bags[video][word], sum(bags[video].values())
        rarity = math.log(1 + (n - held[word] + 0.5) / (held[word] + 0.5))
        return math.floor(1000 * rarity * (times * 2.2 / (times + 1.2 * (0.25 + 0.75 * length / mean))) + 0.5)

    out = set()
    for query in set(queries) - {None}:
        divisor = len(set(re.split(r"[\s.]+", query.lower())))
        found = []
        for video, bag in bags.items():
            shared = set(words(query)) & set(bag)
            if shared:
                found.append((-sum(impact(video, w) for w in shared), titles[video][0], video, len(shared) / divisor))
        for place, (less, _, video, relevance) in enumerate(sorted(found)[:k]):
            out.add((query, place, video, titles[video][1], -less, round(relevance, 9)))
    return out


@pytest.fixture(scope="module")
def catalog():
    rows = []
    for i in range(900):
        bag = ["common"] * (i % 3) + [f"w{(i * 7919) % 40}", f"x{(i * 31) % 13}", "Hot" if i % 3 else "hot."]
        rows.append((f"v{i}", " ".join(bag), i))
    rows += [("v1", "late second place", 5000), ("n", None, 1), ("e", "", 2), ("u", "Été ÉTÉ w1", 3), ("t", "w1 x1", 3)]
    return rows


QUERIES = ["common hot", "w1 x1 w1.", "nothing here", "", " . ", None, "éTÉ", "hot", "w3 common x4 w9 hot", "late"]


@pytest.mark.parametrize("score", SR.SCORES)
@pytest.mark.parametrize("k", [1, 7, 400])
def test_search_equals_brute_force(spark, catalog, score, k):
    table = spark.createDataFrame(catalog, "video_id string, title string, position long").repartition(3)
    asked = spark.createDataFrame([(q, 1) for q in QUERIES + QUERIES], "query string, more int")
    found = SR.search(SR.build_index(table, score), asked, k)
    got = {(r.query, r.position, r.video_id, r.title, r.score, round(r.relevance_score, 9)) for r in found.collect()}
    assert got == brute(catalog, QUERIES, k, score)


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "video_id string, title string, position long")
    some = spark.createDataFrame([("a",)], "query string")
    index = SR.build_index(none)
    assert SR.search(index, some).count() == 0
    with pytest.raises(ValueError):
        SR.build_index(none, score="tf")


def test_blocks_below_the_kth_score_are_not_read(spark, monkeypatch):
    monkeypatch.setattr(SR, "BLOCK_BITS", 4)
    monkeypatch.setattr(SR, "BLOCK_TITLES", 16)
    rows = [(i, f"a{i % 30} b{i % 7} all", i) for i in range(3000)]
    index = SR.build_index(spark.createDataFrame(rows, "video_id long, title string, position long"))
    asked = SR.query_tokens(spark.createDataFrame([(f"a{i} b{i % 7} all",) for i in range(30)], "query string"))
    ranked = SR.rank_blocks(index, asked)
    first = SR._top(SR._postings_of(ranked.where("place <= 2"), asked, index), 5)
    more = SR.blocks_to_read(ranked, first, 5, 2)
    assert 2 * 30 + more.count() < ranked.count() / 4  # every block holds "all"


@pytest.mark.parametrize("bound", [0, SR.MAX_BROADCAST_ROWS])
def test_bounds_are_dealt_over_tasks_and_stay_exact(spark, catalog, monkeypatch, bound):
    """one task held the bounds of all queries; a large query table is joined in slices."""
    monkeypatch.setattr(SR, "MAX_BROADCAST_ROWS", bound)
    monkeypatch.setattr(SR, "TASK_BOUNDS", 8)
    monkeypatch.setattr(SR, "BLOCK_BITS", 4)
    monkeypatch.setattr(SR, "BLOCK_TITLES", 16)
    rows = catalog + [("z", "w1 x1 hot", None)]
    index = SR.build_index(spark.createDataFrame(rows, "video_id string, title string, position long"))
    asked = spark.createDataFrame([(q,) for q in QUERIES], "query string")
    bounds = SR.block_bounds(index, SR.query_tokens(asked))
    dealt = [r["count"] for r in bounds.groupBy(F.spark_partition_id()).count().collect()]
    assert len(dealt) > 8 and max(dealt) < sum(dealt) / 4
    got = {(r.query, r.position, r.video_id, r.title, r.score, round(r.relevance_score, 9))
           for r in SR.search(index, asked, 7).collect()}
    assert got == brute([(v, t, -1 if p is None else p) for v, t, p in rows], QUERIES, 7, "bm25")


def test_blocks_of_later_copies_are_not_read(spark, monkeypatch):
    """F1: titles that equal the k-th one and come after it were all scored."""
    monkeypatch.setattr(SR, "BLOCK_BITS", 4)
    monkeypatch.setattr(SR, "BLOCK_TITLES", 16)
    index = SR.build_index(spark.createDataFrame([(i, "a b", i) for i in range(900)], "video_id long, title string, position long"))
    asked = SR.query_tokens(spark.createDataFrame([("a b",)], "query string"))
    ranked = SR.rank_blocks(index, asked)
    first = SR._top(SR._postings_of(ranked.where("place <= 2"), asked, index), 5)
    assert ranked.count() > 50 and SR.blocks_to_read(ranked, first, 5, 2).count() == 0


def test_no_query_meets_every_title(spark):
    index = SR.build_index(TB.part_catalog(spark, SF))
    plan = SR.search(index, TB.part_queries(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_an_index_is_found_again(spark, catalog, tmp_path):
    table = spark.createDataFrame(catalog, "video_id string, title string, position long")
    asked = spark.createDataFrame([(q,) for q in QUERIES], "query string")
    path = str(tmp_path / "index")
    built = SR.search(SR.build_index(table, path=path), asked).collect()
    assert set(SR.search(SR.SearchIndex.load(spark, path), asked).collect()) == set(built)


def test_a_query_that_finds_nothing_keeps_its_row(spark):
    from crowdrank.plans import ranker as RK

    asked = spark.createDataFrame([("red ring",), ("no such thing",)], "query string")
    params = RK.RankerParams(num_comments=None, comment_order=TB.LINEITEM_ORDER, exclude_words=())
    result = RK.rank_from_catalog(
        asked, TB.part_catalog(spark, SF), TB.part_details(spark, SF), TB.lineitem_comments_ordered(spark, SF), params
    )
    got = {r.query: r.best_video_id for r in Q.rounded(result.recommendation).collect()}
    assert got["no such thing"] is None and got["red ring"] is not None
    assert result.videos.where(F.col("query") == "red ring").count() <= 50
