"""Plan shape: pruning, partial aggregation, window limits, exchange reuse."""

from crowdrank.plans import queries as Q
from crowdrank.plans import ranker as RK
from crowdrank.sources import tables as TB

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_scores_prune_columns_and_aggregate_partially(spark):
    df = Q.item_scores(spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in plan.split("\n") if "FileScan" in line][0]
    assert "l_partkey" in scan and "l_shipdate" not in scan and "l_comment" not in scan
    assert "partial_sum" in plan


def test_caps_use_partial_window_group_limit(spark):
    plan = Q.comments_per_item_capped(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert "Partial" in plan


def test_recommendation_reuses_the_scores_exchange(spark):
    for query in (Q.recommendation, Q.text_ranking):
        assert "ReusedExchange" in _plan(query(spark, SF))


def test_global_topk_is_take_ordered(spark):
    plan = Q.top3_polarized(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_ngram_languages_score_in_the_row_without_a_shuffle(spark):
    plan = _plan(Q.language_ngram(spark, SF))
    assert "ArrowEvalPython" in plan
    assert "Generate explode" not in plan and "Join" not in plan and "hashpartitioning" not in plan


def test_lexicon_join_path_explodes_only_keys(spark):
    plan = _plan(Q.lexicon_sentiment_by_join(spark, SF))
    generates = [line for line in plan.split("\n") if "Generate explode" in line]
    assert generates
    for line in generates:
        # Generate's carried columns are listed after the generator: the key and the text's hash.
        carried = line.rsplit("), [", 1)[1]
        assert carried.startswith("_key") and "text" not in carried and "clean_text" not in carried
    assert "partial_sum" in plan and "BroadcastExchange" in plan


def test_flow_semi_joins_comments_before_the_cap(spark):
    params = RK.RankerParams(exclude_words=Q.TITLE_WORDS, comment_order=TB.LINEITEM_ORDER)
    capped = RK.rank_from_scored(
        TB.part_listing(spark, SF), TB.part_details(spark, SF), TB.lineitem_comments_ordered(spark, SF), params
    )
    lines = _plan(capped.recommendation).split("\n")
    caps = [i for i, line in enumerate(lines) if "WindowGroupLimit [video_id" in line]
    assert caps
    for i in caps:
        # The next join or scan under the per-video cap is the semi-join to
        # the kept videos, not the raw comment scan.
        below = next(line for line in lines[i + 1:] if "Join" in line or "FileScan" in line)
        assert "LeftSemi" in below
