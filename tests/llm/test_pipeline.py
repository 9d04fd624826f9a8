"""The pipeline's stages against what their operators decide."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as CP
from tests.llm.conftest import docs_rows
from tests.llm.test_operators import brute_components

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("stage", [f for _, f in CP.STAGES[:3]])
def test_stages_keep_columns_and_survive_odd_tables(spark, odd_docs, no_docs, stage):
    out = stage(spark, odd_docs, SF)
    assert out.columns == odd_docs.columns
    assert set(out.select("text").collect()) <= set(odd_docs.select("text").collect())
    assert stage(spark, no_docs, SF).count() == 0


def test_near_duplicate_stage_keeps_one_of_each_group(spark, odd_docs):
    kept = Counter(r.doc_id for r in CP.near_duplicate_stage(spark, odd_docs, SF).collect())
    want: Counter = Counter()
    for (d, _, _, keep), times in brute_components([r[:2] for r in docs_rows()], 5, 80).items():
        if keep:
            want[d] = want[d] + times if d is None else 1
    assert kept == want


def test_language_stage_drops_texts_without_letters(spark, odd_docs):
    gone = odd_docs.exceptAll(CP.language_stage(spark, odd_docs, SF)).select("text").collect()
    assert {None, "", "123 456 !!"} <= {r.text for r in gone}


def test_run_packs_what_the_stages_kept(spark):
    pieces = CP.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    packed = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all"))
    assert packed.where("n <> all").count() == 0
    assert 0 < packed.count() < docs.count()
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0")
    bad = labels.count()
    assert packed.join(labels, "doc_id", "left_semi").count() <= 0.1 * bad
