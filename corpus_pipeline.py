"""The corpus pipeline: quality, language, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept.  The first three return the columns they were given, in rows that stay;
the last returns the pieces of the packed token windows.  Rows with NULL or
repeated ids are documents of their own until near duplicates, where rows with
one id are one document.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crowdrank.llm import language_id, near_dedup, packing, quality
from crowdrank.llm.common import free_name, materialise, read_table, without_ids

KEEP_QUALITY = 0.3  # lowest probability of good quality that stays
KEEP_LANGUAGE = 0.2  # lowest profile score that stays
SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents whose co-trained score is too low go."""
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    name = free_name(docs, "quality_score")
    scored = quality.score(docs, model, result_col=name)
    return scored.where(F.col(name)["score"] >= KEEP_QUALITY).select(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents without a letter, or far from every language's
    profile, go.  The profiles are learned from the rows that name a language."""
    profiles = language_id.collect_profiles(language_id.train_profiles(docs))
    if not profiles[0]:  # nothing to compare with: nothing is rejected
        return docs
    name = free_name(docs, "language_id")
    judged = language_id.identify(docs, profiles, result_col=name)
    fits = (F.col(name)["lang_pred"] != language_id.UNDETERMINED) & (F.col(name)["score"] >= KEEP_LANGUAGE)
    return judged.where(fits).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of each group of near duplicates (five-word shingles,
    similarity 0.8) the document with the smallest id stays, once.  Rows with a
    NULL id and documents without words stay."""
    decided = materialise(
        near_dedup.near_duplicates(docs, shingle=SHINGLE_WORDS, percent=SIMILAR_PERCENT), "near-duplicates"
    )
    kept = without_ids(docs, decided.where("not kept").select("doc_id").distinct(), "doc_id")
    repeated = decided.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    place = free_name(docs, "place")
    again = kept.join(repeated, "doc_id", "left_semi").withColumn(
        place, F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    ).where(F.col(place) == 1)
    return without_ids(kept, repeated, "doc_id").select(*docs.columns).unionByName(again.select(*docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the pieces of the packed windows."""
    pieces = packing.pack_documents(docs, TOKENIZER)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

#: SQL expresses neither the trained models nor the dynamic program; the stages
#: are tested against brute-force versions in tests/llm.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    rows = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        rows = materialise(stage(spark, rows, sf_dir), f"stage-{name}")
    return rows
