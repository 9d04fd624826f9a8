"""U6: a trained sentiment scorer in closed form.

Class weights of tokens are log-odds of document counts, so training is one
aggregate and the result is exact and repeatable:

    weight(token, class) = ln((documents of the class with the token + 1) / (documents of the class + 2))

as whole thousandths, for tokens that ``MIN_DOCS`` documents have and whose
weights differ by ``MIN_SPREAD`` or more between classes; a document's score per
class is the class's prior plus the weights of its distinct tokens, the label
the class with the highest score (ties: the lower class), the confidence its
share of exp(score).  Each route (English, the rest) has a model of its own.

Documents are scored out of fold: the counts are kept per fold, and a fold is
scored by the sums over the others, so no document takes part in its own
verdict and the text is counted once for all folds.  Counts are summed per task
before they move.  Weights are joined by (route, fold, token), broadcast up to
``MAX_BROADCAST_BYTES`` (measured): only keys, hashes and tokens are exploded,
and what moves is a row per comment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdrank.functions.terms import word_tokens
from crowdrank.operators.sentiment import ENGLISH, LABEL, RAW, SCORE, TrainedScorer
from crowdrank.sources.files import materialize

CLASSES = (-1, 0, 1)
NAMES = TrainedScorer.CLASSES
FOLDS = 2
SCALE = 1000
MIN_DOCS = 3
MIN_SPREAD = 500  # thousandths
MAX_BROADCAST_BYTES = 32 * 1024 * 1024


def _thousandths(share: Column) -> Column:
    return F.floor(SCALE * F.log(share) + 0.5).cast("long")


def count_weights(labelled: DataFrame, folds: int = FOLDS) -> tuple[DataFrame, DataFrame]:
    """(route, fold, token, w_0 … w_2) and (route, fold, prior_0 … prior_2) from
    ``labelled`` comments (route, fold, label, words; words distinct)."""
    outside = [
        F.count_if((F.col("label") == c) & (F.col("fold") != f)).alias(f"n_{f}_{k}")
        for f in range(folds) for k, c in enumerate(CLASSES)
    ]
    per_fold = F.explode(F.array(*[
        F.struct(F.lit(f).alias("fold"), *[F.col(f"n_{f}_{k}").alias(f"n_{k}") for k in range(3)]) for f in range(folds)
    ])).alias("f")
    tokens = labelled.select("route", "fold", "label", F.explode("words").alias("token"))
    counts = tokens.groupBy("route", "token").agg(*outside).select("route", "token", per_fold)
    sizes = labelled.groupBy("route").agg(*outside).select("route", per_fold).select(
        "route", "f.fold", *[F.col(f"f.n_{k}").alias(f"d_{k}") for k in range(3)]
    )
    weights = [
        _thousandths((F.col(f"n_{k}") + 1) / (F.col(f"d_{k}") + 2)).alias(f"w_{k}") for k in range(3)
    ]
    ws = [F.col(f"w_{k}") for k in range(3)]
    table = (
        counts.select("route", "token", "f.*").join(F.broadcast(sizes), ["route", "fold"])  # a row per route and fold
        .where(F.col("n_0") + F.col("n_1") + F.col("n_2") >= MIN_DOCS)
        .select("route", "fold", "token", *weights)
        .where(F.greatest(*ws) - F.least(*ws) >= MIN_SPREAD)
    )
    whole = F.col("d_0") + F.col("d_1") + F.col("d_2")
    priors = sizes.select(
        "route", "fold", *[_thousandths((F.col(f"d_{k}") + 1) / (whole + 3)).alias(f"prior_{k}") for k in range(3)]
    )
    return table, priors


def score_out_of_fold(
    comments: DataFrame, labels: DataFrame, key: str = "comment_id", text: str = "clean_text", language: str = "language",
    folds: int = FOLDS,
) -> DataFrame:
    """``comments`` with raw label, confidence and label; ``labels`` has the
    key and ``label`` (−1, 0, 1) of some comments.  Rows with one key are
    comments of their own, with the key's label; a NULL key has none.  A route
    without labels has even priors, whose tie goes to the lowest class."""
    english = F.coalesce(F.col(language) == ENGLISH, F.lit(False))
    route = F.when(english, F.lit(ENGLISH)).otherwise(F.lit("*"))
    fold = F.coalesce(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(folds)), F.lit(0))
    if dict(comments.dtypes)[key] in ("bigint", "int"):  # numbers are dealt by themselves
        fold = F.coalesce(F.pmod(F.col(key), F.lit(folds)), F.lit(0))
    words = F.array_distinct(word_tokens(F.col(text)))
    narrow = comments.select(
        F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("mark"), route.alias("route"), fold.cast("int").alias("fold"),
        F.coalesce(words, F.array().cast("array<string>")).alias("words"),
    )
    truth = labels.select(F.col(key).alias("key"), F.col("label").cast("int").alias("label")).where("label is not null").distinct()
    table, priors = count_weights(narrow.join(truth, "key"), folds)
    table, priors = materialize(table, "count-weights"), materialize(priors, "count-priors")
    size = table.agg(F.coalesce(F.sum(F.octet_length("token") + 48), F.lit(0))).first()[0]  # a row: its token and numbers
    table = F.broadcast(table) if size <= MAX_BROADCAST_BYTES else table
    # The empty word counts the rows that share key and text: their sums are divided by it.
    hits = narrow.select("key", "mark", "route", "fold", F.explode(F.concat("words", F.array(F.lit("")))).alias("token"))
    sums = hits.join(table, ["route", "fold", "token"], "left").groupBy("key", "mark", "route").agg(
        F.count_if(F.col("token") == "").alias("rows"), *[F.sum(f"w_{k}").alias(f"s_{k}") for k in range(3)]
    )
    even = _thousandths(F.lit(1.0) / 3)
    totals = [
        (F.coalesce((F.col(f"s_{k}") / F.col("rows")).cast("long"), F.lit(0)) + F.coalesce(f"prior_{k}", even)).alias(f"__total_{k}")
        for k in range(3)
    ]
    names = comments.columns
    scored = (
        comments.withColumns({"__route": route, "__fold": fold.cast("int"), "__mark": F.xxhash64(F.col(text))})
        .join(sums.withColumnsRenamed({"key": "__key", "mark": "__m", "route": "__r"}),
              F.col(key).eqNullSafe(F.col("__key")) & (F.col("__mark") == F.col("__m")) & (F.col("__route") == F.col("__r")),
              "left")
        .join(F.broadcast(priors.withColumnsRenamed({"route": "__p", "fold": "__f"})),
              (F.col("__route") == F.col("__p")) & (F.col("__fold") == F.col("__f")), "left")
        .select(*names, *totals)
    )
    each = [F.col(f"__total_{k}") for k in range(3)]
    best = F.greatest(*each)
    place = F.when(each[0] == best, F.lit(0)).when(each[1] == best, F.lit(1)).otherwise(F.lit(2))
    share = sum((F.exp((t - best).cast("double") / SCALE) for t in each), F.lit(0.0))
    return scored.select(
        *names, F.element_at(F.array(*map(F.lit, NAMES)), place + 1).alias(RAW), (1.0 / share).alias(SCORE),
        (place - 1).cast("int").alias(LABEL),
    )
