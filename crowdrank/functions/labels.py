"""Label maps: model label text → {1, 0, −1} and → word.

Each map (a handful of entries) becomes a ``CASE`` on the lower-cased
label; unknown labels give 0 (scores) or NULL (words).  (A literal ``map``
would also work, but folded map literals do not compare equal, which keeps
Spark from reusing an exchange between two branches of one plan.)
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crowdrank.fixed_values import (
    SENTIMENT_MAP,
    SENTIMENT_MAP_SCORE,
    SENTIMENT_MAP_STARS,
    SENTIMENT_MAP_STARS_SCORE,
    UNKNOWN_LABEL_SCORE,
)

SCHEMES = {
    "sentiment": (SENTIMENT_MAP_SCORE, SENTIMENT_MAP),
    "stars": (SENTIMENT_MAP_STARS_SCORE, SENTIMENT_MAP_STARS),
}


def map_case(key: Column, mapping: dict, default=None) -> Column:
    """``CASE key WHEN k1 THEN v1 ... ELSE default END``."""
    items = list(mapping.items())
    if not items:
        return F.lit(default)
    out = F.when(key == F.lit(items[0][0]), F.lit(items[0][1]))
    for k, v in items[1:]:
        out = out.when(key == F.lit(k), F.lit(v))
    return out.otherwise(F.lit(default))


def label_score(label: Column, scheme: str = "sentiment") -> Column:
    """Canonical label in {1, 0, −1}; unknown or NULL label → 0."""
    scores, _ = SCHEMES[scheme]
    return map_case(F.lower(label), scores, UNKNOWN_LABEL_SCORE).cast("int")


def label_word(label: Column, scheme: str = "sentiment") -> Column:
    """positive / neutral / negative; NULL for unknown labels."""
    _, words = SCHEMES[scheme]
    return map_case(F.lower(label), words, None).cast("string")


def stars_label(stars: Column) -> Column:
    """'1 star' or 'N stars'."""
    return F.when(stars == 1, F.lit("1 star")).otherwise(
        F.concat(stars.cast("string"), F.lit(" stars"))
    )
