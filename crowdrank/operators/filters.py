"""Row filters: title exclusion words, minimum duration, missing text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdrank.fixed_values import EXCLUDE_WORDS, MIN_DURATION_SECONDS
from crowdrank.functions.patterns import quote_literal


def exclusion_pattern(words: Iterable[str]) -> str | None:
    """One whole-word alternation (Unicode word boundaries) for all words;
    double quotes are removed from the words first.  None when empty."""
    cleaned = [w.replace('"', "").lower() for w in words]
    cleaned = [w for w in cleaned if w]
    if not cleaned:
        return None
    return r"(?U)\b(?:" + "|".join(quote_literal(w) for w in cleaned) + r")\b"


def is_performance_title(title: Column, words: Iterable[str] = EXCLUDE_WORDS) -> Column:
    """True when the lower-cased title has none of the words (NULL title → '')."""
    pattern = exclusion_pattern(words)
    if pattern is None:
        return F.lit(True)
    return ~F.lower(F.coalesce(title, F.lit(""))).rlike(pattern)


def filter_titles(df: DataFrame, words: Iterable[str] = EXCLUDE_WORDS, title: str = "title") -> DataFrame:
    return df.filter(is_performance_title(F.col(title), words))


def filter_min_duration(
    df: DataFrame, min_seconds: int | None = MIN_DURATION_SECONDS, seconds: str = "duration_seconds"
) -> DataFrame:
    """Keep rows at or above the minimum; None or 0 switches the filter off."""
    if not min_seconds:
        return df
    return df.filter(F.col(seconds) >= F.lit(int(min_seconds)))


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Fail at analysis time when a needed column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing required column(s): {', '.join(missing)}")
    return df


def drop_missing_text(df: DataFrame, col: str = "clean_text") -> DataFrame:
    return require_columns(df, col).dropna(subset=[col])
