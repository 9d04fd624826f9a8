"""Title relevance: share of the query's distinct tokens found in the title.

Tokens come from splitting the lower-cased text on runs of whitespace and
``.``; commas and colons stay attached.  Both sides are token *sets*, and
the divisor counts the empty token that a leading/trailing separator (or an
empty query) produces, which therefore never matches.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crowdrank.functions.patterns import WS

SPLIT = f"[{WS}.]+"


def tokens(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(text), SPLIT, -1))


def title_relevance(title: Column, query: Column | str) -> Column:
    """Relevance in [0, 1] of ``title`` to ``query`` (a column or a string)."""
    q = tokens(F.lit(query) if isinstance(query, str) else query)
    t = tokens(F.coalesce(title, F.lit("")))
    hits = F.size(F.filter(F.array_intersect(q, t), lambda x: x != F.lit("")))
    return hits.cast("double") / F.size(q).cast("double")
