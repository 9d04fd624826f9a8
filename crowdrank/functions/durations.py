"""ISO-8601 video durations (``PT#H#M#S``) as text and seconds.

Prefix match only, like a ``re.match``: trailing text is ignored, the parts
must come in H, M, S order, a day part or anything else gives zero, and
there is no carry (``PT75M`` → ``00:75:00``).  Digits are ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crowdrank.fixed_values import DEFAULT_DURATION, DURATION_FORMAT

ISO_DURATION = r"^PT(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9]+)S)?"


def duration_parts(iso: Column) -> tuple[Column, Column, Column]:
    """(hours, minutes, seconds) as bigint, 0 where absent."""
    text = F.coalesce(iso, F.lit(DEFAULT_DURATION))

    def part(i: int) -> Column:
        raw = F.regexp_extract(text, ISO_DURATION, i)
        return F.coalesce(F.nullif(raw, F.lit("")).try_cast("bigint"), F.lit(0).cast("bigint"))

    return part(1), part(2), part(3)


def duration_hhmmss(iso: Column) -> Column:
    """``HH:MM:SS`` text (hours may have more than two digits)."""
    h, m, s = duration_parts(iso)
    return F.format_string(DURATION_FORMAT, h, m, s)


def duration_seconds(iso: Column) -> Column:
    h, m, s = duration_parts(iso)
    return h * 3600 + m * 60 + s


def hhmmss_seconds(hhmmss: Column) -> Column:
    """Seconds of an ``HH:MM:SS`` text."""
    parts = F.split(hhmmss, ":")
    return (
        parts.getItem(0).try_cast("bigint") * 3600
        + parts.getItem(1).try_cast("bigint") * 60
        + parts.getItem(2).try_cast("bigint")
    )
