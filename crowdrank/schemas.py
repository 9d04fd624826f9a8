"""Explicit schemas of every table in the ranking flow (no inference)."""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()
L = T.LongType()
D = T.DoubleType()
I = T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields.items()])


# Landed source responses (one JSON document per response page).
SEARCH_ITEM = _struct(
    id=_struct(videoId=S),
    snippet=_struct(title=S),
)
SEARCH_RAW = _struct(query=S, page=L, items=T.ArrayType(SEARCH_ITEM))

VIDEO_ITEM = _struct(
    id=S,
    snippet=_struct(title=S),
    statistics=_struct(viewCount=S, likeCount=S, commentCount=S),
    contentDetails=_struct(duration=S),
)
VIDEOS_RAW = _struct(items=T.ArrayType(VIDEO_ITEM))

COMMENT_ITEM = _struct(
    snippet=_struct(
        topLevelComment=_struct(
            id=S,
            snippet=_struct(authorDisplayName=S, textDisplay=S, likeCount=S),
        )
    )
)
COMMENTS_RAW = _struct(video_id=S, page=L, items=T.ArrayType(COMMENT_ITEM))

# Flat tables.
VIDEOS = _struct(
    video_id=S,
    title=S,
    duration=S,
    duration_seconds=L,
    view_count=L,
    like_count=L,
    comment_count=L,
    relevance_score=D,
)

COMMENTS = _struct(
    video_id=S,
    comment_id=S,
    author=S,
    text=S,
    clean_text=S,
    language=S,
    like_count=L,
    relevance_score=D,
)

SENTIMENT_COLUMNS = _struct(
    sentiment_label=I,
    original_sentiment_label=S,
    sentiment_score=D,
)

COMMENTS_SCORED = T.StructType(COMMENTS.fields + SENTIMENT_COLUMNS.fields)

VIDEO_SCORES = _struct(
    video_id=S,
    total_score=D,
    relevance_score=D,
    std_deviation=D,
    polarization_score_with_pseudo_count=D,
)

RECOMMENDATION = _struct(
    best_video_id=S,
    best_score=D,
    most_polarized_video_id=S,
    most_polarized_polarization_score=D,
    most_polarized_std_deviation=D,
)

# Output of a plug-in scorer (one row per input text).
SCORER_OUTPUT = _struct(label=S, score=D)
