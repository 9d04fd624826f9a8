"""Fixed values.

Everything in this module must stay equal to the behaviour being matched
(word lists, label maps, default parameters, output formats).  The values
are written out plainly, in their natural order, and are not derived from
anything else.  Larger tables (HTML entities, code-page fix-ups) are built
by rule from the Python standard library in ``crowdrank.functions.text``.
"""

from __future__ import annotations

# --- FIXED VALUES: title exclusion words (whole-word, case-insensitive) ---
EXCLUDE_WORDS: tuple[str, ...] = (
    "tutorial",
    "analysis",
    "lesson",
    "fragment",
    "excerpt",
    "review",
    "preview",
    "shorts",
    "masterclass",
    "master class",
    "explanation",
    "guide",
    "demonstration",
    "practice",
    "explained",
    "walkthrough",
    "how to play",
    "how to perform",
    "how to improve",
    "how to learn",
)

# --- FIXED VALUES: sentiment label maps (keys are lower-case labels) ---
SENTIMENT_MAP: dict[str, str] = {
    "very positive": "positive",
    "positive": "positive",
    "neutral": "neutral",
    "negative": "negative",
    "very negative": "negative",
}

SENTIMENT_MAP_STARS: dict[str, str] = {
    "5 stars": "positive",
    "4 stars": "positive",
    "3 stars": "neutral",
    "2 stars": "negative",
    "1 star": "negative",
}

SENTIMENT_MAP_SCORE: dict[str, int] = {
    "very positive": 1,
    "positive": 1,
    "neutral": 0,
    "negative": -1,
    "very negative": -1,
}

SENTIMENT_MAP_STARS_SCORE: dict[str, int] = {
    "5 stars": 1,
    "4 stars": 1,
    "3 stars": 0,
    "2 stars": -1,
    "1 star": -1,
}

# An unknown label maps to this value.
UNKNOWN_LABEL_SCORE = 0

# --- FIXED VALUES: defaults of the ranking flow ---
NUM_CANDIDATES = 50          # listing entries kept per query, in source order
NUM_COMMENTS = 100           # comments kept per video, in source order
MIN_DURATION_SECONDS = 65    # shorter videos are dropped (the boundary stays)
PSEUDO_COUNT = 5.0           # polarization shrinkage n / (n + 5)
TOP_POLARIZED = 3            # candidates for the "most polarized" pick
MODEL_MAX_CHARS = 512        # input limit of the transformer models (opt-in)
DEFAULT_DURATION = "PT0S"    # duration when the details carry none
UNKNOWN_LANGUAGE = "unknown"  # language when nothing can be detected
ERROR_LABEL = "Error"        # raw label of a row whose scorer failed
MISSING_TEXT = "N/A"         # sentinel for missing values at the CSV sink
WATCH_URL_PREFIX = "https://www.youtube.com/watch?v="
DURATION_FORMAT = "%02d:%02d:%02d"
SCORE_FORMAT = "%.2f"
