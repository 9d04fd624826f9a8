"""Independent DuckDB SQL for every registered query with an exact oracle.

Written from the semantics, not from the Spark code: the same tables, the
same column names, floats rounded to 6 places.  Nothing is imported from the
library: patterns, word lists and lexicons are written out here again, so a
wrong one shows as a mismatch.
"""

from __future__ import annotations

import html.entities

# White space as Python's str.isspace sees it.
WS = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

# B1 comments: one scored comment per lineitem row.
_B1 = """
  SELECT l_partkey AS video_id,
         CAST(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 0 WHEN 'R' THEN -1 END AS INTEGER)
           AS sentiment_label,
         CAST(1 - l_discount AS DOUBLE) AS sentiment_score,
         CAST(l_quantity AS BIGINT) AS like_count,
         CAST(1 AS DOUBLE) AS relevance_score
  FROM lineitem
"""


def _scores_sql(comments: str, total: str = "sentiment_score", digits: int | None = 6, keys: str = "video_id") -> str:
    """video_scores over a comments relation (SQL text), grouped by ``keys``."""

    def r(x: str) -> str:
        return f"(round({x}, {digits}) + 0.0)" if digits is not None else x

    return f"""
  WITH c AS ({comments}),
  g AS (
    SELECT {keys},
           coalesce(sum({total}), 0) AS score_sum,
           avg(relevance_score) AS rel,
           stddev_samp(sentiment_score) AS score_std,
           abs(coalesce(sum(sentiment_label * sentiment_score * like_count)
               FILTER (WHERE sentiment_label = 1), 0)) AS pos,
           abs(coalesce(sum(sentiment_label * sentiment_score * like_count)
               FILTER (WHERE sentiment_label = -1), 0)) AS neg,
           count(*) AS n
    FROM c WHERE video_id IS NOT NULL GROUP BY {keys})
  SELECT {keys},
         {r("CAST(score_sum * rel AS DOUBLE)")} AS total_score,
         {r("CAST(rel AS DOUBLE)")} AS relevance_score,
         {r("CAST(score_std * sqrt(rel) AS DOUBLE)")} AS std_deviation,
         {r('''CAST(n / (n + 5.0) * CASE WHEN pos + neg = 0 THEN 0
                ELSE 4 * (pos / (pos + neg)) * (neg / (pos + neg)) END * sqrt(rel) AS DOUBLE)''')}
           AS polarization_score_with_pseudo_count
  FROM g
"""


def _recommendation_sql(scores: str) -> str:
    """Five-column recommendation over a video_scores relation."""
    return f"""
  WITH s AS ({scores}),
  best AS (
    SELECT video_id, total_score FROM s WHERE total_score IS NOT NULL
    ORDER BY round(total_score, 9) DESC, video_id LIMIT 1),
  top3 AS (
    SELECT *, row_number() OVER (ORDER BY round(polarization_score_with_pseudo_count, 9) DESC, video_id) AS rk
    FROM s WHERE polarization_score_with_pseudo_count IS NOT NULL
    ORDER BY rk LIMIT 3),
  pol AS (
    SELECT * FROM top3 WHERE polarization_score_with_pseudo_count * total_score > 0
    ORDER BY round(polarization_score_with_pseudo_count * total_score, 9) DESC, rk LIMIT 1)
  SELECT (SELECT video_id FROM best) AS best_video_id,
         (SELECT total_score FROM best) AS best_score,
         (SELECT video_id FROM pol) AS most_polarized_video_id,
         (SELECT polarization_score_with_pseudo_count FROM pol) AS most_polarized_polarization_score,
         (SELECT std_deviation FROM pol) AS most_polarized_std_deviation
"""


def r6(x: str) -> str:
    """Round to the output digits; ``+ 0.0`` turns -0.0 into 0.0."""
    return f"(round({x}, 6) + 0.0)"


_B1_SCORES_FULL = _scores_sql(_B1, digits=None)

ORACLE: dict[str, str] = {
    "item_scores": _scores_sql(_B1),
    "item_scores_signed": _scores_sql(_B1, total="sentiment_label * sentiment_score"),
    "item_scores_like_weighted": _scores_sql(
        _B1, total="sentiment_label * sentiment_score * like_count"
    ),
    "best_item": f"""
  SELECT video_id, {r6("total_score")} AS total_score FROM ({_B1_SCORES_FULL})
  WHERE total_score IS NOT NULL
  ORDER BY round(total_score, 9) DESC, video_id LIMIT 1
""",
    "top3_polarized": f"""
  SELECT video_id, {r6("total_score")} AS total_score, {r6("relevance_score")} AS relevance_score,
         {r6("std_deviation")} AS std_deviation,
         {r6("polarization_score_with_pseudo_count")} AS polarization_score_with_pseudo_count
  FROM ({_B1_SCORES_FULL}) WHERE polarization_score_with_pseudo_count IS NOT NULL
  ORDER BY round(polarization_score_with_pseudo_count, 9) DESC, video_id LIMIT 3
""",
    "recommendation": f"""
  SELECT best_video_id, {r6("best_score")} AS best_score, most_polarized_video_id,
         {r6("most_polarized_polarization_score")} AS most_polarized_polarization_score,
         {r6("most_polarized_std_deviation")} AS most_polarized_std_deviation,
         printf('%.2f', best_score) AS best_score_text,
         'https://www.youtube.com/watch?v=' || CAST(best_video_id AS VARCHAR) AS best_video_url,
         printf('%.2f', most_polarized_polarization_score) AS polarization_text,
         printf('%.2f', most_polarized_std_deviation) AS std_deviation_text,
         'https://www.youtube.com/watch?v=' || CAST(most_polarized_video_id AS VARCHAR)
           AS most_polarized_video_url
  FROM ({_recommendation_sql(_B1_SCORES_FULL)})
""",
    "recommendation_none_polarized": f"""
  SELECT best_video_id, {r6("best_score")} AS best_score, most_polarized_video_id,
         {r6("most_polarized_polarization_score")} AS most_polarized_polarization_score,
         {r6("most_polarized_std_deviation")} AS most_polarized_std_deviation
  FROM ({_recommendation_sql(_scores_sql(f"SELECT * FROM ({_B1}) WHERE sentiment_label = 0", digits=None))})
""",
}


def _relevance_sql(title: str, query_literal: str) -> str:
    split = f"'[{WS}.]+'"
    q = f"list_distinct(string_split_regex(lower({query_literal}), {split}))"
    t = f"list_distinct(string_split_regex(lower(coalesce({title}, '')), {split}))"
    return f"CAST(len(list_filter({q}, lambda x: x <> '' AND list_contains({t}, x))) AS DOUBLE) / len({q})"


_B1_NO_REL = """
  SELECT l_partkey AS video_id,
         CAST(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 0 WHEN 'R' THEN -1 END AS INTEGER)
           AS sentiment_label,
         CAST(1 - l_discount AS DOUBLE) AS sentiment_score,
         CAST(l_quantity AS BIGINT) AS like_count
  FROM lineitem
"""

_TITLE_WORDS_RE = r"'\b(?:bolt|ring|hot plate)\b'"

# B4 durations computed from the numbers the ISO text was made of.
_DURATIONS = """
  SELECT p_partkey AS video_id, p_name AS title,
         CASE WHEN p_partkey % 13 = 0 THEN 'P1DT' || p_size || 'H'
              ELSE 'PT' || (p_partkey % 3) || 'H' || p_size || 'M' || (p_partkey % 60) || 'S' END AS iso_duration,
         CASE WHEN p_partkey % 13 = 0 THEN '00:00:00'
              ELSE printf('%02d:%02d:%02d', p_partkey % 3, p_size, p_partkey % 60) END AS duration,
         CAST(CASE WHEN p_partkey % 13 = 0 THEN 0
              ELSE (p_partkey % 3) * 3600 + p_size * 60 + p_partkey % 60 END AS BIGINT) AS duration_seconds
  FROM part
"""

_LI_COLS = ("l_orderkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, "
            "l_tax, l_returnflag, l_linestatus, l_shipdate")

_M2 = """CAST(CASE lower({0}) WHEN 'very positive' THEN 1 WHEN 'positive' THEN 1 WHEN 'neutral' THEN 0
        WHEN 'negative' THEN -1 WHEN 'very negative' THEN -1 ELSE 0 END AS INTEGER)"""
_M3 = """CASE lower({0}) WHEN 'very positive' THEN 'positive' WHEN 'positive' THEN 'positive'
        WHEN 'neutral' THEN 'neutral' WHEN 'negative' THEN 'negative' WHEN 'very negative' THEN 'negative' END"""
_M4S = """CAST(CASE lower({0}) WHEN '5 stars' THEN 1 WHEN '4 stars' THEN 1 WHEN '3 stars' THEN 0
        WHEN '2 stars' THEN -1 WHEN '1 star' THEN -1 ELSE 0 END AS INTEGER)"""
_M4W = """CASE lower({0}) WHEN '5 stars' THEN 'positive' WHEN '4 stars' THEN 'positive' WHEN '3 stars' THEN 'neutral'
        WHEN '2 stars' THEN 'negative' WHEN '1 star' THEN 'negative' END"""

ORACLE.update({
    "item_scores_relevance": _scores_sql(f"""
      SELECT c.*, v.relevance_score FROM ({_B1_NO_REL}) c
      JOIN (SELECT p_partkey AS video_id, {_relevance_sql("p_name", "'red widget'")} AS relevance_score
            FROM part) v USING (video_id)
    """),
    "title_filter": f"""
  SELECT p_partkey AS video_id, p_name AS title FROM part
  WHERE NOT regexp_matches(lower(coalesce(p_name, '')), {_TITLE_WORDS_RE})
""",
    "title_relevance": f"""
  SELECT p_partkey AS video_id, p_name AS title,
         {r6(_relevance_sql("p_name", "'blue widget.'"))} AS relevance_score
  FROM part
""",
    "duration_parse": f"SELECT video_id, iso_duration, duration, duration_seconds FROM ({_DURATIONS})",
    "duration_filter": f"""
  SELECT video_id, duration, duration_seconds FROM ({_DURATIONS}) WHERE duration_seconds >= 65
""",
    "candidates_semi_join": f"""
  WITH listing AS (
    SELECT p_partkey AS video_id, p_name AS title,
           row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn
    FROM part),
  kept AS (
    SELECT video_id FROM listing
    WHERE rn <= 50 AND NOT regexp_matches(lower(coalesce(title, '')), {_TITLE_WORDS_RE}))
  SELECT video_id, title, duration, duration_seconds FROM ({_DURATIONS})
  WHERE video_id IN (SELECT video_id FROM kept) AND duration_seconds >= 65
""",
    "comments_per_item_capped": f"""
  SELECT l_orderkey, video_id, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
         l_tax, l_returnflag, l_linestatus, l_shipdate
  FROM (SELECT *, l_partkey AS video_id,
               row_number() OVER (PARTITION BY l_partkey ORDER BY {_LI_COLS}) AS rn
        FROM lineitem)
  WHERE rn <= 20
""",
    "items_with_comments": """
  WITH per AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey),
  v AS (SELECT coalesce(per.n, 0) AS n FROM part LEFT JOIN per ON per.l_partkey = part.p_partkey)
  SELECT count(*) AS n_videos, count(*) FILTER (WHERE n > 0) AS videos_with_comments,
         CAST(sum(n) AS BIGINT) AS n_comments
  FROM v
""",
    "sentiment_labels": f"""
  WITH l AS (
    SELECT doc_id, CASE WHEN toxic = 1 THEN 'Very Negative' WHEN quality = 1 THEN 'Positive'
                        ELSE 'Neutral' END AS original_sentiment_label
    FROM labels)
  SELECT d.doc_id, l.original_sentiment_label,
         {_M2.format("l.original_sentiment_label")} AS sentiment_label,
         {_M3.format("l.original_sentiment_label")} AS sentiment_word
  FROM documents d JOIN l ON l.doc_id = d.doc_id
""",
    "star_labels": f"""
  WITH s AS (
    SELECT l_orderkey, l_linenumber, l_partkey AS video_id,
           CASE WHEN CAST(ceil(l_quantity / 10) AS INTEGER) = 1 THEN '1 star'
                ELSE CAST(CAST(ceil(l_quantity / 10) AS INTEGER) AS VARCHAR) || ' stars' END
             AS original_sentiment_label
    FROM lineitem)
  SELECT *, {_M4S.format("original_sentiment_label")} AS sentiment_label,
         {_M4W.format("original_sentiment_label")} AS sentiment_word
  FROM s
""",
})


# --- text cleaning in DuckDB ---------------------------------------------------
# Entity decoding uses DuckDB's own list and map functions over the standard
# library's table of names.
_URL = rf"(?:https?://|www\.)[^{WS}]+"
_MARKUP = (
    r"(?s)<!--.*?-->",
    r"(?is)<script\b.*?</script>",
    r"(?is)<style\b.*?</style>",
    r"(?is)<a\b[^>]*>.*?</a>",
    r"(?s)</?[a-zA-Z!][^>]*>",
)
_NAMES = html.entities.html5
_BARE_NAMES = "|".join(sorted((name for name in _NAMES if name[-1] != ";"), key=len, reverse=True))


def _windows_1252(point: int) -> str:
    try:
        return bytes((point,)).decode("cp1252")
    except UnicodeDecodeError:
        return chr(point)


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_ENT_MAP = "MAP {" + ", ".join(f"{_lit(k)}: {_lit(v)}" for k, v in _NAMES.items()) + "}"
_CP_MAP = "MAP {" + ", ".join(f"{p}: {_lit(_windows_1252(p))}" for p in range(128, 160)) + "}"
_LEG = _lit(f"^(?:{_BARE_NAMES})")
_ENT_RE = _lit(f"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;|(?:{_BARE_NAMES}))")


def _cp_text(cp: str) -> str:
    return f"""(CASE WHEN {cp} IS NULL OR {cp} = 0 OR {cp} > 1114111 OR {cp} BETWEEN 55296 AND 57343 THEN '�'
      WHEN {cp} = 13 THEN chr(13)
      WHEN {cp} BETWEEN 128 AND 159 THEN {_CP_MAP}[CAST({cp} AS INTEGER)]
      WHEN {cp} BETWEEN 1 AND 8 OR {cp} = 11 OR {cp} BETWEEN 14 AND 31 OR {cp} = 127
           OR {cp} BETWEEN 64976 AND 65007 OR {cp} % 65536 >= 65534 THEN ''
      ELSE chr(CAST({cp} AS INTEGER)) END)"""


def _ref_text(e: str) -> str:
    hex_digits = f"ltrim(regexp_replace(substr({e}, 3), ';$', ''), '0')"
    dec_digits = f"ltrim(regexp_replace(substr({e}, 2), ';$', ''), '0')"
    hex_cp = (f"(CASE WHEN length({hex_digits}) <= 8 THEN TRY_CAST('0x' || "
              f"CASE WHEN {hex_digits} = '' THEN '0' ELSE {hex_digits} END AS BIGINT) END)")
    dec_cp = (f"(CASE WHEN length({dec_digits}) <= 10 THEN TRY_CAST("
              f"CASE WHEN {dec_digits} = '' THEN '0' ELSE {dec_digits} END AS BIGINT) END)")
    prefix = f"regexp_extract({e}, {_LEG}, 0)"
    return f"""(CASE WHEN {e} ILIKE '#x%' THEN {_cp_text(hex_cp)}
      WHEN {e} LIKE '#%' THEN {_cp_text(dec_cp)}
      ELSE coalesce({_ENT_MAP}[{e}],
                    CASE WHEN {prefix} <> '' THEN {_ENT_MAP}[{prefix}] || substr({e}, length({prefix}) + 1) END,
                    '&' || {e}) END)"""


def _decode_steps(src: str, col: str, out: str, keep: str) -> tuple[str, str]:
    """Two CTE bodies that decode ``col`` of relation ``src`` into ``out``."""
    a = f"""SELECT {keep}, {col},
        string_split_regex({col}, {_ENT_RE}) AS _pieces,
        list_transform(regexp_extract_all({col}, {_ENT_RE}, 1), lambda e: {_ref_text('e')}) AS _refs
      FROM {src}"""
    b = f"""SELECT {keep},
        CASE WHEN {col} IS NULL THEN NULL WHEN NOT contains({col}, '&') THEN {col}
             ELSE array_to_string(list_transform(_pieces, lambda p, i: p || coalesce(_refs[i], '')), '') END AS {out}"""
    return a, b


def clean_text_sql(table: str, key: str, col: str, out: str = "clean_text", markup: tuple[str, ...] = _MARKUP) -> str:
    stripped = col
    for pattern in markup:
        stripped = f"regexp_replace({stripped}, {_lit(pattern)}, '', 'g')"
    d1a, d1b = _decode_steps("s0", "t0", "t1", key)
    d2a, d2b = _decode_steps("s2", "t2", "t3", key)
    return f"""
  WITH s0 AS (SELECT {key}, {stripped} AS t0 FROM {table}),
  s1a AS ({d1a}), s1 AS ({d1b} FROM s1a),
  s2 AS (SELECT {key}, regexp_replace(t1, {_lit(_URL)}, '', 'g') AS t2 FROM s1),
  s3a AS ({d2a}), s3 AS ({d2b} FROM s3a)
  SELECT {key}, regexp_replace(t3, {_lit(f"[{WS}]+")}, ' ', 'g') AS {out} FROM s3
"""


ORACLE.update({
    "clean_pages": clean_text_sql("pages", "page_id", "html"),
    "strip_urls_whitespace": f"""
  SELECT doc_id,
         regexp_replace(regexp_replace(text, {_lit(_URL)}, '', 'g'),
                        {_lit(f"[{WS}]+")}, ' ', 'g') AS text_stripped
  FROM documents
""",
})


# --- sentiment and language on documents -------------------------------------------
_STOP_LISTS = {
    "de": "der die und das von mit sich nicht ist ein eine für",
    "en": "the and of to is that it was for with this are",
    "es": "el la los las que del para con una por es y",
    "fr": "le la les et des une pour est qui dans avec pas",
}
_LEXICON_LISTS = {
    ("en", 1.0): "good great love beautiful bravo excellent this",
    ("en", 0.5): "with",
    ("en", -1.0): "not",
    ("en", -2.0): "trash scum clown idiot worthless moron pathetic loser disgusting stupid",
    ("*", 1.0): "bien bon merci magnifique pour gut schön danke mit bueno gracias hermoso para",
    ("*", 0.5): "avec für con",
    ("*", -1.0): "pas nicht no",
}

_TOKENS = r"string_split_regex(lower({0}), '[^\p{{L}}]+')"


def _values(rows: list[tuple], names: str) -> str:
    body = ", ".join("(" + ", ".join(_lit(x) if isinstance(x, str) else f"CAST({x!r} AS DOUBLE)" for x in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({names}))"


_LEXICON = _values(
    [(route, term, weight) for (route, weight), terms in _LEXICON_LISTS.items() for term in terms.split()],
    "route, term, weight",
)


def _lexicon_scored_sql(base: str) -> str:
    """Routed lexicon sentiment over ``base`` (video_id, comment_id,
    clean_text, language, like_count)."""
    return f"""
  WITH c AS (SELECT * FROM ({base}) WHERE clean_text IS NOT NULL),
  tok AS (
    SELECT comment_id, CASE WHEN language = 'en' THEN 'en' ELSE '*' END AS route,
           unnest({_TOKENS.format("clean_text")}) AS term
    FROM c),
  hits AS (
    SELECT comment_id, sum(weight) AS total, sum(abs(weight)) AS absw
    FROM tok JOIN {_LEXICON} lex ON lex.route = tok.route AND lex.term = tok.term
    GROUP BY comment_id),
  v AS (
    SELECT c.*, coalesce(h.total, 0) AS total, coalesce(h.absw, 0) AS absw
    FROM c LEFT JOIN hits h USING (comment_id))
  SELECT video_id, comment_id, language, like_count,
         CASE WHEN total > 0 THEN 'positive' WHEN total < 0 THEN 'negative' ELSE 'neutral' END
           AS original_sentiment_label,
         CAST(CASE WHEN absw > 0 THEN abs(total) / absw ELSE 0.5 END AS DOUBLE) AS sentiment_score,
         CAST(CASE WHEN total > 0 THEN 1 WHEN total < 0 THEN -1 ELSE 0 END AS INTEGER) AS sentiment_label,
         CAST(1 AS DOUBLE) AS relevance_score
  FROM v
"""


_DOC_SCORED = _lexicon_scored_sql("""
    SELECT source AS video_id, doc_id AS comment_id, text AS clean_text, lang AS language,
           doc_id % 10 AS like_count
    FROM documents""")

_STOPWORDS = _values([(lang, w) for lang, words in _STOP_LISTS.items() for w in words.split()], "lang, word")

ORACLE.update({
    "lexicon_sentiment": f"""
  SELECT video_id, comment_id, language, like_count, original_sentiment_label,
         {r6("sentiment_score")} AS sentiment_score, sentiment_label
  FROM ({_DOC_SCORED})
""",
    "source_scores": _scores_sql(_DOC_SCORED),
    "source_recommendation": f"""
  SELECT best_video_id, {r6("best_score")} AS best_score, most_polarized_video_id,
         {r6("most_polarized_polarization_score")} AS most_polarized_polarization_score,
         {r6("most_polarized_std_deviation")} AS most_polarized_std_deviation
  FROM ({_recommendation_sql(_scores_sql(_DOC_SCORED, digits=None))})
""",
    "language_stopwords": f"""
  WITH tok AS (SELECT doc_id, unnest({_TOKENS.format("text")}) AS w FROM documents),
  cnt AS (
    SELECT doc_id, sw.lang, count(*) AS n FROM tok JOIN {_STOPWORDS} sw ON sw.word = tok.w
    GROUP BY doc_id, sw.lang),
  best AS (
    SELECT doc_id, lang FROM cnt
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, lang) = 1)
  SELECT d.doc_id, coalesce(best.lang, 'unknown') AS language
  FROM documents d LEFT JOIN best USING (doc_id)
""",
})


# --- landed responses and stage files (the oracle is the table itself) -----------
ORACLE.update({
    "landed_json_roundtrip": """
  SELECT CAST(conv_id AS VARCHAR) AS video_id, CAST(turn // 100 AS BIGINT) AS page,
         CAST(row_number() OVER (PARTITION BY conv_id, turn // 100 ORDER BY turn) - 1 AS INTEGER) AS item_pos,
         CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS comment_id,
         role AS author, text, turn AS like_count
  FROM conversations
""",
    "landed_listing_roundtrip": f"""
  WITH listing AS (
    SELECT p_partkey AS video_id, p_name AS title,
           row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn
    FROM part),
  kept AS (
    SELECT video_id FROM listing
    WHERE NOT regexp_matches(lower(coalesce(title, '')), {_TITLE_WORDS_RE}))
  SELECT CAST(d.video_id AS VARCHAR) AS video_id, d.title, d.duration, d.duration_seconds,
         CAST(trunc(p.p_retailprice) AS BIGINT) AS view_count, CAST(p.p_size AS BIGINT) AS like_count
  FROM ({_DURATIONS}) d JOIN part p ON p.p_partkey = d.video_id
  WHERE d.video_id IN (SELECT video_id FROM kept) AND d.duration_seconds >= 65
""",
    "csv_roundtrip": "SELECT doc_id, text, lang, source, n_chars FROM documents",
})


# --- end to end ------------------------------------------------------------------


def _stopword_language_sql(rel: str, key: str, col: str) -> str:
    return f"""
  WITH tok AS (SELECT {key}, unnest({_TOKENS.format(col)}) AS w FROM ({rel})),
  cnt AS (
    SELECT {key}, sw.lang, count(*) AS n FROM tok JOIN {_STOPWORDS} sw ON sw.word = tok.w
    GROUP BY {key}, sw.lang),
  best AS (
    SELECT {key}, lang FROM cnt
    QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY n DESC, lang) = 1)
  SELECT r.{key}, CASE WHEN r.{col} IS NULL THEN 'unknown' ELSE coalesce(best.lang, 'unknown') END AS language
  FROM ({rel}) r LEFT JOIN best USING ({key})
"""


def _recommend_per_query_sql(scores: str, queries: str) -> str:
    p = "polarization_score_with_pseudo_count"
    return f"""
  WITH s AS ({scores}),
  best AS (
    SELECT query, video_id AS best_video_id, total_score AS best_score FROM s
    WHERE total_score IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(total_score, 9) DESC, video_id) = 1),
  top AS (
    SELECT *, row_number() OVER (PARTITION BY query ORDER BY round({p}, 9) DESC, video_id) AS rk
    FROM s WHERE {p} IS NOT NULL),
  pol AS (
    SELECT query, video_id AS most_polarized_video_id, {p} AS most_polarized_polarization_score,
           std_deviation AS most_polarized_std_deviation
    FROM top WHERE rk <= 3 AND {p} * total_score > 0
    QUALIFY row_number() OVER (PARTITION BY query ORDER BY round({p} * total_score, 9) DESC, rk) = 1)
  SELECT q.query, best_video_id, {r6("best_score")} AS best_score, most_polarized_video_id,
         {r6("most_polarized_polarization_score")} AS most_polarized_polarization_score,
         {r6("most_polarized_std_deviation")} AS most_polarized_std_deviation
  FROM ({queries}) q LEFT JOIN best USING (query) LEFT JOIN pol USING (query)
"""


_BRAND_COMMENTS = f"""
  WITH listing AS (
    SELECT p_brand AS query, p_partkey AS video_id, p_name AS title,
           row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn
    FROM part),
  kept AS (
    SELECT query, video_id FROM listing
    WHERE NOT regexp_matches(lower(coalesce(title, '')), {_TITLE_WORDS_RE})),
  vids AS (
    SELECT k.query, k.video_id FROM kept k JOIN ({_DURATIONS}) d USING (video_id)
    WHERE d.duration_seconds >= 65),
  com AS (
    SELECT l_partkey AS video_id,
           CAST(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 0 WHEN 'R' THEN -1 END AS INTEGER)
             AS sentiment_label,
           CAST(1 - l_discount AS DOUBLE) AS sentiment_score,
           CAST(l_quantity AS BIGINT) AS like_count
    FROM lineitem)
  SELECT v.query, com.video_id, com.sentiment_label, com.sentiment_score, com.like_count,
         CAST(1 AS DOUBLE) AS relevance_score
  FROM com JOIN vids v USING (video_id)
"""

_RELEVANT_COMMENTS = f"""
  WITH vids AS (
    SELECT split_part(p_name, ' ', 1) || ' widget' AS query, p_partkey AS video_id, p_name AS title
    FROM part JOIN ({_DURATIONS}) d ON d.video_id = part.p_partkey
    WHERE d.duration_seconds >= 65 AND NOT regexp_matches(lower(coalesce(p_name, '')), {_TITLE_WORDS_RE}))
  SELECT v.query, c.*, {_relevance_sql("v.title", "v.query")} AS relevance_score
  FROM ({_B1_NO_REL}) c JOIN vids v USING (video_id)
"""

_CLEAN_DOCS = clean_text_sql("documents", "doc_id", "text")
_TEXT_BASE = f"""
    SELECT d.source AS video_id, d.doc_id AS comment_id, cl.clean_text, lg.language, d.doc_id % 10 AS like_count
    FROM documents d JOIN ({_CLEAN_DOCS}) cl USING (doc_id)
    JOIN ({_stopword_language_sql(_CLEAN_DOCS, "doc_id", "clean_text")}) lg USING (doc_id)
"""

ORACLE.update({
    "ranking_by_brand": _recommend_per_query_sql(
        _scores_sql(_BRAND_COMMENTS, digits=None, keys="query, video_id"),
        "SELECT DISTINCT p_brand AS query FROM part",
    ),
    "ranking_by_relevance": _recommend_per_query_sql(
        _scores_sql(_RELEVANT_COMMENTS, digits=None, keys="query, video_id"),
        "SELECT DISTINCT split_part(p_name, ' ', 1) || ' widget' AS query FROM part",
    ),
    "text_ranking": f"""
  SELECT best_video_id, {r6("best_score")} AS best_score, most_polarized_video_id,
         {r6("most_polarized_polarization_score")} AS most_polarized_polarization_score,
         {r6("most_polarized_std_deviation")} AS most_polarized_std_deviation,
         printf('%.2f', best_score) AS best_score_text,
         'https://www.youtube.com/watch?v=' || CAST(best_video_id AS VARCHAR) AS best_video_url,
         printf('%.2f', most_polarized_polarization_score) AS polarization_text,
         printf('%.2f', most_polarized_std_deviation) AS std_deviation_text,
         'https://www.youtube.com/watch?v=' || CAST(most_polarized_video_id AS VARCHAR)
           AS most_polarized_video_url
  FROM ({_recommendation_sql(_scores_sql(_lexicon_scored_sql(_TEXT_BASE), digits=None))})
""",
})


def _balance_scored_sql(rel: str) -> str:
    """The two plug-in scorers in SQL: '!' against '?' in English, ',' against
    '.' elsewhere; a text without letters is an error row."""
    mark = lambda m: f"(length(clean_text) - length(replace(clean_text, '{m}', '')))"
    return f"""
  SELECT video_id, comment_id, language, like_count,
         CASE WHEN NOT letters THEN 'Error' WHEN ups > downs THEN 'Positive'
              WHEN downs > ups THEN 'Negative' ELSE 'Neutral' END AS original_sentiment_label,
         CASE WHEN NOT letters THEN 0.0 WHEN ups = downs THEN 0.5
              ELSE abs(ups - downs) / CAST(ups + downs AS DOUBLE) END AS sentiment_score,
         CAST(CASE WHEN NOT letters THEN NULL ELSE sign(ups - downs) END AS INTEGER) AS sentiment_label
  FROM (SELECT *, regexp_matches(clean_text, '\\p{{L}}') AS letters,
               CASE WHEN english THEN {mark("!")} ELSE {mark(",")} END AS ups,
               CASE WHEN english THEN {mark("?")} ELSE {mark(".")} END AS downs
        FROM ({rel}))
"""


ORACLE["plugin_sentiment"] = f"""
  SELECT video_id, comment_id, language, like_count, original_sentiment_label,
         {r6("sentiment_score")} AS sentiment_score, sentiment_label
  FROM ({_balance_scored_sql("SELECT source AS video_id, doc_id AS comment_id, text AS clean_text, lang AS language, doc_id % 10 AS like_count, true AS english FROM documents WHERE text IS NOT NULL")})
"""

_PART_COMMENTS = _TEXT_BASE.replace("d.source AS video_id", "CAST(d.doc_id % 200 + 1 AS VARCHAR) AS video_id")


def _brand_rows(scored: str) -> str:
    return f"""
  SELECT k.p_brand AS query, c.video_id, c.sentiment_label, c.sentiment_score, c.like_count,
         CAST(1 AS DOUBLE) AS relevance_score
  FROM ({scored}) c JOIN part k ON CAST(k.p_partkey AS VARCHAR) = c.video_id
  JOIN ({_DURATIONS}) d ON d.video_id = k.p_partkey
  WHERE d.duration_seconds >= 65 AND NOT regexp_matches(lower(coalesce(k.p_name, '')), {_TITLE_WORDS_RE})
"""


for _name, _scored in (
    ("ranking_from_sources", _balance_scored_sql(f"SELECT *, language = 'en' AS english FROM ({_PART_COMMENTS})")),
    ("ranking_from_sources_lexicon", _lexicon_scored_sql(_PART_COMMENTS)),
):
    ORACLE[_name] = _recommend_per_query_sql(
        _scores_sql(_brand_rows(_scored), digits=None, keys="query, video_id"),
        "SELECT DISTINCT p_brand AS query FROM part",
    )


# --- character trigram language profiles ---------------------------------------------
# Every overlapping trigram of ' ' + lower(text) with non-letter runs as one
# space + ' '.  A document is scored by the counts of the other half of the ids:
# mean over its known trigrams of ln((n + 1) / (N + V)).
ORACLE["language_ngram"] = """
  WITH d AS (
    SELECT doc_id, lang, coalesce(doc_id % 2, 0) AS half,
           ' ' || regexp_replace(lower(text), '[^\\p{L}]+', ' ', 'g') || ' ' AS norm
    FROM documents),
  pos AS (SELECT doc_id, lang, half, norm, unnest(generate_series(1, length(norm) - 2)) AS i FROM d),
  g AS (
    SELECT doc_id, lang, half, substring(norm, i, 3) AS gram, count(*) AS times FROM pos GROUP BY ALL),
  cnt AS (
    SELECT 1 - half AS half, lang, gram, sum(times) AS n FROM g WHERE lang IS NOT NULL GROUP BY ALL),
  tot AS (SELECT half, lang, sum(n) AS total FROM cnt GROUP BY ALL),
  voc AS (SELECT half, count(DISTINCT gram) AS v FROM cnt GROUP BY half),
  known AS (
    SELECT g.doc_id, g.half, g.gram, g.times FROM g
    WHERE EXISTS (SELECT 1 FROM cnt WHERE cnt.half = g.half AND cnt.gram = g.gram)),
  hits AS (SELECT doc_id, half, sum(times) AS hits FROM known GROUP BY ALL),
  gain AS (
    SELECT k.doc_id, c.lang, sum(k.times * ln(CAST(c.n + 1 AS DOUBLE))) AS s
    FROM known k JOIN cnt c ON c.half = k.half AND c.gram = k.gram GROUP BY ALL),
  scored AS (
    SELECT h.doc_id, t.lang,
           round(coalesce(gain.s, 0) / h.hits - ln(CAST(t.total + voc.v AS DOUBLE)), 9) AS score
    FROM hits h JOIN tot t ON t.half = h.half JOIN voc ON voc.half = h.half
    LEFT JOIN gain ON gain.doc_id = h.doc_id AND gain.lang = t.lang),
  best AS (
    SELECT doc_id, lang FROM scored
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) = 1)
  SELECT documents.doc_id, coalesce(best.lang, 'unknown') AS language
  FROM documents LEFT JOIN best ON best.doc_id = documents.doc_id
"""


# The join path of the lexicon scorer must give the regex path's result.
ORACLE["lexicon_sentiment_by_join"] = ORACLE["lexicon_sentiment"]


# --- search ---------------------------------------------------------------------------
# Every title's score for every query that shares a token with it, then the first
# 50: BM25 (k1 1.2, b 0.75) per token as whole thousandths, or one per token.
_CATALOG = """
  SELECT p_partkey AS video_id, p_partkey AS position,
         concat_ws(' ', p_name, p_type, p_brand) AS title FROM part
"""


def _search_sql(queries: str, bm25: bool, k: int = 50) -> str:
    split = f"'[{WS}.]+'"
    impact = """CAST(floor(1000 * ln(1 + ((SELECT n FROM size) - h.held + 0.5) / (h.held + 0.5)) * (c.times * 2.2
               / (c.times + 1.2 * (0.25::DOUBLE + 0.75::DOUBLE * c.len / (SELECT mean FROM size)))) + 0.5) AS BIGINT)"""
    return f"""
  WITH catalog AS ({_CATALOG}),
  words AS (SELECT video_id, unnest(list_filter(string_split_regex(lower(title), {split}), lambda x: x <> '')) AS token
            FROM catalog),
  counted AS (SELECT video_id, token, count(*) AS times, sum(count(*)) OVER (PARTITION BY video_id) AS len
              FROM words GROUP BY video_id, token),
  size AS (SELECT (SELECT count(*) FROM catalog) AS n, (SELECT count(*) FROM words)::DOUBLE / (SELECT count(*) FROM catalog) AS mean),
  held AS (SELECT token, count(*) AS held FROM counted GROUP BY token),
  postings AS (SELECT c.video_id, c.token, {impact if bm25 else "1::BIGINT"} AS impact FROM counted c JOIN held h USING (token)),
  asked AS (SELECT DISTINCT query FROM ({queries})),
  wanted AS (SELECT DISTINCT query, token FROM (
      SELECT query, unnest(string_split_regex(lower(query), {split})) AS token FROM asked) WHERE token <> ''),
  found AS (SELECT w.query, p.video_id, CAST(sum(p.impact) AS BIGINT) AS score FROM wanted w JOIN postings p USING (token) GROUP BY ALL)
  SELECT f.query, row_number() OVER (PARTITION BY f.query ORDER BY score DESC, c.position, f.video_id) - 1 AS position,
         f.video_id, c.title, f.score, round({_relevance_sql("c.title", "f.query")}, 6) AS relevance_score
  FROM found f JOIN catalog c USING (video_id)
  QUALIFY row_number() OVER (PARTITION BY f.query ORDER BY score DESC, c.position, f.video_id) <= {k}
"""


_NOUN_QUERIES = "SELECT DISTINCT split_part(p_name, ' ', 2) || ' ' || p_brand AS query FROM part"
_SEARCHED_COMMENTS = f"""
  WITH vids AS (
    SELECT s.query, s.video_id, d.title
    FROM ({_search_sql(_NOUN_QUERIES, bm25=False)}) s JOIN ({_DURATIONS}) d USING (video_id)
    WHERE d.duration_seconds >= 65 AND NOT regexp_matches(lower(s.title), {_TITLE_WORDS_RE}))
  SELECT v.query, c.*, {_relevance_sql("v.title", "v.query")} AS relevance_score
  FROM ({_B1_NO_REL}) c JOIN vids v USING (video_id)
"""

ORACLE.update({
    "search_listing": _search_sql("SELECT p_name || ' ' || p_brand AS query FROM part", bm25=True),
    "ranking_from_search": _recommend_per_query_sql(
        _scores_sql(_SEARCHED_COMMENTS, digits=None, keys="query, video_id"), _NOUN_QUERIES
    ),
})


# --- named stages -----------------------------------------------------------------------
# The restarted flow's answer is that of the flow; its manifests hold the row
# counts of its stages, all but the last finished by the first run.
_KEPT_PARTS = f"""
  SELECT DISTINCT p_brand AS query, CAST(p_partkey AS VARCHAR) AS video_id
  FROM part JOIN ({_DURATIONS}) d ON d.video_id = part.p_partkey
  WHERE d.duration_seconds >= 65 AND NOT regexp_matches(lower(coalesce(p_name, '')), {_TITLE_WORDS_RE})
"""
_KEPT_COMMENTS = f"""
  SELECT video_id FROM (SELECT CAST(doc_id % 200 + 1 AS VARCHAR) AS video_id FROM documents WHERE text IS NOT NULL)
  WHERE video_id IN (SELECT video_id FROM ({_KEPT_PARTS}))
"""
ORACLE.update({
    "ranking_restarted": ORACLE["ranking_from_sources_lexicon"],
    "restarted_stages": f"""
  SELECT 'queries' AS stage, count(DISTINCT p_brand) AS rows, true AS reused FROM part
  UNION ALL SELECT 'videos', count(*), true FROM ({_KEPT_PARTS})
  UNION ALL SELECT 'comments', count(*), true FROM ({_KEPT_COMMENTS})
  UNION ALL SELECT 'comments_scored', count(*), true FROM ({_KEPT_COMMENTS})
  UNION ALL SELECT 'video_scores', count(*), false
  FROM ({_KEPT_PARTS}) WHERE video_id IN (SELECT video_id FROM ({_KEPT_COMMENTS}))
""",
})


# --- broken markup --------------------------------------------------------------------
# The stack of open elements, tag by tag, in a recursive query.
_BROKEN_PAGES = """
  SELECT page_id, CASE page_id % 8
    WHEN 0 THEN '<a>one<a>two</a>three</a>' || html
    WHEN 1 THEN '<div><a href=x>never closed</div>' || html
    WHEN 2 THEN '<p title="a>b" data-x=''c>d''>' || html
    WHEN 3 THEN html || '<!-- open ' || html
    WHEN 4 THEN html || '<a href="quote>' || html
    WHEN 5 THEN replace(html, '</a>', '')
    WHEN 6 THEN '<![CDATA[x < y]]>' || html || '</a></b><A/>1 < 2'
    ELSE replace(html, '<p>', '<p><a name=q>') END AS html
  FROM pages
"""
_IN_TAG = rf"""(?:[^>=]|=[{WS}]*(?:"[^"]*"|'[^']*'|[^"'>{WS}][^>{WS}]*))*(?:=[{WS}]*)?>"""
_HTML_TOKEN = "|".join((
    r"<!\[CDATA\[(?s:.*?)(?:\]\]>|\z)",
    *(rf"(?i:<{n})(?:[/{WS}]{_IN_TAG}|>)(?s:.*?)(?:(?i:</{n})(?:[/{WS}]{_IN_TAG}|>)|\z)" for n in ("script", "style")),
    r"<!--(?:-?>|(?s:.*?)(?:--!?>|\z))", "</>", r"<(?:[!?]|/[^a-zA-Z])[^>]*(?:>|\z)", rf"</?[a-zA-Z]{_IN_TAG}",
    r"<[a-zA-Z/](?s:.*)\z", "[^<]+", "<",
))
_VOID = "area base br col embed hr img input link meta param source track wbr script style"


def _outside_links_sql(pages: str) -> str:
    name = f"lower(regexp_extract(t, '^</?([a-zA-Z][^>/{WS}]*)', 1))"
    return f"""
  WITH RECURSIVE cut AS (SELECT page_id, regexp_extract_all(html, {_lit(f"({_HTML_TOKEN})")}) AS ts FROM ({pages})),
  tokens AS (SELECT page_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM cut),
  named AS (
    SELECT *, t[1] <> '<' OR t = '<' OR starts_with(t, '<![CDATA[') AS shown,
           CASE WHEN regexp_matches(t, '^<[a-zA-Z]') AND NOT ends_with(t, '/>')
                 AND NOT list_contains(string_split('{_VOID}', ' '), {name}) THEN {name} END AS opens,
           CASE WHEN regexp_matches(t, '^</[a-zA-Z]') THEN {name} END AS closes FROM tokens),
  tags AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS k
           FROM named WHERE NOT shown AND (opens IS NOT NULL OR closes IS NOT NULL)),
  walk(page_id, k, stack) AS (
    SELECT page_id, 0::BIGINT, []::VARCHAR[] FROM cut
    UNION ALL
    SELECT w.page_id, g.k, CASE WHEN g.opens IS NOT NULL THEN list_prepend(g.opens, w.stack)
           WHEN list_contains(w.stack, g.closes) THEN w.stack[list_position(w.stack, g.closes) + 1:] ELSE w.stack END
    FROM walk w JOIN tags g ON g.page_id = w.page_id AND g.k = w.k + 1),
  placed AS (
    SELECT n.*, count(*) FILTER (NOT shown AND (opens IS NOT NULL OR closes IS NOT NULL))
                OVER (PARTITION BY page_id ORDER BY i) AS k FROM named n)
  SELECT c.page_id, coalesce(x.html, '') AS html FROM cut c LEFT JOIN (
    SELECT p.page_id, string_agg(CASE WHEN starts_with(t, '<![CDATA[') THEN
             regexp_replace(regexp_replace(t, '^<!\\[CDATA\\[', ''), '\\]\\]>$', '') ELSE t END, '' ORDER BY i) AS html
    FROM placed p JOIN walk w ON w.page_id = p.page_id AND w.k = p.k
    WHERE p.shown AND NOT list_contains(w.stack, 'a') GROUP BY p.page_id) x USING (page_id)
"""


ORACLE["clean_broken_pages"] = clean_text_sql(f"({_outside_links_sql(_BROKEN_PAGES)})", "page_id", "html", markup=())


# --- phrases ------------------------------------------------------------------------------
# Hits of up to three tokens, the longest at each place; a fold takes them from
# the left and passes over those that begin inside the last one taken.
_PHRASE_LISTS = {
    ("en", 1.0): ["the the", "24 7"], ("en", -2.0): ["the the the"], ("en", -1.0): ["the and", "don t"],
    ("en", 2.0): ["the of"], ("en", 0.5): ["and the", "555"], ("en", 0.0): ["the"], ("en", -4.0): ["worthless scum"],
    ("*", 1.0): ["de la"], ("*", -2.0): ["de la des"], ("*", 2.0): ["la des"], ("*", -1.0): ["de de", "l eau"],
    ("*", 1.5): ["de de de"], ("*", 0.5): ["der die", "1"], ("*", -0.5): ["die der die"],
}
_PHRASES = _values(
    [(route, term, weight) for (route, weight), terms in _LEXICON_LISTS.items() for term in terms.split()]
    + [(route, term, weight) for (route, weight), terms in _PHRASE_LISTS.items() for term in terms],
    "route, term, weight",
)
_PHRASE_SCORED = f"""
  WITH words AS (
    SELECT doc_id, CASE WHEN lang = 'en' THEN 'en' ELSE '*' END AS route,
           regexp_extract_all(lower(text), '\\p{{L}}+|\\p{{N}}+') AS w FROM documents WHERE text IS NOT NULL),
  grams AS (
    SELECT doc_id, route, i, n, array_to_string(w[i:i + n - 1], ' ') AS term
    FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM words), (VALUES (1), (2), (3)) s(n) WHERE i + n - 1 <= len(w)),
  hits AS (
    SELECT doc_id, i, n, weight FROM grams JOIN {_PHRASES} lex USING (route, term)
    QUALIFY row_number() OVER (PARTITION BY doc_id, i ORDER BY n DESC) = 1),
  folded AS (
    SELECT doc_id, list_reduce(
        list_prepend({{'i': 0::BIGINT, 'free': 0::BIGINT, 'w': 0::DOUBLE, 'total': 0::DOUBLE, 'absw': 0::DOUBLE}},
                     list({{'i': i, 'free': (i + n)::BIGINT, 'w': weight, 'total': 0::DOUBLE, 'absw': 0::DOUBLE}} ORDER BY i)),
        lambda a, h: CASE WHEN h.i >= a.free THEN
            {{'i': h.i, 'free': h.free, 'w': h.w, 'total': a.total + h.w, 'absw': a.absw + abs(h.w)}} ELSE a END) AS s
    FROM hits GROUP BY doc_id),
  v AS (
    SELECT source AS video_id, doc_id AS comment_id, lang AS language, doc_id % 10 AS like_count,
           coalesce(s.total, 0) AS total, coalesce(s.absw, 0) AS absw
    FROM documents LEFT JOIN folded USING (doc_id) WHERE text IS NOT NULL)
  SELECT video_id, comment_id, language, like_count,
         CASE WHEN total > 0 THEN 'positive' WHEN total < 0 THEN 'negative' ELSE 'neutral' END AS original_sentiment_label,
         {r6("CASE WHEN absw > 0 THEN abs(total) / absw ELSE 0.5 END")} AS sentiment_score,
         CAST(sign(total) AS INTEGER) AS sentiment_label
  FROM v
"""
ORACLE.update({"lexicon_phrases": _PHRASE_SCORED, "lexicon_phrases_by_join": _PHRASE_SCORED})


# --- mergeable and stored scores --------------------------------------------------------------
ORACLE.update({
    "item_scores_merged": ORACLE["item_scores"],
    "stored_item_scores": ORACLE["item_scores"],
    "stored_scores_of_kept": _scores_sql(f"""
  SELECT * FROM ({_B1}) WHERE video_id IN (
    SELECT p_partkey FROM part JOIN ({_DURATIONS}) d ON d.video_id = part.p_partkey
    WHERE d.duration_seconds >= 65 AND NOT regexp_matches(lower(coalesce(p_name, '')), {_TITLE_WORDS_RE}))
"""),
})


# --- closed-form scorer, failing rows -----------------------------------------------------
_LABELLED = f"""
  SELECT doc_id, CASE WHEN toxic = 1 THEN 0 WHEN quality = 1 THEN 2 ELSE 1 END AS k FROM labels
"""
_COUNT_CLASS = "CAST(floor(1000 * ln((coalesce(n{k}, 0) + 1) / (d{k} + 2)) + 0.5) AS BIGINT) AS w{k}"
ORACLE.update({
    "trained_counts": f"""
  WITH docs AS (SELECT doc_id, source, CASE WHEN lang = 'en' THEN 'en' ELSE '*' END AS route, doc_id % 2 AS fold,
                       lang, text FROM documents WHERE text IS NOT NULL),
  tok AS (SELECT DISTINCT doc_id, route, fold, token FROM (
      SELECT doc_id, route, fold, unnest({_TOKENS.format("text")}) AS token FROM docs) WHERE token <> ''),
  sizes AS (SELECT route, 1 - fold AS fold, count(*) FILTER (k = 0) AS d0, count(*) FILTER (k = 1) AS d1,
                   count(*) FILTER (k = 2) AS d2 FROM docs JOIN ({_LABELLED}) USING (doc_id) GROUP BY route, fold),
  counts AS (SELECT route, 1 - fold AS fold, token, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1,
                    count(*) FILTER (k = 2) AS n2 FROM tok JOIN ({_LABELLED}) USING (doc_id) GROUP BY route, fold, token),
  weights AS (SELECT * FROM (SELECT route, fold, token, {", ".join(_COUNT_CLASS.format(k=k) for k in range(3))}
              FROM counts JOIN sizes USING (route, fold) WHERE n0 + n1 + n2 >= 3)
              WHERE greatest(w0, w1, w2) - least(w0, w1, w2) >= 500),
  sums AS (SELECT doc_id, sum(w0) AS s0, sum(w1) AS s1, sum(w2) AS s2 FROM tok JOIN weights USING (route, fold, token)
           GROUP BY doc_id),
  totals AS (
    SELECT d.*, {", ".join(f"coalesce(s{k}, 0) + CAST(floor(1000 * ln((d{k} + 1) / (d0 + d1 + d2 + 3)) + 0.5) AS BIGINT) AS t{k}" for k in range(3))}
    FROM docs d JOIN sizes USING (route, fold) LEFT JOIN sums USING (doc_id)),
  judged AS (SELECT *, greatest(t0, t1, t2) AS best FROM totals)
  SELECT source AS video_id, doc_id AS comment_id, lang AS language, doc_id % 10 AS like_count,
         CASE best WHEN t0 THEN 'negative' WHEN t1 THEN 'neutral' ELSE 'positive' END AS original_sentiment_label,
         {r6("1 / (exp((t0 - best) / 1000::DOUBLE) + exp((t1 - best) / 1000::DOUBLE) + exp((t2 - best) / 1000::DOUBLE))")} AS sentiment_score,
         CAST(CASE best WHEN t0 THEN -1 WHEN t1 THEN 0 ELSE 1 END AS INTEGER) AS sentiment_label
  FROM judged
""",
    "sentiment_errors": """
  WITH texts AS (
    SELECT CASE WHEN lang = 'en' THEN 'en' ELSE '*' END AS route,
           CASE WHEN doc_id % 7 = 0 THEN '123 !?' ELSE text END AS text FROM documents)
  SELECT r.route, count(t.route) FILTER (NOT regexp_matches(text, '\\p{L}')) AS errors,
         (SELECT count(*) FROM texts WHERE text IS NOT NULL) AS all_rows
  FROM (VALUES ('en'), ('*')) r(route) LEFT JOIN texts t ON t.route = r.route AND t.text IS NOT NULL GROUP BY r.route
""",
})


# --- ordered sink, missing texts, no candidates --------------------------------------------------
ORACLE.update({
    "ordered_sink": f"""
  SELECT row_number() OVER (ORDER BY video_id DESC) - 1 AS row_number, video_id, total_score FROM ({ORACLE["item_scores"]})
""",
    "missing_text_dropped": f"""
  SELECT sentiment_label, count(*) AS n FROM ({_DOC_SCORED}) WHERE comment_id % 5 <> 0 GROUP BY sentiment_label
""",
    "recommendation_of_nothing": """
  SELECT DISTINCT p_brand AS query, NULL::BIGINT AS best_video_id, NULL::DOUBLE AS best_score,
         NULL::BIGINT AS most_polarized_video_id, NULL::DOUBLE AS most_polarized_polarization_score,
         NULL::DOUBLE AS most_polarized_std_deviation FROM part
""",
})
