"""Comment text cleaning as native column expressions (no Python per row).

``clean_text`` = strip markup (``<a>`` elements go with their content,
other tags leave their text, no separator) → decode entities → remove URLs
→ decode entities again → collapse whitespace runs to one space (no trim).

The markup step (``crowdrank.functions.markup``) follows the elements of a
page, broken markup included.

Entity decoding follows the HTML5 rules: every named reference of the
standard table (``html.entities.html5``, the 106 legacy names also without
``;``, and an unknown ``&name;`` whose start is a legacy name), decimal and
hex references with or without ``;``, the Windows-1252 fix-ups for
128–159, U+FFFD for NUL, surrogates and values past U+10FFFF, and nothing
for the non-characters and C0/C1 controls that the rules drop.
"""

from __future__ import annotations

import html.entities

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdrank.functions.markup import strip_elements
from crowdrank.functions.patterns import NON_WS_RUN, WS_CHANGED

URL_PATTERN = r"(?:https?://|www\.)" + NON_WS_RUN


def _entity_tables() -> tuple[dict[str, str], list[str], dict[int, str]]:
    """Named references and the 128–159 fix-ups, derived from the standard
    library (not written by hand)."""
    named = dict(html.entities.html5)
    legacy = sorted((k for k in named if not k.endswith(";")), key=lambda k: (-len(k), k))
    cp1252 = {}
    for cp in range(0x80, 0xA0):
        try:
            cp1252[cp] = bytes([cp]).decode("cp1252")
        except UnicodeDecodeError:
            cp1252[cp] = chr(cp)
    return named, legacy, cp1252


NAMED_ENTITIES, LEGACY_NAMES, CP1252_FIXUPS = _entity_tables()
LEGACY_ALTERNATION = "|".join(LEGACY_NAMES)
ENTITY_PATTERN = (
    "&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;|(?:" + LEGACY_ALTERNATION + "))"
)


def _sql_value(v: object) -> str:
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(int(v))


def _array_sql(values: list) -> str:
    return f"array({', '.join(_sql_value(v) for v in values)})"


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _table_sql(entries: dict[str, str]) -> str:
    return f"named_struct('n', {_array_sql(list(entries))}, 'v', {_array_sql(list(entries.values()))})"


def _named_tables_sql() -> tuple[str, str]:
    """Literal tables of the named references (arrays, not maps: folded map
    literals do not compare equal, which would keep Spark from reusing an
    exchange).  The full table is split by initial letter and indexed by the
    letter's position, so a lookup scans ≤ 168 names instead of 2,231; the
    106 legacy names (also valid without ';') get a small table of their own."""
    groups: dict[str, dict[str, str]] = {c: {} for c in LETTERS}
    for key, value in NAMED_ENTITIES.items():
        groups[key[0]][key] = value
    full = "array(" + ", ".join(_table_sql(groups[c]) for c in LETTERS) + ")"
    legacy = _table_sql({k: NAMED_ENTITIES[k] for k in LEGACY_NAMES})
    return full, legacy


NAMED_TABLE_SQL, LEGACY_TABLE_SQL = _named_tables_sql()
CP1252_SQL = _array_sql([CP1252_FIXUPS[cp] for cp in range(0x80, 0xA0)])


# The decoder is written once as SQL text and registered per session as a
# temporary SQL function: Spark inlines its body into the plan (native
# expressions, no Python), and building a plan costs one function call
# instead of assembling ~2,000 expression nodes from Python each time.
DECODE_FUNCTION = "crowdrank_decode_entities"
_MAX_LEN = 1 << 30


def _lookup_sql(table: str, name: str) -> str:
    return f"try_element_at(({table}).v, nullif(CAST(array_position(({table}).n, {name}) AS INT), 0))"


def _named_lookup_sql(name: str) -> str:
    """Value of a named reference; NULL when unknown (tables indexed by the
    initial letter)."""
    letter = f"nullif(instr({_sql_value(LETTERS)}, substring({name}, 1, 1)), 0)"
    return _lookup_sql(f"try_element_at({NAMED_TABLE_SQL}, {letter})", name)


def _codepoint_text_sql(cp: str) -> str:
    """Text of one numeric reference's code point under the HTML5 rules."""
    as_text = f"decode(unhex(lpad(hex({cp}), 8, '0')), 'UTF-32')"
    dropped = (
        f"{cp} BETWEEN 1 AND 8 OR {cp} = 11 OR {cp} BETWEEN 14 AND 31 OR {cp} = 127"
        f" OR {cp} BETWEEN 64976 AND 65007 OR {cp} % 65536 >= 65534"
    )
    return (
        f"CASE WHEN {cp} IS NULL OR {cp} = 0 OR {cp} > 1114111 OR {cp} BETWEEN 55296 AND 57343"
        f" THEN {_sql_value(chr(0xFFFD))}"
        f" WHEN {cp} = 13 THEN chr(13)"
        f" WHEN {cp} BETWEEN 128 AND 159 THEN try_element_at({CP1252_SQL}, CAST({cp} - 127 AS INT))"
        f" WHEN {dropped} THEN ''"
        f" ELSE {as_text} END"
    )


def _decode_sql(text: str) -> str:
    """SQL of one decoding pass over ``text``.  The references found are
    taken through three ``transform`` steps — (reference, hex?, digits) →
    (reference, code point) → text — so no step re-derives a value."""
    pattern = _sql_value(ENTITY_PATTERN)
    legacy_re = _sql_value("^(?:" + LEGACY_ALTERNATION + ")")
    r = "_ref"
    is_hex = f"(startswith({r}, '#x') OR startswith({r}, '#X'))"
    body = f"regexp_replace({r}, ';$', '')"
    digits = (
        f"regexp_replace(CASE WHEN {is_hex} THEN substring({body}, 3, {_MAX_LEN})"
        f" ELSE substring({body}, 2, {_MAX_LEN}) END, '^0+', '')"
    )
    step1 = f"transform(regexp_extract_all({text}, {pattern}, 1), {r} -> named_struct('r', {r}, 'h', {is_hex}, 'd', {digits}))"
    d = "_e.d"
    number = f"CASE WHEN {d} = '' THEN '0' ELSE {d} END"
    cp = (
        f"CASE WHEN _e.h THEN CASE WHEN length({d}) <= 8 THEN try_cast(conv({number}, 16, 10) AS BIGINT) END"
        f" WHEN startswith(_e.r, '#') THEN CASE WHEN length({d}) <= 10 THEN try_cast({number} AS BIGINT) END END"
    )
    step2 = f"transform({step1}, _e -> named_struct('r', _e.r, 'cp', {cp}))"
    n = "_c.r"
    prefix = f"regexp_extract({n}, {legacy_re}, 0)"
    by_name = (
        f"coalesce({_named_lookup_sql(n)},"
        f" CASE WHEN {prefix} != '' THEN concat({_lookup_sql(LEGACY_TABLE_SQL, prefix)},"
        f" substring({n}, length({prefix}) + 1, {_MAX_LEN})) END,"
        f" concat('&', {n}))"
    )
    step3 = f"transform({step2}, _c -> CASE WHEN startswith(_c.r, '#') THEN {_codepoint_text_sql('_c.cp')} ELSE {by_name} END)"
    glued = f"zip_with(split({text}, {pattern}, -1), concat({step3}, array('')), (_a, _b) -> concat(_a, _b))"
    # Skip the array work for the (usual) text without any '&'.
    return f"CASE WHEN contains({text}, '&') THEN array_join({glued}, '') ELSE {text} END"


def register_functions(spark: SparkSession) -> None:
    """Register this module's SQL functions in ``spark`` (once per session)."""
    if not spark.catalog.functionExists(DECODE_FUNCTION):
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {DECODE_FUNCTION}(t STRING) "
            f"RETURNS STRING RETURN {_decode_sql('t')}"
        )


def decode_entities(text: Column, spark: SparkSession | None = None) -> Column:
    """One pass of HTML character-reference decoding, left to right.  The
    SQL function is registered in ``spark`` (default: the active session)."""
    session = spark or SparkSession.getActiveSession()
    if session is None:
        raise RuntimeError("no active Spark session to register the decoder in")
    register_functions(session)
    return F.call_function(DECODE_FUNCTION, text)


def strip_urls(text: Column) -> Column:
    """Remove ``http://``, ``https://`` (lower case only) and ``www.`` runs;
    a text with neither ``http`` nor ``www.`` is returned as it is."""
    return F.when(
        text.contains("http") | text.contains("www."), F.regexp_replace(text, URL_PATTERN, "")
    ).otherwise(text)


def collapse_whitespace(text: Column) -> Column:
    """Each run of whitespace (Python's definition) → one space; no trim."""
    return F.regexp_replace(text, WS_CHANGED, " ")


def with_clean_text(df: DataFrame, src: str = "text", out: str = "clean_text") -> DataFrame:
    """Add ``out`` = the whole cleaning chain applied to ``src`` (NULL
    exactly when ``src`` is NULL).

    Each step is its own column: decoding reads its input several times
    (split, extract, the no-'&' shortcut), and Catalyst does not inline an
    expensive expression into a consumer that reads it more than once, so
    the markup chain runs once per row instead of four times.
    """
    tmp = [f"__{out}_{i}" for i in range(4)]
    spark = df.sparkSession
    return (
        df.withColumn(tmp[0], strip_elements(F.col(src)))
        .withColumn(tmp[1], decode_entities(F.col(tmp[0]), spark))
        .withColumn(tmp[2], strip_urls(F.col(tmp[1])))
        .withColumn(tmp[3], decode_entities(F.col(tmp[2]), spark))
        .withColumn(out, collapse_whitespace(F.col(tmp[3])))
        .drop(*tmp)
    )


def truncate_chars(text: Column, n: int) -> Column:
    """First ``n`` characters (code points).  Opt-in, for plug-in scorers
    whose model has an input limit; built-in scorers read whole texts."""
    return F.substring(text, 1, n)
