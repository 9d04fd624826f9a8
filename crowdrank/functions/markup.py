"""X1 + X2: markup removal that follows the elements of a page.

A text is cut into tokens by one regular expression that knows quoted
attribute values, comments, CDATA sections and the code of scripts and styles.
The text tokens stay; those inside an ``<a>`` element go with it.  What is
inside is told by the stack of open elements: a start tag opens one, an end tag
closes the innermost of its name and all that was opened since (it does nothing
when none is open).  So a nested ``<a>`` ends with its own ``</a>``, and an
``<a>`` that is never closed ends with the element around it, or with the page.

Malformed markup, with the result:

* ``>`` in a quoted attribute value does not end the tag;
* a tag, quoted value, comment, CDATA section or script that is never closed
  takes the rest of the page (a CDATA section leaves it as text);
* ``<`` before anything but a letter, ``/``, ``!`` or ``?`` is text;
* ``</`` before anything but a letter, ``<!`` and ``<?`` run up to the next ``>``;
* an end tag whose element is not open goes and closes nothing;
* ``<a/>`` and void elements (``<br>``) hold nothing.

All of it is native: a scan with state (``aggregate``) over the token array,
in stretches of ``STRETCH`` tokens, so that the text gathered so far is not
copied at every token.  A text without an ``<a>`` needs no stack and is one
replacement.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crowdrank.functions.patterns import WS

STRETCH = 64
#: Elements without an end tag: fixed values (HTML standard).
VOID_ELEMENTS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
)
LINK = "a"

# Inside a tag, after its name: anything but ">" and "=", or "=" and a value.
# Possessive, so that a quote that is never closed is not read as anything else.
_INSIDE = rf"""(?:[^>=]++|=[{WS}]*+(?:"[^"]*+"|'[^']*+'|[^"'>{WS}][^>{WS}]*+|(?=>)))*+"""
_TAG = rf"</?[a-zA-Z]{_INSIDE}>"
_CODE = "|".join(
    rf"(?i:<{name}(?=[>/{WS}]){_INSIDE}>)(?s:.*?)(?:(?i:</{name}(?=[>/{WS}])){_INSIDE}>|\z)"
    for name in ("script", "style")
)
_COMMENT = r"<!--(?:-?>|(?s:.*?)(?:--!?>|\z))"
_CDATA = r"<!\[CDATA\[(?s:.*?)(?:\]\]>|\z)"
_BOGUS = r"<(?:[!?]|/[^a-zA-Z])[^>]*+(?:>|\z)|</>"
_UNFINISHED = r"<[a-zA-Z/](?s:.*)\z"
_TEXT = r"[^<]++|<"
NOT_TEXT = "|".join((_CODE, _COMMENT, "</>", _BOGUS, _TAG, _UNFINISHED))
TOKEN = "|".join((_CDATA, NOT_TEXT, _TEXT))

_OPENS = rf"^<([a-zA-Z][^>/{WS}]*)"
_CLOSES = rf"^</([a-zA-Z][^>/{WS}]*)"


def _is_text(token: Column) -> Column:
    return ~token.startswith("<") | (token == "<") | token.startswith("<![CDATA[")


def _shown(token: Column) -> Column:
    """The text of a text token."""
    return F.when(
        token.startswith("<![CDATA["), F.regexp_replace(token, r"^<!\[CDATA\[|\]\]>$", "")
    ).otherwise(token)


def _opened(token: Column) -> Column:
    """The element that a token opens for what follows; '' if none."""
    name = F.lower(F.regexp_extract(token, _OPENS, 1))
    holds_nothing = name.isin(*VOID_ELEMENTS, "script", "style") | token.endswith("/>")
    return F.when(holds_nothing, F.lit("")).otherwise(name)


def _closed(token: Column) -> Column:
    return F.lower(F.regexp_extract(token, _CLOSES, 1))


def _parse(tokens: Column) -> Column:
    """Tokens as (text, opens, closes), each '' where it is something else.
    Only elements that some end tag closes, and links, count as opened: the
    others never close anything around them."""
    none = F.lit("")

    def closing(ts: Column) -> Column:
        return F.array_distinct(F.transform(F.filter(ts, lambda t: t.startswith("</")), _closed))

    def parse(t: Column, closes: Column) -> Column:
        name = F.when(_is_text(t), none).otherwise(_opened(t))
        return F.struct(
            F.when(_is_text(t), _shown(t)).otherwise(none).alias("text"),
            F.when((name == LINK) | F.array_contains(closes, name), name).otherwise(none).alias("opens"),
            F.when(_is_text(t), none).otherwise(_closed(t)).alias("closes"),
        )

    # Lambda variables hold the tokens and the names: found once for all tokens.
    both = F.array(F.struct(tokens.alias("ts"), closing(tokens).alias("names")))
    return F.transform(both, lambda b: F.transform(b["ts"], lambda t: parse(t, b["names"])))[0]


def _after(elements: Column, token: Column) -> Column:
    """The stack (innermost first) after a token."""
    at = F.array_position(elements, token["closes"]).cast("int")
    return (
        F.when(token["opens"] != "", F.concat(F.array(token["opens"]), elements))
        .when((token["closes"] != "") & (at > 0), F.slice(elements, at + 1, F.size(elements)))
        .otherwise(elements)
    )


def _outside_links(tokens: Column) -> Column:
    """The text of tokens that no link element is open around."""
    def scan(state: Column, token: Column) -> Column:
        inside = F.array_contains(state["elements"], LINK)
        return F.struct(
            _after(state["elements"], token).alias("elements"),
            F.when((token["text"] != "") & ~inside, F.concat(state["text"], token["text"]))
            .otherwise(state["text"]).alias("text"),
        )

    def stretch(state: Column, part: Column) -> Column:
        start = F.struct(state["elements"].alias("elements"), F.lit("").alias("text"))
        return F.aggregate(part, start, scan, lambda end: F.struct(
            end["elements"].alias("elements"), F.concat(state["texts"], F.array(end["text"])).alias("texts")
        ))

    def whole(parsed: Column) -> Column:
        last = F.floor((F.size(parsed) - 1) / STRETCH).cast("int")
        parts = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(parsed, k * STRETCH + 1, STRETCH))
        none = F.array().cast("array<string>")
        start = F.struct(none.alias("elements"), none.alias("texts"))
        return F.aggregate(parts, start, stretch, lambda end: F.array_join(end["texts"], ""))

    # As a lambda's variable the tokens are found once, not once per stretch.
    return F.transform(F.array(_parse(tokens)), whole)[0]


def strip_elements(text: Column) -> Column:
    """Markup removal; a text without ``<`` is returned as it is."""
    tokens = F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(0))
    has_link = text.rlike(rf"(?i)<{LINK}[>/{WS}]")
    sections = F.array_join(F.transform(_parse(tokens), lambda t: t["text"]), "")
    return (
        F.when(~text.contains("<"), text)
        .when(has_link, _outside_links(tokens))
        .when(text.contains("<![CDATA["), sections)
        .otherwise(F.regexp_replace(text, f"({NOT_TEXT})", ""))
    )
