"""Tokens, word counting and phrases.

A token is a maximal run of letters of the lower-cased text.  The text is
normalised once per row into its tokens separated by two spaces and framed
by one (``" the  cat "``); counting how many tokens belong to a word list
is then one regular-expression pass (`` (?:w1|w2|...) ``) that can only
start at a space — generated code, no per-token lambda, no explode, no
shuffle.  A list past ``MAX_REGEX_WORDS`` is counted in several passes.

Phrases are runs of tokens, where runs of digits are tokens as well
(``don't`` is ``don t``, ``24/7`` is ``24 7``).  They match leftmost first and
longest first, whatever stands between their tokens in the text, and a matched
token counts for one phrase only.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from crowdrank.functions.patterns import quote_literal

MAX_REGEX_WORDS = 2_000
TOKEN_SPLIT = r"[^\p{L}]+"   # letters only; digits and punctuation split


def word_tokens(text: Column) -> Column:
    """Lower-cased letter runs of a text, in order, empty pieces removed."""
    return F.array_remove(F.split(F.lower(text), TOKEN_SPLIT, -1), "")


def token_words(words: Iterable[str]) -> list[str]:
    """The distinct lower-cased words, longest first.  A word that is not one
    run of letters can never equal a token and is an error."""
    kept = {w.lower() for w in words}
    never = sorted(w for w in kept if not w.isalpha())
    if never:
        raise ValueError(f"not one run of letters, so never a token: {never}")
    return sorted(kept, key=lambda w: (-len(w), w))


def normalized_tokens(text: Column) -> Column:
    """`` tok1  tok2 `` — the lower-cased letter runs, two spaces apart,
    one space at each end (a text without letters gives ``"  "``)."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), TOKEN_SPLIT, "  "), F.lit(" "))


def whole_token_patterns(words: Iterable[str]) -> list[str]:
    """Patterns that together match each token of ``words`` once."""
    ws = token_words(words)
    parts = [ws[i:i + MAX_REGEX_WORDS] for i in range(0, len(ws), MAX_REGEX_WORDS)]
    return [" (?:" + "|".join(map(quote_literal, part)) + ") " for part in parts]


def count_tokens_in(normalized: Column, words: Iterable[str]) -> Column:
    """Number of tokens in ``words``, over a ``normalized_tokens`` column
    (0 for NULL)."""
    counts = [F.regexp_count(normalized, F.lit(p)) for p in whole_token_patterns(words)]
    total = F.lit(0)
    for count in counts:
        total = total + F.coalesce(count, F.lit(0))
    return total


# --- phrases -------------------------------------------------------------------------

Phrase = tuple[str, ...]
PHRASE_TOKEN = r"(\p{L}+|\p{N}+)"
_PHRASE_GAP = r"[^\p{L}\p{N}]+|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})"


def phrase_of(term: str) -> Phrase:
    """The tokens of a term: runs of letters and runs of digits."""
    out: list[str] = []
    kind = ""
    for ch in term.lower():
        now = unicodedata.category(ch)[0]
        if now in "LN":
            if now == kind:
                out[-1] += ch
            else:
                out.append(ch)
        kind = now
    return tuple(out)


def phrase_tokens(text: Column) -> Column:
    """The same tokens of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(PHRASE_TOKEN), F.lit(1))


def normalized_phrases(text: Column) -> Column:
    """`` tok1  tok2 `` with letter and digit runs as tokens."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), _PHRASE_GAP, "  "), F.lit(" "))


def _framed(phrases: Iterable[Phrase]) -> str:
    """Alternatives of phrases in normalised text, the longest first."""
    longest = sorted(phrases, key=lambda p: (-len(p), p))
    return " (?:" + "|".join(quote_literal("  ".join(p)) for p in longest) + ") "


def matched_phrases(normalized: Column, phrases: Iterable[Phrase]) -> Column:
    """The phrases found in a ``normalized_phrases`` column, each framed by
    bars (``| very  good || bad |``)."""
    found = F.regexp_extract_all(normalized, F.lit(f"({_framed(phrases)})"), F.lit(0))
    return F.concat(F.lit("|"), F.array_join(found, "||"), F.lit("|"))


def count_phrases_in(matched: Column, phrases: Iterable[Phrase]) -> Column:
    """How many of the matched phrases are in ``phrases`` (0 for NULL)."""
    return F.coalesce(F.regexp_count(matched, F.lit(rf"\|{_framed(phrases)}\|")), F.lit(0))


class PhraseTrie:
    """Token trie of phrases with their weights, for lists too long for one
    regular expression."""

    def __init__(self, weights: Mapping[Phrase, float]):
        self.root: dict = {}
        for phrase, weight in weights.items():
            node = self.root
            for token in phrase:
                node = node.setdefault(token, {})
            node[None] = weight

    def found(self, tokens: list[str]) -> Iterator[float]:
        """Weights of the leftmost-longest matches."""
        at = 0
        while at < len(tokens):
            node, end, weight = self.root, at + 1, None
            for k in range(at, len(tokens)):
                node = node.get(tokens[k])
                if node is None:
                    break
                if None in node:
                    end, weight = k + 1, node[None]
            if weight is not None:
                yield weight
            at = end
