"""Lexicons of the registered sentiment queries (test fixtures, not part of
the library): the invented prose of ``documents`` has hardly any sentiment
words apart from the abusive words of toxic texts, so a few common words
are named positive and a negation word negative, to give every route a mix
of labels."""

from __future__ import annotations

ENGLISH_LEXICON: dict[str, float] = {
    "good": 1.0, "great": 1.0, "love": 1.0, "beautiful": 1.0, "bravo": 1.0, "excellent": 1.0,
    "this": 1.0, "with": 0.5,
    "not": -1.0,
    "trash": -2.0, "scum": -2.0, "clown": -2.0, "idiot": -2.0, "worthless": -2.0,
    "moron": -2.0, "pathetic": -2.0, "loser": -2.0, "disgusting": -2.0, "stupid": -2.0,
}

MULTILINGUAL_LEXICON: dict[str, float] = {
    "bien": 1.0, "bon": 1.0, "merci": 1.0, "magnifique": 1.0, "pour": 1.0, "avec": 0.5,
    "gut": 1.0, "schön": 1.0, "danke": 1.0, "mit": 1.0, "für": 0.5,
    "bueno": 1.0, "gracias": 1.0, "hermoso": 1.0, "para": 1.0, "con": 0.5,
    "pas": -1.0, "nicht": -1.0, "no": -1.0,
}

#: Terms of several tokens, over words of the documents: each overlaps a
#: shorter term or another phrase.
ENGLISH_PHRASES: dict[str, float] = {
    **ENGLISH_LEXICON, "the the": 1.0, "the the the": -2.0, "the and": -1.0, "the of": 2.0, "and the": 0.5, "the": 0.0,
    "don't": -1.0, "worthless scum": -4.0, "24/7": 1.0, "555": 0.5,
}
MULTILINGUAL_PHRASES: dict[str, float] = {
    **MULTILINGUAL_LEXICON, "de la": 1.0, "de la des": -2.0, "la des": 2.0, "de de": -1.0, "de de de": 1.5,
    "der die": 0.5, "die der die": -0.5, "l'eau": -1.0, "1": 0.5,
}
