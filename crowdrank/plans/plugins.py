"""Example plug-in scorers for the registered queries.

A plug-in is any ``pandas.Series[str] -> DataFrame(label, score)``
callable (e.g. a wrapper around a local model).  These need no model: they
label a text by the balance of two marks and raise on texts without any
letter, to exercise the error-row contract.
"""

from __future__ import annotations

import pandas as pd


def _balance(texts: pd.Series, good: str, bad: str) -> pd.DataFrame:
    if texts.map(lambda t: not any(ch.isalpha() for ch in t)).any():
        raise ValueError("text without letters")
    ups, downs = texts.str.count(good), texts.str.count(bad)
    total = (ups + downs).clip(lower=1)
    label = pd.Series("Neutral", index=texts.index)
    label[ups > downs] = "Positive"
    label[downs > ups] = "Negative"
    score = ((ups - downs).abs() / total).where(ups != downs, 0.5)
    return pd.DataFrame({"label": label.values, "score": score.astype(float).values})


def punctuation_scorer(texts: pd.Series) -> pd.DataFrame:
    """Exclamation marks against question marks."""
    return _balance(texts, "!", r"\?")


def pause_scorer(texts: pd.Series) -> pd.DataFrame:
    """Commas against full stops."""
    return _balance(texts, ",", r"\.")


def marks_model():
    """A set-up: loads what the scorer needs (here two marks) and returns it."""
    good, bad = "!", r"\?"
    return lambda texts: _balance(texts, good, bad)
