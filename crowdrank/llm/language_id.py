"""Language identification by rank-order n-gram profiles.

Training counts the character 1- to 3-grams of all texts of a language (one
distributed count) and keeps its ``profile_size`` most frequent, ranked.  A
document's own most frequent n-grams are ranked likewise; its distance to a
language is the sum, over its n-grams, of how far each is out of place there
(``profile_size`` if the language's profile lacks it).  The language at the
smallest distance wins; ties go to the smaller name.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crowdrank.llm.common import lean_batches, materialise, narrow

PROFILE_SIZE = 300
UNDETERMINED = "und"
MAX_PROFILE_ROWS = 300_000  # driver-side bound: 1,000 languages of 300 n-grams
_SYMBOL_BITS = 21


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point → its lower-case letter's code point + 1; 1 (a gap) for all else."""
    table = np.ones(0x110000, dtype=np.int64)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            table[cp] = (ord(low) if len(low) == 1 else cp) + 1
    return table


def ngram_codes(text: str | None) -> np.ndarray:
    """Codes of the 1- to 3-grams of the letters of a whole text, runs of
    anything else being one gap; without letters, empty."""
    if not text:
        return np.zeros(0, np.int64)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = np.empty(len(points) + 2, np.int64)
    symbols[0] = symbols[-1] = 1
    symbols[1:-1] = _letters()[points]
    gap = symbols == 1
    keep = np.ones(len(symbols), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    s = symbols[keep]
    if len(s) < 3:
        return np.zeros(0, np.int64)
    two = s[:-1] | s[1:] << _SYMBOL_BITS
    three = two[:-1] | s[2:] << 2 * _SYMBOL_BITS
    return np.concatenate([s[s != 1], two, three])


def _merge(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, where = np.unique(np.concatenate(codes), return_inverse=True)
    return code, np.bincount(where, np.concatenate(counts), len(code)).astype(np.int64)


def train_profiles(
    labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", profile_size: int = PROFILE_SIZE
) -> DataFrame:
    """(lang, code, rank): rank 0 is a language's most frequent n-gram; equal
    counts rank by code.  Rows with a NULL language or a NULL text are left
    out; a language without a letter in any text has no profile."""
    rows = narrow(labelled, lang=lang_col, text=text_col).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull()
    )

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[list, list]] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                code, times = np.unique(ngram_codes(text), return_counts=True)
                codes, counts = held.setdefault(lang, ([], []))
                codes.append(code)
                counts.append(times)
                if len(codes) >= 256:
                    merged = _merge(codes, counts)
                    held[lang] = ([merged[0]], [merged[1]])
        for lang, (codes, counts) in held.items():
            code, times = _merge(codes, counts)
            yield pd.DataFrame({"lang": lang, "code": code, "n": times})

    counted = rows.mapInPandas(count, "lang string, code long, n long")
    best = Window.partitionBy("lang").orderBy(F.desc("n"), F.asc("code"))
    return (
        counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))
        .withColumn("rank", F.row_number().over(best) - 1)
        .where(F.col("rank") < profile_size)
        .select("lang", "code", "rank")
    )


def collect_profiles(profiles: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, sorted codes, ranks[language, code]; -1 where absent), after
    a check that the profiles are few enough for the driver."""
    kept = materialise(profiles, "language-profiles")
    rows = kept.count()
    if rows > MAX_PROFILE_ROWS:
        raise ValueError(f"{rows} profile rows; at most {MAX_PROFILE_ROWS} fit the driver")
    got = kept.toPandas()
    languages = sorted(got["lang"].unique())
    codes = np.unique(got["code"].to_numpy(np.int64))
    ranks = np.full((len(languages), len(codes)), -1, np.int64)
    for k, lang in enumerate(languages):
        own = got[got["lang"] == lang]
        ranks[k, np.searchsorted(codes, own["code"].to_numpy(np.int64))] = own["rank"]
    return languages, codes, ranks


def out_of_place(
    text: str | None, codes: np.ndarray, ranks: np.ndarray, profile_size: int = PROFILE_SIZE
) -> tuple[np.ndarray, int] | None:
    """(distance to each language, largest possible distance), or None for a
    text without letters."""
    found = ngram_codes(text)
    if not len(found):
        return None
    code, times = np.unique(found, return_counts=True)
    code = code[np.argsort(-times, kind="stable")[:profile_size]]
    own = np.arange(len(code))
    at = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
    known = codes[at] == code if len(codes) else np.zeros(len(code), bool)
    theirs = ranks[:, at] if len(codes) else np.full((len(ranks), len(code)), -1)
    apart = np.where(known & (theirs >= 0), np.abs(theirs - own), profile_size)
    return apart.sum(axis=1), profile_size * len(code)


def identify(
    docs: DataFrame,
    profiles: tuple[list[str], np.ndarray, np.ndarray],
    text_col: str = "text",
    profile_size: int = PROFILE_SIZE,
    result_col: str = "language_id",
) -> DataFrame:
    """``docs`` with a struct column ``result_col`` of (lang_pred, score); the
    score is 1 - distance / largest possible distance, from 0 to 1.

    A text that is NULL or without letters is ``und`` with score 0, and so is
    every text when no language has a profile.  All columns and rows stay; an
    existing column named ``result_col`` is replaced.
    """
    from pyspark.sql.functions import pandas_udf

    languages, codes, ranks = profiles
    lean_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((codes, ranks))

    @pandas_udf("lang_pred string, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codes, ranks = shared.value
        for batch in batches:
            out = []
            for text in batch:
                got = out_of_place(text, codes, ranks, profile_size) if languages else None
                if got is None:
                    out.append((UNDETERMINED, 0.0))
                else:
                    best = int(np.argmin(got[0]))
                    out.append((languages[best], 1.0 - float(got[0][best]) / got[1]))
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    return docs.withColumn(result_col, judge(docs[text_col]))
