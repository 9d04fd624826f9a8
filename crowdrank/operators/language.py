"""Language of a comment, as Spark expressions and jobs.

Two detectors, both deterministic (ties go to the smaller language code,
no evidence gives ``unknown``):

* ``stopword_language`` — count the tokens of each language's stop-word
  list, take the largest count.  One expression per row, no shuffle.
* ``train_ngram_profiles`` / ``ngram_languages`` — character trigram counts
  learned by a Spark job from texts with a known language, then every text
  is scored against them (naive Bayes with add-one smoothing).
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdrank.fixed_values import UNKNOWN_LANGUAGE
from crowdrank.functions.terms import count_tokens_in, normalized_tokens, token_words
from crowdrank.sources.files import materialize

# The functions below travel by value, so workers need not be able to import this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Stop words per language (this project's choice; extend freely).
STOPWORDS: dict[str, tuple[str, ...]] = {
    "de": ("der", "die", "und", "das", "von", "mit", "sich", "nicht", "ist", "ein", "eine", "für"),
    "en": ("the", "and", "of", "to", "is", "that", "it", "was", "for", "with", "this", "are"),
    "es": ("el", "la", "los", "las", "que", "del", "para", "con", "una", "por", "es", "y"),
    "fr": ("le", "la", "les", "et", "des", "une", "pour", "est", "qui", "dans", "avec", "pas"),
}


def _argmax_language(counts: Sequence[Column], codes: Sequence[str]) -> Column:
    """Code with the largest count; ties → earlier code; all zero → unknown."""
    best = F.greatest(*[F.struct(c.alias("n"), F.lit(-i).alias("neg_i")) for i, c in enumerate(counts)])
    index = -best["neg_i"] + 1
    return F.when(best["n"] > 0, F.element_at(F.array(*[F.lit(c) for c in codes]), index)).otherwise(
        F.lit(UNKNOWN_LANGUAGE)
    )


def stopword_language(text: Column, stopwords: Mapping[str, Sequence[str]] = STOPWORDS) -> Column:
    """Language code from stop-word token counts over the whole text (one
    regular-expression pass per language).  As a column expression the
    token normalisation may run once per language; on a DataFrame prefer
    ``with_language``, which stages it as a column."""
    return language_of_tokens(normalized_tokens(text), text.isNull(), stopwords)


def language_of_tokens(
    normalized: Column, is_null: Column, stopwords: Mapping[str, Sequence[str]] = STOPWORDS
) -> Column:
    """``stopword_language`` over a ``normalized_tokens`` column."""
    codes = sorted(stopwords)
    counts = [count_tokens_in(normalized, stopwords[c]) for c in codes]
    return F.when(is_null, F.lit(UNKNOWN_LANGUAGE)).otherwise(_argmax_language(counts, codes))


def _stopword_lookup(stopwords: Mapping[str, Sequence[str]]) -> Callable[[Column], Column]:
    """The same language, all lists looked up in one count of the text's tokens."""
    lists = [(code, token_words(stopwords[code])) for code in sorted(stopwords)]

    @F.pandas_udf("string")
    def look_up(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            counts = Counter((text or "").split())
            best, language = 0, UNKNOWN_LANGUAGE
            for code, words in lists:
                n = sum(counts[w] for w in words)
                if n > best:
                    best, language = n, code
            out.append(language)
        return pd.Series(out, dtype=object)

    return look_up


def with_language(
    df: DataFrame, src: str = "clean_text", out: str = "language", stopwords: Mapping[str, Sequence[str]] = STOPWORDS,
    by_lookup: bool = False,
) -> DataFrame:
    """Add the detected language; the normalised tokens are staged as
    their own column, as every language's count reads them.  ``by_lookup``
    counts the tokens once per row in Arrow batches, with the same result: for
    whole tables, where a regular expression per language costs more."""
    tmp = f"__{out}_tokens"
    tokens = F.col(tmp)
    found = _stopword_lookup(stopwords)(tokens) if by_lookup else language_of_tokens(tokens, F.col(src).isNull(), stopwords)
    return df.withColumn(tmp, normalized_tokens(F.col(src))).withColumn(out, found).drop(tmp)


# --- character trigram profiles -------------------------------------------------

NGRAM = 3
MAX_PROFILE_BYTES = 32 * 1024 * 1024  # largest table of counts sent to every executor
SCORE_DIGITS = 9  # scores that differ less are ties
PIECE_CHARS = 1 << 20  # characters whose n-grams are counted at once
DENSE_GRAMS = 1 << 22  # largest table with a place for every n-gram of a piece's characters
HELD_COUNTS = 200_000  # counts that a task holds before it passes them on


def gram_text(text: Column) -> Column:
    """The lower-cased text with runs of non-letters turned into one space,
    padded with a space on both sides."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "), F.lit(" "))


def char_ngrams(padded: Column, n: int = NGRAM) -> Column:
    """Every overlapping character n-gram of a ``gram_text`` column."""
    # A look-ahead group yields every overlapping n-gram in one pass.
    return F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{n}}}))"), 1)


def _pieces(texts: Iterable[str | None]) -> Iterator[list[tuple[int, str]]]:
    """(number of the text, part) lists of about ``PIECE_CHARS`` characters.
    Long texts are cut into parts that overlap by n - 1, so that each n-gram of
    each text lies in exactly one part."""
    piece, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text or "") - NGRAM + 1, PIECE_CHARS):
            piece.append((i, text[at:at + PIECE_CHARS + NGRAM - 1]))
            size += len(piece[-1][1])
            if size >= PIECE_CHARS:
                yield piece
                piece, size = [], 0
    if piece:
        yield piece


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def _piece_grams(piece: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, n-gram number) of every n-gram in the piece, and the
    characters: a gram's number has their places as its digits."""
    numbers, parts = zip(*piece)
    points = _code_points("".join(parts))
    seen = np.zeros(points.max() + 1, bool)
    seen[points] = True
    alphabet = np.flatnonzero(seen)
    place = np.zeros(len(seen), np.int64)
    place[alphabet] = np.arange(len(alphabet))
    digits = place[points]
    of_part = np.repeat(np.arange(len(parts)), [len(part) for part in parts])
    whole = of_part[:1 - NGRAM] == of_part[NGRAM - 1:]
    grams = np.zeros(len(whole), np.int64)
    for i in range(NGRAM):
        grams = grams * len(alphabet) + digits[i:i + len(whole)]
    return np.asarray(numbers)[of_part[:1 - NGRAM][whole]], grams[whole], alphabet


def _gram_counts(texts: Iterable[str | None]) -> Iterator[tuple[str, int]]:
    """(gram, count) over all texts; a gram comes once per piece."""
    for piece in _pieces(texts):
        _, grams, alphabet = _piece_grams(piece)
        if len(alphabet) ** NGRAM <= DENSE_GRAMS:
            counts = np.bincount(grams)
            found = np.flatnonzero(counts)
            counts = counts[found]
        else:
            found, counts = np.unique(grams, return_counts=True)
        digits = [found // len(alphabet) ** i % len(alphabet) for i in reversed(range(NGRAM))]
        letters = alphabet[np.stack(digits, axis=1)].astype("<u4").tobytes().decode("utf-32-le")
        for i, n in enumerate(counts.tolist()):
            yield letters[i * NGRAM:(i + 1) * NGRAM], n


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[tuple[str, str]] = Counter()

    def passed_on() -> pa.RecordBatch:
        langs, grams = zip(*held) if held else ((), ())
        columns = [pa.array(langs, pa.string()), pa.array(grams, pa.string()), pa.array(held.values(), pa.int64())]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n"])

    for batch in batches:
        by_lang: dict[str, list[str | None]] = {}
        for lang, padded in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by_lang.setdefault(lang, []).append(padded)
        for lang, texts in by_lang.items():
            for gram, n in _gram_counts(texts):
                held[lang, gram] += n
                if len(held) >= HELD_COUNTS:
                    yield passed_on()
    yield passed_on()


def train_ngram_profiles(labelled: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n): how often each n-gram occurs in each language's texts.

    No gram is cut off.  Each task counts its texts' n-grams in Arrow batches
    before the shuffle, so a language with most of the texts sends one row per
    gram and task; no row is made for a single occurrence.
    """
    texts = labelled.filter(F.col(lang).isNotNull()).select(
        F.col(lang).alias("lang"), gram_text(F.col(text)).alias("padded")
    )
    counts = texts.mapInArrow(_count_batches, "lang string, gram string, n long")
    return counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def ngram_languages(
    df: DataFrame, key: str, text: str, profiles: DataFrame, max_profile_bytes: int = MAX_PROFILE_BYTES
) -> DataFrame:
    """(key, language) for every row of ``df``: the language with the highest
    mean log-share ``ln((n + 1) / (N + V))`` over the text's grams that some
    profile knows (n: the gram's count in the language, N: all counts of the
    language, V: distinct grams of all profiles).  Ties go to the smaller
    code; a text without a known gram, or NULL, is ``unknown``.

    The profiles are written once to the shared checkpoint folder.  Up to
    ``max_profile_bytes`` (grams x languages, counted first) they are
    broadcast and each text is counted and scored inside its row, without a
    shuffle; larger ones are joined.  The result is the same.
    """
    profiles = materialize(profiles, "ngram-profiles")
    size = profiles.agg(
        F.countDistinct("gram").alias("grams"), F.countDistinct("lang").alias("langs")
    ).first()
    if size["grams"] == 0:
        return df.select(F.col(key), F.lit(UNKNOWN_LANGUAGE).alias("language"))
    if size["grams"] * (size["langs"] + 16) * 8 <= max_profile_bytes:
        return _languages_by_lookup(df, key, text, profiles, size["grams"])
    return _languages_by_join(df, key, text, profiles, size["grams"])


def _known_slots(grams: np.ndarray, alphabet: np.ndarray, known: np.ndarray) -> np.ndarray:
    """For each n-gram of a piece its row in ``known`` (one row of characters
    per known gram), or ``len(known)`` where it is not known."""
    size = len(alphabet)
    place = np.full(max(alphabet[-1], known.max()) + 1, -1, np.int64)
    place[alphabet] = np.arange(size)
    digits = place[known]
    rows = np.flatnonzero((digits >= 0).all(axis=1))
    numbers = np.zeros(len(rows), np.int64)
    for i in range(NGRAM):
        numbers = numbers * size + digits[rows, i]
    if size ** NGRAM <= DENSE_GRAMS:
        slots = np.full(size ** NGRAM, len(known))
        slots[numbers] = rows
        return slots[grams]
    if not len(rows):
        return np.full(len(grams), len(known))
    order = np.argsort(numbers)
    at = np.minimum(np.searchsorted(numbers, grams, sorter=order), len(rows) - 1)
    return np.where(numbers[order][at] == grams, rows[order][at], len(known))


def _languages_by_lookup(df: DataFrame, key: str, text: str, profiles: DataFrame, vocabulary: int) -> DataFrame:
    counts = profiles.toPandas()  # bounded by the caller
    codes = sorted(counts["lang"].unique())
    totals = counts.groupby("lang")["n"].sum()
    log_totals = np.log([totals[c] + vocabulary for c in codes])
    gram_at, grams = pd.factorize(counts["gram"])
    gains = np.zeros((len(codes), len(grams) + 1))  # the last for grams that are not known
    gains[pd.Categorical(counts["lang"], codes).codes, gram_at] = np.log(counts["n"].to_numpy() + 1)
    known = _code_points("".join(grams)).reshape(-1, NGRAM)
    shared = df.sparkSession.sparkContext.broadcast((codes, log_totals, known, gains))

    def languages_of(texts: list[str | None]) -> np.ndarray:
        codes, log_totals, known, gains = shared.value
        hits, sums = np.zeros(len(texts)), np.zeros((len(codes), len(texts)))
        for piece in _pieces(texts):
            of_text, grams, alphabet = _piece_grams(piece)
            first = piece[0][0]  # a piece holds neighbours
            here, of_text = slice(first, piece[-1][0] + 1), of_text - first
            slots = _known_slots(grams, alphabet, known)
            hits[here] += np.bincount(of_text, slots < len(known))
            for i, gain in enumerate(gains):
                sums[i, here] += np.bincount(of_text, gain[slots])
        scores = np.round(sums / np.maximum(hits, 1) - log_totals[:, None], SCORE_DIGITS)
        return np.where(hits > 0, np.array(codes, object)[scores.argmax(axis=0)], UNKNOWN_LANGUAGE)

    @F.pandas_udf("string")
    def best_language(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for padded in batches:
            yield pd.Series(languages_of(padded.tolist()), dtype=object)

    return df.select(F.col(key), best_language(gram_text(F.col(text))).alias("language"))


def _languages_by_join(df: DataFrame, key: str, text: str, profiles: DataFrame, vocabulary: int) -> DataFrame:
    """Texts meet the profiles by gram.  A language without any gram of a
    text gains nothing, so of these only the one with the smallest total can
    win: it gets a row for every known gram, and the others need none.  Equal
    texts share a hash and a score (a mean, so copies do not matter)."""
    totals = profiles.groupBy("lang").agg(F.sum("n").alias("total"))
    least = totals.orderBy("total", "lang").first()["lang"]
    in_least = F.coalesce(F.max(F.when(F.col("lang") == least, F.col("n"))), F.lit(0))
    listed = profiles.filter(F.col("lang") != least).unionByName(
        profiles.groupBy("gram").agg(in_least.alias("n")).withColumn("lang", F.lit(least))
    )
    texts = df.select(F.col(key), gram_text(F.col(text)).alias("_padded")).withColumn(
        "_hash", F.sha2(F.col("_padded"), 256)
    )
    counted = (
        texts.select("_hash", F.explode(char_ngrams(F.col("_padded"))).alias("gram"))
        .groupBy("_hash", "gram").agg(F.count(F.lit(1)).alias("times"))
    )
    sums = (
        counted.join(listed, "gram")
        .groupBy("_hash", "lang")
        .agg(F.sum(F.col("times") * F.log(F.col("n") + 1)).alias("gain"), F.sum("times").alias("seen"))
        .join(totals, "lang")
    )
    hits = F.max(F.when(F.col("lang") == least, F.col("seen"))).over(Window.partitionBy("_hash"))
    score = F.round(F.col("gain") / hits - F.log(F.col("total") + vocabulary), SCORE_DIGITS)
    best = (
        sums.select("_hash", "lang", (-score).alias("loss"))
        .groupBy("_hash").agg(F.min(F.struct("loss", "lang"))["lang"].alias("language"))
    )
    found = texts.select(key, "_hash").join(best, "_hash", "left")
    return found.select(F.col(key), F.coalesce("language", F.lit(UNKNOWN_LANGUAGE)).alias("language"))
