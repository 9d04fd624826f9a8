"""Sentiment stage: comments → comments_scored.

Scorer contract (every scorer, built-in or plug-in): per text a raw label
(``original_sentiment_label``) and a confidence in [0, 1]
(``sentiment_score``); the canonical ``sentiment_label`` in {1, 0, −1} comes
from the label map (unknown label → 0).  A row whose scorer fails gets
label NULL, raw label ``Error`` and score 0.0, and the job goes on.

Routing: ``language == 'en'`` → the English scorer, everything else (other
languages, ``unknown``, NULL) → the multilingual one.

Scorers:

* ``LexiconScorer`` — tokens matched against a term → weight lexicon; label
  is the sign of the summed weight, confidence |Σw| / Σ|w|, no hit →
  neutral with a fixed confidence.  Native expression (one whole-token
  count per distinct weight); a mapping with many weights or terms is looked
  up token by token in one Arrow pass over the text; a lexicon given as a
  table goes through an explode → join → aggregate job.  Terms of several
  tokens ("not good", "don't") match leftmost first, longest first.
* ``TrainedScorer`` — Spark ML tokenizer → hashing TF → logistic
  regression, fitted on labelled comments.
* ``PluginScorer`` — any ``pandas.Series[str] -> DataFrame(label, score)``
  callable, run on the texts of its route in batches bounded by bytes; a
  model it needs is set up once per worker.

All scorers of a route table run over the same frame, and each row then takes
its route's result: no branch reads the source again, and no filter on a
computed language copies the cleaning into itself.

Every scorer reads the whole text; ``max_chars`` (off by default) exists for
plug-in models with an input limit.
"""

from __future__ import annotations

import hashlib
import sys
from collections import Counter
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from crowdrank.fixed_values import ERROR_LABEL
from crowdrank.functions.labels import label_score
from crowdrank.functions.terms import (
    MAX_REGEX_WORDS,
    Phrase,
    PhraseTrie,
    count_phrases_in,
    matched_phrases,
    normalized_phrases,
    normalized_tokens,
    phrase_of,
    phrase_tokens,
)
from crowdrank.operators.filters import drop_missing_text
from crowdrank.sources.files import materialize

ENGLISH = "en"
MAX_REGEX_WEIGHTS = 16  # distinct weights counted by regular expressions; more are looked up
RAW = "original_sentiment_label"
SCORE = "sentiment_score"
LABEL = "sentiment_label"


def _finish(df: DataFrame, scheme: str = "sentiment") -> DataFrame:
    """Canonical label from the raw one; error rows keep a NULL label."""
    canonical = F.when(F.col(RAW) == ERROR_LABEL, F.lit(None).cast("int")).otherwise(
        label_score(F.col(RAW), scheme)
    )
    return df.withColumn(LABEL, canonical)


# --- lexicon scorer ---------------------------------------------------------------


@dataclass(frozen=True)
class LexiconScorer:
    """Term → weight lexicon.  ``weights`` is a mapping; a lexicon too
    large for the driver is given as ``table`` (a DataFrame: term, weight;
    terms with equal tokens must have one weight, else the smallest
    counts) and scored by the join path, as is any lexicon with ``by_join=True``."""

    weights: Mapping[str, float]
    neutral_score: float = 0.5
    name: str = "lexicon"
    by_join: bool = False
    table: object = field(default=None, compare=False, repr=False)
    max_broadcast_bytes: int = 32 * 1024 * 1024

    def verdict(self, total: Column, absolute: Column) -> tuple[Column, Column]:
        """(raw label, confidence) from the two sums, which should be columns:
        each is read several times."""
        raw = (
            F.when(total > 0, F.lit("positive"))
            .when(total < 0, F.lit("negative"))
            .otherwise(F.lit("neutral"))
        )
        score = F.when(absolute > 0, F.abs(total) / absolute).otherwise(F.lit(float(self.neutral_score)))
        return raw, score

    def phrases(self) -> dict[Phrase, float]:
        """Token runs of the terms and their weights (a term listed twice
        keeps its last weight).  A term without any token is an error."""
        out = {phrase_of(term): float(weight) for term, weight in self.weights.items()}
        if () in out:
            empty = sorted(term for term in self.weights if not phrase_of(term))
            raise ValueError(f"terms without a letter or digit can never match: {empty}")
        return out

    def has_phrases(self) -> bool:
        """Whether a term is more than one run of letters."""
        return any(len(p) > 1 or not p[0].isalpha() for p in self.phrases())

    def by_weight(self) -> dict[float, list[Phrase]]:
        groups: dict[float, list[Phrase]] = {}
        for phrase, weight in sorted(self.phrases().items()):
            groups.setdefault(weight, []).append(phrase)
        return groups

    def uses_join(self) -> bool:
        return self.by_join or self.table is not None

    def normalized(self, text: Column) -> Column:
        """The text as ``sums`` reads it."""
        return normalized_phrases(text) if self.has_phrases() else normalized_tokens(text)

    def sums(self, normalized: Column) -> Column:
        """struct(total, absolute) over a column of ``normalized``, no
        shuffle and no key: one lookup per token, or, for a few phrases,
        one count per distinct weight.  Both give the same sums."""
        groups = self.by_weight()
        if len(groups) > MAX_REGEX_WEIGHTS or sum(map(len, groups.values())) > MAX_REGEX_WORDS or not self.has_phrases():
            return _lookup_sums(self.phrases())(normalized)
        return F.transform(
            F.array(matched_phrases(normalized, self.phrases())),  # found once, counted per weight
            lambda matched: _weighted(groups, lambda phrases: count_phrases_in(matched, phrases)),
        )[0]

    def lexicon_table(self, spark) -> DataFrame:
        """(term, weight): ``table`` as given, else the terms of ``weights``."""
        if self.table is not None:
            return self.table
        rows = [(" ".join(phrase), weight) for phrase, weight in self.phrases().items()]
        return spark.createDataFrame(rows, "term string, weight double")

    def score_by_join(
        self, df: DataFrame, key: str, text: str, lexicon: DataFrame | None = None
    ) -> DataFrame:
        """The same scores through a join (``join_sums``), for a lexicon too
        large to ship in the plan."""
        mine = self if lexicon is None else replace(self, table=lexicon)
        joined = join_sums(df, key, text, [(mine, F.lit(True))])
        raw, score = self.verdict(F.col(TOTAL), F.col(ABSOLUTE))
        return joined.select(*df.columns, raw.alias(RAW), score.alias(SCORE))


def _weighted(groups: Mapping[float, list[Phrase]], count: Callable[[list[Phrase]], Column]) -> Column:
    """struct(total, absolute) of counts by weight."""
    total = absolute = F.lit(0.0)
    for weight, phrases in sorted(groups.items()):
        if weight:
            n = count(phrases).cast("double")
            total, absolute = total + F.lit(weight) * n, absolute + F.lit(abs(weight)) * n
    return F.struct(total.alias("total"), absolute.alias("absolute"))


def _lookup_sums(weights: Mapping[Phrase, float]) -> Callable[[Column], Column]:
    """Summed and absolute weights of the phrases of a normalised text (weights
    are added in ascending order, as the native sums).  Single tokens are
    looked up in one count of the text's tokens, others found in a token trie."""
    single = {phrase[0]: weight for phrase, weight in weights.items()} if all(len(p) == 1 for p in weights) else None

    def tallied(text: str, trie: PhraseTrie | None) -> Counter:
        if trie is not None:
            return Counter(trie.found(text.split()))
        counts, found = Counter(text.split()), Counter()
        for token in single.keys() & counts.keys():
            found[single[token]] += counts[token]
        return found

    @F.pandas_udf("total double, absolute double")
    def look_up(texts: pd.Series) -> pd.DataFrame:
        trie = PhraseTrie(weights) if single is None else None
        out = []
        for text in texts:
            found = sorted(tallied(text or "", trie).items())
            out.append((sum(w * n for w, n in found), sum(abs(w) * n for w, n in found)))
        return pd.DataFrame(out, columns=["total", "absolute"]).astype("float64")

    return look_up


# --- lexicons by join ---------------------------------------------------------------

TOTAL, ABSOLUTE = "__total", "__absolute"


def _joint_lexicon(spark, scorers: list[LexiconScorer]) -> tuple[DataFrame, int]:
    """(_route, term, weight) of all routes, terms as their tokens with one
    space between, and the most tokens a term has.  Broadcast if its bytes stay
    within the smallest ``max_broadcast_bytes`` (measured)."""
    parts = []
    for k, scorer in enumerate(scorers):
        words = phrase_tokens(F.col("term"))
        parts.append(scorer.lexicon_table(spark).select(
            F.lit(k).alias("_route"), F.array_join(words, " ").alias("term"), F.size(words).alias("n"),
            F.col("weight").cast("double").alias("weight"),
        ))
    terms = reduce(DataFrame.unionByName, parts).where(F.col("term").isNotNull())
    terms = terms.groupBy("_route", "term", "n").agg(F.min("weight").alias("weight"))
    # A term's bytes, its weight and the row itself.
    size, longest, empty = terms.agg(
        F.coalesce(F.sum(F.octet_length("term") + 32), F.lit(0)), F.coalesce(F.max("n"), F.lit(1)), F.count_if(F.col("n") == 0)
    ).first()
    if empty:
        raise ValueError("terms without a letter or digit can never match")
    terms = terms.drop("n")
    if size <= min(s.max_broadcast_bytes for s in scorers):
        terms = F.broadcast(terms)
    return terms, longest


def join_sums(df: DataFrame, key: str, text: str, routes: list[tuple[LexiconScorer, Column]]) -> DataFrame:
    """``df`` with the sums of its route's lexicon (``__total``, ``__absolute``).

    The comments are written once with their text's hash and their route, so
    that whatever computed the text runs once.  Then (key, hash, route, n-gram)
    rows are exploded — never the text — for n up to the longest term, and
    joined with one lexicon of all routes; the hits are summed per comment
    (partial aggregate first) and joined back (left, NULL keys included).  With
    terms of several tokens the hits of a comment are put in order and taken
    leftmost first, longest first.  Rows with one key and one text share their
    sums, which at most multiplies both and changes neither label nor
    confidence.  A lexicon that is not broadcast shuffles on (route, term), and
    adaptive execution splits hot terms ("the")."""
    lexicon, longest = _joint_lexicon(df.sparkSession, [scorer for scorer, _ in routes])
    route = F.lit(None).cast("int")
    for k, (_, wanted) in reversed(list(enumerate(routes))):
        route = F.when(wanted, F.lit(k)).otherwise(route)
    names = df.columns
    staged = materialize(
        df.withColumns({"__mark": F.xxhash64(F.col(text)), "__route": route}), "lexicon-comments"
    )
    words = phrase_tokens(F.col(text))
    keyed = staged.where(F.col("__route").isNotNull()).select(
        F.col(key).alias("_key"), F.col("__mark").alias("_mark"), F.col("__route").alias("_route"), words.alias("_words")
    )
    if longest == 1:
        tokens = keyed.select("_key", "_mark", "_route", F.explode("_words").alias("term"))
        sums = tokens.join(lexicon, ["_route", "term"]).groupBy("_key", "_mark", "_route").agg(
            F.sum("weight").alias(TOTAL), F.sum(F.abs("weight")).alias(ABSOLUTE)
        )
    else:
        # A row per token with those that follow it (NULL past the end), then one per n.
        shifted = F.arrays_zip(*[F.slice("_words", k + 1, F.size("_words")).alias(f"w{k}") for k in range(longest)])
        at_each = keyed.select("_key", "_mark", "_route", F.posexplode(shifted).alias("at", "w"))
        after = [F.col("w")[f"w{k}"] for k in range(longest)]
        grams = F.array(*[
            F.struct(F.lit(n).alias("n"), F.when(after[n - 1].isNotNull(), F.concat_ws(" ", *after[:n])).alias("term"))
            for n in range(1, longest + 1)
        ])
        placed = at_each.select("_key", "_mark", "_route", (F.col("at") + 1).alias("at"), F.inline(grams))
        hits = placed.where(F.col("term").isNotNull()).join(lexicon, ["_route", "term"])
        in_order = F.array_sort(F.collect_list(F.struct("at", (-F.col("n")).alias("less"), "weight")))
        start = F.struct(F.lit(0).alias("free"), F.lit(0.0).alias("total"), F.lit(0.0).alias("absolute"))

        def take(state: Column, hit: Column) -> Column:
            after = F.struct(
                (hit["at"] - hit["less"]).alias("free"), (state["total"] + hit["weight"]).alias("total"),
                (state["absolute"] + F.abs(hit["weight"])).alias("absolute"),
            )
            return F.when(hit["at"] >= state["free"], after).otherwise(state)

        sums = hits.groupBy("_key", "_mark", "_route").agg(in_order.alias("hits")).select(
            "_key", "_mark", "_route", F.aggregate("hits", start, take).alias("s")
        ).select("_key", "_mark", "_route", F.col("s.total").alias(TOTAL), F.col("s.absolute").alias(ABSOLUTE))
    same = (
        F.col(key).eqNullSafe(F.col("_key")) & (F.col("__mark") == F.col("_mark")) & (F.col("__route") == F.col("_route"))
    )
    none = F.lit(0.0)
    return staged.join(sums, same, "left").select(
        *names, F.coalesce(TOTAL, none).alias(TOTAL), F.coalesce(ABSOLUTE, none).alias(ABSOLUTE)
    )


# --- plug-in scorer ---------------------------------------------------------------


@dataclass(frozen=True)
class PluginScorer:
    """``fn(texts: pd.Series) -> pd.DataFrame`` with columns label, score.

    ``setup()`` makes such a function where it is used (it loads a model, say):
    it runs once per Python worker and the result serves all later tasks of that
    worker; if it fails, the job fails.  Texts are handed over in batches of at
    most ``batch_bytes`` (UTF-8; a longer text is a batch of its own)."""

    fn: Callable[[pd.Series], pd.DataFrame] | None = None
    max_chars: int | None = None
    name: str = "plugin"
    setup: Callable[[], Callable[[pd.Series], pd.DataFrame]] | None = None
    batch_bytes: int = 16 * 1024 * 1024

    def __post_init__(self) -> None:
        if (self.fn is None) == (self.setup is None):
            raise ValueError("give either fn or setup")


#: Functions that ``setup`` made in this worker, by the code that made them.
_MADE: dict[str, Callable] = {}


def _made_once(key: str, setup: Callable[[], Callable]) -> Callable:
    if key not in _MADE:
        _MADE[key] = setup()
    return _MADE[key]


def _by_bytes(texts: list, most: int) -> Iterator[list]:
    batch: list = []
    held = 0
    for text in texts:
        size = len((text or "").encode())
        if batch and held + size > most:
            yield batch
            batch, held = [], 0
        batch.append(text)
        held += size
    if batch:
        yield batch


def _ship_by_value(fn: Callable) -> None:
    """Pickle the scorer's own module by value, so workers need not be able
    to import it (library modules are left alone)."""
    from pyspark import cloudpickle

    name = getattr(fn, "__module__", None)
    module = sys.modules.get(name) if name else None
    if module is None or name == "__main__" or name.split(".")[0] in {"pyspark", "pandas", "numpy", "builtins"}:
        return
    try:
        cloudpickle.register_pickle_by_value(module)
    except (ValueError, AttributeError):
        pass


def _score_batch(fn: Callable, texts: list) -> list[tuple[str, float]]:
    """(label, score) of every text; a failing batch is halved until only the
    failing texts become error rows."""
    if not texts:
        return []
    try:
        res = fn(pd.Series(texts, dtype=object))
        got = list(zip(res["label"].astype(str), res["score"].astype(float)))
        if len(got) != len(texts):
            raise ValueError("scorer returned a different number of rows")
        return got
    except Exception:
        if len(texts) == 1:
            return [(ERROR_LABEL, 0.0)]
        half = len(texts) // 2
        return _score_batch(fn, texts[:half]) + _score_batch(fn, texts[half:])


def _plugin_verdict(scorer: PluginScorer, text: Column, wanted: Column) -> Column:
    """struct(label, score) of the rows that are ``wanted``, NULL elsewhere.
    Only the text and the flag go to Python."""
    from pyspark import cloudpickle

    fn, setup, max_chars, most = scorer.fn, scorer.setup, scorer.max_chars, scorer.batch_bytes
    _ship_by_value(fn or setup)
    key = hashlib.sha256(cloudpickle.dumps(setup)).hexdigest()

    @F.pandas_udf("label string, score double")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        score = fn if setup is None else _made_once(key, setup)
        for texts, flags in batches:
            chosen = [t if max_chars is None or t is None else t[:max_chars] for t, f in zip(texts, flags) if f]
            found = iter([v for part in _by_bytes(chosen, most) for v in _score_batch(score, part)])
            yield pd.DataFrame([next(found) if f else (None, None) for f in flags], columns=["label", "score"])

    return judge(text, wanted)


# --- failing rows -------------------------------------------------------------------


@dataclass(frozen=True)
class ErrorReport:
    """Failing rows per route; known after an action on the observed frame."""

    observed: Observation

    def errors(self) -> dict[str, int]:
        return {route: int(self.observed.get[name]) for route, name in _ERRORS.items()}

    def rows(self) -> int:
        return int(self.observed.get["rows"])


_ERRORS = {ENGLISH: "errors_english", "*": "errors_other"}


def observe_errors(scored: DataFrame, language: str = "language") -> tuple[DataFrame, ErrorReport]:
    """``scored`` with its failing rows counted per route while an action
    computes it (no pass of its own).  The count covers the rows that reach this
    point: filters written before ``score_sentiment`` are pushed to the source as
    ever, those written after this call stay above the count."""
    failed = F.coalesce(F.col(RAW) == ERROR_LABEL, F.lit(False))
    english = F.coalesce(F.col(language) == ENGLISH, F.lit(False))
    observed = Observation()
    return scored.observe(
        observed, F.count_if(failed & english).alias(_ERRORS[ENGLISH]), F.count_if(failed & ~english).alias(_ERRORS["*"]),
        F.count(F.lit(1)).alias("rows"),
    ), ErrorReport(observed)


# --- trained scorer ---------------------------------------------------------------


@dataclass
class TrainedScorer:
    """Tokenizer → hashing TF → logistic regression, one model per route.

    ``fit`` takes labelled comments (text, canonical label in {−1, 0, 1});
    the raw label is the predicted class name, the score its probability.
    """

    num_features: int = 1 << 16
    max_iter: int = 20
    reg_param: float = 0.01
    name: str = "trained"
    model: object = field(default=None, repr=False)

    CLASSES = ("negative", "neutral", "positive")

    def fit(self, labelled: DataFrame, text: str = "text", label: str = "label") -> "TrainedScorer":
        from pyspark.ml import Pipeline
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import HashingTF, RegexTokenizer

        train = labelled.select(
            F.col(text).alias("_text"), (F.col(label).cast("double") + 1.0).alias("_y")
        ).filter(F.col("_text").isNotNull() & F.col("_y").isNotNull())
        train = train.repartition(train.sparkSession.sparkContext.defaultParallelism)
        pipeline = Pipeline(
            stages=[
                RegexTokenizer(inputCol="_text", outputCol="_tokens", pattern=r"[^\p{L}]+", gaps=True),
                HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=self.num_features),
                LogisticRegression(
                    featuresCol="_tf", labelCol="_y", family="multinomial",
                    maxIter=self.max_iter, regParam=self.reg_param,
                ),
            ]
        )
        self.model = pipeline.fit(train)
        return self

    def transform(self, df: DataFrame, text: str) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        if self.model is None:
            raise ValueError("fit the scorer first")
        cols = df.columns
        pred = self.model.transform(df.withColumn("_text", F.col(text)))
        probs = vector_to_array(F.col("probability"))
        classes = F.array(*[F.lit(c) for c in self.CLASSES])
        raw = F.element_at(classes, F.col("prediction").cast("int") + 1)
        return pred.select(
            *cols,
            F.coalesce(raw, F.lit("neutral")).alias(RAW),
            F.array_max(probs).alias(SCORE),
        )


def fit_routes(
    labelled: DataFrame,
    language: str = "language",
    text: str = "text",
    label: str = "label",
    make: Callable[[], TrainedScorer] = TrainedScorer,
) -> dict[str, TrainedScorer]:
    """One trained scorer per route (``en`` and ``*``, as in ``score_sentiment``),
    fitted at the same time: each fit is a chain of small optimizer jobs, so
    the two chains are submitted from two driver threads and share the
    cluster instead of waiting for each other."""
    from concurrent.futures import ThreadPoolExecutor

    is_en = F.coalesce(F.col(language) == F.lit(ENGLISH), F.lit(False))
    parts = {ENGLISH: labelled.filter(is_en), "*": labelled.filter(~is_en)}
    with ThreadPoolExecutor(max_workers=len(parts)) as pool:
        futures = {route: pool.submit(make().fit, part, text, label) for route, part in parts.items()}
        return {route: f.result() for route, f in futures.items()}


# --- the stage ---------------------------------------------------------------------

Scorer = LexiconScorer | PluginScorer | TrainedScorer


def score_sentiment(
    comments: DataFrame,
    scorers: Mapping[str, Scorer],
    text: str = "clean_text",
    language: str = "language",
    scheme: str = "sentiment",
    drop_missing: bool = True,
    key: str = "comment_id",
) -> DataFrame:
    """comments → comments_scored.

    ``scorers`` maps ``"en"`` to the English scorer and ``"*"`` to the one
    for every other language (a single ``"*"`` serves all).  Rows with a
    NULL text are dropped; a caller that computes the text in the same plan
    should drop NULL raw texts before computing it and pass
    ``drop_missing=False`` (Catalyst pushes a filter on a computed column
    down by copying the computation into the filter).  ``key`` identifies a
    comment; only lexicons scored by the join path read it.
    """
    df = drop_missing_text(comments, text) if drop_missing else comments
    english = scorers.get(ENGLISH, scorers["*"])
    other = scorers["*"]
    columns = df.columns
    everyone = F.lit(True)
    is_en = F.coalesce(F.col(language) == F.lit(ENGLISH), F.lit(False))
    routes = [(other, everyone)] if english is other else [(english, is_en), (other, ~is_en)]
    by_join = [(s, wanted) for s, wanted in routes if isinstance(s, LexiconScorer) and s.uses_join()]
    if by_join:
        df = join_sums(df, key, text, by_join)
    verdicts = []
    for k, (scorer, wanted) in enumerate(routes):
        raw, score = f"__raw_{k}", f"__score_{k}"
        if isinstance(scorer, PluginScorer):
            found = f"__found_{k}"
            df = df.withColumn(found, _plugin_verdict(scorer, F.col(text), wanted))
            verdict = (F.col(found)["label"], F.col(found)["score"])
        elif isinstance(scorer, LexiconScorer) and not scorer.uses_join():
            # Columns of their own: routes that read the text alike share one.
            found, tokens = f"__found_{k}", "__phrase_tokens" if scorer.has_phrases() else "__letter_tokens"
            if tokens not in df.columns:
                df = df.withColumn(tokens, scorer.normalized(F.col(text)))
            df = df.withColumn(found, F.when(wanted, scorer.sums(F.col(tokens))))
            verdict = scorer.verdict(F.col(found)["total"], F.col(found)["absolute"])
        elif isinstance(scorer, LexiconScorer):
            verdict = scorer.verdict(F.col(TOTAL), F.col(ABSOLUTE))
        else:
            df = scorer.transform(df, text).withColumnsRenamed({RAW: raw, SCORE: score})
            verdict = (F.col(raw), F.col(score))
        verdicts.append((wanted, verdict))

    def pick(part: int) -> Column:
        if len(verdicts) == 1:
            return verdicts[0][1][part]
        return F.when(verdicts[0][0], verdicts[0][1][part]).otherwise(verdicts[1][1][part])

    scored = df.withColumns({RAW: pick(0), SCORE: pick(1)}).select(*columns, RAW, SCORE)
    return _finish(scored, scheme)
