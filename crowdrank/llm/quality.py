"""Document quality by co-training of two views.

View one is the text's shape (``features.text_shape``), view two the page's
metadata (language, source, stated length).  Each has a logistic model.  In
every round both are trained, calibrated on labelled rows kept aside, and give
their confident pseudo-labels for all unlabelled rows to the other view.
At the end a logistic model on the two calibrated log-odds, fitted on the rows
kept aside, scores every document.

The pool is the whole unlabelled table.  Its features are written once, about 30
bytes a row; every Newton step is one pass over them, in which the tasks add up
the slope and the curvature of the rows that the other view is sure of.  Only
these sums, one row of numbers per feature, reach the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdrank.llm.common import lean_batches, materialise, narrow
from crowdrank.llm.features import SHAPE, text_shape

MAX_LABELLED = 10_000  # bounded training sample: labelled rows, the first by a hash of the id
ROUNDS = 4
CONFIDENT = 0.95
PSEUDO_WEIGHT = 0.3  # of a pseudo-label; the whole pool weighs at most so much of the labelled rows
PASSES = 3  # Newton steps a round, from the weights of the round before
BINS = 16
META_SLOTS = 128
RIDGE = 1.0

_META = ("lang", "source", "n_chars")


def meta_slots(lang: str | None, source: str | None, n_chars) -> list[int]:
    """The three slots of a row's metadata; NULL has a slot of its own."""
    size = -1 if n_chars is None or n_chars != n_chars else int(np.log2(max(int(n_chars), 0) + 1) * 2)
    names = (f"lang={lang}", f"source={source}", f"size={size}")
    return [k * META_SLOTS + zlib.crc32(name.encode()) % META_SLOTS for k, name in enumerate(names)]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _newton(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = RIDGE, steps: int = 12) -> np.ndarray:
    """Weighted ridge logistic regression (last column of ``x`` is the bias)."""
    theta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = _sigmoid(x @ theta)
        slope = x.T @ (w * (p - y)) + penalty * theta
        curve = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        theta -= step
        if np.abs(step).max() < 1e-6:
            break
    return theta


@dataclass
class CoTrained:
    """Both views' models, their calibrations and the combination."""

    edges: np.ndarray  # bin edges of each shape value
    text: np.ndarray
    meta: np.ndarray
    text_scale: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0]))
    meta_scale: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0]))
    both: np.ndarray = field(default_factory=lambda: np.array([1.0, 1.0, 0.0]))

    def text_rows(self, shapes: np.ndarray) -> np.ndarray:
        return text_matrix(shapes, self.edges)

    def score(self, shapes: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = self.text_scale[0] * (text_matrix(shapes, self.edges) @ self.text) + self.text_scale[1]
        b = self.meta_scale[0] * (meta_matrix(slots) @ self.meta) + self.meta_scale[1]
        return _sigmoid(a), _sigmoid(b), _sigmoid(self.both[0] * a + self.both[1] * b + self.both[2])


def text_bins(shapes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The bin of each shape value."""
    out = np.zeros(shapes.shape, np.uint8)
    for j in range(shapes.shape[1]):
        out[:, j] = np.searchsorted(edges[j], shapes[:, j], side="right")
    return out


def _indicators(places: np.ndarray, size: int) -> np.ndarray:
    """One row of indicators per row of ``places``, and the bias."""
    out = np.zeros((len(places), size + 1), np.float32)
    out[np.arange(len(places))[:, None], places] = 1
    out[:, -1] = 1
    return out


def bins_matrix(bins: np.ndarray) -> np.ndarray:
    k = bins.shape[1]
    return _indicators(bins + np.arange(k) * BINS, k * BINS)


def text_matrix(shapes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """One indicator per shape value and bin, and the bias."""
    return bins_matrix(text_bins(shapes, edges))


def meta_matrix(slots: np.ndarray) -> np.ndarray:
    return _indicators(slots, len(_META) * META_SLOTS)


def _calibrate(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Platt scaling: slope and offset of a logistic fit."""
    return _newton(np.column_stack([z, np.ones(len(z))]), y, np.ones(len(z)), ridge=0.01)


#: Of a view: its weights and its calibration.
ViewModel = tuple[np.ndarray, np.ndarray]
#: (judges, weights) → per view slope, curvature and number of the rows that the other view's judge is sure of.
PoolSums = Callable[[list[ViewModel], list[np.ndarray]], list[tuple[np.ndarray, np.ndarray, int]]]


def view_sums(
    bins: np.ndarray, slots: np.ndarray, judges: list[ViewModel], weights: list[np.ndarray]
) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For both views (text, metadata): slope and curvature of the logistic loss
    at ``weights``, over the rows that the other view's judge is sure of, and
    their number."""
    views = [bins_matrix(bins), meta_matrix(slots)]
    out = []
    for own, other in ((0, 1), (1, 0)):
        theta, scale = judges[other]
        p = _sigmoid(scale[0] * (views[other] @ theta) + scale[1])
        sure = (p >= CONFIDENT) | (p <= 1 - CONFIDENT)
        x, y = views[own][sure].astype(np.float64), (p[sure] >= 0.5).astype(float)
        q = _sigmoid(x @ weights[own])
        out.append((x.T @ (q - y), (x * (q * (1 - q))[:, None]).T @ x, int(sure.sum())))
    return out


def co_train(
    shapes: np.ndarray, slots: np.ndarray, y: np.ndarray, aside: np.ndarray, edges: np.ndarray,
    pool: PoolSums, pool_rows: int, rounds: int = ROUNDS,
) -> CoTrained:
    """Fit on labelled rows (``y``), of which ``aside`` only calibrate, and on
    the ``pool_rows`` rows without labels that ``pool`` sums up.  Without rows of
    both classes in each part, the model gives the positive share everywhere (0.5
    without labels)."""
    if min(len(set(y[aside])), len(set(y[~aside]))) < 2:
        share = min(max(float(y.mean()), 0.01), 0.99) if len(y) else 0.5
        k = shapes.shape[1]
        model = CoTrained(np.zeros((k, BINS - 1)), np.zeros(k * BINS + 1), np.zeros(len(_META) * META_SLOTS + 1))
        model.both = np.array([0.0, 0.0, np.log(share / (1 - share))])
        return model
    views = [text_matrix(shapes, edges).astype(np.float64), meta_matrix(slots).astype(np.float64)]
    fit, base = ~aside, np.ones(int((~aside).sum()))
    weight = PSEUDO_WEIGHT * len(base) / max(len(base), pool_rows)

    def judged(weights: list[np.ndarray]) -> list[ViewModel]:
        return [(theta, _calibrate(x[aside] @ theta, y[aside])) for x, theta in zip(views, weights)]

    weights = [_newton(x[fit], y[fit], base) for x in views]
    models = judged(weights)
    for _ in range(rounds - 1 if pool_rows else 0):
        for _ in range(PASSES):
            sums = pool(models, weights)
            moved = []
            for x, theta, (slope, curve, _) in zip(views, weights, sums):
                penalty = np.full(len(theta), RIDGE)
                penalty[-1] = 1e-6
                p = _sigmoid(x[fit] @ theta)
                slope = x[fit].T @ (p - y[fit]) + weight * slope + penalty * theta
                curve = (x[fit] * (p * (1 - p))[:, None]).T @ x[fit] + weight * curve + np.diag(penalty)
                moved.append(theta - np.linalg.solve(curve, slope))
            weights = moved
        models = judged(weights)
    (text, text_scale), (meta, meta_scale) = models
    a = text_scale[0] * (views[0][aside] @ text) + text_scale[1]
    b = meta_scale[0] * (views[1][aside] @ meta) + meta_scale[1]
    both = _newton(np.column_stack([a, b, np.ones(len(a))]), y[aside], np.ones(len(a)), ridge=0.01)
    return CoTrained(edges, text, meta, text_scale, meta_scale, both)


def pool_table(rows: DataFrame, marks: DataFrame, edges: np.ndarray) -> DataFrame:
    """(bins, slots) of the rows whose id is not among ``marks``, written to the
    shared folder.  Only ids and features meet the ids of ``marks``, no text."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            shapes = np.array([text_shape(t) for t in batch["text"]], float).reshape(-1, len(SHAPE))
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "bins": [b.tobytes() for b in text_bins(shapes, edges)],
                "slots": [np.array(meta_slots(*v), np.uint16).tobytes() for v in zip(*(batch[c] for c in _META))],
            })

    made = rows.mapInPandas(make, "doc_id long, bins binary, slots binary")
    return materialise(made.join(marks.select("doc_id"), "doc_id", "left_anti").select("bins", "slots"), "quality-pool")


def pool_sums(table: DataFrame) -> PoolSums:
    """``view_sums`` of a whole ``pool_table``: each task adds up its rows, the
    tasks' sums are added by feature, and one row of numbers per feature comes to
    the driver."""

    def sums(judges: list[ViewModel], weights: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, int]]:
        def of_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = None
            for batch in batches:
                if len(batch):
                    bins = np.frombuffer(b"".join(batch["bins"]), np.uint8).reshape(len(batch), -1)
                    slots = np.frombuffer(b"".join(batch["slots"]), np.uint16).reshape(len(batch), -1)
                    got = view_sums(bins, slots.astype(int), judges, weights)
                    held = got if held is None else [tuple(a + b for a, b in zip(*v)) for v in zip(held, got)]
            for view, (slope, curve, n) in enumerate(held or []):
                yield pd.DataFrame({
                    "view": view, "feature": np.arange(len(slope)),
                    "sums": list(np.column_stack([curve, slope, np.full(len(slope), float(n))])),
                })

        def added(part: pd.DataFrame) -> pd.DataFrame:
            return part.iloc[:1].assign(sums=[np.sum(np.stack(part["sums"].to_list()), axis=0)])

        schema = "view int, feature int, sums array<double>"
        got = table.mapInPandas(of_task, schema).groupBy("view", "feature").applyInPandas(added, schema).toPandas()
        out = []
        for view, theta in enumerate(weights):
            own = got[got["view"] == view].sort_values("feature")
            m = np.stack(own["sums"].to_list()) if len(own) else np.zeros((len(theta), len(theta) + 2))
            out.append((m[:, -2], m[:, :-2], int(m[0, -1])))
        return out

    return sums


def _features(rows: DataFrame) -> pd.DataFrame:
    """Features of bounded rows, made by the tasks: (doc_id, shape, slots)."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({
                "doc_id": batch["doc_id"],
                "shape": [text_shape(t) for t in batch["text"]],
                "slots": [meta_slots(*v) for v in zip(*(batch[c] for c in _META))],
            })

    return rows.mapInPandas(make, "doc_id long, shape array<double>, slots array<int>").toPandas()


def train(
    docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id",
    text_col: str = "text", lang_col: str = "lang", source_col: str = "source", size_col: str = "n_chars",
    label_id_col: str = "doc_id", label_col: str = "quality",
    max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS,
) -> CoTrained:
    """Co-train on the documents for which ``usable`` (over the operator's
    ``doc_id``) holds: on at most ``max_labelled`` labelled ones and on all that
    have no label.  A document with several labels has the lowest; rows with a
    NULL id teach nothing, a NULL label is none.  Of labelled rows with one id
    one counts, of unlabelled ones each."""
    usable = F.lit(True) if usable is None else usable
    rows = narrow(
        docs, doc_id=id_col, text=text_col, lang=lang_col, source=source_col, n_chars=size_col
    ).where(usable & F.col("doc_id").isNotNull())
    marks = (
        narrow(labels, doc_id=label_id_col, quality=label_col)
        .where(usable & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id").agg(F.min("quality").cast("double").alias("quality"))
    )

    learnable = marks.join(rows.select("doc_id"), "doc_id", "left_semi")
    chosen = learnable.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(max_labelled).toPandas()
    picked = docs.sparkSession.createDataFrame([(int(d),) for d in chosen["doc_id"]], "doc_id long")
    got = _features(rows.join(F.broadcast(picked), "doc_id", "left_semi"))  # at most max_labelled ids
    got["shape"], got["slots"] = got["shape"].map(tuple), got["slots"].map(tuple)
    # Of several rows with one id the one with the least features, whatever order they come in.
    got = got.sort_values(["doc_id", "shape", "slots"]).drop_duplicates("doc_id")
    y = got["doc_id"].map(dict(zip(chosen["doc_id"], chosen["quality"]))).to_numpy(float)
    shapes = np.array(got["shape"].tolist(), float).reshape(-1, len(SHAPE))
    slots = np.array(got["slots"].tolist(), int).reshape(-1, len(_META))
    aside = np.array([zlib.crc32(b"aside%d" % d) % 4 == 0 for d in got["doc_id"]], bool)
    if min(len(set(y[aside])), len(set(y[~aside]))) < 2:  # nothing to judge the pool by
        return co_train(shapes, slots, y, aside, np.zeros(0), lambda judges, weights: [], 0)
    edges = np.quantile(shapes, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    pool = pool_table(rows, marks, edges)
    return co_train(shapes, slots, y, aside, edges, pool_sums(pool), pool.count(), rounds)


def score(
    docs: DataFrame, model: CoTrained, text_col: str = "text", lang_col: str = "lang",
    source_col: str = "source", size_col: str = "n_chars", result_col: str = "quality_score",
) -> DataFrame:
    """``docs`` with a struct column ``result_col`` of (text_score, meta_score,
    score), each the probability of good quality.  Every row and column stays, but
    an existing column named ``result_col`` is replaced; a NULL or empty text has the shape of no characters, NULL metadata a value
    of its own."""
    from pyspark.sql.functions import pandas_udf

    lean_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    @pandas_udf("text_score double, meta_score double, score double")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, langs, sources, sizes in batches:
            shapes = np.array([text_shape(t) for t in texts], float).reshape(-1, len(SHAPE))
            slots = np.array([meta_slots(*v) for v in zip(langs, sources, sizes)], int).reshape(-1, len(_META))
            a, b, both = shared.value.score(shapes, slots)
            yield pd.DataFrame({"text_score": a, "meta_score": b, "score": both}).astype("float64")

    return docs.withColumn(
        result_col, judge(docs[text_col], docs[lang_col], docs[source_col], docs[size_col])
    )
