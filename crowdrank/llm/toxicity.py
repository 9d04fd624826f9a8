"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives P; all other texts are unlabelled U, of
which a share ``prior`` is toxic too.  With the sigmoid loss l(z) = 1 / (1 + e^z)
and a linear score g, the class-prior-corrected risk is

    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])

where the second term estimates the risk on the unseen negatives; when it falls
below zero by more than a slack (the model begins to memorise U), the step goes against that term
instead.  The features are the words of the whole text and their first four
bytes, hashed to 2**20 slots, as log counts; a slot takes part when its
document frequency in P differs from that expected from P and U together, both
counted over all usable texts.

The descent starts from weights fitted to samples of P and U and goes on by
``PASSES`` steps on the risk of all usable texts.  Their features in these slots
are written once; in every step the tasks add up the risk's parts and their
slopes over P and over U, and only these sums reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdrank.llm.common import lean_batches, materialise, narrow
from crowdrank.llm.features import WordSlots, word_slots

SLOT_BITS = 20
MAX_POSITIVE = 10_000  # of the samples that the descent starts from: confirmed toxic texts
MAX_UNLABELLED = 20_000  # and unlabelled texts, both drawn by a hash of the id
STEPS = 500
RATE = 0.1
PASSES = 15  # steps on the risk of all texts
PASS_RATE = 0.05  # of the first of them, falling to zero
CHUNK = 1024  # numbers in a row of sums
RIDGE = 1e-6
SLACK = 0.01  # how far below zero the risk on the unseen negatives may be estimated
MIN_SURPRISE = 5.0  # of a slot's frequency in P, in deviations of a Poisson count
DEFAULT_PRIOR = 0.05
MOST_BROADCAST = 1_000_000  # toxic ids, or texts with copies; more are joined by a shuffle


def _sparse(text: str | None, slots: WordSlots, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    index, count = word_slots(text, slots, kept)
    return index.astype(np.int32), np.log1p(count).astype(np.float16)


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def slot_frequencies(rows: DataFrame, toxic: DataFrame) -> tuple[DataFrame, int, int]:
    """(slot, in_p, in_u): documents of all ``rows`` that hold each slot, among
    the ids of ``toxic`` and among all; and the numbers of these rows.  Rows with equal
    texts count once: each of c copies counts 1 / c."""
    size = 1 << SLOT_BITS
    rows = rows.where("doc_id is not null").join(
        _bounded(toxic.select("doc_id", F.lit(1).alias("toxic"))), "doc_id", "left"
    ).select(
        "text", F.coalesce("toxic", F.lit(0)).alias("toxic"),
        F.xxhash64("text").alias("one"), F.xxhash64(F.lit(1), "text").alias("two"),
    )
    copies = rows.groupBy("one", "two").agg(F.count("*").alias("all_copies"), F.sum("toxic").alias("toxic_copies"))
    copies = materialise(copies.where("all_copies > 1"), "copies")
    rows = rows.join(_bounded(copies), ["one", "two"], "left").select("text", "toxic", "all_copies", "toxic_copies")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots = WordSlots(SLOT_BITS)
        in_p, in_u, n_p, n_u = np.zeros(size), np.zeros(size), 0, 0
        for batch in batches:
            n_p, n_u = n_p + int(batch["toxic"].sum()), n_u + len(batch)
            of_all, of_toxic = batch["all_copies"].fillna(1), batch["toxic_copies"].fillna(1)
            for text, toxic, c, k in zip(batch["text"], batch["toxic"], of_all, of_toxic):
                index, _ = word_slots(text, slots)
                in_u[index] += 1 / c
                if toxic:
                    in_p[index] += 1 / k
        held = np.flatnonzero(in_u)
        yield pd.DataFrame({
            "slot": np.append(held, -1), "in_p": np.append(in_p[held], n_p), "in_u": np.append(in_u[held], n_u)
        })

    sums = materialise(
        rows.mapInPandas(count, "slot long, in_p double, in_u double").groupBy("slot")
        .agg(F.rint(F.sum("in_p")).cast("long").alias("in_p"), F.rint(F.sum("in_u")).cast("long").alias("in_u")),
        "slot-frequencies",
    )
    total = sums.where("slot < 0").first()  # none without rows
    return sums.where("slot >= 0"), total["in_p"] if total else 0, total["in_u"] if total else 0


def surprising_slots(frequencies: DataFrame, n_p: int, n_u: int) -> np.ndarray:
    """``surprising`` of a table of frequencies; only these slots come to the driver."""
    expected = (F.col("in_p") + F.col("in_u")) * F.lit(n_p / max(n_p + n_u, 1))
    found = frequencies.where(F.abs(F.col("in_p") - expected) / F.sqrt(expected + 1) >= MIN_SURPRISE)
    return np.sort(found.select("slot").toPandas()["slot"].to_numpy(np.int64))


def feature_table(rows: DataFrame, toxic: DataFrame, chosen: np.ndarray) -> DataFrame:
    """(doc_id, toxic, place, value) of all ``rows``, written to the shared
    folder: the places in ``chosen`` of a text's slots, and their values.  Only
    ids and features meet the ids of ``toxic``, no text."""
    place = np.full(1 << SLOT_BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    shared = rows.sparkSession.sparkContext.broadcast(place)  # 2**20 numbers: 4 MB

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots, kept = WordSlots(SLOT_BITS), shared.value >= 0
        for batch in batches:
            got = [_sparse(text, slots, kept) for text in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"],
                "place": [shared.value[i].tobytes() for i, _ in got], "value": [v.tobytes() for _, v in got],
            })

    made = rows.select("doc_id", "text").mapInPandas(make, "doc_id long, place binary, value binary")
    marked = made.join(_bounded(toxic.select("doc_id", F.lit(1).alias("toxic"))), "doc_id", "left")
    return materialise(marked.select("doc_id", F.coalesce("toxic", F.lit(0)).alias("toxic"), "place", "value"), "toxicity-features")


def _pairs(got: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float16)) for i, v in zip(got["place"], got["value"])]


def _sample(features: DataFrame, rows: int, most: int) -> pd.DataFrame:
    """Of ``rows`` rows the share with the smallest hashes of their ids that
    holds ``most`` rows less four deviations; all, if they are no more than that."""
    share = (most - 4 * np.sqrt(most)) / max(rows, 1)
    if rows > most:
        low = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30))
        features = features.where(low < F.lit(int(share * (1 << 30))))
    return features.select("doc_id", "place", "value").toPandas().sort_values(["doc_id", "place", "value"], kind="stable")


#: weights and bias → over P, then over U: number of texts, sum of their
#: probabilities, and the slope of that sum by each weight and the bias.
RiskSums = Callable[[np.ndarray], np.ndarray]


def view_of(pairs: list[tuple[np.ndarray, np.ndarray]], theta: np.ndarray) -> np.ndarray:
    """One half of ``RiskSums`` over the texts given."""
    owner, column, value = _stack(pairs)
    value = value.astype(np.float64)
    z = np.bincount(owner, value * theta[column], len(pairs)) + theta[-1]
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    slope = p * (1 - p)
    by_slot = np.bincount(column, slope[owner] * value, len(theta) - 1)
    return np.concatenate([[len(pairs), p.sum()], by_slot, [slope.sum()]])


def risk_sums(table: DataFrame) -> RiskSums:
    """The sums over a whole ``feature_table``: each task adds up its rows, the
    tasks' sums are added in pieces of ``CHUNK`` numbers."""

    def sums(theta: np.ndarray) -> np.ndarray:
        size = 2 * (len(theta) + 2)

        def of_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = np.zeros(size)
            for batch in batches:
                pairs = _pairs(batch)
                confirmed = [pair for pair, toxic in zip(pairs, batch["toxic"]) if toxic]
                held += np.concatenate([view_of(confirmed, theta), view_of(pairs, theta)])
            pieces = [held[k:k + CHUNK] for k in range(0, size, CHUNK)]
            yield pd.DataFrame({"piece": np.arange(len(pieces)), "sums": pieces})

        def added(part: pd.DataFrame) -> pd.DataFrame:
            return part.iloc[:1].assign(sums=[np.sum(np.stack(part["sums"].to_list()), axis=0)])

        schema = "piece int, sums array<double>"
        got = table.mapInPandas(of_task, schema).groupBy("piece").applyInPandas(added, schema).toPandas()
        return np.concatenate(got.sort_values("piece")["sums"].to_list()) if len(got) else np.zeros(size)

    return sums


def _stack(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(i) for i, _ in rows], np.int64)
    owner = np.repeat(np.arange(len(rows)), sizes)
    if not len(owner):
        return owner, np.zeros(0, np.int32), np.zeros(0, np.float32)
    return owner, np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows])


def _frequencies(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Documents that hold each slot; rows with equal features count once."""
    seen: set[int] = set()
    out = np.zeros(1 << SLOT_BITS, np.int64)
    for index, value in rows:
        mark = xxhash.xxh3_128_intdigest(index.tobytes() + value.tobytes())
        if mark not in seen:
            seen.add(mark)
            out[index] += 1
    return out


def surprising(in_p: np.ndarray, in_u: np.ndarray, n_p: int, n_u: int) -> np.ndarray:
    """The slots whose frequency in P differs from the expected one."""
    expected = (in_p + in_u) * (n_p / max(n_p + n_u, 1))
    return np.flatnonzero(np.abs(in_p - expected) / np.sqrt(expected + 1) >= MIN_SURPRISE)


def fit_nnpu(
    positive: list, unlabelled: list, prior: float, steps: int = STEPS, chosen: np.ndarray | None = None
) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk plus a small ridge,
    by Adam steps over all rows given, in the slots ``chosen`` (by default those
    surprising in these rows).  Without positives or unlabelled texts: zero
    weights and the prior's bias."""
    weights = np.zeros(1 << SLOT_BITS, np.float32)
    bias = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return weights, bias
    n_p, n_u = len(positive), len(unlabelled)
    if chosen is None:
        chosen = surprising(_frequencies(positive), _frequencies(unlabelled), n_p, n_u)
    if not len(chosen):
        return weights, bias
    place = np.full(1 << SLOT_BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    kept = [(place[i], v.astype(np.float32)) for i, v in positive + unlabelled]
    kept = [(i[i >= 0], v[i >= 0]) for i, v in kept]
    owner, column, value = _stack(kept)
    theta = np.zeros(len(chosen) + 1)
    theta[-1] = bias
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        z = np.bincount(owner, value * theta[column], n_p + n_u) + theta[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        unseen = p[n_p:].mean() - prior * p[:n_p].mean()
        slope = p * (1 - p)  # of the risk by each text's score
        if unseen >= -SLACK:
            slope[:n_p] *= -2 * prior / n_p
            slope[n_p:] *= 1 / n_u
        else:
            slope[:n_p] *= prior / n_p
            slope[n_p:] *= -1 / n_u
        gradient = np.append(np.bincount(column, slope[owner] * value, len(chosen)), slope.sum())
        gradient[:-1] += RIDGE * theta[:-1]
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient * gradient
        theta -= RATE * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
    weights[chosen] = theta[:-1]
    return weights, float(theta[-1])


def descend(theta: np.ndarray, sums: RiskSums, prior: float, passes: int = PASSES) -> np.ndarray:
    """``theta`` (weights, bias) after ``passes`` Adam steps on the risk that
    ``sums`` gives, with a rate that falls to zero."""
    theta = theta.copy()
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, passes + 1):
        of_p, of_u = np.split(sums(theta), 2)
        risk_p, risk_u = of_p[1:] / max(of_p[0], 1), of_u[1:] / max(of_u[0], 1)
        if risk_u[0] - prior * risk_p[0] >= -SLACK:
            gradient = risk_u[1:] - 2 * prior * risk_p[1:]
        else:
            gradient = prior * risk_p[1:] - risk_u[1:]
        gradient[:-1] += RIDGE * theta[:-1]
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient * gradient
        rate = PASS_RATE * (1 - (step - 1) / passes)
        theta -= rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
    return theta


def train(
    docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", label_id_col: str = "doc_id",
    max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED,
) -> tuple[np.ndarray, float]:
    """Fit on the documents for which ``usable`` (an expression over the
    operator's ``doc_id``) holds.  The class prior is the toxic share of their
    labelled rows, of all of them; a document with several labels is toxic if
    one says so.  Without any label the prior is ``DEFAULT_PRIOR``.  Rows with a
    NULL id teach nothing; of rows with one id each counts.  The two bounds are
    those of the samples that the descent starts from; its last steps see all."""
    rows = narrow(docs, doc_id=id_col, text=text_col).where(usable)
    marks = (
        narrow(labels, doc_id=label_id_col, toxic=label_col)
        .where(usable & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    total = marks.agg(F.count("*").alias("n"), F.sum((F.col("toxic") == 1).cast("long")).alias("k")).first()
    prior = min(max(total["k"] / total["n"], 1e-3), 0.5) if total["n"] else DEFAULT_PRIOR
    toxic = marks.where("toxic = 1").select("doc_id")
    frequencies, n_p, n_u = slot_frequencies(rows, toxic)
    chosen = surprising_slots(frequencies, n_p, n_u)
    if not n_p or not len(chosen):
        return fit_nnpu([], [], prior)
    # Unlabelled are all texts, the confirmed ones included, so that they hold
    # the prior's share of toxic ones.
    table = feature_table(rows.where("doc_id is not null"), toxic, chosen)
    positive = _pairs(_sample(table.where("toxic = 1"), n_p, max_positive))
    unlabelled = _pairs(_sample(table, n_u, max_unlabelled))
    places = np.arange(len(chosen))
    start, bias = fit_nnpu(positive, unlabelled, prior, chosen=places)
    theta = descend(np.append(start[places], bias).astype(np.float64), risk_sums(table), prior)
    weights = np.zeros(1 << SLOT_BITS, np.float32)
    weights[chosen] = theta[:-1]
    return weights, float(theta[-1])


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", result_col: str = "score") -> DataFrame:
    """``docs`` with ``result_col`` (an existing one is replaced): the
    probability, 0 to 1, that the whole text is toxic.  A NULL or empty text has the score of no words at all."""
    from pyspark.sql.functions import pandas_udf

    lean_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**20 weights: 4 MB

    @pandas_udf("double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, bias = shared.value
        slots, kept = WordSlots(SLOT_BITS), weights != 0
        for batch in batches:
            out = []
            for text in batch:
                index, value = _sparse(text, slots, kept)
                z = float(weights[index] @ value.astype(np.float32)) + bias
                out.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
            yield pd.Series(out, dtype="float64")

    return docs.withColumn(result_col, judge(docs[text_col]))
