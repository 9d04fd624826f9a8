"""Near-duplicate documents by MinHash bands and odd sketches.

A document is the set of its distinct word shingles.  Equal sets form a class
and go on as one.  Of each class, ``BANDS * ROWS`` MinHash values are folded into
band keys (candidates share a key) and into an odd sketch: a bitmap of the
parities of the hashed samples.  The XOR of two sketches has a population count
z from which the similarity follows as 1 + m / (4 k) * ln(1 - 2 z / m), with
little error near 1; pairs that it puts clearly below the threshold are dropped.
The rest is confirmed on the full shingle sets.

Only components are wanted, so not all pairs of a bucket are formed.  Every
bucket first compares its members with one pivot P, the member that shares most
buckets with others.  Buckets whose members then lie in different components
may hide links across them.  With M = P - x, D = x - P and F = M + D (sizes),
two sets x, y are linked only if they share at least

    t = (F_x + F_y - r (|x| + |y|)) / 2 - min(M_x, M_y)

words of D, where r = (1 - s) / (1 + s) for similarity s.  So two components
can be linked only if members of theirs have t <= 0, or share a shingle that
the pivot lacks (one of the first r' |x| + 1 of D, as a prefix filter needs).

Pairs of components, not of documents, are formed from that.  One member of each
is its centre; 1 - similarity is a metric, so with distances d to the centre

    d(x, y) >= d(A, B) - d(A, x) - d(B, y)   and   d(x, y) >= d(x, B) - d(B, y),

and the pair goes no further if the first exceeds 1 - s for the farthest members.
In the pairs left over, the centre of the larger component is the pivot P again:
the smaller one's members are measured against it, and documents are paired only
where t <= 0, or where they share one of the rarest D - t + 1 words of both
D's and t words in all.  No link across components is left out; groups of thousands of near copies
of related texts cost about as many comparisons as they have members, not their
product.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdrank.llm.common import materialise, narrow
from crowdrank.llm.components import connected_components, looked_up

BANDS = 64
ROWS = 8  # a pair at similarity 0.8 shares no band with probability 8e-6
SKETCH_BITS = 1024
SKETCH_MARGIN = 0.15  # five deviations of the estimate at similarity 0.8
SET_BATCH = 500_000  # shingles (4 MB) that leave a Python worker at once, and a set more
HOT_CLASS = 1_000  # equal texts from which a class is a hot key
MAX_BROADCAST_SIDES = 200_000  # rows of 64 bytes
MAX_BROADCAST_IDS = 1_000_000  # 8 MB of ids; more are joined by a shuffle

_M64 = (1 << 64) - 1


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift steps)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    x = (x ^ (x >> np.uint64(28))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, size: int, hashes: _WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``size`` words of a whole
    text: ASCII letters lower-cased, words between ASCII white space; fewer words
    form one shingle; none, none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(size, len(h))
    got = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        got = _mix(got * np.uint64(0x9E3779B97F4A7C15) + h[k:len(h) - width + 1 + k])
    return np.unique(got)


@functools.lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    k = BANDS * ROWS
    odd = rng.integers(1, 1 << 31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    band = rng.integers(1, 1 << 62, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    fold = rng.integers(1, 1 << 62, k, dtype=np.uint64)
    return odd, band, fold


def signature(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, odd sketch as 64-bit numbers) of a non-empty set."""
    odd, band, fold = _permutations()
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    step = max(1, 65_536 // len(odd))
    low = np.full(len(odd), np.uint32(0xFFFFFFFF))
    for k in range(0, len(x), step):
        np.minimum(low, (odd[:, None] * x[None, k:k + step]).min(axis=1), out=low)
    wide = low.astype(np.uint64)
    keys = (wide.reshape(BANDS, ROWS) * band).sum(axis=1, dtype=np.uint64)
    keys = _mix(keys + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    bits = (_mix(wide + fold) & np.uint64(SKETCH_BITS - 1)).astype(np.int64)
    parity = (np.bincount(bits, minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return keys.view(np.int64), np.packbits(parity).view(np.int64)


def _farthest(similarity: float) -> int:
    """Largest XOR population count of sketches that may still be similar."""
    k = BANDS * ROWS
    apart = 2 * k * (1 - max(0.0, similarity - SKETCH_MARGIN))
    return math.ceil(SKETCH_BITS / 2 * (1 - math.exp(-2 * apart / SKETCH_BITS)))


def _differing(a: str, b: str) -> Column:
    """XOR population count of two sketches."""
    return sum(F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(SKETCH_BITS // 64))


def _signatures(docs: DataFrame, shingle: int) -> DataFrame:
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _WordHashes()
        for batch in batches:
            for k in range(0, len(batch), 512):
                part, out = batch.iloc[k:k + 512], []
                for text in part["text"]:
                    own = shingle_set(text, shingle, hashes)
                    keys, sketch = signature(own) if len(own) else (None, None)
                    out.append((len(own), xxhash.xxh3_128_digest(own.tobytes()), keys, sketch))
                made = pd.DataFrame(out, columns=["n", "set_id", "bands", "sketch"])
                made.insert(0, "doc_id", part["doc_id"].astype("Int64").to_numpy())
                yield made

    return docs.mapInPandas(
        make, "doc_id long, n long, set_id binary, bands array<long>, sketch array<long>"
    )


def _sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(rep, own): full shingle sets of the documents whose id is in ``ids``."""
    if ids.count() <= MAX_BROADCAST_IDS:
        ids = F.broadcast(ids)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _WordHashes()
        for batch in batches:
            reps, own, held = [], [], 0
            for rep, text in zip(batch["doc_id"], batch["text"]):
                reps.append(rep)
                own.append(shingle_set(text, shingle, hashes).view(np.int64))
                held += len(own[-1])
                if held >= SET_BATCH:
                    yield pd.DataFrame({"rep": reps, "own": own})
                    reps, own, held = [], [], 0
            if reps:
                yield pd.DataFrame({"rep": reps, "own": own})

    return (
        docs.join(ids, "doc_id", "left_semi").mapInPandas(make, "rep long, own array<long>")
        .where(F.size("own") > 0)
    )


def _confirm(pairs: DataFrame, reps: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar: sketches first, then sets."""
    sketches = reps.select("rep", "sketch")
    z = _differing("sa", "sb")
    near = materialise(
        pairs.join(sketches.withColumnsRenamed({"rep": "a", "sketch": "sa"}), "a")
        .join(sketches.withColumnsRenamed({"rep": "b", "sketch": "sb"}), "b")
        .where(z <= _farthest(percent / 100)).select("a", "b").distinct(),
        "near-pairs",
    )
    ids = materialise(near.select("a").unionByName(near.select(F.col("b").alias("a"))).distinct().toDF("doc_id"), "pair-ids")
    sets = materialise(_sets(docs, ids, shingle), "shingle-sets")
    both = F.size(F.array_intersect("oa", "ob"))
    return (
        near.join(sets.withColumnsRenamed({"rep": "a", "own": "oa"}), "a")
        .join(sets.withColumnsRenamed({"rep": "b", "own": "ob"}), "b")
        .where(100 * both >= percent * (F.size("oa") + F.size("ob") - both))
        .select("a", "b").distinct()
    )


def _distance(a: str, b: str) -> Column:
    both = F.size(F.array_intersect(a, b))
    return 1 - both / (F.size(a) + F.size(b) - both)


def _beside(rows: DataFrame, key: str, sets: DataFrame) -> DataFrame:
    """``rows`` with ``own``, the set of ``rep``, and ``theirs``, the set of
    ``key``.  A key of many rows is spread over a task per ``HOT_CLASS`` rows."""
    rows = materialise(rows, "beside")
    parts = materialise(
        rows.groupBy(key).agg(F.ceil(F.count("*") / HOT_CLASS).cast("int").alias("parts")), "parts"
    )
    theirs = sets.withColumnsRenamed({"rep": key, "own": "theirs"}).join(parts, key)
    theirs = theirs.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    placed = looked_up(rows, key, parts).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    return placed.drop("parts").join(sets, "rep").join(theirs, [key, "part"]).drop("part")


def _component_pairs(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of component labels that a bucket's pivot cannot rule out."""
    ratio = (100 - percent) / (100 + percent)
    prefix = F.floor(ratio * (1 + 100 / percent) * F.size("own")).cast("int") + 1
    extra = F.col("extra")
    apart = left.select("pivot", "rep", "label").distinct()
    own_of = materialise(
        _beside(apart, "pivot", sets)
        .withColumn("extra", F.array_sort(F.array_except("own", "theirs")))
        .select(
            "pivot", "rep", "label", F.size("own").alias("n"),
            (F.size(extra) - ratio * F.size("own")).alias("over"), F.slice(extra, F.lit(1), prefix).alias("words"),
        ),
        "pivot-differences",
    )
    sizes = [F.min("n").alias("low"), F.max("n").alias("high")]
    # t <= 0 needs D_x - r |x| + D_y - r |y| <= 0, as min(M_x, M_y) is at most their mean
    within = left.select("key", "pivot", "rep").join(own_of.drop("words"), ["pivot", "rep"])
    keyed = within.groupBy("key", "label").agg(F.min("over").alias("over"), *sizes)
    worded = own_of.select("pivot", "label", "n", F.explode("words").alias("word"))
    worded = worded.groupBy("pivot", "word", "label").agg(*sizes)

    def paired(rows: DataFrame, on: list[str], more: Column) -> DataFrame:
        sized = (100 * F.col("x.high") >= percent * F.col("y.low")) & (100 * F.col("y.high") >= percent * F.col("x.low"))
        same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in on]
        return (
            rows.alias("x").join(rows.alias("y"), same).where((F.col("x.label") < F.col("y.label")) & sized & more)
            .select(F.col("x.label").alias("a"), F.col("y.label").alias("b")).distinct()
        )

    open_ones = keyed.groupBy("key").agg(F.count("*").alias("labels"), F.min("over").alias("least"))
    open_ones = open_ones.where("labels > 1 and least <= 0").select("key")
    return (
        paired(worded, ["pivot", "word"], F.lit(True))
        .unionByName(paired(keyed.join(open_ones, "key"), ["key"], F.col("x.over") + F.col("y.over") <= 0)).distinct()
    )


def _between(pairs: DataFrame, placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of members of the component pairs ``pairs`` (a, b, ca,
    cb, ra, rb, na, nb, apart) that the larger component's centre leaves open.

    That centre is the pivot: only the members y of the smaller component are
    measured against it, those of the larger, x, have been.  So a component of
    many members costs its partners' members, not its own once per partner."""
    far, slack, ratio = 1 - percent / 100, 1e-9, (100 - percent) / (100 + percent)
    to_a = F.col("na") >= F.col("nb")
    sides = pairs.select(
        F.when(to_a, F.col("a")).otherwise(F.col("b")).alias("large"), F.when(to_a, F.col("b")).otherwise(F.col("a")).alias("label"),
        F.when(to_a, F.col("ca")).otherwise(F.col("cb")).alias("centre"),
        F.when(to_a, F.col("ra")).otherwise(F.col("rb")).alias("reach"), "apart",
    )
    sides = materialise(sides, "sides")
    near = placed.select("label", "rep", "r").join(
        F.broadcast(sides) if sides.count() <= MAX_BROADCAST_SIDES else sides, "label"
    ).where(F.col("apart") - F.col("r") - F.col("reach") <= far + slack)
    lacking, lost = F.array_except("own", "theirs"), F.size(F.array_except("theirs", "own"))
    y = materialise(
        _beside(near, "centre", sets)
        .select(
            "large", "rep", "reach", F.size("own").alias("n"), lacking.alias("extra"), lost.alias("m"),
            _distance("own", "theirs").alias("q"),
        )
        .where(F.col("q") - F.col("reach") <= far + slack)
        .withColumn("d", F.size("extra")),
        "shells",
    )
    x = materialise(
        placed.withColumnRenamed("label", "large").join(y.select("large").distinct(), "large", "left_semi")
        .withColumn("d", F.size("extra")),
        "facing",
    )
    # t of the module's docstring is at least (u_x + u_y) / 2 and (v_x + v_y) / 2 - M of either side.
    u, v = F.col("d") - ratio * F.col("n"), F.col("d") + F.col("m") - ratio * F.col("n")
    least = lambda side: side.groupBy("large").agg(F.min(u).alias("u"), F.min(v).alias("v"))
    of_x, of_y = materialise(least(x), "least-of-large"), materialise(least(y), "least-of-small")
    held = x.select("large", F.explode("extra").alias("word")).groupBy("large", "word").agg(F.count("*").alias("held"))
    held = materialise(held.join(y.select("large", F.explode("extra").alias("word")).distinct(), ["large", "word"]), "held-words")

    def worded(side: DataFrame, other: DataFrame, *more: str) -> DataFrame:
        """The words that a pair sharing t words of D needs: the first d - t + 1, the rarest first."""
        bounded = side.join(other.withColumnsRenamed({"u": "ou", "v": "ov"}), "large")
        needed = F.greatest((u + F.col("ou")) / 2, (v + F.col("ov")) / 2 - F.col("m"), F.lit(1.0))
        words = bounded.withColumn("first", F.col("d") - F.ceil(needed - slack) + 1).where("first > 0").select(
            "large", "rep", "n", "d", "m", "first", *more, F.explode("extra").alias("word")
        )
        found = words.join(held, ["large", "word"])
        # Words that no pair shares come first in the order: they hold the places before the found ones.
        shared = found.groupBy("large", "rep", "n", "d", "m", "first", *more).agg(
            F.array_sort(F.collect_list(F.struct("held", "word"))).alias("words")
        )
        placed_at = shared.select("*", F.posexplode("words").alias("at", "w")).withColumn(
            "at", F.col("d") - F.size("words") + F.col("at") + 1
        )
        return placed_at.where("at <= first").select("large", "rep", "n", "d", "m", "at", *more, F.col("w.word").alias("word"))

    shared_least = (F.col("x.d") + F.col("x.m") + F.col("y.d") + F.col("y.m") - ratio * (F.col("x.n") + F.col("y.n"))) / 2
    t = shared_least - F.least("x.m", "y.m") - slack
    sized = (100 * F.col("x.n") >= percent * F.col("y.n")) & (100 * F.col("y.n") >= percent * F.col("x.n"))
    room = F.col("y.q") - F.col("x.r") <= far + slack
    first = lambda c: F.col(f"{c}.at") <= F.col(f"{c}.d") - F.ceil(t) + 1
    sharing = (
        worded(x, of_y, "r").alias("x")
        .join(worded(y, of_x, "q").alias("y"), [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("large", "word")])
        .where((t > 0) & first("x") & first("y") & sized & room)
        .select("x.large", F.col("x.rep").alias("xr"), F.col("y.rep").alias("yr"), t.alias("t")).distinct()
        .join(x.select("large", F.col("rep").alias("xr"), F.col("extra").alias("ex")), ["large", "xr"])
        .join(y.select("large", F.col("rep").alias("yr"), F.col("extra").alias("ey")), ["large", "yr"])
        .where(F.size(F.array_intersect("ex", "ey")) >= F.col("t"))
        .select(F.least("xr", "yr").alias("a"), F.greatest("xr", "yr").alias("b"))
    )
    # t <= 0 is told by the numbers d and n (m follows): each pair of them is compared once.
    numbers = materialise(x.select("large", "d", "n", "m").distinct(), "numbers")
    free = y.drop("extra").join(of_x.select("large", F.col("u").alias("ou")), "large").where(u + F.col("ou") <= 3 * slack)
    chosen = (
        numbers.alias("x").join(free.alias("y"), F.col("x.large") == F.col("y.large")).where((t <= 0) & sized)
        .select("x.large", "x.d", "x.n", F.col("y.rep").alias("other"), "y.q")
    )
    counted = x.drop("extra").join(chosen, ["large", "d", "n"]).where(F.col("q") - F.col("r") <= far + slack).select(
        F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")
    )
    return sharing.unionByName(counted).distinct()


def _across(
    members: DataFrame, pivots: DataFrame, found: DataFrame, reps: DataFrame, docs: DataFrame, shingle: int, percent: int
) -> DataFrame:
    """The pairs (a, b) in different components that neither a bucket's pivot
    nor the components' centres can rule out."""
    named = members.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "key", "rep", F.coalesce("component", "rep").alias("label")
    )
    mixed = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    left = materialise(
        named.join(mixed.where("low <> high").select("key"), "key")
        .join(pivots.select("key", F.col("a").alias("pivot")), "key").where("rep <> pivot"),
        "mixed-buckets",
    )
    ids = materialise(
        left.select("pivot").unionByName(left.select(F.col("rep").alias("pivot"))).distinct().toDF("doc_id"), "pair-ids"
    )
    sets = materialise(_sets(docs, ids, shingle), "shingle-sets")
    joined = materialise(_component_pairs(left, sets, percent), "component-pairs")

    wanted = joined.select("a").union(joined.select("b")).distinct().toDF("label")
    people = left.groupBy("label", "rep").agg(F.count("*").alias("held")).join(wanted, "label")
    centres = people.groupBy("label").agg(
        F.max(F.struct("held", (-F.col("rep")).alias("r"))).alias("top"), F.count("*").alias("n")
    ).select("label", (-F.col("top.r")).alias("centre"), "n")
    centres = materialise(centres, "centres")
    around = looked_up(people.select("label", "rep"), "label", centres.where("n > 1")).where("rep <> centre")
    placed = materialise(
        _beside(around, "centre", sets)
        .select(
            "label", "rep", _distance("own", "theirs").alias("r"), F.array_except("own", "theirs").alias("extra"),
            F.size("own").alias("n"), F.size(F.array_except("theirs", "own")).alias("m"),
        )
        .unionByName(
            centres.select("label", F.col("centre").alias("rep")).join(sets, "rep").select(
                "label", "rep", F.lit(0.0).alias("r"), F.array().cast("array<long>").alias("extra"),
                F.size("own").alias("n"), F.lit(0).alias("m"),
            )
        ),
        "placed",
    )
    described = materialise(
        centres.join(placed.groupBy("label").agg(F.max("r").alias("reach")), "label")
        .join(reps.select(F.col("rep").alias("centre"), "sketch"), "centre").select("label", "centre", "reach", "sketch", "n"),
        "described",
    )
    side = lambda label, c: described.select(
        F.col("label").alias(label), F.col("centre").alias(f"c{c}"), F.col("reach").alias(f"r{c}"), F.col("sketch").alias(f"s{c}"),
        F.col("n").alias(f"n{c}"),
    )
    z = _differing("sa", "sb")
    alike = 1 + SKETCH_BITS / (4 * BANDS * ROWS) * F.log(F.greatest(1 - 2 * z / SKETCH_BITS, F.lit(1e-9)))
    roomy = F.col("ra") + F.col("rb")
    sketched = (
        joined.join(side("a", "a"), "a").join(side("b", "b"), "b")
        .where(alike >= percent / 100 - SKETCH_MARGIN - 2 * roomy).drop("sa", "sb").distinct()
    )
    hopeful = materialise(sketched, "hopeful")
    single = hopeful.where("ra + rb = 0").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"))
    wide = materialise(
        hopeful.where("ra + rb > 0")
        .join(sets.withColumnsRenamed({"rep": "ca", "own": "oa"}), "ca")
        .join(sets.withColumnsRenamed({"rep": "cb", "own": "ob"}), "cb")
        .withColumn("apart", _distance("oa", "ob")).drop("oa", "ob")
        .where(F.col("apart") - F.col("ra") - F.col("rb") <= 1 - percent / 100 + 1e-9),
        "open-components",
    )
    if wide.isEmpty():
        return single.distinct()
    return single.unionByName(_between(wide, placed, sets, percent)).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``.

    Documents are linked when their sets' Jaccard similarity is at least
    ``percent`` / 100; a component is named by its smallest id and ``kept`` says
    whether a row has that id.  A NULL text or one without words has an empty
    set and no link.  Rows with the same id are one document: it is linked if
    one of its texts is, and each row reports its own text's set size.  A row
    with a NULL id is never linked: component NULL, kept true.
    """
    rows = narrow(docs, doc_id=id_col, text=text_col)
    known = rows.where("doc_id is not null")
    marks = materialise(_signatures(rows, shingle), "signatures")
    usable = marks.where("doc_id is not null and n > 0")
    reps = materialise(
        usable.groupBy("set_id").agg(
            F.min("doc_id").alias("rep"), F.count("*").alias("held"), F.first("n").alias("n"),
            F.first("bands").alias("bands"), F.first("sketch").alias("sketch"),
        ),
        "classes",
    )
    repeated = reps.where("held > 1").select("set_id", "rep", "held")
    hot = repeated.where(F.col("held") > HOT_CLASS).select("set_id", F.col("rep").alias("hot"))
    copies = looked_up(usable.select("doc_id", "set_id"), "set_id", hot)
    copies = copies.where("hot is not null").select(F.col("doc_id").alias("a"), F.col("hot").alias("b")).unionByName(
        copies.where("hot is null").join(repeated.where(F.col("held") <= HOT_CLASS), "set_id")
        .select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    ).where("a <> b")

    banded = reps.select(F.explode("bands").alias("key"), "rep", "n")
    shared = banded.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    members = materialise(banded.join(shared, "key"), "bucket-members")
    reach = members.groupBy("rep").agg(F.sum("members").alias("reach"))
    pivots = materialise(members.join(reach, "rep").groupBy("key").agg(
        F.max(F.struct("reach", (-F.col("rep")).alias("r"), "n")).alias("top")
    ).select("key", (-F.col("top.r")).alias("a"), F.col("top.n").alias("na")), "pivots")
    close = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (F.col("a") != F.col("b"))
    stars = materialise(
        members.select("key", F.col("rep").alias("b"), F.col("n").alias("nb")).join(pivots, "key")
        .where(close).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "stars",
    )
    links = materialise(_confirm(stars, reps, known, shingle, percent), "links")

    found = connected_components(links)
    across = _across(members, pivots, found, reps, known, shingle, percent).join(stars, ["a", "b"], "left_anti")
    more = _confirm(materialise(across, "across"), reps, known, shingle, percent)

    named_nodes = connected_components(links.unionByName(more).unionByName(copies))
    return (
        marks.select("doc_id", F.col("n").alias("n_shingles"))
        .join(named_nodes.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
        .select(
            "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
            F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
        )
    )
