"""Document fingerprints of closed syncmers, in DataFrame functions only.

Every window of ``WINDOW`` characters, one from each position of the text, holds
``WINDOW - INNER + 1`` inner substrings of ``INNER`` characters; the window is
chosen when the smallest hash among them lies at an edge.  The choice depends on
the window alone, so two texts choose the same windows wherever they agree, with
or without white space.  The chosen windows' hashes with their positions are the
anchors (``with_char_anchors``).  Of ``WINDOW - INNER`` windows in a row at least
one is chosen.

``with_anchors`` does the same over units, pieces of at most ``UNIT`` characters
between white space, in windows of ``K`` units with inner substrings of ``S``.  In
text without white space its units shift with every inserted character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdrank.llm.common import narrow

WINDOW = 32
INNER = 8
#: A look-ahead group yields the substring at every character; not between the halves of a surrogate pair.
EACH_INNER = rf"(?s)(?![\x{{DC00}}-\x{{DFFF}}])(?=(.{{{INNER}}}))"
UNIT = 8
K = 6
S = 2
NULL_BUCKETS = 1024
ROWS_PER_BUCKET = 512  # documents of a stretch of ids that a window function holds


def with_anchors(df: DataFrame, text: str, name: str, unit: int = UNIT, k: int = K, s: int = S) -> DataFrame:
    """``df`` with ``name``: array of (position, anchor), by position, of the
    whole text in column ``text``.  In a text without a chosen window, as in any
    of fewer than ``k`` units, each unit makes one anchor; NULL, empty and blank
    texts have none.

    The unit and inner hashes are columns of their own, which the positions
    then look up; each is used several times, so Spark does not fold them back
    into the position functions.
    """
    h, g, c = f"{name}_units", f"{name}_inner", f"{name}_chosen"
    if s < 1 or k <= s:
        raise ValueError("a window must hold more units than its inner substrings")
    w = k - s + 1
    units = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(rf"(\S{{1,{unit}}})"), F.lit(1))
    df = df.withColumn(h, F.transform(units, lambda u: F.xxhash64(u)))
    inner = F.col(h)
    for j in range(1, s):
        inner = F.zip_with(inner, F.slice(F.col(h), F.lit(j + 1), F.size(h)), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn(g, inner)
    n = F.size(h)
    edge = lambda i: F.least(F.get(F.col(g), i), F.get(F.col(g), i + F.lit(w - 1)))
    chosen = F.filter(
        F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))),
        lambda i: F.array_min(F.slice(F.col(g), i + F.lit(1), F.lit(w))) == edge(i),
    )
    df = df.withColumn(c, F.when(n >= k, chosen).otherwise(F.array().cast("array<int>")))
    anchors = F.transform(
        F.col(c), lambda i: F.struct(i.alias("pos"), F.xxhash64(F.slice(F.col(h), i + F.lit(1), F.lit(k))).alias("anchor"))
    )
    units_alone = F.transform(F.col(h), lambda u, i: F.struct(i.alias("pos"), F.xxhash64(u).alias("anchor")))
    found = F.when(F.size(c) > 0, anchors).otherwise(units_alone)
    return df.withColumn(name, found).drop(h, g, c)


def with_char_anchors(df: DataFrame, text: str, name: str, whole: Column | None = None) -> DataFrame:
    """``df`` with ``name``: array of (position, anchor), by position in code
    points, of the whole text in column ``text``.  In a text without a chosen
    window, as in any of fewer than ``WINDOW`` characters, each inner substring
    is an anchor, or the text itself if it has none; where ``whole`` is false,
    there are none then.  NULL and empty texts have none.

    The minima of 2, 4, 8 and 16 inner hashes in a row are columns of their own
    for the reason given in ``with_anchors``; two runs of 16 cover a window.
    """
    g, low, c = f"{name}_inner", f"{name}_low", f"{name}_chosen"
    w = WINDOW - INNER + 1
    given = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn(g, F.transform(F.regexp_extract_all(given, F.lit(EACH_INNER), F.lit(1)), lambda u: F.xxhash64(u)))
    df, held = df.withColumn(low, F.col(g)), 1
    while 2 * held <= w:
        beyond = F.slice(F.col(low), F.lit(held + 1), F.size(low))
        df, held = df.withColumn(low, F.zip_with(low, beyond, lambda a, b: F.least(a, b))), 2 * held
    at = lambda column, i: F.get(F.col(column), i)
    chosen = F.filter(
        F.sequence(F.lit(0), F.greatest(F.size(g) - w, F.lit(0))),
        lambda i: F.least(at(low, i), at(low, i + F.lit(w - held)))
        == F.least(at(g, i), at(g, i + F.lit(w - 1))),
    )
    df = df.withColumn(c, F.when(F.size(g) >= w, chosen).otherwise(F.array().cast("array<int>")))
    anchors = F.transform(
        F.col(c), lambda i: F.struct(i.alias("pos"), F.xxhash64(F.slice(F.col(g), i + F.lit(1), F.lit(w))).alias("anchor"))
    )
    inner_alone = F.transform(F.col(g), lambda x, i: F.struct(i.alias("pos"), x.alias("anchor")))
    text_alone = F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64(given).alias("anchor")))
    none = (F.length(given) == 0) if whole is None else (F.length(given) == 0) | ~whole
    found = (
        F.when(F.size(c) > 0, anchors)
        .when(none, F.slice(text_alone, 1, 0))
        .when(F.size(g) > 0, inner_alone)
        .otherwise(text_alone)
    )
    return df.withColumn(name, found).drop(g, low, c)


def _with_edited_anchors(df: DataFrame) -> DataFrame:
    """``df`` with ``edited_anchors``, the anchors of column ``edited``: the
    first ``kept`` characters of ``text`` and then the first ``added`` of another
    text.  A window inside either part is chosen as it is in the text that the
    part is from, so only the windows across the seam are looked for again.  A
    part of less than two windows is looked through as a whole, as the text it
    is from may have no chosen window."""
    before, after = F.col("kept") >= 2 * WINDOW, F.col("added") >= 2 * WINDOW
    df = df.withColumn("begin", F.when(before, F.col("kept") - (WINDOW - 1)).otherwise(F.lit(0)))
    until = F.col("kept") + F.when(after, F.lit(WINDOW - 1)).otherwise(F.col("added"))
    df = df.withColumn("seam", F.col("edited").substr(F.col("begin") + 1, until - F.col("begin")))
    df = with_char_anchors(df, "seam", "seam_anchors", whole=~(before | after))
    inside = lambda anchors, n: F.filter(F.col(anchors), lambda a: a["pos"] + F.lit(WINDOW) <= F.col(n))
    moved = lambda anchors, by: F.transform(
        anchors, lambda a: F.struct((a["pos"] + F.col(by)).alias("pos"), a["anchor"].alias("anchor"))
    )
    none = F.slice(F.col("seam_anchors"), 1, 0)
    return df.withColumn(
        "edited_anchors",
        F.concat(
            F.when(before, inside("anchors", "kept")).otherwise(none),
            moved(F.col("seam_anchors"), "begin"),
            F.when(after, moved(inside("next_anchors", "added"), "kept")).otherwise(none),
        ),
    ).drop("begin", "seam", "seam_anchors")


def likeness(a: Column, b: Column) -> Column:
    """Twice the shared distinct anchors by the distinct anchors of both, 0 to
    1; two texts without anchors are alike (1)."""
    x, y = F.array_distinct(a["anchor"]), F.array_distinct(b["anchor"])
    total = F.size(x) + F.size(y)
    return F.when(total == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / total)


def fingerprint_text(anchors: Column) -> Column:
    """The anchors' low 32 bits in hexadecimal, in the order of the text."""
    return F.array_join(
        F.transform(anchors["anchor"], lambda a: F.lower(F.lpad(F.hex(a.bitwiseAND(0xFFFFFFFF)), 8, "0"))), ""
    )


def _next_buckets(firsts: DataFrame) -> DataFrame:
    """(bucket, following): the next bucket that has rows; after the last, the
    first.  Stretches of 512 buckets first, then their ends: the only window
    over all rows sees one row per 262,144 documents."""
    spread = firsts.select("bucket", F.floor(F.col("bucket") / 512).alias("stretch"))
    inside = spread.withColumn(
        "following", F.lead("bucket").over(Window.partitionBy("stretch").orderBy("bucket"))
    )
    ends = spread.groupBy("stretch").agg(F.min("bucket").alias("head"))
    ordered = Window.orderBy("stretch")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "stretch", F.coalesce(F.lead("head").over(ordered), F.min("head").over(whole)).alias("beyond")
    )
    return inside.join(ends, "stretch").select("bucket", F.coalesce("following", "beyond").alias("following"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, text, edited, anchors, edited_anchors,
    next_anchors.

    The edited text has its last floor(n_chars / 2) code points replaced by the
    first as many of the next document in ascending id (after the last: the
    first).  NULL texts are empty.  Rows with the same id follow each other by
    a hash of their text.  A NULL id has no place in the order: its next
    document is the first (none, if no row has an id).  A single document is its
    own next.  Texts are
    shuffled once, by stretches of ids sized so that a window function holds
    about ``ROWS_PER_BUCKET`` documents.
    """
    rows = narrow(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    bounds = rows.agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("doc_id").alias("n")
    ).first()
    low, count = bounds["low"] or 0, max(bounds["n"], 1)
    width = max(1, -(-((bounds["high"] or 0) - low + 1) * ROWS_PER_BUCKET // count))
    # A NULL id has a bucket below 0, by its text; the first document follows.
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn(
        "bucket",
        F.coalesce(
            F.floor((F.col("doc_id") - F.lit(low)) / F.lit(width)), -1 - F.pmod("tie", F.lit(NULL_BUCKETS))
        ).cast("long"),
    )
    placed = rows.where("doc_id is not null")
    firsts = placed.groupBy("bucket").agg(F.min(F.struct("doc_id", "tie", "text")).alias("first"))
    firsts = with_char_anchors(firsts.select("bucket", F.col("first.text").alias("head_text")), "head_text", "head_anchors")
    lost = rows.where("doc_id is null").select("bucket", F.lit(0).cast("long").alias("following")).distinct()
    heads = _next_buckets(firsts.select("bucket")).unionByName(lost).join(
        firsts.select(F.col("bucket").alias("following"), "head_text", "head_anchors"), "following"
    ).drop("following")
    # One shuffle of the texts: the window and the join keep its buckets.
    own = with_char_anchors(rows.repartition("bucket"), "text", "anchors")
    after = F.lead(F.struct("text", "anchors")).over(Window.partitionBy("bucket").orderBy("doc_id", "tie"))
    joined = own.withColumn("after", F.when(F.col("doc_id").isNotNull(), after)).join(heads, "bucket", "left").select(
        "doc_id", "text", "anchors", F.length("text").cast("long").alias("n_chars"),
        F.coalesce("after.text", "head_text").alias("next_text"),
        F.coalesce("after.anchors", "head_anchors").alias("next_anchors"),
    )
    n = F.col("n_chars").cast("int")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = (
        joined.withColumn("kept", n - half)
        .withColumn("addition", F.coalesce(F.col("next_text"), F.lit("")).substr(F.lit(1), half))
        .withColumn("added", F.length("addition"))
        .withColumn("edited", F.concat(F.col("text").substr(F.lit(1), F.col("kept")), F.col("addition")))
    )
    return _with_edited_anchors(edited).drop("next_text", "addition", "kept", "added")
