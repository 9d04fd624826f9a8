"""Operator 12: fill-in-the-middle over a piece table.

A document is a list of descriptors (buffer, start, length) over buffers that
never change: its text and the sentinels.  Cutting splits a descriptor,
an arrangement permutes descriptors and puts those of sentinels between them,
and the inverse permutation restores the order; no text is copied until it is
wanted, and a hash reads the stretches one after another.  A text becomes
``<P>prefix<S>suffix<M>middle`` (``psm``) or ``<S>suffix<P>prefix<M>middle``
(``spm``), or stays as it is (``plain``): so do an empty text, a text that
holds a sentinel, and a share of all.  The hash of the key decides all draws,
so a retried task, or another run, gives the same.

Rows never meet: the work is one pass in Arrow batches, no shuffle, and memory
holds one batch of whole texts.

Defined cases: NULL text is empty; a NULL key draws as the empty text; repeated
rows give equal results; an empty table gives no rows; other columns stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crowdrank.llm.common import lean_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = PREFIX + SUFFIX + MIDDLE  # the second buffer
MARK = {PREFIX: 0, SUFFIX: 3, MIDDLE: 6}  # a sentinel's place in it
TEXT_BUFFER, MARK_BUFFER = 0, 1
#: What follows what, per form: a sentinel, then the part it announces.  Parts
#: are numbered as in the text: prefix 0, middle 1, suffix 2.
ARRANGEMENTS = {
    "psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)),
    "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1)),
}
PLAIN = "plain"

Piece = tuple[int, int, int]  # buffer, start, length (code points)


@dataclass(frozen=True)
class Draws:
    """How often texts are cut: ``rate`` of 100 at all, ``spm`` of 100 of them
    suffix first; ``seed`` starts the hashed name."""

    rate: int = 90
    spm: int = 20
    seed: str = "1"

    def of(self, key: str) -> list[int]:
        digest = hashlib.sha256(f"{self.seed}:{key}".encode()).hexdigest()
        return [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]


class PieceTable:
    """Descriptors over immutable buffers."""

    def __init__(self, buffers: Sequence[str], pieces: list[Piece]):
        self.buffers, self.pieces = buffers, pieces

    @classmethod
    def of(cls, text: str) -> PieceTable:
        return cls((text, SENTINELS), [(TEXT_BUFFER, 0, len(text))])

    def cut(self, at: int) -> None:
        """Split the descriptor that covers unit ``at``, or the last one at its
        end (one side may be empty)."""
        for k, (buffer, start, length) in enumerate(self.pieces):
            if at < length or k == len(self.pieces) - 1:
                self.pieces[k:k + 1] = [(buffer, start, at), (buffer, start + at, length - at)]
                return
            at -= length

    def arrange(self, form: str) -> PieceTable:
        """The three parts in the form's order, each behind its sentinel."""
        out = []
        for mark, part in ARRANGEMENTS[form]:
            out += [(MARK_BUFFER, MARK[mark], len(mark)), self.pieces[part]]
        return PieceTable(self.buffers, out)

    @classmethod
    def parse(cls, output: str, form: str) -> PieceTable:
        """The table of a finished output: a descriptor per part, in the text's
        order.  A part holds no sentinel and each sentinel starts with ``<``,
        so the first match from the left is the one that was put there."""
        if form == PLAIN:
            return cls.of(output)
        order = ARRANGEMENTS[form]
        starts, at = [], 0
        for mark, _ in order:
            at = output.index(mark, at) + len(mark)
            starts.append(at)
        ends = [start - len(mark) for (mark, _), start in zip(order[1:], starts[1:])] + [len(output)]
        parts = [(TEXT_BUFFER, start, end - start) for start, end in zip(starts, ends)]
        inverse = sorted(range(len(order)), key=lambda k: order[k][1])
        return cls((output, SENTINELS), [parts[k] for k in inverse])

    def stretches(self) -> Iterator[str]:
        for buffer, start, length in self.pieces:
            yield self.buffers[buffer][start:start + length]

    def text(self) -> str:
        return "".join(self.stretches())

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for stretch in self.stretches():
            digest.update(stretch.encode())
        return digest.hexdigest()


def arranged(text: str, key: str, draws: Draws) -> tuple[str, int | None, int | None, PieceTable]:
    """(form, prefix length, middle length, descriptors) of one text."""
    table = PieceTable.of(text)
    h1, h2, h3, h4 = draws.of(key)
    if not text or any(mark in text for mark in MARK) or h3 % 100 >= draws.rate:
        return PLAIN, None, None, table
    n = len(text)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    form = "spm" if h4 % 100 < draws.spm else "psm"
    table.cut(low)
    table.cut(high)
    return form, low, high - low, table.arrange(form)


FIM = (
    "n long, form string, prefix_chars long, middle_chars long, "
    "pieces array<struct<buffer:int,start:long,length:long>>, sha256 string, output string"
)


def fill_in_middle(
    df: DataFrame, draws: Draws = Draws(), id_col: str = "doc_id", text_col: str = "text", result_col: str = "fim"
) -> DataFrame:
    """``df`` with a struct ``result_col``: code points, form, lengths of
    prefix and middle (NULL if plain), the descriptors, the hash read along
    them and the text they spell.  A column of that name is replaced."""
    lean_batches(df.sparkSession)

    @F.pandas_udf(FIM)
    def transform(texts: pd.Series, keys: pd.Series) -> pd.DataFrame:
        rows = []
        for text, key in zip(texts, keys):
            form, prefix, middle, table = arranged(text, key, draws)
            rows.append((len(text), form, prefix, middle, table.pieces, table.sha256(), table.text()))
        out = pd.DataFrame(
            rows, columns=["n", "form", "prefix_chars", "middle_chars", "pieces", "sha256", "output"]
        )
        return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    empty = F.lit("")
    return df.withColumn(
        result_col, transform(F.coalesce(df[text_col], empty), F.coalesce(df[id_col].cast("string"), empty))
    )


@F.pandas_udf(T.StringType())
def restored_sha256(outputs: pd.Series, forms: pd.Series) -> pd.Series:
    """Hash of the text that an output and its form give back, read along the
    descriptors in their restored order."""
    return pd.Series([PieceTable.parse(o, f).sha256() for o, f in zip(outputs, forms)], dtype=object)


@F.pandas_udf(T.StringType())
def restore(outputs: pd.Series, forms: pd.Series) -> pd.Series:
    """The text that an output and its form give back."""
    return pd.Series([PieceTable.parse(o, f).text() for o, f in zip(outputs, forms)], dtype=object)


def piece_text(text: Column, pieces: Column) -> Column:
    """The text that descriptors spell, as a native expression."""
    buffers = F.array(F.coalesce(text, F.lit("")), F.lit(SENTINELS))
    return F.array_join(
        F.transform(pieces, lambda p: F.substring(
            F.element_at(buffers, p["buffer"] + 1), (p["start"] + 1).cast("int"), p["length"].cast("int")
        )), "",
    )
