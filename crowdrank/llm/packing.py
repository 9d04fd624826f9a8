"""Order-preserving packing of documents into token windows.

The documents, in ascending id order, form one token stream per range
partition.  A dynamic program chooses where the stream is cut into windows of
at most ``window`` tokens: candidates are document ends, sentence ends, and the
places exactly one window after such an end (a cut inside a sentence).  Its
cost is the padding of every window plus a penalty for a cut inside a document
(smaller at a sentence end).  With positions p and cost f,

    f(j) = min over i with 0 < p(j) - p(i) <= window of
           f(i) + window - (p(j) - p(i)) + penalty(j)

so only g(i) = f(i) + p(i) has to be minimal in a sliding range, which a
monotone queue gives in constant time per candidate.  The last, short stretch
of a partition is cut into windows whose lengths are powers of two, which need
no padding.
"""

from __future__ import annotations

import functools
import json
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdrank.llm.common import narrow

WINDOW = 2048
EOS_ID = 1
SENTENCE_PENALTY = 1.0  # cut at a sentence end inside a document, in tokens of padding
INNER_PENALTY = 12.0  # cut inside a sentence
SEGMENT_TOKENS = 1 << 20  # tokens held and solved at a time

PIECE_SCHEMA = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
)


@functools.lru_cache(maxsize=2)
def load_byte_bpe(path: str):
    """(encoding, ids that end a sentence) of a byte-level BPE ``tokenizers``
    file.  In such a file a token's id is its merge rank, which is checked."""
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(b): b for b in plain}
    to_byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {
        bytes(to_byte[c] for c in token): i
        for token, i in spec["model"]["vocab"].items()
        if token not in special
    }
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
    order = [spec["model"]["vocab"][m] for m in merged]
    if any(a >= b for a, b in zip(order, order[1:])):
        raise ValueError(f"{path}: ids do not follow the order of the merges")
    encoding = tiktoken.Encoding(
        "byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special
    )
    ends = np.zeros(max([*ranks.values(), *special.values()]) + 1, dtype=bool)
    for token, i in ranks.items():
        ends[i] = b"\n" in token or token.rstrip().endswith((b".", b"!", b"?"))
    return encoding, ends


def choose_cuts(
    total: int,
    doc_ends: np.ndarray,
    sentence_ends: np.ndarray,
    window: int = WINDOW,
    sentence_penalty: float = SENTENCE_PENALTY,
    inner_penalty: float = INNER_PENALTY,
) -> list[int]:
    """Ends of the windows that cover tokens 0..total, by the dynamic program
    of the module's docstring; the last is ``total``.  Empty stream: none."""
    if total <= 0:
        return []
    kinds = np.full(total + 1, 2, dtype=np.int8)
    kinds[sentence_ends] = 1
    kinds[doc_ends] = 0
    kinds[total] = 0
    natural = np.flatnonzero(kinds[1:] < 2) + 1
    places = np.union1d(natural, natural[:-1] + window)
    places = np.union1d(places, np.arange(window, total, window))
    places = places[places <= total]
    penalty = np.array([0.0, sentence_penalty, inner_penalty])[kinds[places]].tolist()
    at = [0, *places.tolist()]
    cost = [0.0] * len(at)
    back = [0] * len(at)
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])  # (f + position, position, index)
    append, drop_last, drop_first = queue.append, queue.pop, queue.popleft
    for j in range(1, len(at)):
        p = at[j]
        low = p - window
        while queue and queue[0][1] < low:
            drop_first()
        best = queue[0]
        f = best[0] + window - p + penalty[j - 1]
        cost[j] = f
        back[j] = best[2]
        g = f + p
        while queue and queue[-1][0] >= g:
            drop_last()
        append((g, p, j))
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(at[j])
        j = back[j]
    return cuts[::-1]


def powers(rest: int) -> list[int]:
    """``rest`` as falling powers of two."""
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


class _Stream:
    """Tokens of consecutive documents that no window holds yet."""

    def __init__(self, window: int, sentence_penalty: float, inner_penalty: float, base: int):
        self.args = (window, sentence_penalty, inner_penalty)
        self.window, self.next_sequence = window, base
        self.docs: list[tuple] = []  # (doc_id, tokens of the document, ids from ``done`` on, done)
        self.held = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids), ids, 0))
        self.held += len(ids)

    def flush(self, ends: np.ndarray, last: bool) -> pd.DataFrame:
        """Cut what is held; all but the last window leaves (all, at the end)."""
        lengths = np.array([len(d[2]) for d in self.docs], dtype=np.int64)
        edges = np.concatenate([[0], np.cumsum(lengths)])
        total = int(edges[-1])
        tokens = np.concatenate([d[2] for d in self.docs]) if self.docs else np.zeros(0, np.uint32)
        cuts = choose_cuts(total, edges[1:], np.flatnonzero(ends[tokens]) + 1, *self.args)
        if last:
            tail = cuts[-2] if len(cuts) > 1 else 0
            rest = total - tail
            if cuts and rest < self.window:
                cuts = [*cuts[:-1], *(tail + np.cumsum(powers(rest))).tolist()]
        else:
            cuts = cuts[:-1]
        starts = np.array([0, *cuts], dtype=np.int64)
        stop = int(starts[-1])
        marks = np.union1d(starts, edges[edges <= stop])
        rows = []
        for a, b in zip(marks[:-1].tolist(), marks[1:].tolist()):
            k = int(np.searchsorted(edges, a, side="right")) - 1
            s = int(np.searchsorted(starts, a, side="right")) - 1
            doc_id, size, _, done = self.docs[k]
            rows.append((
                doc_id, done + a - int(edges[k]), b - a, size, self.next_sequence + s,
                a - int(starts[s]), tokens[a:b].astype("<u4").tobytes(),
            ))
        self.next_sequence += len(starts) - 1
        k = int(np.searchsorted(edges, stop, side="right")) - 1
        left = self.docs[k:]
        if left:
            doc_id, size, ids, done = left[0]
            cut = stop - int(edges[k])
            left[0] = (doc_id, size, ids[cut:], done + cut)
        self.docs, self.held = left, total - stop
        names = [c.split()[0] for c in PIECE_SCHEMA.split(", ")]
        out = pd.DataFrame(rows, columns=names)
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    eos_id: int = EOS_ID,
    sentence_penalty: float = SENTENCE_PENALTY,
    inner_penalty: float = INNER_PENALTY,
    segment_tokens: int = SEGMENT_TOKENS,
) -> DataFrame:
    """One row per piece of a document in a window (``PIECE_SCHEMA``; ``ids``
    are little-endian unsigned 32-bit integers).

    Every row of ``docs`` is a document of its own, repeated rows and repeated
    or NULL ids included; a NULL or empty text is the end token alone.  Rows
    with equal ids are ordered by a hash of their text.  An empty table gives
    no pieces.  One range shuffle of (id, text) orders the stream; a task holds
    ``segment_tokens`` tokens and one document at a time.
    """
    rows = narrow(docs, doc_id=id_col, text=text_col)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding, ends = load_byte_bpe(tokenizer_path)
        eos = np.array([eos_id], dtype=np.uint32)
        stream = _Stream(
            window, sentence_penalty, inner_penalty, TaskContext.get().partitionId() << 33
        )
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = encoding.encode_to_numpy(text or "", allowed_special="all")
                stream.add(None if pd.isna(doc_id) else int(doc_id), np.concatenate([ids, eos]))
                if stream.held >= segment_tokens:
                    yield stream.flush(ends, last=False)
        yield stream.flush(ends, last=True)

    return ordered.mapInPandas(pack, PIECE_SCHEMA)
