"""Byte-level BPE over a corpus with one global shuffle of distinct words.

1. Every task splits its texts into pre-tokens, in blocks of at most
   ``block_tokens`` of them.  A block keeps, per document, the positions as an
   array of word numbers (position i holds the number of the i-th pre-token),
   a dictionary of its distinct words, and the numbers of the dictionary's words.  This is the exploded (document,
   position, word) relation in columnar form: a word crosses the network once
   per block and not once per occurrence.
2. The dictionaries are shuffled by a hash of the word; the task that owns a
   word encodes it once for the whole corpus.
3. The ids are joined back to their block, and each document is put together
   by position.

The positions are written as a table bucketed by block, so joining the ids back
shuffles the ids only.  Decoding joins ids to the table of token bytes (one row
per vocabulary entry, so its size is bounded by the vocabulary file).
"""

from __future__ import annotations

import base64
import functools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdrank.llm.common import narrow
from crowdrank.session import scratch_path

BLOCK_TOKENS = 2_000_000
KNOWN_WORDS = 1_000_000  # encoded words that a task remembers; beyond, it starts anew (the ids are the same)

_BLOCK_SCHEMA = "block long, doc_id long, n long, codes binary, bucket int, words binary, sizes binary, numbers binary"


@functools.lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _planes(values: np.ndarray) -> bytes:
    """32-bit numbers as four byte planes: the high ones compress to nothing."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


class _Numbers(dict):
    """word → number, in order of first appearance."""

    def __missing__(self, word):
        number = self[word] = len(self)
        return number


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in _BLOCK_SCHEMA.split(", ")])
    for c in ("doc_id", "n"):
        out[c] = out[c].astype("Int64")
    out["bucket"] = out["bucket"].astype("Int32")
    return out


def _block_rows(
    block: int, ids: list, arrays: list, numbers: _Numbers, buckets: int
) -> Iterator[pd.DataFrame]:
    """The rows of one block: its documents' positions, its dictionary's parts."""
    uses = np.zeros(len(numbers), np.int64)
    for codes in arrays:
        np.add.at(uses, codes, 1)
    rank = np.empty(len(numbers), dtype=np.int32)  # frequent words get small numbers
    rank[np.argsort(-uses, kind="stable")] = np.arange(len(numbers), dtype=np.int32)
    chunk = 1024
    for k in range(0, len(ids), chunk):
        yield _frame([
            (block, doc_id, len(codes), _planes(rank[codes]), None, None, None, None)
            for doc_id, codes in zip(ids[k:k + chunk], arrays[k:k + chunk])
        ])
    raws = [word.encode() for word in numbers]
    numbers.clear()
    bucket_of = np.fromiter((zlib.crc32(raw) % buckets for raw in raws), np.int32, len(raws))
    for bucket in np.unique(bucket_of).tolist():
        part = sorted(np.flatnonzero(bucket_of == bucket).tolist(), key=raws.__getitem__)
        yield _frame([(
            block, None, None, None, bucket, b"".join([raws[n] for n in part]),
            _planes(np.array([len(raws[n]) for n in part])), None,
        ), (block, None, None, None, bucket, None, None, _planes(rank[part]))])


def encode_corpus(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_tokens: int = BLOCK_TOKENS,
    word_buckets: int | None = None,
) -> DataFrame:
    """(doc_id, n_tokens, ids): the ids of every row's whole text as
    little-endian unsigned 32-bit integers.

    Equal to encoding each match of ``pattern`` by itself.  A NULL or empty
    text has no ids; repeated rows and repeated or NULL ids give a row each;
    an empty table gives no rows.  ``word_buckets``, the parts of the dictionary
    and so the tasks that encode, follow the session's shuffle partitions, which
    follow the input's size.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    word_buckets = max(64, parts) if word_buckets is None else word_buckets
    rows = narrow(docs, doc_id=id_col, text=text_col)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex

        find = regex.compile(pattern).findall
        block = TaskContext.get().partitionId() << 24
        ids, arrays, numbers, held = [], [], _Numbers(), 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                words = find(text) if text else []
                arrays.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                held += len(words)
                if held >= block_tokens:
                    yield from _block_rows(block, ids, arrays, numbers, word_buckets)
                    block, ids, arrays, numbers, held = block + 1, [], [], _Numbers(), 0
        if ids:
            yield from _block_rows(block, ids, arrays, numbers, word_buckets)

    table = f"bpe_blocks_{uuid.uuid4().hex}"
    (rows.mapInPandas(split, _BLOCK_SCHEMA)
         .write.option("path", scratch_path(spark, table)).option("compression", "zstd")
         .bucketBy(parts, "block").saveAsTable(table))
    blocks = spark.table(table)
    # The frame knows the files and their buckets by now; only the catalogue forgets them.
    spark.sql(f"DROP TABLE {table}")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        bpe = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=load_ranks(ranks_path), special_tokens={}
        ).encode_ordinary
        known: dict[bytes, list[int]] = {}  # this task's share of the corpus' distinct words
        for batch in batches:
            out = []
            for block, bucket, words, sizes in zip(
                batch["block"], batch["bucket"], batch["words"], batch["sizes"]
            ):
                counts, flat, start = [], [], 0
                for size in _unplanes(sizes).tolist():
                    word = words[start:start + size]
                    start += size
                    got = known.get(word)
                    if got is None:
                        if len(known) >= KNOWN_WORDS:
                            known.clear()
                        got = known[word] = bpe(word.decode())
                    counts.append(len(got))
                    flat += got
                out.append((block, bucket, _planes(np.array(counts)), _planes(np.array(flat))))
            yield pd.DataFrame(out, columns=["block", "bucket", "counts", "ids"])

    encoded = (
        blocks.where("words is not null").select("block", "bucket", "words", "sizes")
        .repartition(parts, "bucket")
        .mapInPandas(encode, "block long, bucket int, counts binary, ids binary")
    )

    def assemble(positions: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        of_block = positions[positions["codes"].isna()].set_index("bucket")["numbers"]
        numbers = [_unplanes(of_block[bucket]) for bucket in words["bucket"]]
        positions = positions[positions["codes"].notna()]
        counts = [_unplanes(x).astype(np.int64) for x in words["counts"]]
        size = sum(map(len, numbers))
        count = np.zeros(size, np.int64)
        first = np.zeros(size, np.int64)  # where a word's ids begin in ``flat``
        base = 0
        for number, c in zip(numbers, counts):
            count[number] = c
            first[number] = base + np.cumsum(c) - c
            base += int(c.sum())
        flat = np.concatenate([_unplanes(x) for x in words["ids"]]) if len(words) else np.zeros(0, "<u4")
        out = []
        for doc_id, codes in zip(positions["doc_id"], positions["codes"]):
            code = _unplanes(codes)
            each = count[code]
            ends = np.cumsum(each)
            total = int(ends[-1]) if len(ends) else 0
            place = np.repeat(first[code] - (ends - each), each) + np.arange(total)
            out.append((None if pd.isna(doc_id) else int(doc_id), total, flat[place].astype("<u4").tobytes()))
        made = pd.DataFrame(out, columns=["doc_id", "n_tokens", "ids"])
        made["doc_id"] = made["doc_id"].astype("Int64")
        return made

    positions = blocks.where("codes is not null or numbers is not null").select(
        "block", "doc_id", "codes", "bucket", "numbers"
    )
    return (
        positions.groupBy("block").cogroup(encoded.groupBy("block"))
        .applyInPandas(assemble, "doc_id long, n_tokens long, ids binary")
    )


def decode_ids(rows: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """``rows`` with a ``decoded`` binary column: the bytes of the ids' tokens
    in order (NULL ids: NULL), through the table of token bytes."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ranks = load_ranks(ranks_path)
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            size[i] = len(token)
        first = np.cumsum(size) - size
        table = np.frombuffer(b"".join(sorted(ranks, key=ranks.get)), np.uint8)
        for batch in batches:
            out = []
            for data in batch:
                if data is None:
                    out.append(None)
                    continue
                ids = np.frombuffer(data, "<u4")
                each = size[ids]
                ends = np.cumsum(each)
                total = int(ends[-1]) if len(ends) else 0
                out.append(table[np.repeat(first[ids] - (ends - each), each) + np.arange(total)].tobytes())
            yield pd.Series(out, dtype=object)

    return rows.withColumn("decoded", decode(F.col(ids_col)))
