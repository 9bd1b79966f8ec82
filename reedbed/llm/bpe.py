"""Encoding of a corpus with a public byte-level BPE tokenizer.

Each pre-token is merged with a hierarchical-bitmap rank queue: the bytes form a linked list, every neighbouring pair whose
merge has a rank waits in the bucket of that rank, a three-level bitmap over the ranks gives the next bucket by find-first-set,
and entries whose pair has changed meanwhile are skipped when they come up. A pre-token of n bytes takes O(n log n) at most,
so very long ones do no harm; results of pre-tokens are kept in a bounded cache of each worker.
"""

from __future__ import annotations

import base64
import heapq
import importlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"
#: Entries of a worker's cache; it is emptied when full.
CACHE_ENTRIES = 400_000


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    """Place of a public vocabulary file."""
    return importlib.import_module("public_tokenizers").path(name)


def pattern() -> str:
    """The pre-token pattern published with the vocabularies."""
    return importlib.import_module("public_tokenizers").PATTERN


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, which is also the id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class RankQueue:
    """Positions by merge rank: buckets under a three-level bitmap of 64-bit words, smallest rank first, leftmost position first."""

    __slots__ = ("buckets", "low", "mid", "top")

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.low: dict[int, int] = {}
        self.mid: dict[int, int] = {}
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heapq.heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        a, b = rank >> 6, rank >> 12
        self.low[a] = self.low.get(a, 0) | 1 << (rank & 63)
        self.mid[b] = self.mid.get(b, 0) | 1 << (a & 63)
        self.top |= 1 << b

    def pop(self) -> tuple[int, int] | None:
        """(rank, position), or None if empty."""
        top = self.top
        if not top:
            return None
        b = (top & -top).bit_length() - 1
        word = self.mid[b]
        a = b << 6 | (word & -word).bit_length() - 1
        word = self.low[a]
        rank = a << 6 | (word & -word).bit_length() - 1
        bucket = self.buckets[rank]
        position = heapq.heappop(bucket)
        if not bucket:
            word &= word - 1
            self.low[a] = word
            if not word:
                word = self.mid[b] & ~(1 << (a & 63))
                self.mid[b] = word
                if not word:
                    self.top &= ~(1 << b)
        return rank, position


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # of the token that starts at a position; 0 once it is swallowed
    before = list(range(-1, n - 1))
    queue = RankQueue()
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            queue.push(rank, i)
    while (item := queue.pop()) is not None:
        rank, i = item
        j = end[i]
        if not j or j >= n:
            continue
        k = end[j]
        if ranks.get(piece[i:k]) != rank:
            continue  # stale: one of the two has grown since
        end[i], end[j] = k, 0
        if k < n:
            before[k] = i
            rank = ranks.get(piece[i : end[k]])
            if rank is not None:
                queue.push(rank, i)
        h = before[i]
        if h >= 0:
            rank = ranks.get(piece[h:k])
            if rank is not None:
                queue.push(rank, h)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


def encoder(path: str) -> Callable[[str | None], list[int]]:
    """A function from text to ids. A null or empty text has no ids; strings like special tokens are ordinary text."""
    ranks = load_ranks(path)
    split = regex.compile(pattern()).findall
    cache: dict[str, list[int]] = {}

    def encode(text: str | None) -> list[int]:
        if not text:
            return []
        ids: list[int] = []
        for word in split(text):
            known = cache.get(word)
            if known is None:
                known = merge_piece(word.encode("utf-8", "surrogatepass"), ranks)
                if len(word) <= 64:
                    if len(cache) >= CACHE_ENTRIES:
                        cache.clear()
                    cache[word] = known
            ids += known
        return ids

    return encode


def spread(df: DataFrame, per_task: int = 2) -> DataFrame:
    """Enough partitions for all cores where a table comes in fewer files; rows are dealt out by a count, so equal and null ids lie as evenly as others."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.withColumn("_deal", F.monotonically_increasing_id()).repartition(cores * per_task, "_deal").drop("_deal")


def _batches(table: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    for batch in table:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def encode_corpus(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id and ids (list of int) of every row, without special tokens; null and empty text both have the empty list.

    Rows are kept as they are: equal ids or texts give equal rows. No shuffle unless the table has fewer partitions than cores.
    """
    path = path or vocabulary_path()

    def work(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in _batches(table):
            offsets, flat = [0], []
            for value in batch.column(1).to_pylist():
                flat += encode(value)
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[doc_id, "ids"])

    rows = spread(documents.select(F.col(doc_id).cast("bigint").alias(doc_id), F.col(text).cast("string").alias(text)))
    return rows.mapInArrow(work, f"{doc_id} bigint, ids array<int>")
