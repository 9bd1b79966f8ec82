"""Filling fixed-capacity containers with documents that lie near each other on a space-filling curve.

The tokens of a document are hashed into a vector, the vector is projected to a few dimensions, and its cell on a Hilbert curve is the
document's place in one line. The line is range-sorted and cut into stretches; each stretch is packed on its own, neighbours first:
windows of consecutive documents go by falling size into the fullest open container that still takes them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reedbed.llm.bpe import _batches, encoder, spread, vocabulary_path
from reedbed.session import materialise

WIDTH, DIMENSIONS, BITS = 512, 4, 10


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of rows of non-negative integers below 2**bits (transpose method, vectorised over rows)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | x[i] >> b & 1
    return key


def _projected(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Cells (rows x DIMENSIONS) of documents given as token ids one after another."""
    n = len(offsets) - 1
    mixed = (flat.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    slot = (mixed >> np.uint64(40)).astype(np.int64) % WIDTH
    sign = np.where((mixed >> np.uint64(33)) & np.uint64(1), 1.0, -1.0)
    row = np.repeat(np.arange(n), np.diff(offsets))
    vectors = np.bincount(row * WIDTH + slot, sign, minlength=n * WIDTH).reshape(n, WIDTH)
    vectors = np.sign(vectors) * np.sqrt(np.abs(vectors))
    norm = np.linalg.norm(vectors, axis=1)
    vectors /= np.where(norm > 0, norm, 1.0)[:, None]
    direction = np.random.default_rng(7).normal(size=(WIDTH, DIMENSIONS))
    y = vectors @ direction  # about standard normal
    spread_ = 1 / (1 + np.exp(-1.702 * y))
    return np.minimum((spread_ * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def placed_documents(documents: DataFrame, doc_id: str, text: str, path: str | None = None) -> DataFrame:
    """doc, size (tokens), key (place on the curve) of every row with at least one token."""
    path = path or vocabulary_path()

    def work(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in _batches(table, 1000):
            offsets, flat = [0], []
            for value in batch.column(1).to_pylist():
                flat += encode(value)
                offsets.append(len(flat))
            ends = np.array(offsets)
            key = hilbert_key(_projected(np.array(flat, dtype=np.int64), ends), BITS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends), pa.int64()), pa.array(key, pa.int64())], names=["doc", "size", "key"])

    rows = spread(documents.select(F.col(doc_id).cast("bigint").alias(doc_id), F.col(text).cast("string").alias(text)))
    return rows.mapInArrow(work, "doc bigint, size bigint, key bigint").where("size > 0")


class _Packer:
    """Best fit over open containers: a bit for each remaining capacity that some open container has."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next, self.mask = capacity, first, 0
        self.open: dict[int, list[int]] = {}

    def put(self, size: int) -> int:
        fits = self.mask >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            container = self.open[left].pop()
            if not self.open[left]:
                self.mask &= ~(1 << left)
        else:
            left, container = self.capacity, self.next
            self.next += 1
        left -= size
        if left:
            self.open.setdefault(left, []).append(container)
            self.mask |= 1 << left
        return container

    def close(self, before: int) -> None:
        """Containers numbered below ``before`` take nothing more."""
        for left, containers in list(self.open.items()):
            kept = [c for c in containers if c >= before]
            if kept:
                self.open[left] = kept
            else:
                del self.open[left]
                self.mask &= ~(1 << left)


def packed_line(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, path: str | None = None, stretch: int = 20_000, window: int = 500, keep: int = 3
) -> DataFrame:
    """container, doc_id, piece, tokens, place: as ``pack``, with the tokens that lie in the container and the place of the document in the line of its stretch."""
    items = materialise(placed_documents(documents, doc_id, text, path), "sizes")  # cuts the lineage: the packing below is deterministic over it
    total = items.count()
    stretches = max(1, -(-total // stretch))
    placed = items.withColumn("tie", F.xxhash64("doc", "size"))
    line = placed.repartitionByRange(stretches, "key", "tie", "doc").sortWithinPartitions("key", "tie", "doc")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = TaskContext.get().partitionId() << 40
        packer, at, starts = _Packer(capacity, first), 0, []
        for pdf in batches:
            docs, sizes = pdf["doc"].to_numpy(), pdf["size"].to_numpy()
            for start in range(0, len(docs), window):
                starts.append(packer.next)
                if len(starts) > keep:
                    packer.close(starts[-1 - keep])
                out: list[tuple[int, int, int | None, int, int]] = []
                rest = []
                for doc, size in zip(docs[start : start + window].tolist(), sizes[start : start + window].tolist(), strict=True):
                    whole = size // capacity if size > capacity else 0
                    for piece in range(whole):
                        out.append((packer.put(capacity), doc, piece, capacity, first + at))
                    left = size - whole * capacity
                    if left:
                        rest.append((left, doc, whole if whole else None, first + at))
                    at += 1
                rest.sort(key=lambda x: -x[0])
                out += [(packer.put(size), doc, piece, size, place) for size, doc, piece, place in rest]
                frame = pd.DataFrame(out, columns=["container", doc_id, "piece", "tokens", "place"])
                yield frame.astype({"container": "int64", doc_id: "int64", "piece": "Int32", "tokens": "int64", "place": "int64"})

    return line.select("doc", "size").mapInPandas(work, f"container bigint, {doc_id} bigint, piece int, tokens bigint, place bigint")


def pack(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, path: str | None = None, **options) -> DataFrame:
    """container, doc_id, piece: which container holds each document; piece (from 0) only where a document exceeds the capacity.

    Documents without tokens (null or empty text) are left out. A document of up to ``capacity`` tokens is never split; a longer one
    fills containers of its own with whole pieces and its rest is packed like a document. Rows with equal doc_id are packed each for
    itself. A stretch has about ``stretch`` documents whatever the table's size; a key that many documents share is cut at a
    hash of their ids. A container takes documents of the window in which it was opened and of the ``keep`` - 1 next ones, so what it holds lies within ``keep`` windows of the curve.
    Container numbers are unique, not consecutive. An empty table gives no rows.
    """
    return packed_line(documents, doc_id, text, capacity, path, **options).select("container", doc_id, "piece")


def packing_quality(line: DataFrame, capacity: int) -> DataFrame:
    """One row of packed_line: containers, tokens, fill, over (containers above the capacity), reach (mean distance along the curve, in documents, from a container's first to its last), reach_random (the same if
    the containers of a stretch were filled in any order: the mean of n random places of it spans (n - 1) / (n + 1) of the stretch)."""
    per = line.groupBy("container").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"), (F.max("place") - F.min("place")).alias("reach"), F.shiftright("container", 40).alias("stretch"))
    length = line.groupBy(F.shiftright("container", 40).alias("stretch")).agg((F.max("place") - F.min("place")).alias("length"))
    j = per.join(length, "stretch")
    return j.agg(
        F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), (F.sum("tokens") / (F.count(F.lit(1)) * capacity)).alias("fill"),
        F.count(F.when(F.col("tokens") > capacity, 1)).alias("over"), F.avg("reach").alias("reach"), F.avg(F.col("length") * (F.col("n") - 1) / (F.col("n") + 1)).alias("reach_random"),
    )
