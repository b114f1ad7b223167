"""Operator 4: packing token pieces into near-equal windows by Karmarkar-Karp multiway differencing.

Documents are tokenised and get a closing id. Whole windows of ``capacity`` ids are cut off first; the rest is cut into
pieces of at most ``piece`` ids. Pieces are packed in batches of about ``windows`` windows: every piece starts as a
partial partition (its length and zeros); the two partitions with the largest imbalance are merged so that the largest
parts of one meet the smallest of the other, until one partition is left. If its largest part exceeds the capacity, the
window count rises by one and the batch is packed again. A batch aims at ``slack`` free places a window, which the
differencing nearly always keeps to. The ids left over at the end of a partition, too few for a window, become
sequences whose lengths are powers of two, which need no padding.

Each task packs the documents of its own partition, so nothing is shuffled; memory is one batch of texts and one batch
of pieces, of which a partial partition holds its own parts only. Sequence ids carry the partition's number in their upper bits.

Defined results: a null or empty text has only the closing id; repeated rows are packed each on its own; an empty table
has no pieces; rows with a null doc_id are packed under that null.
"""

from __future__ import annotations

import functools
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envspark.llm.bpe import PLAIN, TOKENIZER, codec
from envspark.llm.common import documents, python_texts

CAPACITY, PIECE, WINDOWS, SLACK, CLOSING = 2048, 512, 256, 4, 1
SCHEMA = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
          "offset bigint")


def differencing(lengths: list[int], k: int) -> np.ndarray:
    """The part, 0 to k-1, of each length: multiway differencing of partial partitions.

    A partition holds its parts that are not empty, largest first, so one of few pieces takes little room however large k is;
    the parts of a merged pair meet as if both had all k (the first's part i the second's part k - 1 - i)."""
    n = len(lengths)
    spread = lambda parts: int(parts[0]) - (int(parts[-1]) if len(parts) == k else 0)
    sums = {i: np.array([length], np.int64) for i, length in enumerate(lengths)}
    heap, made = [(-spread(parts), i) for i, parts in sums.items()], []
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        first, second = sums.pop(a), sums.pop(b)[::-1]
        if len(first) + len(second) <= k:
            parts = np.concatenate([first, second])
            slots = np.concatenate([np.arange(len(first), dtype=np.int32), np.arange(k - len(second), k, dtype=np.int32)])
        else:
            parts, slots = np.zeros(k, np.int64), np.arange(k, dtype=np.int32)
            parts[:len(first)] = first
            parts[k - len(second):] += second
        order = np.argsort(-parts, kind="stable")
        node, parts = n + len(made), parts[order]
        made.append((a, len(first), b, len(second), slots[order]))
        sums[node] = parts
        heapq.heappush(heap, (-spread(parts), node))
    part = np.zeros(n, np.int64)
    # from the last partition down: the window of each part
    window = {heap[0][1]: np.arange(len(sums[heap[0][1]]))} if heap else {}
    at = np.empty(k, np.int64)
    for node in range(n + len(made) - 1, n - 1, -1):
        a, size_a, b, size_b, slots = made[node - n]
        at[slots] = window.pop(node)
        window[a], window[b] = at[:size_a].copy(), at[k - size_b:][::-1].copy()
    for i, own in window.items():
        part[i] = own[0]
    return part


def pack(lengths: list[int], capacity: int) -> tuple[np.ndarray, int]:
    """The window of each piece, and the number of windows: it rises until no window exceeds the capacity."""
    total = sum(lengths)
    k = max(1, -(-total // capacity))
    while True:
        part = differencing(lengths, k)
        if not len(part) or np.bincount(part, lengths, k).max() <= capacity:
            return part, k
        k += 1


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    """text -> ids of the tokenizer file. The fast encoder takes the texts whose characters every Unicode version
    classes alike; the others go to the codec, which splits as the file's own library does."""
    c = codec(path)
    known = {b: i for i, b in enumerate(c.bytes_of) if b and i not in c.special.values()}
    fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens=c.special)

    def ids(text: str) -> np.ndarray:
        if text.isascii() or PLAIN.fullmatch(text):
            return fast.encode_to_numpy(text, allowed_special="all")
        return c.ids(text)

    return ids


class _Packer:
    """Packs the pieces of one partition; rows of finished sequences gather in ``rows``."""

    def __init__(self, capacity: int, piece: int, windows: int, slack: int):
        self.capacity, self.piece, self.slack = capacity, piece, slack
        self.aim = windows * (capacity - slack)  # ids of a full batch
        self.pending: list[tuple] = []  # (doc_id, doc_tokens, start, ids)
        self.waiting = 0
        self.next = TaskContext.get().partitionId() << 40 if TaskContext.get() else 0
        self.rows: list[tuple] = []

    def _emit(self, doc: tuple, offset: int) -> None:
        doc_id, doc_tokens, start, ids = doc
        self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), doc_tokens, self.next, offset))

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, whole = len(ids), len(ids) // self.capacity * self.capacity
        for start in range(0, whole, self.capacity):
            self._emit((doc_id, n, start, ids[start:start + self.capacity]), 0)
            self.next += 1
        for a in range(whole, n, self.piece):  # pieces of many lengths even out better than equal shares
            b = min(n, a + self.piece)
            self.pending.append((doc_id, n, a, ids[a:b].copy()))
            self.waiting += b - a
            if self.waiting >= self.aim:
                self._batch(self._split(self.aim))

    def _split(self, size: int) -> list[tuple]:
        """Takes pieces of ``size`` ids in all from the pending ones; the last is cut where needed."""
        taken, rest = [], size
        while rest:
            doc_id, n, start, ids = self.pending.pop()
            if len(ids) > rest:
                self.pending.append((doc_id, n, start, ids[:-rest]))
                start, ids = start + len(ids) - rest, ids[-rest:]
            taken.append((doc_id, n, start, ids))
            rest -= len(ids)
        self.waiting -= size
        return taken

    def _batch(self, pieces: list[tuple]) -> None:
        part, k = pack([len(p[3]) for p in pieces], self.capacity)
        fill = np.zeros(k, np.int64)
        first = self.next
        for p, w in zip(pieces, part.tolist()):
            self.next = first + w
            self._emit(p, int(fill[w]))
            fill[w] += len(p[3])
        self.next = first + k

    def close(self) -> None:
        whole = self.waiting // (self.capacity - self.slack) * (self.capacity - self.slack)
        if whole:
            self._batch(self._split(whole))
        while self.waiting:
            size, offset = 1 << (self.waiting.bit_length() - 1), 0
            for p in self._split(min(size, self.capacity)):
                self._emit(p, offset)
                offset += len(p[3])
            self.next += 1


def pack_documents(docs: DataFrame, text: str = "text", path: str = TOKENIZER, capacity: int = CAPACITY,
                   piece: int = PIECE, windows: int = WINDOWS, slack: int = SLACK, closing: int = CLOSING) -> DataFrame:
    """One row per piece of every document of ``docs`` (columns of SCHEMA)."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    schema = pa.schema([(c, pa.int64()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end, packer = tokenizer(path), np.array([closing], "<u4"), _Packer(capacity, piece, windows, slack)

        def rows() -> Iterator[pa.RecordBatch]:
            if packer.rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*packer.rows)], schema=schema)
                packer.rows = []

        for batch in batches:
            for doc_id, t in zip(batch.column(0).to_pylist(), python_texts(batch.column(1))):
                packer.add(doc_id, np.concatenate([ids(t), end]))
                if len(packer.rows) >= 50_000:
                    yield from rows()
            yield from rows()
        packer.close()
        yield from rows()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
