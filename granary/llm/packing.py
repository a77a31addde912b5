"""Packing tokenised documents into sequences by Karmarkar-Karp multiway differencing.

Packing needs no shuffle: each task tokenises its rows, cuts off whole windows of long documents, and
gathers the remaining pieces until they fill about GROUP windows. One group is then partitioned into
k = ceil(total / capacity) windows: each piece starts as a partial partition, and the two partitions with
the widest spread are merged, fullest window onto emptiest, until one is left. Where a window exceeds the
capacity, k rises by one and the group is partitioned again. Where k would rise past the padding bound (pieces
just over half a window can't share one), the pieces are cut in halves first. Memory is bounded by one group
and one slice of texts. A lost task repeats with the rows it reads: sequence ids are the same where these come
in the same order, as they do from files."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import textvec as tv

#: Tokens of a sequence, id that ends a document, windows of a group, most padding of a group (share of its
#: tokens, beyond the last window's) before pieces are cut, and the length they aren't cut below.
CAPACITY, END_ID, GROUP, PADDING, SHORTEST = 4096, 2, 128, 0.04, 64


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of ``sizes`` in k windows with near-equal sums, by Karmarkar-Karp multiway differencing.

    A partial partition is its k window sums in ascending order and, per window, a chain of pieces; equal
    spreads are taken in input order."""
    if k == 1:
        return [list(range(len(sizes)))]
    heap = []
    for i, s in enumerate(sizes):
        sums = np.zeros(k, np.int64)
        sums[-1] = s
        items = np.full(k, -1, np.int64)
        items[-1] = i
        heap.append((-s, i, sums, items))
    heapq.heapify(heap)
    joined: list[tuple[int, int]] = []  # node len(sizes) + j stands for the union of two nodes
    tick = len(sizes)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        sums, x2 = a + b[::-1], y[::-1]
        items = np.where(x < 0, x2, x)
        for w in np.flatnonzero((x >= 0) & (x2 >= 0)).tolist():
            items[w] = len(sizes) + len(joined)
            joined.append((int(x[w]), int(x2[w])))
        order = np.argsort(sums, kind="stable")
        sums, items = sums[order], items[order]
        sums -= sums[0]
        tick += 1
        heapq.heappush(heap, (-int(sums[-1]), tick, sums, items))
    out = []
    for root in heap[0][3].tolist():
        found, stack = [], [root] if root >= 0 else []
        while stack:
            n = stack.pop()
            if n < len(sizes):
                found.append(n)
            else:
                stack.extend(joined[n - len(sizes)])
        out.append(sorted(found))
    return out


def windows(sizes: list[int], capacity: int = CAPACITY, most: int | None = None) -> list[list[int]] | None:
    """Indices of ``sizes`` (each at most ``capacity``) in windows within capacity, as few as differencing
    finds by raising the count from the least possible one; None beyond ``most`` windows. No two pieces over
    half the capacity share a window, so there are as many windows as such pieces at least."""
    k = max(1, -(-sum(sizes) // capacity), sum(2 * s > capacity for s in sizes))
    while most is None or k <= most:
        found = difference(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in found):
            return [w for w in found if w]
        k += 1
    return None


def filled(sizes: list[int], capacity: int = CAPACITY, padding: float = PADDING) -> list[list[tuple[int, int, int]]]:
    """Windows of (index, start, length) that hold all of ``sizes``, cut where whole pieces would pad more than
    ``padding`` of all tokens: into parts of half the capacity at most, of a quarter, and so on down to SHORTEST
    tokens; a group that even these don't fill that well stays whole."""
    total = sum(sizes)
    most = max(1, -(-total // capacity), int(total * (1 + padding) / capacity))
    longest = capacity
    while True:
        parts = []
        for i, s in enumerate(sizes):
            edges = [j * s // -(-s // longest) for j in range(-(-s // longest) + 1)]
            parts += [(i, a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        found = windows([n for _, _, n in parts], capacity, most)
        if found is not None:
            return [[parts[j] for j in w] for w in found]
        longest //= 2
        if longest < SHORTEST:
            return [[(i, 0, sizes[i]) for i in w] for w in windows(sizes, capacity)]


class _Packer:
    def __init__(self, task: int, capacity: int, group: int, padding: float, with_ids: bool):
        self.next, self.capacity, self.most, self.padding, self.with_ids = task << 33, capacity, group * capacity, padding, with_ids
        self.waiting: list[tuple] = []
        self.total = 0
        self.rows: list[tuple] = []

    def _row(self, doc_id, start: int, ids: np.ndarray, doc_tokens: int, offset: int) -> None:
        self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), doc_tokens, self.next, offset, ids if self.with_ids else None))

    def add(self, doc_id, start: int, ids: np.ndarray, doc_tokens: int) -> None:
        if len(ids) == self.capacity:
            self._row(doc_id, start, ids, doc_tokens, 0)
            self.next += 1
            return
        self.waiting.append((doc_id, start, ids, doc_tokens))
        self.total += len(ids)
        if self.total >= self.most:
            self.flush()

    def flush(self) -> None:
        for window in filled([len(p[2]) for p in self.waiting], self.capacity, self.padding) if self.waiting else ():
            offset = 0
            for i, at, n in window:
                doc_id, start, ids, doc_tokens = self.waiting[i]
                self._row(doc_id, start + at, ids[at : at + n], doc_tokens, offset)
                offset += n
            self.next += 1
        self.waiting, self.total = [], 0

    def taken(self, schema: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [[]] * 8
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=False)], schema=schema)


def _packed(path: str, end_id: int, capacity: int, group: int, padding: float, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from granary.llm.wordpiece import word_tokenizer

        tokenizer, packer, schema = word_tokenizer(path), None, None
        for batch in batches:
            if packer is None:
                context = TaskContext.get()
                packer = _Packer(context.partitionId() if context else 0, capacity, group, padding, with_ids)
                names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                schema = pa.schema([("doc_id", batch.column(0).type), *((n, pa.int64()) for n in names), *[("ids", pa.list_(pa.int32()))] * with_ids])
            for part in tv.slices(batch, "text"):
                ids, bounds = tokenizer.encode(part.column(1))
                wide, bounds = ids.astype("<u4"), bounds.tolist()
                tail = np.array([end_id], "<u4")
                for i, doc_id in enumerate(part.column(0).to_pylist()):
                    own = np.concatenate([wide[bounds[i] : bounds[i + 1]], tail])
                    for start in range(0, len(own), capacity):
                        packer.add(doc_id, start, own[start : start + capacity], len(own))
                if len(packer.rows) >= 2000:
                    yield packer.taken(schema)
        if packer is not None:
            packer.flush()
            yield packer.taken(schema)

    return run


def pack(docs: DataFrame, tokenizer: str, *, end_id: int = END_ID, capacity: int = CAPACITY, group: int = GROUP, padding: float = PADDING, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A document is its token ids, then ``end_id``; null and empty texts are the end id alone. Documents are
    cut at multiples of ``capacity``, and further where a group would pad more than ``padding``; every id lies
    in one piece, pieces fill a sequence without gaps from offset 0. Repeated rows are packed once each, and a null doc_id stays null. Sequence ids hold the task's
    number in the upper bits. An empty table gives no rows; other columns are ignored."""
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col("doc_id"), F.col("text")).mapInArrow(_packed(tokenizer, end_id, capacity, group, padding, with_ids), schema + ", ids array<int>" * with_ids)
