"""Vectorised text scanning: words and their hashes straight from Arrow buffers.

Everything works on UTF-8 bytes; the word separators are the ASCII bytes 0x20 and 0x09-0x0D, which never
occur inside a multi-byte character, so byte scanning and code point scanning cut the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
GOLDEN = U(0x9E3779B97F4A7C15)

#: Bytes of text whose words are found at once; a text of any length needs working space for about two of these.
STRETCH = 1 << 21
#: Words whose shingles are made at once.
LOT = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; the argument is left as it is."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return body[ends[0] : ends[-1]], ends - ends[0]


def slices(batch: pa.RecordBatch, name: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each piece has about ``most`` bytes of text, one row at least."""
    if batch.num_rows == 0:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, start = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and n+1 offsets of each document's words in them."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    gap = SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[0] = edge[n] = True
    edge[offsets] = True
    before, after = edge[:-1].copy(), edge[1:].copy()
    before[1:] |= gap[:-1]
    after[:-1] |= gap[1:]
    ink = ~gap
    starts, ends = np.flatnonzero(ink & before), np.flatnonzero(ink & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_blocks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each span as 64-bit blocks, the last one filled up with zeros, and n+1 offsets of each
    span's blocks. Spans of equal length are equal if their blocks are."""
    edge = np.concatenate([[0], np.cumsum((ends - starts + 7) >> 3)])
    sizes = np.diff(edge)
    at = np.repeat(starts - 8 * edge[:-1], sizes) + 8 * np.arange(edge[-1])
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    blocks = np.ndarray(len(data) + 1, "<u8", buffer=padded, strides=(1,))[at]
    rest = np.repeat(ends, sizes) - at
    short = np.flatnonzero(rest < 8)
    blocks[short] &= (U(1) << (U(8) * rest[short].astype(U))) - U(1)
    return blocks, edge


def block_hashes(blocks: np.ndarray, edge: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span: every block is mixed with its place before the blocks are added up, so that
    no arithmetic relation between texts carries over."""
    if len(lengths) == 0:
        return np.empty(0, U)
    place = np.arange(edge[-1]) - np.repeat(edge[:-1], np.diff(edge))
    mixed = mix(mix(blocks) + (place + 1).astype(U) * GOLDEN)
    return mix(np.add.reduceat(mixed, edge[:-1]) + lengths.astype(U) * GOLDEN)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span (none of them empty), the same wherever the span stands."""
    blocks, edge = span_blocks(data, starts, ends)
    return block_hashes(blocks, edge, ends - starts)


def equal_blocks(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which of the runs of ``sizes`` blocks that start at ``a_start`` in a are those at ``b_start`` in b."""
    same = a[a_start] == b[b_start]
    more = np.flatnonzero(sizes > 1)
    if len(more):
        n = sizes[more]
        edge = np.concatenate([[0], np.cumsum(n)[:-1]])
        step = np.arange(n.sum()) - np.repeat(edge, n)
        same[more] = np.logical_and.reduceat(a[np.repeat(a_start[more], n) + step] == b[np.repeat(b_start[more], n) + step], edge)
    return same


def _stretches(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about ``STRETCH`` bytes that together are all of ``data`` and cut no word."""
    start, n = 0, len(data)
    while n - start > 2 * STRETCH:
        end = at = start + STRETCH
        bound = int(offsets[np.searchsorted(offsets, at)])
        while end < bound:
            gaps = np.flatnonzero(SPACE[data[end : min(end + 4096, bound)]])
            if len(gaps):
                end += int(gaps[0])
                break
            end = min(end + 4096, bound)
        yield start, end
        start = end
    yield start, n


def folded_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words with A-Z lower-cased, and the n+1 offsets of each document's words."""
    data, offsets = raw(column)
    found, bounds = [], np.zeros(len(offsets), np.int64)
    for a, b in _stretches(data, offsets):
        piece = LOWER[data[a:b]]
        starts, ends, inner = word_bounds(piece, np.clip(offsets, a, b) - a)
        found.append(span_hashes(piece, starts, ends))
        bounds += inner
    return found[0] if len(found) == 1 else np.concatenate(found), bounds


def chained(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """An order-sensitive combination of two hashes."""
    return mix(first * U(0xD6E8FEB86659FD93) + second)


def shingles(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside a document and the n+1 offsets per document.

    A document of 1 to k-1 words has its whole sequence as one shingle; one without words has none."""
    counts = np.diff(bounds)
    per = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(per)])
    if not len(words):
        return np.empty(0, U), out_bounds
    span = len(words) - k + 1
    long = np.flatnonzero(counts >= k)
    out = np.empty(out_bounds[-1], U)
    if len(long) and span > 0:
        inside = np.zeros(len(words) + 1, np.int8)
        np.add.at(inside, bounds[:-1][long], 1)
        np.add.at(inside, bounds[1:][long] - k + 1, -1)
        np.cumsum(inside, out=inside)
        mark = np.zeros(out_bounds[-1] + 1, np.int8)
        np.add.at(mark, out_bounds[:-1][long], 1)
        np.add.at(mark, out_bounds[1:][long], -1)
        to, done = np.flatnonzero(np.cumsum(mark, out=mark)[:-1] > 0), 0
        for a in range(0, span, LOT):
            b = min(a + LOT, span)
            acc = words[a:b]
            for i in range(1, k):
                acc = chained(acc, words[a + i : b + i])
            acc = acc[inside[a:b] > 0]
            out[to[done : done + len(acc)]] = acc
            done += len(acc)
    for d in np.flatnonzero((counts > 0) & (counts < k)).tolist():
        acc = words[bounds[d] : bounds[d] + 1]
        for i in range(1, int(counts[d])):
            acc = chained(acc, words[bounds[d] + i : bounds[d] + i + 1])
        out[out_bounds[d]] = mix(acc + U(int(counts[d])))[0]
    return out, out_bounds
