"""Cross-tokenizer alignment: which tokens of one tokenizer stand for which tokens of another.

Tokens of A and B over the same bytes are the nodes of a bipartite graph, those that overlap its edges. Its
connected components, found by union-find, are exactly the minimal groups: between two of them both tokenizers
have an end. The members of a component are expanded into its links, and a pair of ids counts in how many
documents it is linked.

Neither tokenizer lets a token cross the start of a word (see ``Aligner``), so texts are aligned word by word
and a worker aligns a word once. Documents travel in blocks: a block keeps the words of each document as
numbers, its distinct pairs, and in how many of its documents each stands. Pair counting adds blocks up over
the cluster, and each block then asks only for the counts of its own pairs, so what crosses the network is
distinct pairs per block, never links. Nothing is broadcast or collected."""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm import textvec as tv
from granary.llm.shared import written
from granary.llm.wordpiece import _byte_letters

#: Bytes of text in a block, words that a worker remembers before it starts afresh, words that are encoded at
#: once, and room for ids of B (a power of two).
BLOCK, MOST_WORDS, AT_ONCE, IDS_B = 1 << 19, 300_000, 8192, 1 << 17

_U = np.uint64


def groups_of(a_sizes: np.ndarray, a_ends: np.ndarray, b_sizes: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links and components of many words at once. a_sizes are the byte lengths of all tokens of A, and word i
    has those from a_ends[i] to a_ends[i + 1]; likewise B, over the same bytes.

    Returns the overlapping pairs (place in A, place in B) in byte order, and the component of each token of A
    and of B, numbered in that order. The pieces between neighbouring ends of either kind are the edges; each
    lies in one token of A and one of B. Union-find by hooking to the smallest neighbour and halving paths."""
    at_a, at_b = np.cumsum(a_sizes), np.cumsum(b_sizes)
    ends = np.union1d(at_a, at_b)
    a, b = np.searchsorted(at_a, ends), np.searchsorted(at_b, ends)
    n = len(at_a)
    above = np.arange(n + len(at_b))
    while True:
        x, y = above[a], above[n + b]
        open_ = x != y
        if not open_.any():
            break
        x, y = x[open_], y[open_]
        np.minimum.at(above, np.maximum(x, y), np.minimum(x, y))
        while (up := above[above]).tobytes() != above.tobytes():
            above = up
    roots, component = np.unique(above, return_inverse=True)
    return a, b, component[:n], component[n:]


class Aligner:
    """Aligns texts of the byte-level file A (over space and text) and the piece file B (over text), word by word.

    Words are cut before a space or line feed that follows anything but white space, and before a full stop or
    comma that follows a letter of a-z. There A's pre-tokenizer ends a token, and no piece of B holds such a
    place within (tested on its vocabulary), so both encode words on their own as within the text. A word that
    starts with a space is one of B's words; any other follows a byte token that nothing merges with.

    Words are found and hashed by column; the bytes of every word are compared with those that its hash stands
    for. What is known of a word lies in columns, by slot."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel part
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        code = {letter: bytes([byte]) for byte, letter in _byte_letters().items()}
        a_bytes = {i: b"".join(code.get(c, c.encode()) for c in t) for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [a_bytes.get(i, b"") for i in range(max(a_bytes) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
        if len(pieces) > IDS_B:
            raise ValueError(f"B has {len(pieces)} ids; pairs of ids have room for {IDS_B}")
        if any(re.search(r"[^\u2581]\u2581|\n.|.\n|[A-Za-z][.,]", p) for p in pieces):
            raise ValueError("B has pieces across the places where words are cut")
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.a_name, self.b_name = ([str(i) for i in range(len(t))] for t in (self.a_bytes, self.b_bytes))
        self.mark = self.b.piece_to_id("\u2581")
        self.forget()

    def forget(self) -> None:
        self.known, self.slot = np.empty(0, _U), np.empty(0, np.int64)
        self.body, self.body_start, self.length = np.empty(0, _U), np.zeros(1, np.int64), np.empty(0, np.int64)
        self.groups: list[str] = []
        self.counts = np.empty((0, 4), np.int64)  # whether the bytes agree, tokens of A and of B, groups
        self.pairs, self.start = np.empty(0, np.int64), np.zeros(1, np.int64)

    def _learn(self, pieces: list[bytes]) -> None:
        """Appends a slot for each piece."""
        words = [p.decode() for p in pieces]
        a = [e.ids for e in self.a.encode_batch(words, add_special_tokens=False)]
        b = self.b.encode([w[1:] if w[0] == " " else "\n" + w for w in words], num_threads=1)
        b = [(i or [self.mark]) if w[0] == " " else i[2:] for w, i in zip(words, b, strict=True)]
        (ids_a, ends_a), (ids_b, ends_b) = _joined(a), _joined(b)
        fits = [True] * len(pieces)
        if not self._all_fit(pieces, ids_a, ends_a, ids_b, ends_b):
            fits = [b"".join([self.a_bytes[k] for k in x]) == p == b"".join([self.b_bytes[k] for k in y]) for p, x, y in zip(pieces, a, b, strict=True)]
            (ids_a, ends_a), (ids_b, ends_b) = (_joined([x if f else [] for x, f in zip(t, fits, strict=True)]) for t in (a, b))
        left, right, of_a, of_b = groups_of(self.a_size[ids_a], ends_a, self.b_size[ids_b], ends_b)
        n = int(of_a[-1]) + 1 if len(of_a) else 0
        first_a, first_b = np.searchsorted(of_a, np.arange(n + 1)).tolist(), np.searchsorted(of_b, np.arange(n + 1)).tolist()
        name_a, name_b = [self.a_name[i] for i in ids_a.tolist()], [self.b_name[i] for i in ids_b.tolist()]
        text = [",".join(name_a[i:j]) + "|" + ",".join(name_b[k:m]) for i, j, k, m in zip(first_a, first_a[1:], first_b, first_b[1:], strict=False)]
        group = np.searchsorted(of_a, np.arange(n))  # the first token of each group
        ends = np.searchsorted(group, ends_a)
        self.groups += [";".join(text[i:j]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        self.counts = np.vstack([self.counts, np.column_stack([np.array(fits, np.int64), np.diff(ends_a), np.diff(ends_b), np.diff(ends)])])
        self.pairs = np.concatenate([self.pairs, ids_a[left] * IDS_B + ids_b[right]])
        self.start = np.concatenate([self.start, self.start[-1] + np.searchsorted(left, ends_a[1:])])

    def _all_fit(self, pieces: list[bytes], ids_a: np.ndarray, ends_a: np.ndarray, ids_b: np.ndarray, ends_b: np.ndarray) -> bool:
        """Whether the tokens of every piece spell it: all of them together, and each one's as long as it."""
        whole, sizes = b"".join(pieces), np.array([len(p) for p in pieces])
        for ids, ends, of, size in ((ids_a, ends_a, self.a_bytes, self.a_size), (ids_b, ends_b, self.b_bytes, self.b_size)):
            at = np.concatenate([[0], np.cumsum(size[ids])])[ends]
            if (np.diff(at) != sizes).any() or b"".join([of[k] for k in ids.tolist()]) != whole:
                return False
        return True

    def slots(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each word of all texts (of a space and the text) and the n+1 offsets of each text's words.
        Null and empty texts have no words. Slots hold until the next call."""
        if len(self.groups) > MOST_WORDS or len(self.pairs) > 16 * MOST_WORDS:
            self.forget()
        data, offsets = _spaced(column)
        starts, bounds = _word_starts(data, offsets)
        ends = np.append(starts[1:], len(data)).astype(np.int64)
        if not len(starts):
            return np.empty(0, np.int64), bounds
        lengths = ends - starts
        blocks, edge = tv.span_blocks(data, starts, ends)
        unique, first, inverse = np.unique(tv.block_hashes(blocks, edge, lengths), return_index=True, return_inverse=True)
        stands, body = first[inverse], data.tobytes()
        sizes = np.diff(edge)
        at = np.searchsorted(self.known, unique)
        old = np.zeros(len(unique), bool)
        near = at < len(self.known)
        old[near] = self.known[at[near]] == unique[near]
        slot, own = self.slot[at[old]], first[old]
        same = (lengths == lengths[stands]).all() and tv.equal_blocks(blocks, edge[:-1], blocks, edge[stands], sizes).all()
        if not (same and (self.length[slot] == lengths[own]).all() and (not len(own) or tv.equal_blocks(blocks, edge[own], self.body, self.body_start[slot], sizes[own]).all())):
            return self._without_hashes(body, starts, ends), bounds
        new = first[~old]
        if len(new):
            base = len(self.groups)
            for k in range(0, len(new), AT_ONCE):
                self._learn([body[i:j] for i, j in zip(starts[new[k : k + AT_ONCE]].tolist(), ends[new[k : k + AT_ONCE]].tolist(), strict=True)])
            self.known, self.slot = np.insert(self.known, at[~old], unique[~old]), np.insert(self.slot, at[~old], base + np.arange(len(new)))
            n = sizes[new]
            last = np.cumsum(n)
            self.body = np.concatenate([self.body, blocks[np.repeat(edge[new] - last + n, n) + np.arange(last[-1])]])
            self.body_start = np.concatenate([self.body_start, self.body_start[-1] + last])
            self.length = np.concatenate([self.length, lengths[new]])
            at = np.searchsorted(self.known, unique)
        return self.slot[at][inverse], bounds

    def _without_hashes(self, body: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For texts in which two words share a hash: all words are learnt anew."""
        self.forget()
        place: dict[bytes, int] = {}
        out = [place.setdefault(body[i:j], len(place)) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
        self._learn(list(place))
        self.known, self.slot, self.groups = np.empty(0, _U), np.empty(0, np.int64), self.groups
        self.body_start, self.length = np.zeros(len(place) + 1, np.int64), np.zeros(len(place), np.int64)
        return np.array(out, np.int64)


def _joined(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
    return np.fromiter(itertools.chain.from_iterable(ids), np.int64, ends[-1]), ends


def _spaced(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts with a space before each that isn't empty."""
    data, offsets = tv.raw(column)
    some = np.diff(offsets) > 0
    shift = np.concatenate([[0], np.cumsum(some)])
    out = np.full(len(data) + shift[-1], 0x20, np.uint8)
    out[np.arange(len(data)) + np.repeat(shift[1:], np.diff(offsets))] = data
    return out, offsets + shift


#: Bytes that end white space, or may: ASCII white space and separators, line and page ends.
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def _word_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start, and the n+1 offsets of each text's words."""
    cut = np.zeros(len(data), bool)
    if len(data):
        before = np.concatenate([np.zeros(3, np.uint8), data])[: len(data) + 2]
        one, two, three = before[2:], before[1:-1], before[:-2]
        # U+0085 and U+00A0 follow C2; other white space is three bytes from E1, E2 or E3
        blank = _BLANK[one] | (two == 0xC2) & ((one == 0x85) | (one == 0xA0)) | (three >= 0xE1) & (three <= 0xE3) & (one >= 0x80)
        cut = ~blank & ((data == 0x20) | (data == 0x0A)) | _LETTER[one] & ((data == 0x2E) | (data == 0x2C))
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(cut)
    return starts, np.searchsorted(starts, offsets)


@functools.lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def alignments(own: Aligner, column: pa.Array) -> list[str]:
    """Each text's groups, ``a1,a2|b1;a3|b2,b3``; '' where it has no tokens."""
    slots, bounds = own.slots(column)
    out = []
    for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        words = slots[i:j]
        out.append(";".join([own.groups[k] for k in words.tolist()]) if own.counts[words, 0].all() else "")
    return out


def groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, groups as text, for reading; see ``scored`` for what has no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for batch in batches:
            for part in tv.slices(batch, "text", BLOCK):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(alignments(own, part.column(1)), pa.string())], names=["doc_id", "groups"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, groups string")


_DOC = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _list(values: np.ndarray | list, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _pressed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, one behind the other, compressed; each number in as many bytes as the largest needs."""
    out = []
    for a in arrays:
        kind = np.min_scalar_type(int(a.max(initial=0)))
        out.append(np.array([len(a), kind.itemsize], "<i8").tobytes() + a.astype(f"<u{kind.itemsize}").tobytes())
    body = b"".join(out)
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def _opened(body: bytes) -> list[np.ndarray]:
    whole, at, out = pa.decompress(body[8:], int.from_bytes(body[:8], "little"), codec="zstd", asbytes=True), 0, []
    while at < len(whole):
        n, width = np.frombuffer(whole, "<i8", 2, at)
        out.append(np.frombuffer(whole, f"<u{width}", n, at + 16).astype(np.int64))
        at += 16 + int(n * width)
    return out


def _block(own: Aligner, part: pa.RecordBatch) -> pa.RecordBatch:
    """A row: the digests of the documents; per document the words that it holds, as numbers, and how often; per
    word its links, as places among the block's distinct pairs (these compressed); and those pairs with the number
    of their documents."""
    slots, bounds = own.slots(part.column(1))
    n = part.num_rows
    doc = np.repeat(np.arange(n), np.diff(bounds))
    fits = np.ones(n, bool)
    np.logical_and.at(fits, doc, own.counts[slots, 0] > 0)
    fits &= np.diff(bounds) > 0
    hashes = [hashlib.sha256(";".join([own.groups[k] for k in slots[bounds[d] : bounds[d + 1]].tolist()]).encode()).hexdigest() if f else "" for d, f in enumerate(fits.tolist())]
    slots, doc = slots[fits[doc]], doc[fits[doc]]
    words, number = np.unique(slots, return_inverse=True)
    held, times = np.unique(doc * max(len(words), 1) + number, return_counts=True)
    doc, bag = held // max(len(words), 1), held % max(len(words), 1)
    sizes = own.start[words + 1] - own.start[words]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    pairs, place = np.unique(own.pairs[np.repeat(own.start[words] - ends[:-1], sizes) + np.arange(ends[-1])], return_inverse=True)
    sums = np.zeros((n, 4), np.int64)
    np.add.at(sums, doc, np.column_stack([own.counts[words[bag], 1:], sizes[bag]]) * times[:, None])
    spread = np.repeat(ends[:-1][bag] - np.concatenate([[0], np.cumsum(sizes[bag])[:-1]]) if len(bag) else bag, sizes[bag])
    seen = np.unique(np.repeat(doc, sizes[bag]) * max(len(pairs), 1) + place[spread + np.arange(len(spread))])
    in_docs = np.bincount(seen % max(len(pairs), 1), minlength=len(pairs))[: len(pairs)]
    digests = pa.StructArray.from_arrays([*(pa.array(c) for c in sums.T), pa.array(hashes, pa.string())], names=["n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
    row = {
        "doc_ids": pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), part.column(0)), "digests": pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), digests),
        "body": pa.array([_pressed(np.bincount(doc, minlength=n), np.diff(held, prepend=0), times, sizes, place)], pa.binary()),
        "pairs": _list(pairs, pa.int64()), "in_docs": _list(in_docs, pa.int32()),
    }
    return pa.RecordBatch.from_arrays(list(row.values()), names=list(row))


def _blocks(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for batch in batches:
            for part in tv.slices(batch, "text", BLOCK):
                yield _block(own, part)

    return run


def _blocks_ddl(doc_id: str) -> str:
    return f"doc_ids array<{doc_id}>, digests array<struct<{_DOC.replace(' long', ':long').replace(' string', ':string')}>>, body binary, pairs array<long>, in_docs array<int>"


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, count (documents that hold it linked), best (whether no pair of its A id has a higher one)."""
    each = blocks.select(F.explode(F.arrays_zip("pairs", "in_docs")).alias("p")).select("p.pairs", "p.in_docs")
    counts = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("in_docs").alias("count"))
    # The rows of an A id are at most as many as B has ids.
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy(F.shiftright("pair", IDS_B.bit_length() - 1))))


def _summed(key: tuple, block: pa.Table, counts: pa.Table) -> pa.Table:
    """Each document's sums over its links: a word's sums are made once."""
    ids, digests, body = (block.column(c)[0] for c in ("doc_ids", "digests", "body"))
    held, steps, times, sizes, places = _opened(body.as_py())
    number = np.cumsum(steps)
    bag = number % max(len(sizes), 1)
    count, best = (np.zeros(int(places.max(initial=-1)) + 1, np.int64) for _ in range(2))
    at = counts.column("place").to_numpy()
    count[at], best[at] = counts.column("count").to_numpy(), counts.column("best").to_numpy(zero_copy_only=False)
    word = np.repeat(np.arange(len(sizes)), sizes)
    doc = np.repeat(np.arange(len(held)), held)
    out = []
    for of in (best, count):
        per_word = np.zeros(len(sizes), np.int64)
        np.add.at(per_word, word, of[places])
        per_doc = np.zeros(len(held), np.int64)
        np.add.at(per_doc, doc, per_word[bag] * times)
        out.append(pa.array(per_doc))
    return pa.table([ids.values, *digests.values.flatten(), *out], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"])


def scored(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum, a row per row of ``docs``.

    A's tokens are those of a space and the text, B's those of the text. Texts that are null, empty, or whose
    joined token bytes of A or B differ from space and text have no tokens: zeros, and '' for the hash. Every row
    counts as a document, so repeated rows count again; null doc_ids stay, an empty table gives no rows, other
    columns are ignored. Tokens' bytes are A's letters undone and B's pieces with U+2581 as a space, so a text
    that holds U+2581 itself has no tokens."""
    kind = dict(docs.dtypes)["doc_id"]
    made = docs.select("doc_id", "text").mapInArrow(_blocks(a_path, b_path), _blocks_ddl(kind))
    blocks = written(made.withColumn("block", F.monotonically_increasing_id()), "blocks")
    counts = pair_counts(blocks)
    asks = blocks.select("block", F.posexplode("pairs").alias("at", "pair")).join(counts, "pair").select(F.col("block").alias("of"), F.col("at").alias("place"), "count", "best")
    return blocks.drop("pairs", "in_docs").groupBy("block").cogroup(asks.groupBy("of")).applyInArrow(_summed, f"doc_id {kind}, {_DOC}, n_best long, count_sum long")


__all__ = ["Aligner", "aligner", "alignments", "groups", "groups_of", "pair_counts", "scored"]
