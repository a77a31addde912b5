"""Token ids of whole texts, exactly as the tokenizer file gives them, at column speed.

The file's pre-tokenizer never lets a token cross white space, so ids of a text are the ids of its words in
order. Words are found and hashed by column; only words new to this worker meet the tokenizer, and those
are cut further into runs, so that "word," and "word." share the work for "word"."""

from __future__ import annotations

import functools
import itertools
import unicodedata

import numpy as np
import pyarrow as pa

from granary.llm import textvec as tv

#: Distinct words and runs that a worker remembers before it starts afresh; only speed depends on them.
MOST_WORDS, MOST_RUNS = 700_000, 250_000


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 stands for itself, all other bytes for U+0100 onwards."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class WordTokenizer:
    """ids(text) for the byte-level BPE file with word ends; see the module's docstring."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = {chr(k): v for k, v in _byte_letters().items()}
        self.plain = str.maketrans(self.letters)
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.specials = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.special = False
        self.runs: dict[str, list[int]] = {}
        self.forget()

    def forget(self) -> None:
        self.known = np.empty(0, np.uint64)
        self.slot = np.empty(0, np.int64)
        self.flat = np.empty(0, np.uint32)
        self.start = np.zeros(1, np.int64)
        self.blocks, self.block_start, self.length = np.empty(0, np.uint64), np.zeros(1, np.int64), np.empty(0, np.int64)

    def _run(self, run: str) -> list[int]:
        got = self.runs.get(run)
        if got is None:
            if len(self.runs) >= MOST_RUNS:
                self.runs.clear()
            plain = run if run.isascii() and run.isprintable() else run.encode().decode("latin-1").translate(self.plain)
            got = self.runs[run] = [t.id for t in self.model.tokenize(plain)]
        return got

    def word(self, word: str) -> list[int]:
        if self.special and any(s in word for s in self.specials):
            return self.whole.encode(word, add_special_tokens=False).ids
        if word.isascii():
            word = word.lower()
        elif "\u03a3" not in word and unicodedata.is_normalized("NFC", word):
            word = word.lower()  # the file's own lower case knows no final sigma; else both agree
        else:
            word = self.whole.normalizer.normalize_str(word)
        if word.isalpha():
            return self._run(word)
        return [i for run in self.cut(word) for i in self._run(run)]

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        ids = [self.word(w) for w in words]
        base = len(self.start) - 1
        self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(ids), np.uint32)])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum([len(x) for x in ids], dtype=np.int64)])
        at = np.searchsorted(self.known, hashes)
        self.known, self.slot = np.insert(self.known, at, hashes), np.insert(self.slot, at, base + np.arange(len(hashes)))

    def _keep_bytes(self, blocks: np.ndarray, edge: np.ndarray, lengths: np.ndarray, new: np.ndarray) -> None:
        n = edge[new + 1] - edge[new]
        ends = np.cumsum(n)
        self.blocks = np.concatenate([self.blocks, blocks[np.repeat(edge[new] - ends + n, n) + np.arange(ends[-1])]])
        self.block_start = np.concatenate([self.block_start, self.block_start[-1] + ends])
        self.length = np.concatenate([self.length, lengths[new]])

    def _one_by_one(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Without hashes, for a slice in which two words share one."""
        body = data.tobytes()
        self.special = any(s.encode() in body for s in self.specials)
        ids = [self.word(body[a:b].decode()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        return np.fromiter(itertools.chain.from_iterable(ids), np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])[bounds]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order and n+1 offsets of each text's ids; null counts as empty.

        A hash only proposes: the bytes of every word are compared with those of the word it stands for."""
        data, offsets = tv.raw(column)
        starts, ends, bounds = tv.word_bounds(data, offsets)
        lengths = ends - starts
        blocks, edge = tv.span_blocks(data, starts, ends)
        unique, first, inverse = np.unique(tv.block_hashes(blocks, edge, lengths), return_index=True, return_inverse=True)
        if not len(unique):
            return np.empty(0, np.uint32), np.zeros(len(bounds), np.int64)
        stands = first[inverse]
        if not ((lengths == lengths[stands]).all() and tv.equal_blocks(blocks, edge[:-1], blocks, edge[stands], np.diff(edge)).all()):
            return self._one_by_one(data, starts, ends, bounds)
        if len(self.known) + len(unique) > MOST_WORDS:
            self.forget()
        at = np.searchsorted(self.known, unique)
        old = np.zeros(len(unique), bool)
        near = at < len(self.known)
        old[near] = self.known[at[near]] == unique[near]
        slot, own = self.slot[at[old]], first[old]
        if not ((self.length[slot] == lengths[own]).all() and (not len(own) or tv.equal_blocks(blocks, edge[own], self.blocks, self.block_start[slot], edge[own + 1] - edge[own]).all())):
            return self._one_by_one(data, starts, ends, bounds)
        if not old.all():
            new = first[~old]
            body = data.tobytes()
            self.special = any(s.encode() in body for s in self.specials)
            self._learn(unique[~old], [body[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            self._keep_bytes(blocks, edge, lengths, new)
            at = np.searchsorted(self.known, unique)
        slot = self.slot[at][inverse]
        begin, sizes = self.start[slot], self.start[slot + 1] - self.start[slot]
        ends_out = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(begin - ends_out[:-1], sizes) + np.arange(ends_out[-1])]
        return ids, ends_out[bounds]


@functools.lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)
