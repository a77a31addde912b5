"""Language ID: multinomial naive Bayes over hashed character n-grams.

Learning counts n-grams of 1 to 3 characters per language, all labelled rows, reduced to BUCKETS hashed
features. The log-probability matrix (BUCKETS x languages) has a fixed number of rows and one column a
language; it is broadcast, and texts are scored in slices: gather the matrix rows of all n-grams of a slice,
add them up by document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import textvec as tv
from granary.llm.shared import fold, ship

#: Hashed features, longest n-gram, additive smoothing, n-grams of evidence that a score counts, and characters of
#: a text that are looked at in one go.
BUCKETS, LONGEST, SMOOTHING, EVIDENCE, STRETCH = 1 << 15, 3, 0.5, 200, 1 << 20
UNDETERMINED = "und"

_letter: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters; one table for a worker's life."""
    if not _letter:
        _letter.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letter[0]


def _hashed(chars: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each place."""
    acc = np.zeros(len(chars) - n + 1, np.uint64)
    for i in range(n):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + chars[i : i + len(acc)]
    hashed = acc * np.uint64(0xD6E8FEB86659FD93) ^ np.uint64(n)
    return ((hashed ^ hashed >> np.uint64(32)) & np.uint64(buckets - 1)).astype(np.int64)


def _points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(texts: list[str], buckets: int, longest: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Per n: buckets of the n-grams and their n+1 document offsets; and which documents have a letter.

    Text is lower-cased; every run without letters counts as one blank, so n-grams see word edges but
    neither digits nor punctuation. A document's text is set between blanks, and no n-gram leaves it."""
    points = _points([f" {t} " for t in texts])
    edge = np.concatenate([[0], np.cumsum([len(t) + 2 for t in texts])]).astype(np.int64)
    letter = _letters()[points]
    has = np.add.reduceat(letter, edge[:-1], dtype=np.int64) > 0 if texts else np.empty(0, bool)
    keep = letter.copy()
    keep[edge[:-1]] = True
    keep[1:] |= letter[:-1]
    chars = np.where(letter, points, np.uint32(32))[keep].astype(np.uint64)
    ends = np.concatenate([[0], np.cumsum(keep)])[edge]
    out = []
    for n in range(1, longest + 1):
        if len(chars) < n:
            break
        inside = np.ones(len(chars), bool)
        for k in range(1, n):
            inside[np.maximum(ends[1:] - k, ends[:-1])] = False
        out.append((_hashed(chars, n, buckets)[inside[: len(chars) - n + 1]], np.concatenate([[0], np.cumsum(inside)])[ends]))
    return out, has


def _long_grams(text: str, buckets: int, longest: int, stretch: int) -> Iterator[np.ndarray]:
    """The n-grams of one text as ``_grams`` counts them, stretch by stretch."""
    held, after_letter, old = np.array([32], np.uint64), False, 0
    for start in [*range(0, len(text), stretch), None]:
        points = _points([text[start : start + stretch] if start is not None else " "])
        letter = _letters()[points]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[0] |= after_letter
        after_letter = bool(letter[-1])
        chars = np.concatenate([held, np.where(letter, points, np.uint32(32))[keep]])
        for n in range(1, longest + 1):
            first = max(0, old - n + 1)  # n-grams that end in the first ``old`` places were given before
            if len(chars) - first >= n:
                yield _hashed(chars[first:], n, buckets)
        held = chars[-(longest - 1) :] if longest > 1 else chars[:0]
        old = len(held)


def _counted(names: list[str], buckets: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {n: i for i, n in enumerate(names)}
        counts = np.zeros(len(names) * buckets, np.int64)
        for batch in batches:
            for part in tv.slices(batch, "text", STRETCH):
                own = np.array([place[x] for x in part.column(1).to_pylist()], np.int64)
                texts = [t.lower() for t in part.column(0).to_pylist()]
                if len(texts) == 1:
                    for grams in _long_grams(texts[0], buckets, longest, STRETCH):
                        counts[own[0] * buckets : (own[0] + 1) * buckets] += np.bincount(grams, minlength=buckets)
                    continue
                for grams, ends in _grams(texts, buckets, longest)[0]:
                    counts += np.bincount(grams + np.repeat(own, np.diff(ends)) * buckets, minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some // buckets, pa.int32()), pa.array(some % buckets, pa.int32()), pa.array(counts[some])], names=["lang", "bucket", "n"])

    return run


class LanguageModel:
    """names: languages in order; table: buckets x languages log-probabilities; prior: log share of rows."""

    def __init__(self, names: list[str], table: np.ndarray, prior: np.ndarray, longest: int):
        self.names, self.table, self.prior, self.longest = names, table, prior, longest


def learn(labelled: DataFrame, *, buckets: int = BUCKETS, longest: int = LONGEST, smoothing: float = SMOOTHING) -> LanguageModel:
    """Fits on columns text and lang; rows with null text or lang are passed over. Only the count table,
    buckets x languages at most (256 KB a language), comes to the driver."""
    ship(labelled.sparkSession)
    rows = labelled.select("text", "lang").filter("text is not null and lang is not null")
    seen = sorted((r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect())
    names = [n for n, _ in seen]
    counts = np.zeros((buckets, len(names)))
    if names:
        got = rows.mapInArrow(_counted(names, buckets, longest), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
        counts[got["bucket"], got["lang"]] = got["n"]
    counts += smoothing
    prior = np.log(np.array([n for _, n in seen], float) / max(1, sum(n for _, n in seen)))
    return LanguageModel(names, np.log(counts / counts.sum(axis=0)).astype(np.float32), prior, longest)


def _evidence(model: LanguageModel, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of log-probabilities and numbers of n-grams of each text, and which have a letter. A text's sums are
    its own, whatever stands beside it; a text over STRETCH characters is summed stretch by stretch."""
    total, n, has = np.zeros((len(texts), len(model.names))), np.zeros(len(texts)), np.zeros(len(texts), bool)
    short = [i for i, t in enumerate(texts) if len(t) <= STRETCH]
    grams, has[short] = _grams([texts[i] for i in short], len(model.table), model.longest)
    for g, ends in grams:
        some = np.flatnonzero(ends[1:] > ends[:-1])
        at = np.array(short)[some]
        total[at] += np.add.reduceat(model.table[g], ends[:-1][some], axis=0, dtype=np.float64)
        n[at] += np.diff(ends)[some]
    for i in set(range(len(texts))) - set(short):
        has[i] = any(_letters()[_points([texts[i][a : a + STRETCH]])].any() for a in range(0, len(texts[i]), STRETCH))
        for g in _long_grams(texts[i], len(model.table), model.longest, STRETCH):
            total[i] += model.table[g].sum(axis=0, dtype=np.float64)
            n[i] += len(g)
    return total, n, has


def _guessed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in tv.slices(batch, "text", (1 << 23) // max(8, len(model.names))):
                pred, score = [UNDETERMINED] * part.num_rows, np.zeros(part.num_rows)
                if model.names:
                    total, n, has = _evidence(model, [(t or "").lower() for t in part.column(1).to_pylist()])
                    # Neighbouring n-grams repeat each other: for the score, a text's evidence counts as that of
                    # EVIDENCE n-grams at most. The best language is the same with and without.
                    logit = (total + model.prior) * np.minimum(1, EVIDENCE / np.maximum(n, 1))[:, None]
                    logit -= logit.max(axis=1, keepdims=True)
                    share = np.exp(logit)
                    share /= share.sum(axis=1, keepdims=True)
                    best = (total + model.prior).argmax(axis=1)
                    pred = [model.names[b] if k else UNDETERMINED for b, k in zip(best.tolist(), has.tolist(), strict=True)]
                    score = np.where(has, share[np.arange(len(best)), best], 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score (tempered posterior of the best language, 0 where undetermined), one row per row.

    Null texts and texts without a letter are ``und``, as all are if nothing was learned. Equal scores take
    the language first in code point order; repeated rows and null doc_ids pass through."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(_guessed(shared), f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")


def learn_open_fold(docs: DataFrame, **kw) -> LanguageModel:
    """Fits on documents whose crc32(doc_id) mod 3 is not 1."""
    return learn(docs.filter(fold(F.col("doc_id"), 3) != 1), **kw)


def known_language(docs: DataFrame, model: LanguageModel, least: float = 0.5) -> DataFrame:
    """``docs`` without the rows that language ID rejects: undetermined ones, and those whose best language
    has a posterior under ``least``. Repeated rows and null doc_ids are judged by their own text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ship(docs.sparkSession)
    names = docs.columns
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _guessed(shared)
        for batch in batches:
            text = batch.column(names.index("text"))
            probe = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), text], names=["doc_id", "text"])
            keep = [p >= least and g != UNDETERMINED for out in score(iter([probe])) for g, p in zip(out.column(1).to_pylist(), out.column(2).to_pylist(), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)
