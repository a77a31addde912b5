"""Toxicity by class-conditional Kneser-Ney models of expressions.

An expression is a run of letters, lower-cased; its characters are predicted from up to ORDER - 1 before
them within the run, so inflected and compound forms share the evidence of their stems. One model per class
counts in how many training documents an expression stands; both discount by the same constant and back off,
order by order, to one shared model of continuation counts, so what either class has hardly seen costs them
alike. A text's evidence is its toxic minus its ordinary log-likelihood, per expression: once with every
expression from the toxic model, and once with a share SHARE of them from it and the rest from the ordinary
one, as toxic texts are mostly ordinary. A logistic calibration over these two gives the score; it is fitted
under models that didn't count its rows, those of the fifth kept apart.

All labelled training rows are counted in the final models, the fifth too. Counts end in tables of BUCKETS
hashed cells (a parameter; 52 bytes a cell), which bounds what is sent to the driver and broadcast; the
calibration takes at most CALIBRATION texts."""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import textvec as tv
from granary.llm.shared import fold, ship, written

#: Characters of an n-gram, discount, buckets of each table, share of a toxic text's expressions from the toxic
#: model, score from which a text is predicted toxic, most texts of the calibration sample, share of rows it is
#: taken from.
ORDER, DISCOUNT, BUCKETS, SHARE, LEAST, CALIBRATION, APART = 5, 0.75, 1 << 20, 0.02, 0.7, 20_000, 5
FEATURES = 2
#: Least spread of the features that the calibration reckons with, as rows of one class hardly differ.
LEAST_SCALE = np.array([1.0, 0.25])
#: Words and expressions that a worker remembers; only speed depends on it.
MOST_WORDS = 300_000

_RUN = re.compile(r"[^\W\d_]+")
_U = np.uint64


def expressions(text: str) -> list[str]:
    return _RUN.findall(text.lower())


def character_grams(words: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams (rows 0 to order) that end at each character of the words set between a start and
    an end mark, the places of the characters to predict in them, how far into its word each of these stands
    (from 1), and its word. An n-gram lies in its word where n is at most that place + 1."""
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    points = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
    edge = np.concatenate([[0], np.cumsum(sizes)])
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(points)) - edge[word]
    acc = np.zeros(len(points), _U)
    by_length = [tv.mix(acc + _U(1))]
    for n in range(1, order + 1):
        shifted = np.concatenate([np.zeros(1, _U), acc[:-1]]) if n > 1 else acc
        acc = shifted * _U(0x9E3779B97F4A7C15) + points
        by_length.append(tv.mix(acc + _U(n * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF)))
    at = np.flatnonzero(place > 0)
    return np.stack(by_length), at, place[at], word[at]


#: Counts by class: of rows outside the fifth kept apart, and within.
_COUNTS = ("n0", "n1", "a0", "a1")


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = tuple(Counter() for _ in _COUNTS)

    def taken() -> pa.RecordBatch:
        words = list(set().union(*counts))
        out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in counts)], names=["word", *_COUNTS])
        for c in counts:
            c.clear()
        return out

    for batch in batches:
        for text, toxic, apart in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            counts[toxic + 2 * apart].update(set(expressions(text or "")))
            if sum(map(len, counts)) > MOST_WORDS:
                yield taken()
    yield taken()


def _hashes(points: np.ndarray) -> np.ndarray:
    """Hashes of n-grams given as rows of n characters, as ``character_grams`` has them."""
    acc = np.zeros(len(points), _U)
    for k in range(points.shape[1]):
        acc = acc * _U(0x9E3779B97F4A7C15) + points[:, k]
    return tv.mix(acc + _U(points.shape[1] * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF if points.shape[1] else 1))


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams of two characters or more of words set between marks, and their counts."""
    for batch in batches:
        for start in range(0, batch.num_rows, 25_000):
            part = batch.slice(start, 25_000)
            words = part.column(0).to_pylist()
            points = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
            table, at, place, word = character_grams(words)
            counts = [part.column(i + 1).to_numpy() for i in range(len(_COUNTS))]
            for n in range(2, len(table)):
                inside = place + 1 >= n
                here, own = at[inside], word[inside]
                unique, first, index = np.unique(table[n, here], return_index=True, return_inverse=True)
                if len(unique):
                    grams = np.ascontiguousarray(points[here[first][:, None] + np.arange(1 - n, 1)]).view(f"<U{n}").ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(grams.tolist(), pa.string()), *(pa.array(np.bincount(index, c[own]).astype(np.int64)) for c in counts)], names=["gram", *_COUNTS])


def _placed(buckets: int, sums: int):
    """Buckets of an n-gram and of its context (all but the last character), beside ``sums`` further columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column(0).to_pylist()
            sizes = np.array([len(g) for g in grams], np.int64)
            at, context = np.zeros((2, len(grams)), np.int32)
            for n in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == n)
                points = np.frombuffer("".join(grams[i] for i in own.tolist()).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n).astype(_U)
                at[own], context[own] = _hashes(points) & _U(buckets - 1), _hashes(points[:, :-1]) & _U(buckets - 1)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(context), *(batch.column(1 + i) for i in range(sums))], names=["at", "context", *(f"n{i}" for i in range(sums))])

    return run


class ToxicModel:
    """Bucketed counts of both classes and of the shared backoff, and the calibration."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        z = lambda t: np.zeros(buckets, t)
        self.gram, self.context, self.types = [z(np.int64), z(np.int64)], [z(np.int64), z(np.int64)], [z(np.int32), z(np.int32)]
        self.tail, self.tail_context, self.tail_types, self.characters = z(np.int32), z(np.int32), z(np.int32), 0
        self.mean, self.scale, self.weights = np.zeros(FEATURES), np.ones(FEATURES), None

    def __getstate__(self) -> dict:
        """Tables are mostly zeros until much text is labelled: they travel compressed."""
        press = lambda a: (a.dtype.str, zlib.compress(a.tobytes(), 1))
        return {k: [press(a) for a in v] if isinstance(v, list) else press(v) if isinstance(v, np.ndarray) else v for k, v in self.__dict__.items()}

    def __setstate__(self, state: dict) -> None:
        whole = lambda t: np.frombuffer(zlib.decompress(t[1]), t[0])
        self.__dict__ = {k: [whole(t) for t in v] if isinstance(v, list) else whole(v) if isinstance(v, tuple) else v for k, v in state.items()}

    def _at(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & _U(self.buckets - 1)).astype(np.int64)

    def logs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-probability of every character (and end) of the words under the ordinary and the toxic model,
        and its word. Each order discounts and gives what that frees to the next shorter one: the longest
        n-gram by class counts, all shorter ones by the shared continuation counts, the last evenly to the
        known characters and one unknown."""
        table, at, place, word = character_grams(words)
        order = len(table) - 1
        p = np.full(len(at), 1 / (self.characters + 1))
        for n in range(1, order):
            here = np.flatnonzero(place >= n)
            context = self._at(table[n - 1, at[here] - 1])
            seen = self.tail_context[context]
            here, context, seen = here[seen > 0], context[seen > 0], seen[seen > 0]
            p[here] = (np.maximum(self.tail[self._at(table[n, at[here]])] - DISCOUNT, 0) + DISCOUNT * self.tail_types[context] * p[here]) / seen
        long = np.minimum(order, place + 1)
        gram, context = self._at(table[long, at]), self._at(table[long - 1, at - 1])
        out = []
        for c in (0, 1):
            seen = self.context[c][context]
            own = (np.maximum(self.gram[c][gram] - DISCOUNT, 0) + DISCOUNT * self.types[c][context] * p) / np.maximum(seen, 1)
            out.append(np.log(np.maximum(np.where(seen > 0, own, p), 1e-12)))  # buckets that collide can add up to nothing
        return out[0], out[1], word

    def evidence(self, words: list[str]) -> np.ndarray:
        """Toxic minus ordinary log-likelihood of each expression, in nats."""
        ordinary, toxic, word = self.logs(words)
        return np.bincount(word, toxic - ordinary, len(words))

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(features))
        x = np.column_stack([(features - self.mean) / self.scale, np.ones(len(features))])
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -700, 40)))

    def calibrate(self, features: np.ndarray, toxic: np.ndarray, odds: float) -> None:
        """Ridge logistic regression by Newton steps on the toxic share of each text, towards weights of 1 for
        either feature and the log odds of all labelled texts, so that few rows, rows of one class or none
        still give scores that rise with the evidence."""
        if len(features):
            self.mean, self.scale = features.mean(axis=0), np.maximum(features.std(axis=0), LEAST_SCALE)
        x = np.column_stack([(features - self.mean) / self.scale, np.ones(len(features))])
        towards = np.array([1.0] * FEATURES + [odds])
        w = towards.copy()
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
            slope = x.T @ (toxic - p) - 0.1 * (w - towards)
            w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(FEATURES + 1), slope)
        if not 0 < toxic.sum() < len(toxic):  # one class alone says nothing of the features' signs
            w[:FEATURES] = np.maximum(w[:FEATURES], 0)
        self.weights = w


class _Reader:
    """Features of texts: the log of the mixed evidence per expression, and the plain evidence per expression.
    Evidence of words met before is remembered."""

    def __init__(self, model: ToxicModel):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.known, self.values = np.empty(0, _U), np.empty((0, 3))

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        runs = [expressions(w) for w in words]
        flat = [r for x in runs for r in x]
        sizes = np.array([len(x) for x in runs])
        values = np.zeros((len(words), 3))
        if flat:
            e = self.model.evidence(flat)
            owner = np.repeat(np.arange(len(words)), sizes)
            mixed = np.log1p(SHARE * np.expm1(np.minimum(e, 500)))
            values = np.column_stack([np.bincount(owner, mixed, len(words)), np.bincount(owner, e, len(words)), sizes])
        known, values = np.concatenate([self.known, hashes]), np.concatenate([self.values, values])
        order = np.argsort(known, kind="stable")
        self.known, self.values = known[order], values[order]

    def features(self, column: pa.Array) -> np.ndarray:
        data, offsets = tv.raw(column)
        starts, ends, bounds = tv.word_bounds(data, offsets)
        unique, first, index = np.unique(tv.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) + len(unique) > MOST_WORDS:
            self.forget()
        new = ~np.isin(unique, self.known, assume_unique=True)
        if new.any():
            body = data.tobytes()
            self._learn(unique[new], [body[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
        sums = np.zeros((len(column), 3))
        some = np.flatnonzero(bounds[1:] > bounds[:-1])
        if len(some):  # each text's own sum, whatever stands beside it
            sums[some] = np.add.reduceat(self.values[np.searchsorted(self.known, unique)][index], bounds[:-1][some], axis=0)
        mixed, plain, n = sums.T
        n = np.maximum(n, 1)
        return np.column_stack([np.log(np.maximum(mixed, 0) / n + 0.001), plain / n])


_readers: dict[str, _Reader] = {}


def _reader(shared) -> _Reader:
    if shared.id not in _readers:
        _readers.clear()
        _readers[shared.id] = _Reader(shared.value)
    return _readers[shared.id]


class _Shared:
    """A broadcast with a name of its own, so that a worker keeps what it learned across tasks."""

    def __init__(self, spark, model: ToxicModel):
        self.broadcast, self.id = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    @property
    def value(self) -> ToxicModel:
        return self.broadcast.value


def _featured(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.slices(batch, "text"):
                f = _reader(shared).features(part.column(0))
                yield pa.RecordBatch.from_arrays([*(pa.array(f[:, i]) for i in range(FEATURES)), part.column(1)], names=["a", "b", "toxic"])

    return run


def _counted(grams: DataFrame, buckets: int) -> ToxicModel:
    """The tables of grams and their counts n0 and n1. The longest n-gram that a character has is of ORDER
    characters or begins with the start mark; only these have class counts, all others say how many distinct
    characters precede their tail."""
    model = ToxicModel(buckets)

    def table(df: DataFrame, key: str, **sums) -> pd.DataFrame:
        return df.groupBy(F.col(key).alias("at")).agg(*[F.sum(v).alias(k) for k, v in sums.items()]).toPandas()

    longest = grams.filter((F.length("gram") == ORDER) | F.col("gram").startswith("\x02")).select("gram", "n0", "n1")
    longest = longest.mapInArrow(_placed(buckets, 2), "at int, context int, n0 long, n1 long")
    t = table(longest, "at", n0=F.col("n0"), n1=F.col("n1"))
    model.gram[0][t["at"]], model.gram[1][t["at"]] = t["n0"], t["n1"]
    t = table(longest, "context", n0=F.col("n0"), n1=F.col("n1"), t0=(F.col("n0") > 0).cast("int"), t1=(F.col("n1") > 0).cast("int"))
    for c in (0, 1):
        model.context[c][t["at"]], model.types[c][t["at"]] = t[f"n{c}"], t[f"t{c}"]
    tails = grams.groupBy(F.substr("gram", F.lit(2)).alias("tail")).agg(F.count(F.lit(1)).alias("n"))
    placed = tails.mapInArrow(_placed(buckets, 1), "at int, context int, n0 long")
    t = table(placed, "at", n=F.col("n0"))
    model.tail[t["at"]] = t["n"]
    t = table(placed, "context", n=F.col("n0"), types=F.lit(1))
    model.tail_context[t["at"]], model.tail_types[t["at"]] = t["n"], t["types"]
    model.characters = tails.filter(F.length("tail") == 1).count()
    return model


def learn(labelled: DataFrame, *, buckets: int = BUCKETS, calibration: int = CALIBRATION) -> ToxicModel:
    """Fits on columns text and toxic (0 or 1; other labels are passed over).

    In the counts every row is a document, copies too. In the calibration one text counts once, with the
    toxic share of its copies; the sample is the ``calibration`` texts of the lowest hashes.

    Expressions of the fifth kept apart are counted beside the others, in the same pass: the calibration sees
    tables without them, the model returned has tables of all rows."""
    spark = labelled.sparkSession
    ship(spark)
    rows = labelled.select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1)")
    rows = written(rows.withColumn("h", F.xxhash64("text")), "labelled")
    marked = rows.select("text", "toxic", (F.pmod("h", F.lit(APART)) == 0).cast("int").alias("apart"))
    sums = [F.sum(n).alias(n) for n in _COUNTS]
    longs = ", ".join(f"{n} long" for n in _COUNTS)
    words = marked.mapInArrow(_word_counts, f"word string, {longs}").groupBy("word").agg(*sums)
    grams = words.mapInArrow(_gram_counts, f"gram string, {longs}")
    grams = written(grams.groupBy("gram").agg(*sums), "grams")

    model = _counted(grams.filter("n0 + n1 > 0"), buckets)
    shared = _Shared(spark, model)
    apart = rows.filter(F.pmod("h", F.lit(APART)) == 0)
    of = {r["toxic"]: r["n"] for r in rows.select("h", "toxic").distinct().groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(of) == 2:
        near = apart.select("h").distinct().orderBy("h").limit(calibration).agg(F.max("h")).first()[0]
        once = apart.filter(F.col("h") <= (0 if near is None else near)).groupBy("text").agg(F.avg("toxic").alias("toxic"))
        f = once.mapInArrow(_featured(shared), "a double, b double, toxic double").toPandas().sort_values(["a", "b", "toxic"])
        model.calibrate(f[["a", "b"]].to_numpy(dtype=float).reshape(-1, FEATURES), f["toxic"].to_numpy(dtype=float), float(np.log(of[1] / of[0])))
    shared.broadcast.destroy()
    whole = _counted(grams.withColumns({"n0": F.col("n0") + F.col("a0"), "n1": F.col("n1") + F.col("a1")}), buckets)
    whole.mean, whole.scale, whole.weights = model.mean, model.scale, model.weights
    return whole


def _judged(shared, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.slices(batch, "text"):
                score = shared.value.score(_reader(shared).features(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array((score >= least).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return run


def judge(docs: DataFrame, model: ToxicModel, least: float = LEAST) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from ``least`` on), one row per row of ``docs``.

    Null texts and texts without letters have no evidence and get the low score of that; where training had
    not both classes, every score is 0. Equal texts score alike; repeated rows and null doc_ids pass
    through; an empty table gives no rows. Only the text is an input."""
    ship(docs.sparkSession)
    shared = _Shared(docs.sparkSession, model)
    return docs.select("doc_id", "text").mapInArrow(_judged(shared, least), f"doc_id {dict(docs.dtypes)['doc_id']}, score double, predicted int")


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and toxic of documents whose crc32(doc_id) mod 3 is not 1; of several labels, the largest.

    The join is a merge at every size: labels grow with the documents and are never broadcast."""
    own = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(fold(F.col("doc_id"), 3) != 1)
    return docs.select("doc_id", "text").filter(fold(F.col("doc_id"), 3) != 1).join(own.hint("merge"), "doc_id").select("text", "toxic")
