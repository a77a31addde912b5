"""LM scoring: word bigrams, unigrams and a uniform floor mixed by deleted interpolation.

Counts cover all training documents and are never held in one place. Each task cuts its texts into chunks,
rows of word numbers with the chunk's distinct words, written once; texts aren't shuffled. A chunk asks for
the counts of its distinct n-grams: sorted 64-bit keys, cut by key range into parts, together with its own
training counts of them. The owner of a part adds these up over all chunks and answers each chunk in the
order in which it asked, so an answer is a bare row of counts. Where there are more than GROUP chunks, an
owner serves GROUP of them and asks the next level in its turn, its range cut again: every chunk or owner
sends and gets GROUP parts at most, so rows and bytes grow in proportion to the text (times the levels, the
logarithm of the number of chunks to base GROUP). Memory is one chunk or one part; a frequent word costs one
key per chunk.

The weights depend on how often the context was seen (a bucket per power of two) and are learned by
expectation-maximisation on a tenth of the training documents, each scored with its own counts deleted. The
counts behind that come to the driver as a histogram whose number of cells is fixed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from granary.llm import textvec as tv
from granary.llm.shared import fold, parts_for, ship, written

#: Bytes of text in a chunk, keys in a part, chunks that one owner serves, folds, EM rounds, context buckets,
#: half-octaves of a probability.
CHUNK, PART, GROUP, FOLDS, ROUNDS, BUCKETS, LEVELS = 3_000_000, 1_000_000, 1024, 10, 60, 40, 80

_U = np.uint64
_EVEN = ~_U(1)
_END = tv.mix(np.array([0xE0D], _U))[0] & _EVEN
_START = tv.mix(np.array([0x57A7], _U))[0] & _EVEN

ASKED = "part long, child long, keys binary, own binary"
ANSWERED = "part long, child long, counts binary, types long"


def _planes(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, as many as the largest needs (the first byte tells)."""
    values = values.astype("<u8")
    n = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    return bytes([n]) + values.view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes()


def _unplanes(body: bytes) -> np.ndarray:
    planes = np.frombuffer(body, np.uint8, offset=1).reshape(body[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : body[0]] = planes.T
    return out.view("<u8").ravel()


def _pressed(keys: np.ndarray) -> bytes:
    """Sorted keys, one at least: the first, then differences."""
    return keys[:1].astype("<u8").tobytes() + _planes(np.diff(keys, prepend=keys[:1]))


def _unpressed(body: bytes) -> np.ndarray:
    steps = _unplanes(body[8:])
    steps[0] = np.frombuffer(body, "<u8", 1)[0]
    return np.cumsum(steps, dtype=_U)


def _chunked(chunk_bytes: int):
    """A row per chunk: its number (odd if its documents teach the weights), ids, which are held out, tokens of
    each, training tokens, all tokens, distinct words and the number of each token's word among them."""

    def row(number: int, part: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
        words, bounds = tv.folded_words(part.column(1))
        tokens = np.insert(words & _EVEN, bounds[1:], _END)
        sizes = np.diff(bounds) + 1
        held = part.column(2).to_numpy() == 0
        keys, index = np.unique(np.concatenate([tokens, np.array([_START], _U)]), return_inverse=True)
        ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
        values = [[number], ids, [held.tobytes()], [sizes.astype("<u4").tobytes()], [int(sizes[~held].sum())], [len(tokens)], [_pressed(keys)], [index[:-1].astype("<u4").tobytes()]]
        return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 22
        for batch in batches:
            schema = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(batch.column(0).type)), ("held", pa.binary()), ("sizes", pa.binary()), ("trained", pa.int64()), ("size", pa.int64()), ("words", pa.binary()), ("tokens", pa.binary())])
            for part in tv.slices(batch, "text", chunk_bytes):
                teaches = part.column(2).to_numpy() == 1
                for odd, which in enumerate((~teaches, teaches)):
                    if which.any():
                        yield row(number + odd, part.filter(pa.array(which)), schema)
                number += 2

    return run


class _Chunk:
    """Tokens of a chunk's documents and its distinct keys, sorted; unigram keys are even, bigram keys odd."""

    def __init__(self, held: bytes, sizes: bytes, words: bytes, tokens: bytes):
        self.held = np.frombuffer(held, bool)
        self.sizes = np.frombuffer(sizes, "<u4").astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        words, uni = _unpressed(words), np.frombuffer(tokens, "<u4").astype(np.int64)
        self.start = int(np.searchsorted(words, _START))
        self.context = np.empty_like(uni)
        self.context[1:] = uni[:-1]
        self.context[self.at[:-1]] = self.start
        pairs, bi = np.unique(self.context * len(words) + uni, return_inverse=True)
        keys = np.concatenate([words, tv.chained(words[pairs // len(words)], words[pairs % len(words)]) | _U(1)])
        order = np.argsort(keys, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.keys, self.uni, self.bi = keys[order], place[uni], place[len(words) + bi]
        self.context, self.start = place[self.context], place[self.start]

    def trained(self) -> np.ndarray:
        learn = np.repeat(~self.held, self.sizes)
        own = np.bincount(np.concatenate([self.uni[learn], self.bi[learn]]), minlength=len(self.keys))
        own[self.start] = int((~self.held).sum())
        return own


def _cut(keys: np.ndarray, own: np.ndarray, parts: int, child: int) -> pa.RecordBatch:
    """Sorted keys and their counts as a row per part that holds some."""
    part, first = np.unique(((keys >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64), return_index=True)
    ends = [*first[1:].tolist(), len(keys)]
    return pa.RecordBatch.from_arrays(
        [pa.array(part), pa.array([child] * len(part), pa.int64()), pa.array([_pressed(keys[a:b]) for a, b in zip(first, ends, strict=True)], pa.binary()), pa.array([_planes(own[a:b]) for a, b in zip(first, ends, strict=True)], pa.binary())],
        names=["part", "child", "keys", "own"],
    )


def _asked(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                number, *body = (batch.column(c)[i].as_py() for c in range(5))
                chunk = _Chunk(*body)
                yield _cut(chunk.keys, chunk.trained(), parts, number)

    return run


def _added(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of the rows, their counts added up, the key's number at each place of the rows laid end
    to end, and where each row ends."""
    asked = [_unpressed(x) for x in table.column("keys").to_pylist()]
    own = np.concatenate([_unplanes(x) for x in table.column("own").to_pylist()])
    unique, index = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.zeros(len(unique), np.int64)
    np.add.at(total, index, own.astype(np.int64))
    return unique, total, index, np.concatenate([[0], np.cumsum([len(a) for a in asked])])


def _told(table: pa.Table, total: np.ndarray, index: np.ndarray, cut: np.ndarray, types: int | None = None) -> pa.Table:
    """A row of counts for each row that asked, and one with child -1 for the number of word types."""
    parts, children = table.column("part").to_pylist(), table.column("child").to_pylist()
    counts = [_planes(total[index[a:b]]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    if types is not None:
        parts, children, counts = [*parts, parts[0]], [*children, -1], [*counts, b""]
    return pa.table({"part": pa.array(parts, pa.int64()), "child": pa.array(children, pa.int64()), "counts": pa.array(counts, pa.binary()), "types": pa.array([types if c < 0 else None for c in children], pa.int64())})


def _answered(table: pa.Table) -> pa.Table:
    unique, total, index, cut = _added(table)
    return _told(table, total, index, cut, int(((unique & _U(1) == 0) & (unique != _START) & (total > 0)).sum()))


def _merged(parts: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        unique, total, _, _ = _added(table)
        return pa.Table.from_batches([_cut(unique, total, parts, key[1].as_py())])

    return run


def _passed(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
    if not table.num_rows:
        return _told(table, np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(1, np.int64))
    _, _, index, cut = _added(table)
    return _told(table, _counts(answers), index, cut)


def _counts(answers: pa.Table) -> np.ndarray:
    rows = sorted(zip(answers.column("part").to_pylist(), answers.column("counts").to_pylist(), strict=True))
    return np.concatenate([_unplanes(x) for _, x in rows]).astype(np.int64)


def totals(asked: DataFrame, children: int, parts: int, group: int) -> DataFrame:
    """Answers (see ANSWERED) to all rows of ``asked`` (see ASKED): the counts of their keys over all children."""
    groups = parts_for(children, group)
    if groups == 1:
        return asked.groupBy("part").applyInArrow(_answered, ANSWERED)
    asked = written(asked.withColumn("owner", F.pmod(F.xxhash64("child"), F.lit(groups)).cast("long")), "asked")
    fan = min(groups, group)
    up = asked.groupBy("part", "owner").applyInArrow(_merged(parts * fan), ASKED)
    up = written(totals(up, groups, parts * fan, group), "answers")
    own = up.filter("child >= 0").withColumn("whole", F.floor(F.col("part") / fan).cast("long"))
    return asked.groupBy("part", "owner").cogroup(own.groupBy("whole", "child")).applyInArrow(_passed, ANSWERED).unionByName(up.filter("child < 0"))


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(context + 1.0)).astype(np.int64), BUCKETS - 1)


def _ratio(a: np.ndarray, b) -> np.ndarray:
    b = np.broadcast_to(np.asarray(b, float), a.shape)
    return np.divide(a, b, out=np.zeros(a.shape), where=b > 0)


def _level(p: np.ndarray) -> np.ndarray:
    """0 for probability 0, else 1 + half-octaves below 1."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, 1 + np.minimum(np.round(-2 * np.log2(np.maximum(p, 1e-300))), LEVELS - 1), 0).astype(np.int64)


def _share(level: np.ndarray) -> np.ndarray:
    return np.where(level > 0, 2.0 ** (-(level - 1) / 2), 0.0)


def _deleted(n_tokens: int):
    """Histogram of (context bucket, level of the bigram estimate, level of the unigram estimate), each
    document's own counts taken away."""

    def run(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = _Chunk(*(rows.column(c)[0].as_py() for c in BODY))
        counts = _counts(answers)
        doc = np.repeat(np.arange(len(chunk.sizes)), chunk.sizes)
        wide = len(counts)

        def own(index: np.ndarray) -> np.ndarray:
            _, inverse, n = np.unique(doc * wide + index, return_inverse=True, return_counts=True)
            return n[inverse]

        # A context occurs in its document once per successor; the opening context once in all.
        context = counts[chunk.context] - own(chunk.context)
        p2 = _ratio(counts[chunk.bi] - own(chunk.bi), context)
        p1 = _ratio(counts[chunk.uni] - own(chunk.uni), n_tokens - np.repeat(chunk.sizes, chunk.sizes))
        cell = (_bucket(context) * (LEVELS + 1) + _level(p2)) * (LEVELS + 1) + _level(p1)
        cells, n = np.unique(cell, return_counts=True)
        return pa.table({"cell": pa.array(cells, pa.int64()), "n": pa.array(n, pa.int64())})

    return run


def learn_weights(cells: np.ndarray, n: np.ndarray, floor: float, rounds: int = ROUNDS) -> np.ndarray:
    """BUCKETS x 3 weights (bigram, unigram, floor) by expectation-maximisation over histogram cells.

    Every component starts each round with one pseudo-count, so none becomes 0; a bucket without held-out
    tokens takes equal weights, and bucket 0 (context unseen) gives the bigram nothing to explain."""
    width = LEVELS + 1
    bucket, p = cells // (width * width), np.stack([_share(cells // width % width), _share(cells % width), np.full(len(cells), floor)], axis=1)
    weights = np.full((BUCKETS, 3), 1 / 3)
    for _ in range(rounds):
        joint = weights[bucket] * p
        joint *= (n / np.maximum(joint.sum(axis=1), 1e-300))[:, None]
        got = np.ones((BUCKETS, 3))
        np.add.at(got, bucket, joint)
        weights = got / got.sum(axis=1, keepdims=True)
    return weights


def _scored(shared, doc_type: pa.DataType):
    def run(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        n_tokens, n_types, weights = shared.value
        chunk = _Chunk(*(rows.column(c)[0].as_py() for c in BODY))
        counts = _counts(answers)
        own, context = counts[chunk.uni], counts[chunk.context]
        base = np.log10((own + 0.1) / (n_tokens + 0.1 * (n_types + 1)))
        w = weights[_bucket(context)]
        p = w[:, 0] * _ratio(counts[chunk.bi], context) + w[:, 1] * _ratio(own, n_tokens) + w[:, 2] / (n_types + 1)
        at = chunk.at[:-1]
        return pa.table({
            "doc_id": rows.column("ids").combine_chunks().flatten().cast(doc_type), "held_out": pa.array(chunk.held), "n_tokens": pa.array(chunk.sizes, pa.int64()),
            "n_known": pa.array(np.add.reduceat((own > 0).astype(np.int64), at)), "train_tokens": pa.array(np.full(len(at), n_tokens), pa.int64()),
            "base_score": pa.array(np.add.reduceat(base, at)), "score": pa.array(np.add.reduceat(np.log10(p), at)),
        })

    return run


BODY = ["held", "sizes", "words", "tokens"]


def score_texts(docs: DataFrame, *, weights: np.ndarray | None = None, chunk_bytes: int = CHUNK, part_keys: int = PART, group: int = GROUP) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, one row per row of ``docs``.

    Words are runs without ASCII white space, A-Z lower-cased; an end token follows them. Null and empty
    texts are the end token alone. Rows whose crc32(doc_id) mod 10 is 0 are held out; the others are counted
    (a null doc_id counts as the empty text), and those with remainder 1 also teach the weights. ``weights``
    (BUCKETS x 3: bigram, unigram, floor) are learned unless given. Repeated rows count as often as they stand.
    Without training rows all counts are 0 and the floor is all there is; an empty table gives no rows. Other
    columns are ignored. A text is in one chunk, however long."""
    spark = docs.sparkSession
    ship(spark)
    doc_type = docs.schema["doc_id"].dataType
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), fold(F.col("doc_id"), FOLDS).alias("fold"))
    chunks = written(d.mapInArrow(_chunked(chunk_bytes), f"chunk long, ids array<{doc_type.simpleString()}>, held binary, sizes binary, trained long, size long, words binary, tokens binary"), "chunks")
    n_chunks, n_tokens, size = chunks.agg(F.count(F.lit(1)), F.coalesce(F.sum("trained"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = parts_for(size * min(1, group / max(n_chunks, 1)), part_keys)  # a key a token, about

    asked = chunks.select("chunk", *BODY).mapInArrow(_asked(parts), ASKED)
    answers = written(totals(asked, n_chunks, parts, group), "answers")
    n_types = int(answers.filter("child = -1").agg(F.sum("types")).first()[0] or 0)
    answers = answers.filter("child >= 0").select("child", "part", "counts")

    met = lambda rows, said: rows.groupBy("chunk").cogroup(said.groupBy("child"))
    if weights is None:
        teach = met(chunks.select("chunk", *BODY).filter("chunk % 2 = 1"), answers.filter("child % 2 = 1")).applyInArrow(_deleted(n_tokens), "cell long, n long")
        cells = teach.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        weights = learn_weights(cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(float), 1 / (n_types + 1))
    shared = spark.sparkContext.broadcast((n_tokens, n_types, weights))
    return met(chunks.drop("trained", "size"), answers).applyInArrow(
        _scored(shared, to_arrow_type(doc_type)), f"doc_id {doc_type.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
