"""Document fingerprints by randomised edit embedding.

A text is spelt out along shared random walks: at step j a walk writes the character it stands on and, if the
random bit of (j, character) is 1, moves on to the next. Two texts meet the same bits, so after an edit their
walks drift apart and meet again, and the edit distance of the texts becomes a Hamming distance of what the
walks wrote. Of that writing a fingerprint keeps one sampled place per slot (bit sampling), as a byte.

The places of a slot are the records of one random sequence, so that the last record before the end of a
writing is a uniform place of it, and writings of nearly equal length mostly sample the same place. The share
of equal slots is the likeness of two fingerprints.

Banding: the slots are cut into BANDS bands. Fingerprints that differ in fewer slots than there are bands
agree in a whole band, so no pair within the limit is missed. Candidates of a band are verified on all slots
and grouped by union-find; hubs and blocks keep large groups from being listed pair by pair."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm import textvec as tv
from granary.llm.components import components
from granary.llm.shared import written

#: Walks, slots of a walk, bands over all slots, slots that two linked fingerprints may differ in (less than BANDS).
WALKS, SLOTS, BANDS, APART = 1, 224, 16, 15
#: Steps after which a walk's bits repeat (256, so that a step fits a byte), and classes that characters are dealt to.
PERIOD, CLASSES = 256, 64
#: Fingerprints of a block in the comparison of what hubs left over, and shares that the members of a bucket are dealt to.
BLOCK, SHARES = 20_000, 16

_U = np.uint64
_WIDTH = WALKS * SLOTS


class Walk:
    """One random walk as an automaton: a state is the step (modulo PERIOD) at which a character is reached."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        bits = rng.random((PERIOD, CLASSES)) < 0.5
        bits[0] = True  # no character stays for a whole period
        ahead = np.zeros((2 * PERIOD + 1, CLASSES), np.int64)
        ahead[-1] = 2 * PERIOD
        for j in range(2 * PERIOD - 1, -1, -1):
            ahead[j] = np.where(bits[j % PERIOD], j, ahead[j + 1])
        to = (ahead[:PERIOD] + 1) % PERIOD
        self.states: list[list] = [[] for _ in range(PERIOD)]
        for j, row in enumerate(to.tolist()):
            self.states[j] += [self.states[k] for k in row]
            self.states[j].append(j)
        records = np.zeros((SLOTS, 96), np.int64)
        for k in range(1, 96):
            records[:, k] = np.minimum(np.ceil((records[:, k - 1] + 1) / rng.random(SLOTS)), 2.0**53)
        self.records, self.soonest = records.T.copy(), records.min(axis=0)
        self.salt = rng.integers(0, 1 << 63, SLOTS).astype(_U)

    def steps(self, classes: bytes, start: int = 0) -> np.ndarray:
        """At which step each character is reached, and the end; the first one at ``start``."""
        state = self.states[start % PERIOD]
        at = np.frombuffer(bytes([(state := state[c])[CLASSES] for c in classes]), np.uint8)
        out = np.empty(len(classes) + 1, np.int64)
        out[0] = start
        np.cumsum(np.diff(at, prepend=np.uint8(start % PERIOD)), out=out[1:])  # differences of bytes are modulo PERIOD
        out[1:] += start
        return out

    def samples(self, steps: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """A byte for each slot: 0 where nothing was written, else 1 to 255 by place and character."""
        end = steps[-1]
        if not end:
            return np.zeros(SLOTS, np.uint8)
        early = self.records[: np.searchsorted(self.soonest, end)]
        place = early[(early < end).sum(axis=0) - 1, np.arange(SLOTS)]
        letter = classes[np.searchsorted(steps, place, "right") - 1]
        return (tv.mix(place.astype(_U) * tv.GOLDEN + letter + self.salt) % _U(255) + _U(1)).astype(np.uint8)


@functools.lru_cache(maxsize=1)
def walks() -> tuple[Walk, ...]:
    return tuple(Walk(seed) for seed in range(WALKS))


def classes_of(text: str) -> np.ndarray:
    """The class of each code point."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return (tv.mix(points.astype(_U) * tv.GOLDEN) & _U(CLASSES - 1)).astype(np.uint8)


class Print:
    """A text with its classes, the steps of its walks and its fingerprint."""

    def __init__(self, text: str, before: Print | None = None, keep: int = 0):
        """``before`` and ``keep``: the walks go on from the first ``keep`` characters of that text."""
        own = classes_of(text)
        if before is None:
            self.classes = own
            self.steps = [w.steps(own.tobytes()) for w in walks()]
        else:
            self.classes = np.concatenate([before.classes[:keep], own])
            body = own.tobytes()
            self.steps = [np.concatenate([s[:keep], w.steps(body, int(s[keep]))]) for w, s in zip(walks(), before.steps, strict=True)]
        self.bytes = np.concatenate([w.samples(s, self.classes) for w, s in zip(walks(), self.steps, strict=True)])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal slots."""
    return float((a == b).mean())


def fingerprint(text: str | None) -> bytes:
    return Print(text or "").bytes.tobytes()


def edited(text: str, following: str) -> tuple[str, int]:
    """The text whose last half is replaced by the start of the following one, and how many of its own
    characters it keeps."""
    half = len(text) // 2
    keep = len(text) - half
    return text[:keep] + following[:half], keep


def _row(text: str, own: Print, after: str, following: np.ndarray) -> tuple:
    changed, keep = edited(text, after)
    other = Print(changed[keep:], own, keep)
    return (len(text), hashlib.sha256(changed.encode()).hexdigest(), own.bytes.tobytes(), other.bytes.tobytes(), likeness(own.bytes, other.bytes), likeness(own.bytes, following))


_MADE = [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_MADE_DDL = "n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, each with the one behind it. The last row of a task waits for the next task's first: both
    leave with their texts, as kind 'last' and 'first'."""
    held, out, schema, part = None, [], None, TaskContext.get().partitionId()

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        kinds = [schema.field("doc_id").type, schema.field("copies").type, pa.string(), pa.int32(), pa.string(), *(t for _, t in _MADE)]
        names = ["doc_id", "copies", "kind", "part", "text", *(n for n, _ in _MADE)]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    nothing = (None,) * len(_MADE)
    for b in batches:
        schema = b.schema
        for piece in tv.slices(b, "text"):
            for doc_id, text, copies in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist(), piece.column("copies").to_pylist(), strict=True):
                own = Print(text)
                if held is None:
                    out.append((doc_id, copies, "first", part, text, *nothing))
                else:
                    out.append((held[0], held[1], "done", part, None, *_row(held[2], held[3], text, own.bytes)))
                held = (doc_id, copies, text, own)
            if out:
                yield batch()
    if held is not None:
        out.append((held[0], held[1], "last", part, held[2], *nothing))
        yield batch()


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for piece in tv.slices(b, "text"):
            made = [_row(text, Print(text), after, Print(after).bytes) for text, after in zip(piece.column("text").to_pylist(), piece.column("after").to_pylist(), strict=True)]
            columns = zip(*made, strict=True)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("copies"), *(pa.array(list(c), t) for c, (_, t) in zip(columns, _MADE, strict=True))], names=["doc_id", "copies", *(n for n, _ in _MADE)])


def _distinct(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty), copies: repeated rows are one document."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return rows.withColumn("copies", F.lit(1).cast("long"))
    return rows.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("copies"))


def prints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (binary), near_edited, near_next.

    Each document also meets the next one by descending doc_id (nulls last, ties by hash of the text; after the
    last the first), whose start replaces its last half in the edited text. Null texts count as empty; their
    fingerprint is all zeros and like no other's but theirs. Rows equal in doc_id and text are one document and
    return one row each with the same values; a single document follows itself. An empty table gives no rows,
    other columns are ignored. Texts cross the network once, ordered by ranges of doc_id; only the first and the
    last text of each range travel again."""
    doc_id = dict(docs.dtypes)["doc_id"]
    order = [F.col("doc_id").desc_nulls_last(), F.col("h"), F.col("text")]
    rows = _distinct(docs).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order).select("doc_id", "text", "copies")
    out = written(rows.mapInArrow(_chain, f"doc_id {doc_id}, copies long, kind string, part int, text string, {_MADE_DDL}"), "prints")
    ranges = out.filter("kind = 'first'").select("part")
    behind = F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.orderBy("part")))
    after = out.filter("kind = 'first'").select(F.col("part").alias("behind"), F.col("text").alias("after"))
    last = out.filter("kind = 'last'").join(ranges.withColumn("behind", behind), "part").join(after, "behind")
    ends = last.select("doc_id", "copies", "text", "after").mapInArrow(_ends, f"doc_id {doc_id}, copies long, {_MADE_DDL}")
    both = out.filter("kind = 'done'").drop("kind", "part", "text").unionByName(ends)
    return both.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("_", "copies")


def _near(links: DataFrame, ids: DataFrame) -> DataFrame:
    """The pairs (u, v) of ids whose fingerprints differ in APART slots at most."""
    left, right = (ids.select(F.col("id").alias(c), F.col("fingerprint").alias(f"f{c}")) for c in "uv")
    return links.join(left, "u").join(right, "v").mapInArrow(_within, "u binary, v binary")


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fu, fv = _matrix(b.column("fu")), _matrix(b.column("fv"))
        yield b.select(["u", "v"]).filter(pa.array((fu != fv).sum(axis=1) <= APART))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _compared(key: tuple, held: pa.Table, waiting: pa.Table) -> pa.Table:
    """Links of waiting fingerprints to a block of their group, as many as it takes to join what is connected:
    one link into the group stands for all."""
    links: list[tuple[bytes, bytes]] = []
    if held.num_rows and waiting.num_rows:
        names, inside, rows = held.column("id").to_pylist(), held.column("inside").to_pylist(), _matrix(held.column("fingerprint"))
        above: dict[bytes, bytes] = {}

        def top(x: bytes) -> bytes:
            while above.setdefault(x, x) != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        for name, own in zip(waiting.column("asks").to_pylist(), _matrix(waiting.column("own")), strict=True):
            for i in np.flatnonzero((rows != own).sum(axis=1) <= APART).tolist():
                a, b = top(name), top(b"" if inside[i] else names[i])
                if a != b:
                    above[a] = b
                    links.append((name, names[i]))
    return pa.table({"u": pa.array([u for u, _ in links], pa.binary()), "v": pa.array([v for _, v in links], pa.binary())})


def classes(made: DataFrame) -> DataFrame:
    """fingerprint, class_id for each fingerprint of ``made`` (doc_id, n_chars, fingerprint): the smallest doc_id
    reachable over links between fingerprints that differ in APART slots at most. Texts without characters are
    in no class.

    Equal fingerprints are one node. In every bucket of a band all nodes are compared with its hub; pairs that
    no group holds after that involve a node outside the bucket's largest group, and those nodes are compared,
    in blocks, with the members of such buckets. So no link is lost and none within a group is listed."""
    nodes = written(made.filter("n_chars > 0").groupBy("fingerprint").agg(F.min("doc_id").alias("first")).withColumn("id", F.unhex(F.md5("fingerprint"))), "nodes")
    wide = _WIDTH // BANDS
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("fingerprint"), i * wide + 1, F.lit(wide))))
    member = nodes.select("id", F.explode(band).alias("key")).withColumn("share", F.pmod(F.xxhash64("id"), F.lit(SHARES)).cast("int"))
    full = member.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("hub")).filter("members > 1")
    full = full.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    member = written(member.join(full, ["key", "share"]).select("key", "share", "id", "hub"), "buckets")

    asks = member.filter("id <> hub").select(F.col("id").alias("u"), F.col("hub").alias("v")).distinct()
    edges = written(_near(asks, nodes), "links")
    roots = components(edges)
    rest = member.filter("id <> hub").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    share = rest.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    main = share.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("groups")).filter("groups > 1")
    main = main.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    open_ = rest.join(main, ["key", "share"]).select("main", "id", (F.col("root") == F.col("main")).alias("inside")).distinct()
    open_ = written(open_.join(nodes, "id").select("main", "id", "inside", "fingerprint"), "waits")
    cuts = open_.groupBy("main").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("segments"), F.ceil(F.sum(F.when(F.col("inside"), 0).otherwise(1)) / BLOCK).cast("int").alias("blocks"))
    lot = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = open_.join(cuts, "main").select("main", "id", "inside", "fingerprint", lot("segments").alias("segment"), each("blocks").alias("block"))
    waiting = open_.filter("not inside").join(cuts, "main").select(F.col("main").alias("to"), F.col("id").alias("asks"), F.col("fingerprint").alias("own"), lot("blocks").alias("lot"), each("segments").alias("part"))
    more = written(held.groupBy("main", "segment", "block").cogroup(waiting.groupBy("to", "part", "lot")).applyInArrow(_compared, "u binary, v binary"), "links")
    if not more.isEmpty():
        roots = components(edges.union(more))
    named = nodes.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("fingerprint", "first", F.coalesce("root", "id").alias("root"))
    return named.select("fingerprint", "root").join(named.groupBy("root").agg(F.min("first").alias("class_id")), "root").select("fingerprint", "class_id")


def near_texts(docs: DataFrame) -> DataFrame:
    """``prints`` with class_id; a text without characters has its own doc_id there."""
    made = prints(docs)
    found = classes(made)
    return made.join(found, "fingerprint", "left").withColumn("class_id", F.when(F.col("n_chars") == 0, F.col("doc_id")).otherwise(F.col("class_id")))
