"""Near-duplicate groups: SuperMinHash signatures, banding, exact verification, union-find.

1. One pass over whole texts makes each document's set of distinct word shingles and from it a digest of
   the set and the band keys of its SuperMinHash signature.
2. Documents of one set are one node from here on, so thousands of copies cost one row.
3. Nodes that share a band key are candidates. In every bucket all members are first compared with a hub,
   which unites most of a group of near copies by as many pairs as it has members. Pairs of a bucket that no
   group holds after that involve a member outside the bucket's largest group; such members wait for that
   group and are compared, in blocks, with its members in such buckets and with each other. So pairs within a
   group are never listed, and no candidate that banding proposes is dropped.
4. A candidate counts only if the full sets pass the threshold; union-find joins what passed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm import textvec as tv
from granary.llm.components import components
from granary.llm.shared import small_batches, written

#: Words in a shingle, least similarity in percent, bands and rows of a band. A pair at 80 % is missed by
#: all of 24 bands of 4 rows with probability (1 - 0.8**4)**24 < 4e-6.
WORDS, PERCENT, BANDS, ROWS = 5, 80, 24, 4
#: Shingles of a block in the comparison of what hubs left over.
BLOCK = 500_000
#: Elements whose permutations are held at once.
LOT = 1 << 18

_U = np.uint64
_LOW = _U(0xFFFFFFFF)


def super_minhash(elements: np.ndarray, owner: np.ndarray, n: int, m: int) -> np.ndarray:
    """n x m signatures of the distinct ``elements`` of each owner, slots as level << 32 | random.

    Every element draws a random permutation of the slots step by step (Fisher-Yates) and offers slot
    number j of it the value j + uniform. An owner leaves the loop as soon as all its slots are below
    the current level: no later step can lower any of them. Elements go in lots, which bounds the working
    space; the least value of a slot doesn't depend on their order."""
    slots = np.full(n * m, np.iinfo(_U).max, _U)
    table = slots.reshape(n, m)
    lots = [slice(a, a + LOT) for a in range(0, len(elements), LOT)]
    for lot in lots:
        first, value = _first(elements[lot], m)
        np.minimum.at(slots, owner[lot] * m + first, value)
    for lot in lots:
        open_ = table.max(axis=1) >= _U(1 << 32)
        own = open_[owner[lot]]
        _lower(table, elements[lot][own], owner[lot][own])
    return table


def _first(e: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The slot that each element draws first, and its value there."""
    drawn = tv.mix(e ^ _U(0x5851F42D4C957F2D))
    return ((drawn & _LOW) * _U(m) >> _U(32)).astype(np.int64), drawn >> _U(32)


def _lower(table: np.ndarray, e: np.ndarray, d: np.ndarray) -> None:
    """Lowers the slots of owners ``d`` by what their elements ``e`` draw after the first step."""
    m = table.shape[1]
    slots = table.reshape(-1)
    first, _ = _first(e, m)
    place = np.broadcast_to(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(e), m)).copy()
    row = np.arange(len(e))
    place[row, first] = 0
    place[row, 0] = first
    for j in range(1, m):
        if not len(e):
            break
        drawn = tv.mix(e + _U(j * int(tv.GOLDEN) & 0xFFFFFFFFFFFFFFFF))
        k = j + ((drawn & _LOW) * _U(m - j) >> _U(32)).astype(np.int64)
        taken, here = place[row, k], place[row, j]
        place[row, k], place[row, j] = here, taken
        np.minimum.at(slots, d * m + taken, (_U(j) << _U(32)) | (drawn >> _U(32)))
        still = table.max(axis=1) >= _U((j + 1) << 32)
        if not still[d].all():
            go = still[d]
            e, d, row = e[go], d[go], row[go]


def _distinct(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text and their offsets."""
    grams, ends = tv.shingles(*tv.folded_words(column), k)
    sets = [np.unique(grams[ends[i] : ends[i + 1]]) for i in range(len(ends) - 1)]
    del grams
    values = sets[0] if len(sets) == 1 else np.concatenate([np.empty(0, _U), *sets])
    return values, np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def _digests(values: np.ndarray, ends: np.ndarray) -> list[bytes | None]:
    import hashlib

    return [hashlib.blake2b(values[a:b], digest_size=16).digest() if b > a else None for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.view(np.int64)))


def _signed(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.slices(batch, "text"):
                values, ends = _distinct(part.column(1), k)
                sizes, n = np.diff(ends), part.num_rows
                table = super_minhash(values, np.repeat(np.arange(n), sizes), n, bands * rows)
                keys = np.empty((n, bands), _U)
                for b in range(bands):
                    acc = np.full(n, b + 1, _U)
                    for r in range(rows):
                        acc = tv.chained(acc, table[:, b * rows + r])
                    keys[:, b] = acc
                some = sizes > 0
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(sizes, pa.int64()), pa.array(_digests(values, ends), pa.binary()),
                     _lists(keys[some].ravel(), np.concatenate([[0], np.cumsum(some * bands)]))],
                    names=["doc_id", "text_hash", "n_shingles", "node", "bands"],
                )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.slices(batch, "text"):
                values, ends = _distinct(part.column(1), k)
                yield pa.RecordBatch.from_arrays([pa.array(_digests(values, ends), pa.binary()), _lists(values, ends)], names=["node", "grams"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v, nu, nv) whose full sets have 100 * intersection >= percent * union."""
    left, right = sets.select(F.col("node").alias("u"), F.col("grams").alias("gu")), sets.select(F.col("node").alias("v"), F.col("grams").alias("gv"))
    both = F.size(F.array_intersect("gu", "gv"))
    found = pairs.join(left, "u").join(right, "v").filter(100 * both >= percent * (F.col("nu") + F.col("nv") - both))
    return found.select("u", "v")


def _compared(percent: int):
    """Links between waiting nodes (right) and a group with its waiting nodes (left), as many as it takes to
    join what is connected: one link into the group stands for all."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        links: list[tuple[bytes, bytes]] = []
        if left.num_rows and right.num_rows:
            names, inside = left.column("node").to_pylist(), left.column("inside").to_numpy()
            grams = left.column("grams").combine_chunks()
            sizes = np.diff(grams.offsets.to_numpy())
            flat = grams.flatten().to_numpy()
            owner = np.repeat(np.arange(len(names)), sizes)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            parent: dict = {}

            def find(x):
                while parent.setdefault(x, x) != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for node, own in zip(right.column("asks").to_pylist(), right.column("own"), strict=True):
                own = own.values.to_numpy()
                lo, hi = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
                n = hi - lo
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                both = np.bincount(owner[at], minlength=len(names))
                for i in np.flatnonzero(100 * both >= percent * (sizes + len(own) - both)).tolist():
                    if names[i] != node:
                        a, b = find(node), find(b"" if inside[i] else names[i])
                        if a != b:
                            parent[a] = b
                            links.append((node, names[i]))
        return pa.table({"u": pa.array([x for x, _ in links], pa.binary()), "v": pa.array([y for _, y in links], pa.binary())})

    return run


def _close(a: Column, b: Column, percent: int) -> Column:
    """A necessary condition on the sizes alone."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _grouped(docs: DataFrame, words: int, percent: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, node, root (of the node's group, null with it), first (smallest doc_id of the group)."""
    docs = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash long, n_shingles long, node binary, bands array<long>"
    with small_batches(docs.sparkSession):
        signed = written(docs.mapInArrow(_signed(words, bands, rows), schema), "signed")
    nodes = signed.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.max("n_shingles").alias("n"), F.min("bands").alias("bands"))
    member = nodes.select("node", "n", F.explode("bands").alias("key"))
    full = member.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("hub")).filter("members > 1")
    member = written(member.join(full, "key").select("key", "node", "n", "members", "hub"), "buckets")

    source = signed.filter("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("at")).join(member.select("node").distinct(), "node", "left_semi")
    source = source.select(F.col("at.doc_id").alias("_id"), F.col("at.text_hash").alias("_hash")).distinct()
    texts = docs.join(source, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left_semi").select("doc_id", "text")
    with small_batches(docs.sparkSession):
        sets = written(texts.mapInArrow(_sets(words), "node binary, grams array<long>").filter("node is not null"), "sets")
    if not docs.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        sets = sets.dropDuplicates(["node"])

    hubs = member.select("key", F.col("node").alias("v"), F.col("n").alias("nv")).join(member.select("key", F.col("hub").alias("v")).distinct(), ["key", "v"])
    pairs = member.join(hubs, "key").filter((F.col("node") != F.col("v")) & _close(F.col("n"), F.col("nv"), percent))
    edges = written(_verified(pairs.select(F.col("node").alias("u"), "v", F.col("n").alias("nu"), "nv").distinct(), sets, percent), "links")
    roots = components(edges)

    # What is left to compare: pairs of a bucket without its hub that no group holds yet.
    rest = member.filter("node <> hub").join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    share = rest.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    main = share.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count(F.lit(1)).alias("groups")).filter("groups > 1")
    open_ = written(rest.join(main, "key").select("main", "node", "n", (F.col("root") == F.col("main")).alias("inside")).distinct(), "waits")
    cluster, waits = open_, open_.filter("not inside").drop("inside")
    cuts = cluster.groupBy("main").agg(F.sum("n").alias("a")).join(waits.groupBy("main").agg(F.sum("n").alias("b")), "main")
    cuts = cuts.select("main", F.ceil(F.col("a") / BLOCK).cast("int").alias("segments"), F.ceil(F.col("b") / BLOCK).cast("int").alias("blocks"))
    lot = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = cluster.join(cuts, "main").select("main", "node", "inside", lot("segments").alias("segment"), each("blocks").alias("block")).join(sets, "node")
    right = waits.join(cuts, "main").select("main", "node", lot("blocks").alias("block"), each("segments").alias("segment"))
    right = right.join(sets.select(F.col("node").alias("k"), F.col("grams").alias("own")), F.col("node") == F.col("k"))
    right = right.select(F.col("main").alias("to"), F.col("segment").alias("part"), F.col("block").alias("lot"), F.col("k").alias("asks"), "own")
    more = left.groupBy("main", "segment", "block").cogroup(right.groupBy("to", "part", "lot")).applyInArrow(_compared(percent), "u binary, v binary")
    more = written(more, "links")
    if not more.isEmpty():
        roots = components(edges.union(more))

    named = nodes.select("node", "first").join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("first"))
    named = named.drop("first").join(least, "root")
    return signed.drop("bands").join(named, "node", "left")


def near_groups(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, node (16-byte digest of the set, null if empty), component_id, kept.

    component_id is the smallest doc_id reachable over links; kept is doc_id = component_id. Words are
    runs without ASCII white space, A-Z lower-cased; a text of fewer than ``words`` words has its whole
    sequence as its one shingle. Null and empty texts have the empty set, are linked with nothing and form
    their own component. Repeated rows stay and share their component. A null doc_id stays a row; its
    component is the smallest doc_id of its group, or null, and it is kept only in the latter case. An
    empty table gives no rows. Other columns are ignored."""
    out = _grouped(docs, words, percent, bands, rows)
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("first"))
    return out.select("doc_id", "n_shingles", "node", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, that with the smallest doc_id (a null one last), of
    several under that doc_id the one with the smallest text hash. Rows equal in doc_id and text count as one
    row, which of them stays is open; rows without words are in no group and stay."""
    out = written(_grouped(docs, words, percent, bands, rows).select("doc_id", "text_hash", "root"), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("at")
    keep = out.filter("root is not null").groupBy("root").agg(first).select("at.doc_id", "at.text_hash").unionByName(out.filter("root is null").select("doc_id", "text_hash").distinct())
    keep = keep.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    rows_ = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.struct("*").alias("row"))
    kept = rows_.join(keep, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_hash")), "left_semi")
    if not out.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "h"])
    return kept.select("row.*")
