"""Approximate nearest neighbours: inverted lists and an adaptive dimension scan within each probed list.

A k-means codebook, fitted on a bounded sample, deals all vectors into lists; every query probes the lists
nearest to it, as many as the sample says it takes to meet the wanted recall: few where vectors cluster, many
where they don't, and fewer the more vectors there are. A list whose centroid lies further off than its radius
and the k-th best distance so far is passed over. Within a list, vectors and query are rotated by one random
orthogonal matrix and compared in blocks of columns. After each block a hypothesis test on the partial distance
abandons the candidates that can hardly reach the k-th best distance so far; only survivors are measured, on
the original vectors in double precision. With a recall of 1 all lists are probed and nothing is abandoned that
could be a neighbour.

Neighbouring lists form groups, the unit of work, so that a query is sent once per group and not per list.
Groups are cut into segments of bounded size and their queries into blocks, so a list that holds a third of all
vectors is many tasks. Nothing but the codebook and the list sizes is broadcast or sent to the driver; both
have MOST_LISTS rows at most."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.shared import ship, written

#: Sampled vectors for the codebook and the number of probes, sampled queries for the latter, most lists, recall
#: aimed at, vectors of a segment, queries of a block, columns of a scan step, the test's slack (larger abandons
#: less), and rows that are compared with all centroids in one go.
SAMPLE, SAMPLE_QUERIES, MOST_LISTS, RECALL, SEGMENT, QUERIES, COLUMNS, SLACK, ROWS = 20_000, 512, 4096, 0.97, 16_384, 2048, 16, 2.1, 2048


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the vectors that take part: an id, all components present and finite, not all
    zero. Of several rows of one id the least vector stands, component by component."""
    kind = dict(vectors.dtypes)["embedding"]
    v = F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>").alias("embedding")
    fit = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v).filter(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(x)) & F.exists("embedding", lambda x: x != 0)
    )
    if fit.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return fit
    return fit.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def codebook(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Lloyd's centroids from distinct sampled starts; a list that runs empty keeps its centroid."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(sample, axis=0)
    centres = distinct[rng.choice(len(distinct), min(lists, len(distinct)), replace=False)].copy()
    for _ in range(rounds):
        own = _closest(sample, centres, 1)[:, 0]
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _closest(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest centres of each row, nearest first."""
    far = (centres**2).sum(axis=1) - 2 * x @ centres.T
    if k == 1:
        return far.argmin(axis=1)[:, None]
    return np.argsort(far, axis=1, kind="stable")[:, :k]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def probes_for(sample: np.ndarray, centres: np.ndarray, k: int, recall: float, queries: int = SAMPLE_QUERIES) -> int:
    """Lists to probe so that of the k nearest of sampled queries within the sample a share of ``recall`` is
    met. Neighbours in the whole lie nearer than those in a sample of it, so more vectors need no more."""
    if recall >= 1 or len(sample) <= k + 1:
        return len(centres)
    own, ranks = _closest(sample, centres, 1)[:, 0], []
    squares = (sample**2).sum(axis=1)
    for i in range(0, len(sample), max(1, len(sample) // queries)):
        far = squares - 2 * sample @ sample[i]
        far[i] = np.inf
        order = np.argsort(_closest(sample[i : i + 1], centres, len(centres))[0])
        ranks.append(order[own[np.argpartition(far, k)[:k]]])
    return int(np.quantile(np.concatenate(ranks), recall, method="higher")) + 1


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, ROWS):
        yield batch.slice(start, ROWS)


def _dealt(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, group, *_ = shared.value
        for batch in batches:
            for b in _parts(batch):
                own = _closest(_matrix(b.column(1)), centres, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(group[own], pa.int32()), pa.array(own.astype(np.int32))], names=["vec_id", "embedding", "group", "list"])

    return run


def _probing(shared, k: int):
    """A row per query and group with the probed lists of the group, nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, group, sizes, probes = shared.value
        for batch in batches:
            for b in _parts(batch):
                order = _closest(_matrix(b.column(1)), centres, len(centres))
                held = np.cumsum(sizes[order], axis=1) - sizes[order]
                row, place = np.nonzero((np.arange(order.shape[1]) < probes) | (held < k + 1))
                lists = order[row, place]
                by = np.lexsort((place, group[lists], row))
                row, lists = row[by], lists[by]
                edge = np.flatnonzero(np.diff(row * (group.max() + 1) + group[lists], prepend=-1))
                at = pa.array(row[edge])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(1).take(at), pa.array(group[lists[edge]], pa.int32()), pa.ListArray.from_arrays(pa.array([*edge, len(lists)], pa.int32()), pa.array(lists, pa.int32()))],
                    names=["query_id", "query", "group", "lists"],
                )

    return run


def rotation(d: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def scan(ids: np.ndarray, vectors: np.ndarray, turned: np.ndarray, query_id: int, query: np.ndarray, turned_query: np.ndarray, k: int, columns: int = COLUMNS, slack: float = SLACK, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """ids and distances of the k nearest of a segment, nearest first, ties to the smaller id. ``least`` gives a
    distance that each vector can't fall below."""
    d = vectors.shape[1]
    best_ids, best = np.empty(0, np.int64), np.empty(0)
    start, step = 0, max(64, 4 * k)
    while start < len(ids):
        rows = np.arange(start, min(start + step, len(ids)))
        start, step = start + step, 1024
        rows = rows[ids[rows] != query_id]
        if len(best) >= k:
            bound = best[k - 1] ** 2
            if least is not None:
                rows = rows[least[rows] <= best[k - 1] * (1 + 1e-9)]
            partial = np.zeros(len(rows))
            for c in range(0, d, columns):
                to = min(c + columns, d)
                partial = partial + ((turned[rows, c:to] - turned_query[c:to]) ** 2).sum(axis=1)
                # The last test is exact but for rounding; before it, the slack bounds the error rate.
                limit = bound * (1 + 1e-9) if to == d else bound * to / d * (1 + slack / np.sqrt(to)) ** 2
                stay = partial <= limit
                rows, partial = rows[stay], partial[stay]
                if not len(rows):
                    break
        if len(rows):
            far = np.sqrt(((vectors[rows] - query) ** 2).sum(axis=1))
            best_ids, best = np.concatenate([best_ids, ids[rows]]), np.concatenate([best, far])
            order = np.lexsort((best_ids, best))[:k]
            best_ids, best = best_ids[order], best[order]
    return best_ids, best


def _searched(shared, k: int, slack: float):
    def run(key: tuple, held: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if held.num_rows and asked.num_rows:
            held = held.sort_by("list")
            ids, own = held.column("vec_id").to_numpy(), held.column("list").to_numpy()
            vectors = _matrix(held.column("embedding").combine_chunks())
            lists, first = np.unique(own, return_index=True)
            ends = np.append(first[1:], len(own))
            # other lengths than the codebook's form a group with one list and no centroid
            centres = shared.value[0][lists] if key[0].as_py() >= 0 else vectors.mean(axis=0, keepdims=True)
            radius = np.sqrt(np.maximum.reduceat(((vectors - np.repeat(centres, ends - first, axis=0)) ** 2).sum(axis=1), first))
            turn = rotation(vectors.shape[1])
            turned = vectors @ turn
            queries = _matrix(asked.column("query").combine_chunks())
            for name, q, tq, wanted in zip(asked.column("query_id").to_pylist(), queries, queries @ turn, asked.column("lists").to_pylist(), strict=True):
                at = np.searchsorted(lists, wanted)
                at = at[(at < len(lists)) & (lists[np.minimum(at, len(lists) - 1)] == wanted)]
                rows = np.concatenate([np.arange(first[a], ends[a]) for a in at]) if len(at) else np.empty(0, np.int64)
                away = np.sqrt(((centres[at] - q) ** 2).sum(axis=1))
                far = away - radius[at] - 1e-9 * (away + radius[at])
                found, near = scan(ids[rows], vectors[rows], turned[rows], name, q, tq, k, slack=slack, least=np.repeat(far, ends[at] - first[at]))
                out.append((np.full(len(found), name), found, near))
        columns = [np.concatenate([o[i] for o in out]) if out else np.empty(0) for i in range(3)]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    return run


def search(vectors: DataFrame, queries: DataFrame, *, k: int = 10, recall: float = RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest found by Euclidean distance.

    Both tables have vec_id (an integer) and embedding; see ``usable`` for the rows that take part and what
    repeated ids mean. Candidates are all usable vectors of the query's length but that of the query's own
    id; all of them, if there are fewer than k. Vectors of the commonest length (of equally common ones the
    larger) have lists, those of other lengths are all compared. Equal distances go to the smaller vec_id.
    Queries that aren't usable, and empty tables, give no rows. Other columns are ignored."""
    spark = vectors.sparkSession
    ship(spark)
    held, asked = written(usable(vectors), "vectors"), written(usable(queries), "queries")
    length = held.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n, usual = length["count"], F.size("embedding") == length["d"]
    sample = np.stack(held.filter(usual).select("embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()["embedding"].to_list()).astype(np.float64)
    centres = codebook(sample, int(min(MOST_LISTS, max(1, round(n**0.5)))))
    group = _closest(centres, codebook(centres, max(1, round(len(centres) ** 0.5))), 1)[:, 0].astype(np.int32)
    probes = probes_for(sample, centres, k, recall)
    shared = spark.sparkContext.broadcast((centres, group))
    other = lambda df, name, lists: df.filter(~usual).select(F.col("vec_id").alias(name[0]), F.col("embedding").alias(name[1]), (-F.size("embedding")).alias("group"), lists)
    vector = dict(held.dtypes)["embedding"]
    dealt = held.filter(usual).mapInArrow(_dealt(shared), f"vec_id long, embedding {vector}, group int, list int")
    dealt = written(dealt.unionByName(other(held, ("vec_id", "embedding"), F.lit(0).alias("list"))), "lists")
    sizes = np.zeros(len(centres), np.int64)
    counted = dealt.filter("`group` >= 0").groupBy("list").count().toPandas()
    sizes[counted["list"]] = counted["count"]
    probing = spark.sparkContext.broadcast((centres, group, sizes, probes))
    vector = dict(asked.dtypes)["embedding"]
    asked = asked.filter(usual).mapInArrow(_probing(probing, k), f"query_id long, query {vector}, group int, lists array<int>").unionByName(other(asked, ("query_id", "query"), F.array(F.lit(0)).alias("lists")))
    asked = written(asked, "probes")

    amount = lambda df, each, name: df.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / each).cast("int").alias(name))
    cuts = amount(dealt, SEGMENT, "segments").join(amount(asked, QUERIES, "blocks"), "group")
    lot = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = dealt.join(cuts, "group").withColumn("segment", lot("vec_id", "segments")).select("vec_id", "embedding", "group", "list", "segment", each("blocks").alias("block"))
    right = asked.join(cuts, "group").withColumn("block", lot("query_id", "blocks")).select("query_id", "query", "lists", "group", "block", each("segments").alias("segment"))
    keys = ["group", "segment", "block"]
    slack = SLACK if recall < 1 else float("inf")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_searched(shared, k, slack), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
