"""Embedding whitening by hierarchical merging of singular value decompositions.

Vectors are whole numbers, floor(256 * component). Every block of distinct vectors becomes a part: how many
vectors it has, their exact sums, and the singular values and right singular vectors of the block about its own
mean, at full rank. Two parts merge by a decomposition of both parts' scaled vectors and one more row, which
accounts for the distance of their means; no dimension is ever dropped, so the last part's singular values and
vectors are those of all rows. Merging goes FAN parts at a time until one part is left for each length of
vectors, so no task reads more than FAN parts of (d + 1) x d numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.shared import ship, written

#: Vectors of a block that is decomposed at once, parts that one task merges, and the share of the largest
#: singular value under which a component counts as one without variance.
ROWS, FAN, FLAT = 4096, 16, 1e-12

Part = tuple[int, np.ndarray, np.ndarray]


def part_of(x: np.ndarray) -> Part:
    """Count, exact sums, and singular values times right singular vectors of the centred rows, d rows."""
    sums = x.sum(axis=0)
    return len(x), sums, _decomposed(x - sums / len(x))


def _decomposed(rows: np.ndarray) -> np.ndarray:
    d = rows.shape[1]
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    out = np.zeros((d, d))
    out[: len(s)] = s[:, None] * vt
    return out


def merged(a: Part, b: Part) -> Part:
    """The part of both parts' rows; the last row of what is decomposed corrects for the two means."""
    (n, s, r), (m, t, q) = a, b
    apart = np.sqrt(n * m / (n + m)) * (s / n - t / m)
    return n + m, s + t, _decomposed(np.vstack([r, q, apart]))


def _packed(part: Part) -> tuple:
    return part[0], part[1].tolist(), part[2].astype("<f8").tobytes()


def _parts(table: pa.Table) -> Iterator[Part]:
    for n, sums, rows in zip(*(table.column(c).to_pylist() for c in ("n", "sums", "rows")), strict=True):
        yield n, np.array(sums, np.int64), np.frombuffer(rows, "<f8").reshape(len(sums), -1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _first_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, Part] = {}
    for batch in batches:
        sizes = batch.column("d").to_numpy()
        for d in np.unique(sizes).tolist():
            x = _matrix(batch.column("x").filter(pa.array(sizes == d)))
            for start in range(0, len(x), ROWS):
                part = part_of(x[start : start + ROWS])
                held[d] = merged(held[d], part) if d in held else part
    if held:
        columns = zip(*(_packed(p) for p in held.values()), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), *(pa.array(list(c), t) for c, t in zip(columns, _KINDS, strict=True))], names=["d", "n", "sums", "rows"])


_KINDS = [pa.int64(), pa.list_(pa.int64()), pa.binary()]
_DDL = "d int, n long, sums array<long>, rows binary"


def _met(table: pa.Table) -> pa.Table:
    part, d = None, table.column("d")[0].as_py()
    for p in _parts(table.sort_by("place")):
        part = merged(part, p) if part else p
    columns = [pa.array([c], t) for c, t in zip(_packed(part), _KINDS, strict=True)]
    return pa.table([pa.array([d], pa.int32()), *columns], names=["d", "n", "sums", "rows"])


def numbers(vectors: DataFrame) -> DataFrame:
    """vec_id, x (whole numbers), d of the rows whose vector is neither null nor empty and has only finite entries."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", v.alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(c)))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * 256).cast("long")).alias("x"), F.size("v").alias("d"))


def fit(fitted: DataFrame, fan: int = FAN) -> DataFrame:
    """d, n, sums, rows: one part for each length d of the vectors ``x``."""
    parts = written(fitted.select("d", "x").mapInArrow(_first_parts, _DDL), "parts")
    while (most := parts.groupBy("d").count().agg(F.max("count")).first()[0] or 0) > 1:
        # A hash of the part decides where it goes, so that a task that runs again does the same.
        place = F.xxhash64("n", "sums", "rows")
        parts = parts.withColumn("place", place).withColumn("lot", F.pmod("place", F.lit(-(-most // fan))))
        parts = written(parts.groupBy("d", "lot").applyInArrow(_met, _DDL), "parts")
    return parts


def components_of(n: int, sums: np.ndarray, rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Unit eigenvectors of the covariance (as rows) by falling eigenvalue, the eigenvalues, and their total.
    Those without variance are left out. The sign makes the entry of largest size positive."""
    _, s, vt = np.linalg.svd(rows)
    values = s**2 / n
    keep = [k for k in range(min(most, len(s))) if s[k] > FLAT * max(s[0], 1)]
    vt = vt[keep] * np.sign(vt[keep, np.abs(vt[keep]).argmax(axis=1)])[:, None] if keep else vt[:0]
    return vt, values[keep], float(values.sum())


Model = tuple[int, np.ndarray, np.ndarray, np.ndarray, float]


def _whitened(x: np.ndarray, model: Model) -> np.ndarray:
    n, sums, vt, values, _ = model
    return (x - sums / n) @ vt.T / np.sqrt(values)


def _crossed(shared):
    """Sums of whitened vectors and of their products, for the measured covariance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = batch.column("d").to_numpy()
            for d in np.unique(sizes).tolist():
                w = _whitened(_matrix(batch.column("x").filter(pa.array(sizes == d))), shared.value[d])
                w = np.hstack([w, np.ones((len(w), 1))])
                total[d] = total.get(d, 0) + w.T @ w
        for d, t in total.items():
            for i, row in enumerate(t):
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(row), pa.int32()), pa.array([i] * len(row), pa.int32()), pa.array(range(len(row)), pa.int32()), pa.array(row)], names=["d", "i", "j", "v"])

    return run


def _projected(shared, errors: dict[int, float], id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("d").to_numpy()
            for d in np.unique(sizes).tolist():
                rows = batch.filter(pa.array(sizes == d))
                x, model = _matrix(rows.column("x")), shared.value[d]
                n, sums, vt, values, total = model
                k = len(values)
                at = pa.array(np.repeat(np.arange(len(x)), k))
                far = [sum((n * c - s) ** 2 for c, s in zip(row, sums.tolist(), strict=True)) for row in x.tolist()]
                each = np.tile(values / total if total else values, len(x))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("vec_id").cast(id_type).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array([n] * (k * len(x)), pa.int64()), pa.array([str(f) for f in far]).take(at),
                     pa.array(_whitened(x, model).ravel()), pa.array(each), pa.array([errors[d]] * (k * len(x)))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


def whiten(vectors: DataFrame, components: int = 4) -> DataFrame:
    """vec_id, component, n, deviation (decimal), whitened, explained, identity_error.

    Rows whose vector is null, empty or holds null or non-finite entries are dropped. x = floor(256 * entry); the
    fit list has each distinct x once, so copies, however many, count once in n, sums, covariance and the
    measured identity error. Each length of vectors has a fit list of its own. A component without variance has
    no rows: one vector alone has none. deviation is exact up to 38 digits. Repeated vec_ids stay rows of their
    own, a null vec_id too; an empty table gives no rows, other columns are ignored. The driver sees, and tasks
    get, one part for each length: counts, sums and ``components`` vectors."""
    spark = vectors.sparkSession
    ship(spark)
    rows = written(numbers(vectors), "numbers")
    fitted = written(rows.select("d", "x").distinct(), "fit")
    models: dict[int, Model] = {}
    for r in fit(fitted).toLocalIterator():
        sums = np.array(r["sums"], np.int64)
        models[r["d"]] = (r["n"], sums, *components_of(r["n"], sums, np.frombuffer(r["rows"], "<f8").reshape(len(sums), -1), components))
    shared = spark.sparkContext.broadcast(models)
    measured: dict[int, np.ndarray] = {d: np.zeros((len(m[3]) + 1,) * 2) for d, m in models.items()}
    for r in fitted.mapInArrow(_crossed(shared), "d int, i int, j int, v double").groupBy("d", "i", "j").agg(F.sum("v").alias("v")).collect():
        measured[r["d"]][r["i"], r["j"]] = r["v"]
    errors = {}
    for d, t in measured.items():
        n, mean = t[-1, -1], t[-1, :-1] / max(t[-1, -1], 1)
        errors[d] = float(np.abs(t[:-1, :-1] / max(n, 1) - np.outer(mean, mean) - np.eye(len(mean))).max(initial=0))
    vec_id = dict(vectors.dtypes)["vec_id"]
    from pyspark.sql.pandas.types import to_arrow_type

    out = rows.mapInArrow(_projected(shared, errors, to_arrow_type(rows.schema["vec_id"].dataType)), f"vec_id {vec_id}, component int, n long, deviation string, whitened double, explained double, identity_error double")
    return out.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))
