"""Tables that change by whole documents and are read whole: versions, each named by one manifest file.

A version says, for every table and bucket of documents, which folder holds its rows. A change writes the rows
of the buckets that it touches into folders of their own and then creates the next manifest, which either
happens or does not: readers see the version before or after it, a writer that dies in between leaves folders
that nobody names, and of two writers the second finds the number taken, and then carries its change over to
the other's version. All tables of a change appear together. Only the manifest (BUCKETS folders a table at
most) passes through the driver."""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Folders of a table; a document's rows lie in one of them.
BUCKETS = 256
#: How often a writer carries its change over to another's version before it gives up.
ATTEMPTS = 20


def bucket_of(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id.cast("string")), F.lit(BUCKETS)).cast("int")


def folder(spark: SparkSession, path: str):
    """The file system of a path, and the path as that knows it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


@dataclass
class Version:
    """Tables by name: the schema as JSON, and folders (below the store's path) by bucket."""

    number: int = 0
    tables: dict[str, dict] = field(default_factory=dict)

    def folders(self, table: str, buckets: set[int] | None = None) -> list[str]:
        held = self.tables.get(table, {"folders": {}})["folders"]
        return [f for b, f in held.items() if buckets is None or int(b) in buckets]


def _names(spark: SparkSession, path: str) -> list[int]:
    files, at = folder(spark, f"{path}/versions")
    if not files.exists(at):
        return []
    return sorted(int(s.getPath().getName()) for s in files.listStatus(at) if s.getPath().getName().isdigit())


def current(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """The latest version, or that of a number; without any an empty one of number 0."""
    numbers = _names(spark, path) if number is None else [number]
    if not numbers:
        return Version()
    files, at = folder(spark, f"{path}/versions/{numbers[-1]:012d}")
    stream = files.open(at)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Version(numbers[-1], json.loads(text))


def _create(spark: SparkSession, path: str, version: Version) -> bool:
    """Writes a manifest aside and gives it its name, unless that is taken."""
    files, aside = folder(spark, f"{path}/versions/_{uuid.uuid4().hex}")
    out = files.create(aside, False)
    out.write(bytearray(json.dumps(version.tables).encode()))
    out.close()
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(aside, folder(spark, f"{path}/versions/{version.number:012d}")[1], options)
    except Exception as e:
        files.delete(aside, False)
        if "FileAlreadyExistsException" in str(e) or "already exists" in str(e):
            return False
        raise
    return True


def read(spark: SparkSession, path: str, table: str = "rows", version: Version | None = None, buckets: set[int] | None = None) -> DataFrame | None:
    """A table as of a version (the latest unless given), of some buckets only if wanted; None where there is none."""
    version = version or current(spark, path)
    if table not in version.tables:
        return None
    schema = StructType.fromJson(version.tables[table]["schema"])
    folders = [f"{path}/{f}" for f in version.folders(table, buckets)]
    # the folders' names would come as a column
    return spark.read.schema(schema).parquet(*folders).select(*schema.fieldNames()) if folders else spark.createDataFrame([], schema)


def _buckets_in(spark: SparkSession, path: str) -> dict[str, str]:
    """Bucket to folder name, of what partitionBy("bucket") wrote."""
    files, at = folder(spark, path)
    names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
    return {n.removeprefix("bucket="): n for n in names if n.startswith("bucket=")}


#: A table's new rows, or how they follow from the tables before it, as they were written.
Rows = DataFrame | Callable[[dict[str, DataFrame]], DataFrame]


def replace(spark: SparkSession, path: str, rows: dict[str, Rows], documents: DataFrame | None = None, before_commit: Callable[[], None] | None = None) -> Version:
    """Replaces, in all tables of ``rows`` at once, the rows of ``documents`` (doc_id; those that the rows name
    unless given) and of no others, also by none; repeating it changes nothing. The rows are made once, whatever
    other writers do meanwhile; what is read again then are the rows of other documents in touched buckets."""
    mark, new = f"data/{uuid.uuid4().hex}", {}
    for t, given in rows.items():
        frame = given(new) if callable(given) else given
        frame.withColumn("bucket", bucket_of(F.col("doc_id"))).write.partitionBy("bucket").parquet(f"{path}/{mark}/{t}")
        new[t] = spark.read.schema(frame.schema).parquet(f"{path}/{mark}/{t}").select(*frame.columns)
    if documents is None:
        documents = functools.reduce(DataFrame.union, [f.select("doc_id") for f in new.values()])
    documents.select("doc_id").distinct().withColumn("bucket", bucket_of(F.col("doc_id"))).write.parquet(f"{path}/{mark}/_documents")
    named = spark.read.parquet(f"{path}/{mark}/_documents")
    touched = {str(r[0]) for r in named.select("bucket").distinct().collect()}
    own = {t: {b: f"{mark}/{t}/{f}" for b, f in _buckets_in(spark, f"{path}/{mark}/{t}").items()} for t in rows}
    files, at = folder(spark, f"{path}/versions")
    files.mkdirs(at)
    built: dict[str, tuple[dict[str, str], dict[str, str]]] = {}  # by table: the folders built upon, and what came of it
    for attempt in range(ATTEMPTS):
        base = current(spark, path)
        tables = dict(base.tables)
        for t, frame in new.items():
            held = dict(tables.get(t, {"folders": {}})["folders"])
            upon = {b: f for b, f in held.items() if b in touched}
            if t not in built or built[t][0] != upon:
                made = own[t]
                if upon:
                    old = read(spark, path, t, base, {int(b) for b in upon}).join(named.select("doc_id"), "doc_id", "left_anti")
                    both = new[t].unionByName(old, allowMissingColumns=True).select(*frame.columns)
                    at_ = f"{mark}/{t}-{attempt}"
                    both.withColumn("bucket", bucket_of(F.col("doc_id"))).write.partitionBy("bucket").parquet(f"{path}/{at_}")
                    made = {b: f"{at_}/{f}" for b, f in _buckets_in(spark, f"{path}/{at_}").items()}
                built[t] = upon, made
            tables[t] = {"schema": frame.schema.jsonValue(), "folders": {b: f for b, f in held.items() if b not in touched} | built[t][1]}
        if before_commit:
            before_commit()
        version = Version(base.number + 1, tables)
        if _create(spark, path, version):
            return version
    raise RuntimeError(f"{path} changed {ATTEMPTS} times while documents were replaced in it")


def tidy(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Removes the manifests before the latest ``keep`` and the folders that none of those names, what dead writers
    left included. Not while another writer is at work."""
    numbers = _names(spark, path)
    for n in numbers[:-keep]:
        files, at = folder(spark, f"{path}/versions/{n:012d}")
        files.delete(at, False)
    kept = [current(spark, path, n) for n in numbers[-keep:]]
    used = {f.split("/")[1] for v in kept for t in v.tables for f in v.folders(t)}
    files, at = folder(spark, f"{path}/data")
    for s in files.listStatus(at) if files.exists(at) else []:
        if s.getPath().getName() not in used:
            files.delete(s.getPath(), True)
