"""Sending this package to executors, and the folder that they share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SENT: dict[str, str] = {}
_LOCAL: dict[str, str] = {}
#: Paths written in this thread's ``scratch`` block, if it is in one.
_SCRATCH: ContextVar[list[str] | None] = ContextVar("granary_scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session whose
    executors run on this machine (a local master) gets a temporary one; any other is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = "file://" + tempfile.mkdtemp(prefix="granary-")
    return _LOCAL["dir"]


def _forget(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _quietly_forget(spark: SparkSession, path: str) -> None:
    try:
        _forget(spark, path)
    except Exception:  # noqa: BLE001  the session may have ended first; the folder is the cluster's to clean
        return


def written(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: df as a Parquet table in the shared folder, read back. Removed at the end of the ``scratch``
    block it was written in, else when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/granary/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    paths = _SCRATCH.get()
    if paths is not None:
        paths.append(path)
    else:
        atexit.register(_quietly_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is ``written`` within goes at the end, for what runs again and again under one driver."""
    paths: list[str] = []
    block = _SCRATCH.set(paths)
    try:
        yield
    finally:
        _SCRATCH.reset(block)
        for path in paths:
            _quietly_forget(spark, path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once a session, unless PYTHONPATH already names its folder."""
    home = Path(__file__).resolve().parents[1]
    app = spark.sparkContext.applicationId
    if str(home) in os.environ.get("PYTHONPATH", "").split(":") or _SENT.get("shipped") == app:
        return
    archive = Path(tempfile.mkdtemp(prefix="granary-")) / "granary_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((home / "granary").rglob("*.py")):
            z.write(f, f.relative_to(home))
    spark.sparkContext.addPyFile(str(archive))
    _SENT["shipped"] = app
