"""Shared-folder tables and small helpers used by every operator here."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.package import shared_dir, ship, written

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column, divisor: int) -> Column:
    """crc32 of doc_id as text, modulo divisor; a null doc_id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(divisor)).cast("int")


def parts_for(amount: float, each: float, least: int = 1) -> int:
    """How many partitions hold ``amount`` at ``each`` a partition."""
    return max(least, math.ceil(amount / max(each, 1)))


@contextmanager
def small_batches(spark: SparkSession, most: int = 4 << 20) -> Iterator[None]:
    """Texts that are written within go to Python in batches of about ``most`` bytes, one row at least, unless the
    session sets that size itself. By default only rows are counted, so batches grow with the texts, in the JVM
    and in Python. Results don't depend on it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is not None:
        yield
        return
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.unset(key)


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


__all__ = ["WORD", "fold", "parts_for", "shared_dir", "ship", "small_batches", "tables", "word_count", "written"]
