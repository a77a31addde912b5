"""Mixing sources to target weights, in DataFrame operations only.

Every document gets a hash-random key. Keys are cut into equal ranges, so that (source, range) is a range
partitioning of each source in key order; word totals of the ranges give the prefix of every range, and a
running sum inside a range gives each document's own prefix. A source's budget is then cut exactly: full
epochs, and after them the prefix of the key order that fits, the last document in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.shared import word_count, written

#: Weights of the sources in order, repeating; share of all words; most epochs of one source.
WEIGHTS, SHARE, MOST_EPOCHS = (3, 1, 2), 1.5, 2
#: Documents in a key range, about.
RANGE_ROWS = 4096


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """Adds ``target`` to (source, source_size): weighted shares of ``share`` times all words, none above
    ``most`` times its source, the excess reshared by weight until none is above.

    Sorting by size over weight turns the resharing into one prefix computation: the sources that end at
    their limit are those whose limit lies below the level that the rest would get. It runs over the table
    of sources, one row each, in one task: sources may be millions, not billions. They are ordered by code
    point, null last."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    s = sizes.withColumn("weight", F.element_at(cycle, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int") + 1).cast("long"))
    s = s.withColumn("limit", F.col("source_size") * most)
    by_ratio = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    s = (
        s.withColumn("full_before", F.coalesce(F.sum("limit").over(before), F.lit(0)))
        .withColumn("weight_from", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    )
    # At the first source in ratio order that stays below its limit, the level for it and all after it is fixed.
    s = s.withColumn("level", (F.col("total") - F.col("full_before")) / F.col("weight_from"))
    s = s.withColumn("open", F.col("limit") > F.col("level") * F.col("weight"))
    first_open = F.min(F.when(F.col("open"), F.struct(F.col("limit") / F.col("weight"), "full_before", "weight_from"))).over(everything)
    s = s.withColumn("at", first_open)
    rest = F.col("weight") * (F.col("total") - F.col("at.full_before")) / F.col("at.weight_from")
    return s.select("source", "source_size", F.when(F.col("at").isNull() | (F.col("limit") <= rest), F.col("limit").cast("double")).otherwise(rest).alias("target"))


def mix(docs: DataFrame, *, size: Column | None = None, seed: int = 20, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """One row per document: doc_id, source, text_hash, size, source_size, target, before (words of its
    source that precede it in key order), taken (words the mix takes, repeats counted).

    Null text has size 0; null is a source of its own, the last. Equal keys are ordered by doc_id, size and
    text hash, so repeated rows and ties give the same rows in every run. A source without words has target
    0. An empty table gives no rows. Columns other than doc_id, text and source are ignored."""
    words = word_count(F.col("text")) if size is None else size
    base = docs.select(
        "doc_id", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), words.alias("size")
    )
    base = written(base.withColumn("key", F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))), "mix")
    bits = min(30, (base.count() // RANGE_ROWS).bit_length())
    base = base.withColumn("range", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), 32 - bits))

    by_range = base.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    goals = targets(by_range.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, most)
    along = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = by_range.withColumn("range_before", F.coalesce(F.sum("range_size").over(along), F.lit(0)))
    ranges = ranges.alias("r").join(goals.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source"))).select(
        F.col("r.source").alias("of"), F.col("r.range").alias("at_range"), "range_before", "source_size", "target"
    )
    inside = Window.partitionBy("source", "range").orderBy("key", F.col("doc_id").asc_nulls_last(), "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    base = base.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = base.join(ranges, base["source"].eqNullSafe(ranges["of"]) & (base["range"] == ranges["at_range"]))
    out = out.withColumn("before", F.col("range_before") + F.col("within"))
    budget = F.floor(F.col("target") + F.lit(0.5)).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return out.select("doc_id", "source", "text_hash", "size", "source_size", "target", "before", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **kw) -> DataFrame:
    """The mix as documents: each row as often as the mix takes it, in whole documents.

    A document's last, partial take counts if at least half of it lies within the budget. Rows with no
    words are kept once: they cost no budget. Columns are those of ``docs``."""
    plan = mix(docs, **kw).select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("text_hash").alias("_hash"),
        F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)) + F.lit(0.5))).cast("int").alias("_times"),
    )
    # Repeated rows of one key may differ by the cut; their total is dealt as evenly as whole copies allow.
    plan = plan.groupBy("_id", "_source", "_hash").agg(F.sum("_times").alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    named = docs.select(F.struct("*").alias("_row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"))
    joined = named.join(plan, F.col("_row.doc_id").eqNullSafe(F.col("_id")) & F.col("_row.source").eqNullSafe(F.col("_source")) & (F.col("_h") == F.col("_hash")))
    place = F.row_number().over(Window.partitionBy("_id", "_source", "_hash").orderBy("_h"))
    times = F.floor(F.col("_sum") / F.col("_rows")).cast("int") + F.when(place <= F.pmod(F.col("_sum"), F.col("_rows")), 1).otherwise(0)
    return joined.withColumn("_n", times).filter("_n > 0").select("_row", F.explode(F.expr("sequence(1, _n)")).alias("_copy")).select("_row.*")
