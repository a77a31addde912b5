"""Line dedup over overlapping windows of three lines, and of one or two that hold a passage, in DataFrame
operations only.

Each window of consecutive lines is hashed (two independent 64-bit hashes); windows that occur again
anywhere are found by one aggregation, whose map side shrinks hot windows to a row per task; every later
occurrence covers its lines, covered positions of a document are merged, and the document is rebuilt
without them. Only window hashes and positions are shuffled for the search; texts move once, to meet their
covered positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.shared import written

#: Lines in a window, and from how many words on a single line, or two lines of fewer words each, are a window.
WINDOW, LONG_LINE = 3, 50


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def windows(docs: DataFrame, window: int = WINDOW, long_line: int = LONG_LINE) -> DataFrame:
    """doc_id, text_hash, pos, span, h1, h2: the windows of every document, those of blank lines left out.

    Windows are built inside the document's array of lines and leave it by one explode that carries the
    document's key alone, so a document costs in proportion to its lines."""
    line_h = F.transform("lines", lambda x: F.struct(
        F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b"), (F.length(F.trim(x)) > 0).alias("ink"), F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"),
    ))
    d = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), _lines(F.col("text")).alias("lines"))
    d = d.select("doc_id", "text_hash", line_h.alias("l"))

    def hashed(i: Column, group: list[Column]) -> Column:
        return F.struct(i.alias("pos"), F.lit(len(group)).alias("span"), F.xxhash64(*[g["a"] for g in group]).alias("h1"), F.xxhash64(F.lit(11), *[g["b"] for g in group]).alias("h2"))

    def three(i: Column) -> Column:
        group = [F.get("l", i + k) for k in range(window)]
        ink = group[0]["ink"]
        for g in group[1:]:
            ink = ink | g["ink"]
        return F.when(ink, hashed(i, group))

    def alone(x: Column, i: Column) -> Column:
        """The line itself if it is long, or it and the next one if both together are."""
        following = F.get("l", i + 1)
        two = (following["words"] < long_line) & (x["words"] + following["words"] >= long_line)
        one = F.struct(i.alias("pos"), F.lit(1).alias("span"), x["a"].alias("h1"), x["b"].alias("h2"))
        return F.when(x["words"] >= long_line, one).when(two, hashed(i, [x, following]))

    starts = F.when(F.size("l") >= window, F.sequence(F.lit(0), F.size("l") - window)).otherwise(F.array().cast("array<int>"))
    single = F.transform("l", alone)
    # exploded as an expression: behind a named column a filter would compute the windows a second time
    return d.select("doc_id", "text_hash", F.explode(F.array_compact(F.concat(F.transform(starts, three), single))).alias("w")).select("doc_id", "text_hash", "w.pos", "w.span", "w.h1", "w.h2")


def covered(docs: DataFrame, window: int = WINDOW, long_line: int = LONG_LINE) -> DataFrame:
    """doc_id, text_hash, gone (sorted distinct line positions to remove). Windows are written once, as keys and
    positions; both the search for repeats and the way back to their places read them."""
    w = written(windows(docs, window, long_line), "windows")
    first = F.min(F.struct(F.col("doc_id"), F.col("text_hash"), F.col("pos")))
    again = w.groupBy("h1", "h2", "span").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    hits = w.join(again, ["h1", "h2", "span"])
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    later = hits.filter(~own | (F.col("pos") >= F.col("first.pos") + F.col("span")))
    places = later.select("doc_id", "text_hash", F.explode(F.sequence("pos", F.col("pos") + F.col("span") - 1)).alias("pos"))
    return places.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("gone"))


def dedup_lines(docs: DataFrame, window: int = WINDOW, long_line: int = LONG_LINE) -> DataFrame:
    """All columns of ``docs`` in a struct ``row``, with n_lines, removed (lines) and clean (the new text).

    A window is three consecutive lines (cut at line feeds), not all blank, a single line of ``long_line``
    words or more, or two consecutive lines of fewer that have as many together. Its first occurrence, by doc_id (null first), text hash and position, stays; an
    occurrence that overlaps its own first one is no repetition. Lines are compared exactly. Null text gives
    one empty line and stays null; texts of fewer than three lines have no window of three. Repeated rows of
    one doc_id and text count as one document and are treated alike; an empty table gives no rows."""
    gone = covered(docs, window, long_line).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "gone")
    d = docs.select(F.struct("*").alias("row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"))
    j = d.join(gone, F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash")), "left")
    lines = _lines(F.col("row.text"))
    # true for each line up to the last covered one that stays, built from the gaps between covered lines
    runs = F.transform("gone", lambda p, i: F.concat(
        F.array_repeat(F.lit(True), p - F.when(i > 0, F.element_at("gone", F.greatest(i, F.lit(1)))).otherwise(F.lit(-1)) - 1), F.array(F.lit(False))
    ))
    # lines and marks side by side; a mark looked up inside the filter would be built again for every line
    marked = F.arrays_zip(lines.alias("line"), F.flatten(runs).alias("stays"))
    clean = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(
        F.array_join(F.transform(F.filter(marked, lambda x: F.coalesce(x["stays"], F.lit(True))), lambda x: x["line"]), "\n")
    )
    return j.select("row", F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("removed"), clean.alias("clean"))


def cleaned_documents(docs: DataFrame, **kw) -> DataFrame:
    """``docs`` with text (and n_chars, if there) replaced by what line dedup leaves.

    Documents of which every line was removed go; all others stay, those without words or lines too."""
    out = dedup_lines(docs, **kw).filter((F.col("removed") == 0) | (F.col("removed") < F.col("n_lines")))
    new = {"text": F.col("clean")} | ({"n_chars": F.when(F.col("removed") > 0, F.length("clean").cast("long")).otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {})
    return out.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])


__all__ = ["windows", "covered", "dedup_lines", "cleaned_documents"]
