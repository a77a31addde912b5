"""Narrative text: pages to offsets, headings, chunks, sections; exact retrieval; prompt context."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary import registry as R
from granary.functions.text import LINE_END, heading_shaped, section_of_heading, trim
from granary.package import ship

#: Characters of a chunk, of the overlap, and separators from the coarsest down.
SIZE, OVERLAP, SEPARATORS = 800, 150, ("\n\n", "\n", ". ", " ")
#: Retrieval: about so many vectors and queries of one key meet in a task, queries by so many at a time.
VECTORS, QUERIES, TILE = 65_536, 8_192, 64
#: Buckets of a stored index.
BUCKETS = 64
#: Page numbers, and characters of a document's text, that one task goes through in order.
PAGES, CHARACTERS = 512, 1 << 20


def narrative(pages: DataFrame, classes: DataFrame) -> DataFrame:
    """doc_id, page_no, text, statement_type of non-blank pages that are no statement."""
    kind = classes.select("doc_id", "page_no", "statement_type")
    p = pages.join(kind, ["doc_id", "page_no"], "left").withColumn("statement_type", F.coalesce("statement_type", F.lit("other")))
    return p.filter(~F.col("statement_type").isin(*R.STATEMENTS) & (F.length(trim(F.coalesce("text", F.lit("")))) > 0)).select("doc_id", "page_no", "text", "statement_type")


def offsets(pages: DataFrame, block: int = PAGES) -> DataFrame:
    """Adds char_start, char_end of each page in its document's text, pages one line feed apart.

    A prefix sum in two levels: blocks of ``block`` page numbers are added up, the sums of a document's blocks run
    over a row per block, and each block goes on from there, so one long document is many tasks."""
    p = pages.withColumn("_block", F.floor(F.col("page_no") / block))
    sums = p.groupBy("doc_id", "_block").agg(F.sum(F.length("text") + 1).alias("_n"))
    along = Window.partitionBy("doc_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("doc_id", "_block", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_before"))
    met = (F.col("doc_id").eqNullSafe(F.col("_doc"))) & (F.col("_block").eqNullSafe(F.col("_of")))
    p = p.join(sums.withColumnsRenamed({"doc_id": "_doc", "_block": "_of"}), met)
    within = Window.partitionBy("doc_id", "_block").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("char_start", (F.col("_before") + F.coalesce(F.sum(F.length("text") + 1).over(within), F.lit(0))).cast("int"))
    return p.drop("_block", "_before", "_doc", "_of").withColumn("char_end", (F.col("char_start") + F.length("text")).cast("int"))


def headings(placed: DataFrame) -> DataFrame:
    """doc_id, pos, heading: heading-like lines and where they start in the document's text. A line's place is
    a running sum within its page, on the partitioning that page offsets have already."""
    ends = F.regexp_extract_all(F.concat("text", F.lit("\n")), F.lit(f"(?s).*?(?:{LINE_END}|\\z)"), F.lit(0))
    ls = placed.select("doc_id", "page_no", "char_start", F.posexplode(ends).alias("i", "line"))
    before = Window.partitionBy("doc_id", "page_no").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    ls = ls.withColumn("at", F.coalesce(F.sum(F.length("line")).over(before), F.lit(0)).cast("int"))
    return ls.filter(heading_shaped(F.col("line"))).select("doc_id", (F.col("char_start") + F.col("at")).alias("pos"), trim(F.col("line")).alias("heading"))


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters where separators allow: cut at the coarsest separator present,
    cut pieces still too long at the next ones, then fill chunks with pieces, each chunk starting with the
    last pieces of the one before, up to ``overlap`` characters. Separators stay with the piece they open."""
    sep, finer = next(((s, separators[i + 1 :]) for i, s in enumerate(separators) if s in text), ("", ()))
    parts = text.split(sep) if sep else list(text)
    pieces = [p for p in [parts[0], *(sep + p for p in parts[1:])] if p]
    out: list[str] = []
    held: deque[str] = deque()
    chars = 0  # of the pieces held

    def emit() -> None:
        if whole := "".join(held).strip():
            out.append(whole)

    for p in pieces:
        if len(p) > size:
            emit()
            held.clear()
            chars = 0
            out.extend(split_text(p, size, overlap, finer) if finer else [p])
            continue
        if held and chars + len(p) > size:
            emit()
            while held and (chars > overlap or chars + len(p) > size):
                chars -= len(held.popleft())
        held.append(p)
        chars += len(p)
    emit()
    return out


def _chunked(size: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["full"], strict=True):
                reach = 0
                for i, chunk in enumerate(split_text(text, size, overlap)):
                    at = text.find(chunk, reach)
                    start = max(0, at if at >= 0 else text.find(chunk))
                    reach = max(reach, start + max(1, size - overlap))
                    rows.append((doc, i, chunk, start, start + len(chunk)))
            yield pd.DataFrame(rows, columns=["doc_id", "i", "text", "char_start", "char_end"])

    return run


def chunk(pages: DataFrame, classes: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """chunk_id, doc_id, text, page_no, section_title, section_type, char_start, char_end.

    A chunk's page is the one that holds its first character (the last page, if that is a separator), its
    title the last heading at or before it; its section comes from the title, else its first 200 characters,
    else the page's narrative type."""
    placed = offsets(narrative(pages, classes))
    full = placed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("p"))
    full = full.select("doc_id", F.array_join(F.transform("p", lambda x: F.concat(x["text"], F.lit("\n"))), "").alias("full"))
    ship(pages.sparkSession)
    kind = dict(pages.dtypes)["doc_id"]
    parts = full.mapInPandas(_chunked(size, overlap), f"doc_id {kind}, i int, text string, char_start int, char_end int")
    return locate(parts, placed, headings(placed))


def locate(parts: DataFrame, placed: DataFrame, titles: DataFrame, block: int = CHARACTERS) -> DataFrame:
    """Page and title of every chunk by a backward as-of pass in two levels: pages, headings and chunks of a
    document in order of position, each chunk taking the last page and heading at or before it. Within blocks
    of ``block`` characters every event sees what came before it there; the last page and heading of a block run on
    over a row per block, for those at the start of later ones."""
    none = F.lit(None)
    events = titles.select("doc_id", "pos", F.lit(0).alias("rank"), none.cast("int").alias("page"), none.cast("string").alias("kind"), F.col("heading"), none.cast("struct<i:int,text:string,char_start:int,char_end:int>").alias("chunk"))
    events = events.unionByName(placed.select("doc_id", F.col("char_start").alias("pos"), F.lit(0).alias("rank"), F.col("page_no").cast("int").alias("page"), F.col("statement_type").alias("kind"), none.cast("string").alias("heading"), none.cast("struct<i:int,text:string,char_start:int,char_end:int>").alias("chunk")))
    events = events.unionByName(parts.select("doc_id", F.col("char_start").alias("pos"), F.lit(1).alias("rank"), none.cast("int").alias("page"), none.cast("string").alias("kind"), none.cast("string").alias("heading"), F.struct("i", "text", "char_start", "char_end").alias("chunk")))
    carried, order = ["page", "kind", "heading"], F.struct("pos", "rank")
    events = events.withColumn("_block", F.floor(F.col("pos") / block))
    ends = events.filter("chunk is null").groupBy("doc_id", "_block").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(f"_{c}") for c in carried])
    earlier = Window.partitionBy("doc_id").orderBy("_block")
    # what stands before a block is told to every block that holds chunks, by one more pass over a row per block
    ends = ends.unionByName(events.filter("chunk is not null").select("doc_id", "_block").distinct(), allowMissingColumns=True).groupBy("doc_id", "_block").agg(*[F.max(f"_{c}").alias(f"_{c}") for c in carried])
    before = earlier.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col("doc_id").alias("_doc"), F.col("_block").alias("_of"), *[F.last(f"_{c}", ignorenulls=True).over(before).alias(f"_{c}") for c in carried])
    past = Window.partitionBy("doc_id", "_block").orderBy("pos", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = events.select("doc_id", "_block", "pos", "rank", "chunk", *[F.last(c, ignorenulls=True).over(past).alias(c) for c in carried]).filter("chunk is not null")
    e = e.join(ends, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_block") == F.col("_of")), "left")
    e = e.select("doc_id", "chunk", *[F.coalesce(c, f"_{c}").alias(c) for c in carried])
    title = F.coalesce("heading", F.lit(""))
    section = section_of_heading(F.when(title != "", title).otherwise(F.substring("chunk.text", 1, 200)))
    section = F.when((section == "other") & F.col("kind").isin("mda", "notes", "risk_factors", "liquidity"), F.col("kind")).otherwise(section)
    return e.select(F.concat_ws("_", F.col("doc_id").cast("string"), F.col("page").cast("string"), F.col("chunk.i").cast("string")).alias("chunk_id"), "doc_id", F.col("chunk.text").alias("text"), F.col("page").alias("page_no"), title.alias("section_title"), section.alias("section_type"), F.col("chunk.char_start").alias("char_start"), F.col("chunk.char_end").alias("char_end"))


def _rows(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length of each vector (-1 if it or a component is null), its start, and all components."""
    a = column.combine_chunks()
    offsets, values = a.offsets.to_numpy().astype(np.int64), a.values
    holes = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))])
    whole = a.is_valid().to_numpy(zero_copy_only=False) & (holes[offsets[1:]] == holes[offsets[:-1]])
    return np.where(whole, np.diff(offsets), -1), offsets[:-1], values.to_numpy(zero_copy_only=False).astype(np.float64)


def inner_products(vectors: tuple, queries: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Queries x vectors: inner products, summed from the first component on, and where there is none (a null,
    or lengths that differ)."""
    (vn, v_at, v), (qn, q_at, q) = vectors, queries
    out, none = np.zeros((len(qn), len(vn))), np.ones((len(qn), len(vn)), bool)
    for n in set(vn.tolist()) & set(qn.tolist()) - {-1}:
        i, j = np.flatnonzero(qn == n), np.flatnonzero(vn == n)
        s = np.zeros((len(i), len(j)))
        with np.errstate(all="ignore"):
            for c in range(n):
                s += q[q_at[i] + c][:, None] * v[v_at[j] + c]
        out[np.ix_(i, j)], none[np.ix_(i, j)] = s, False
    return out, none


def _best(k: int):
    """The k best of a group's vectors for each of its queries: NaN first, no score last, ties by id."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.take(pc.sort_indices(left, sort_keys=[("vid", "ascending")], null_placement="at_start"))
        vectors, (qn, q_at, q) = _rows(left.column("v")), _rows(right.column("q"))
        asked, found, scores, empty = [], [], [], []
        for start in range(0, right.num_rows if left.num_rows else 0, TILE):
            part = slice(start, start + TILE)
            score, none = inner_products(vectors, (qn[part], q_at[part], q))
            cost = np.where(none, np.inf, np.where(np.isnan(score), -np.inf, -score))
            least = np.partition(cost, min(k, left.num_rows) - 1, axis=1)[:, min(k, left.num_rows) - 1]
            for i in range(len(cost)):
                c = np.flatnonzero(cost[i] <= least[i])
                kind = np.where(none[i, c], 2, np.where(np.isnan(score[i, c]), 0, 1))
                c = c[np.lexsort((cost[i, c], kind))[:k]]
                asked.append(np.full(len(c), start + i))
                found.append(c)
                scores.append(score[i, c])
                empty.append(none[i, c])
        join = lambda x, t: np.concatenate(x).astype(t) if x else np.empty(0, t)
        return pa.table({
            "query_id": right.column("query_id").take(pa.array(join(asked, np.int64))), "vid": left.column("vid").take(pa.array(join(found, np.int64))),
            "score": pa.array(join(scores, np.float64), mask=join(empty, bool)),
        })

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 4, key: str = "doc_id", vector_id: str = "vec_id", rows: int = VECTORS, asked: int = QUERIES) -> DataFrame:
    """query_id, rank, vector id, score: the k best inner products among the vectors of the query's ``key``.

    Retrieval stays within a document and is exact: every query meets every vector of its key. A key's vectors
    are dealt over parts of about ``rows`` and its queries over blocks of about ``asked``, so neither a hot key
    nor many queries make a large task; a part sends k rows a query to the final ranking."""
    ship(vectors.sparkSession)
    v = vectors.select(F.col(key).alias("_key"), F.col(vector_id).alias("vid"), F.col("embedding").alias("v"))
    q = queries.select(F.col(key).alias("_key"), "query_id", F.col("embedding").alias("q"))
    count = lambda df, n, name: df.groupBy("_key").agg(F.ceil(F.count(F.lit(1)) / n).cast("int").alias(name))
    parts = count(v, rows, "parts").join(count(q, asked, "blocks"), "_key")
    deal = lambda n: F.pmod(F.monotonically_increasing_id(), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    v = v.join(parts, "_key").withColumn("part", deal("parts")).withColumn("block", every("blocks")).drop("parts", "blocks")
    q = q.join(parts, "_key").withColumn("block", deal("blocks")).withColumn("part", every("parts")).drop("parts", "blocks")
    kinds = dict(v.dtypes) | dict(q.dtypes)
    s = v.groupBy("_key", "part", "block").cogroup(q.groupBy("_key", "part", "block")).applyInArrow(_best(k), f"query_id {kinds['query_id']}, vid {kinds['vid']}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vid"))
    return s.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("vid").alias(vector_id), "score")


def store_index(vectors: DataFrame, table: str, key: str = "doc_id", vector_id: str = "vec_id", rows: int = VECTORS, buckets: int = BUCKETS) -> None:
    """Keeps vectors as a table that ``search_index`` reads in place: dealt over parts of about ``rows`` within their
    key, bucketed and sorted by key and part, one file a bucket. Replaces a table of that name."""
    v = vectors.select(F.col(key).alias("_key"), F.col(vector_id).alias("vid"), F.col("embedding").alias("v")).filter("_key is not null")
    parts = v.groupBy("_key").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("parts"))
    v = v.join(parts, "_key").withColumn("part", F.pmod(F.xxhash64("vid"), F.col("parts")).cast("int")).select("_key", "part", "vid", "v")
    v.repartition(buckets, "_key", "part").write.mode("overwrite").bucketBy(buckets, "_key", "part").sortBy("_key", "part").format("parquet").saveAsTable(table)


def search_index(queries: DataFrame, table: str, k: int = 4, key: str = "doc_id", vector_id: str = "vec_id", asked: int = QUERIES) -> DataFrame:
    """``top_k`` over a stored index. Vectors stay where they are: only queries are shuffled, to the buckets of their
    key, in as many rounds of ``asked`` a key as it takes."""
    spark = queries.sparkSession
    ship(spark)
    v = spark.table(table)
    q = queries.select(F.col(key).alias("of"), "query_id", F.col("embedding").alias("q")).filter("of is not null")
    parts = v.select(F.col("_key").alias("of"), F.col("part").alias("at")).distinct()
    most = q.groupBy("of").count().agg(F.max("count")).first()[0] or 0
    rounds = max(1, -(-most // asked))
    q = q.withColumn("round", F.pmod(F.xxhash64("query_id"), F.lit(rounds)))
    found = None
    for i in range(rounds):
        own = q.filter(F.col("round") == i).drop("round").join(parts, "of")
        s = v.groupBy("_key", "part").cogroup(own.groupBy("of", "at")).applyInArrow(_best(k), f"query_id {dict(q.dtypes)['query_id']}, vid {dict(v.dtypes)['vid']}, score double")
        found = s if found is None else found.unionByName(s)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vid"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("vid").alias(vector_id), "score")


def sources(retrieved: DataFrame) -> DataFrame:
    """doc_id, pages: retrieved chunks by page in order of first appearance, with distinct sections and
    snippets of 200 characters."""
    r = retrieved.withColumn("snippet", F.substring("text", 1, 200))
    order = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("rank", c))), lambda x: x[c]))
    g = r.groupBy("query_id", "page_no").agg(F.min("rank").alias("first"), order("section_title").alias("sections"), order("snippet").alias("snippets"))
    return g.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("first", "page_no", "sections", "snippets"))).alias("pages"))
