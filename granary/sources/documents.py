"""Reading documents into pages, and keeping what the engine makes of them."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.package import ship
from granary.sources import versions

#: A parser takes bytes and gives the text of each page; it raises what it can't read.
Parser = Callable[[bytes], list[str]]
PAGES = "doc_id string, page_no int, text string, parser string, error string"


def _pymupdf(body: bytes) -> list[str]:
    import fitz

    with fitz.open(stream=body, filetype="pdf") as d:
        return [p.get_text() for p in d]


def _pdfplumber(body: bytes) -> list[str]:
    import io

    import pdfplumber

    with pdfplumber.open(io.BytesIO(body)) as d:
        return [p.extract_text() or "" for p in d.pages]


def _pypdf(body: bytes) -> list[str]:
    import io

    from pypdf import PdfReader

    return [p.extract_text() or "" for p in PdfReader(io.BytesIO(body)).pages]


#: Pages that the layout parser reads of a longer document: its last ones, where statements stand.
LAYOUT_PAGES = 180


def last_pages(count: int, most: int = LAYOUT_PAGES) -> tuple[int, int]:
    """First and last page to read of a document of ``count`` pages."""
    return max(1, count - most + 1), count


def _layout(body: bytes, ocr: bool = False) -> list[str]:
    import io

    from docling.datamodel.base_models import DocumentStream, InputFormat
    from docling.datamodel.pipeline_options import PdfPipelineOptions
    from docling.document_converter import DocumentConverter, PdfFormatOption
    from pypdf import PdfReader

    first, last = last_pages(len(PdfReader(io.BytesIO(body)).pages))
    options = PdfFormatOption(pipeline_options=PdfPipelineOptions(do_ocr=ocr))
    read = DocumentConverter(format_options={InputFormat.PDF: options}).convert(DocumentStream(name="document.pdf", stream=io.BytesIO(body)), page_range=(first, last)).document
    return [""] * (first - 1) + [read.export_to_markdown(page_no=p) for p in range(first, last + 1)]


def _layout_ocr(body: bytes) -> list[str]:
    return _layout(body, ocr=True)


def _plain(body: bytes) -> list[str]:
    return body.decode("utf-8").split("\f")


def installed_parsers() -> list[tuple[str, Parser]]:
    """PDF parsers in order of preference, those whose library is there."""
    known = [("pymupdf", "fitz", _pymupdf), ("layout", "docling", _layout), ("layout_ocr", "docling", _layout_ocr), ("pdfplumber", "pdfplumber", _pdfplumber), ("pypdf", "pypdf", _pypdf)]
    return [(name, f) for name, module, f in known if importlib.util.find_spec(module)]


def _parsed(parsers: list[tuple[str, Parser]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, body in zip(b["doc_id"], b["content"], strict=True):
                texts, used, errors = None, None, []
                for name, parse in parsers:
                    try:
                        texts, used = parse(bytes(body)), name
                    except Exception as e:  # noqa: BLE001  a file that one parser can't read goes to the next
                        errors.append(f"{name}: {e}")
                        continue
                    if any(t.strip() for t in texts):
                        break
                rows += [(doc, i + 1, t, used, None) for i, t in enumerate(texts)] if texts else [(doc, None, None, None, "; ".join(errors) or "no page")]
            yield pd.DataFrame(rows, columns=["doc_id", "page_no", "text", "parser", "error"])

    return run


def read_pages(spark: SparkSession, path: str, parsers: list[tuple[str, Parser]] | None = None, pattern: str = "*.pdf") -> DataFrame:
    """Pages of all files under ``path``: each file goes through the parsers until one gives text; one that
    none reads gives a row with its errors. doc_id is twelve hex digits of md5 over name and size."""
    from granary.operators.views import doc_key

    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(doc_key(name, F.col("length")).alias("doc_id"), "content").mapInPandas(_parsed(installed_parsers() if parsers is None else parsers), PAGES)


def read_text_pages(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """Pages of text files, form feeds between pages."""
    return read_pages(spark, path, [("text", _plain)], pattern)


#: A table parser takes bytes and gives (page number, header names or none, rows) of each table.
TableParser = Callable[[bytes], list[tuple[int, list[str] | None, list[list[str | None]]]]]
TABLES = "doc_id string, page_no int, ord int, header array<string>, rows array<array<string>>"


def _pymupdf_tables(body: bytes) -> list:
    import fitz

    with fitz.open(stream=body, filetype="pdf") as d:
        return [(i + 1, list(t.header.names or []), t.extract()) for i, p in enumerate(d) for t in p.find_tables().tables]


def _pdfplumber_tables(body: bytes) -> list:
    import io

    import pdfplumber

    with pdfplumber.open(io.BytesIO(body)) as d:
        return [(i + 1, None, t) for i, p in enumerate(d.pages) for t in p.extract_tables() or [] if t]


def read_tables(spark: SparkSession, path: str, parser: TableParser, pattern: str = "*.pdf") -> DataFrame:
    """Tables of all files under ``path``, numbered within their page; a file that the parser can't read has none."""
    from granary.operators.views import doc_key

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, body in zip(b["doc_id"], b["content"], strict=True):
                try:
                    found = parser(bytes(body))
                except Exception:  # noqa: BLE001  tables are a help to validation; a file without them is no failure
                    continue
                seen: dict[int, int] = {}
                for page, header, cells in found:
                    rows.append((doc, page, seen.setdefault(page, 0), header, cells))
                    seen[page] += 1
            yield pd.DataFrame(rows, columns=["doc_id", "page_no", "ord", "header", "rows"])

    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(doc_key(F.element_at(F.split("path", "/"), -1), F.col("length")).alias("doc_id"), "content").mapInPandas(run, TABLES)


def promoted(tables: DataFrame) -> DataFrame:
    """Tables without header names whose first row is text throughout have it as their header; those of which no
    row is left go."""
    first = F.get("rows", F.lit(0))
    text = F.col("header").isNull() & (F.size("rows") > 0) & F.forall(first, lambda c: c.isNotNull())
    t = tables.withColumn("_text", text)
    t = t.withColumn("header", F.when(F.col("_text"), first).otherwise(F.col("header"))).withColumn("rows", F.when(F.col("_text"), F.slice("rows", 2, 1_000_000)).otherwise(F.col("rows")))
    return t.filter(F.size("rows") > 0).drop("_text")


def store(rows: DataFrame, path: str, documents: DataFrame | None = None) -> None:
    """Replaces the rows of ``documents`` (doc_id; those that ``rows`` names unless given) and of no others, also
    by none; repeating it changes nothing. Readers see the rows before or after, see ``versions``; of the
    buckets of documents only those touched are written anew."""
    versions.replace(rows.sparkSession, path, {"rows": rows}, documents)


def exists(spark: SparkSession, path: str) -> bool:
    files, at = versions.folder(spark, path)
    return files.exists(at)


def store_chunks(chunks: DataFrame, path: str, documents: DataFrame | None = None) -> None:
    """Chunks with their ``embedding`` (array<float>, of length 1 each as inner products are to be cosines)."""
    missing = {"chunk_id", "doc_id", "text", "embedding"} - set(chunks.columns)
    if missing:
        raise ValueError(f"chunks lack {sorted(missing)}")
    store(chunks, path, documents)


def load_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Stored chunks; unlike other tables, their absence is an error."""
    found = load(spark, path)
    if found is None:
        raise FileNotFoundError(path)
    return found


def export(rows: DataFrame, path: str, kind: str = "csv", documents: DataFrame | None = None) -> None:
    """CSV with a header (arrays joined by "; ") or JSON lines without NaN, for readers outside: a folder
    ``document=<doc_id>`` with one file for each of ``documents`` (doc_id; those that ``rows`` names unless
    given). It replaces what they had, or removes it where they have no rows; other documents stay as they are."""
    spark, flat = rows.sparkSession, []
    for c, t in rows.dtypes:
        if t.startswith("array<") and kind == "csv":
            flat.append(F.array_join(F.col(c).cast("array<string>"), "; ").alias(c))
        elif t in ("double", "float") and kind == "json":
            flat.append(F.when(~F.isnan(c), F.col(c)).alias(c))
        else:
            flat.append(F.col(c))
    out = rows.select(*flat, F.col("doc_id").cast("string").alias("document")).repartition("document")
    w = out.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("document")
    w.option("header", True).csv(path) if kind == "csv" else w.option("ignoreNullFields", False).json(path)
    if documents is not None:
        gone = documents.select(F.col("doc_id").cast("string").alias("document")).distinct().join(out.select("document").distinct(), "document", "left_anti")
        for r in gone.toLocalIterator():
            files, at = versions.folder(spark, f"{path}/document={_escaped(spark, r[0])}")
            files.delete(at, True)


def _escaped(spark: SparkSession, name: str | None) -> str:
    """A partition's folder name, as Spark writes it."""
    if name is None:
        return "__HIVE_DEFAULT_PARTITION__"
    return spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(name)


def write_ordered(rows: DataFrame, path: str, *order: str | Column, partitions: int | None = None) -> None:
    """Parquet files in a global order: read one after the other by name, they give the rows as sorted by
    ``order``. Ranges of the order go to tasks, each of which sorts its own, so no task sees all rows."""
    dealt = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def quality_json(quality: DataFrame) -> DataFrame:
    """doc_id, report: the quality report of each document as JSON, without missing metrics an empty object."""
    missing = F.coalesce(F.to_json("missing"), F.lit("{}"))
    report = F.concat(F.lit('{"candidate_rows":'), F.col("candidate_rows").cast("string"), F.lit(',"resolved_rows":'), F.col("resolved_rows").cast("string"), F.lit(',"missing_core_metrics_by_year":'), missing, F.lit(',"issues":'), F.to_json("issues"), F.lit("}"))
    return quality.select("doc_id", report.alias("report"))


def load(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame | None:
    """A stored table, or an export of ``kind``; None where there is none."""
    if kind == "parquet":
        return versions.read(spark, path)
    return spark.read.option("header", True).format(kind).load(path).drop("document") if exists(spark, path) else None
