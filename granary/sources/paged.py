"""Files of pages as a Spark data source: partitions are page ranges of files, so a long file is many tasks.

    register(spark)
    spark.read.format("paged_files").option("path", folder).option("parsers", "pypdf,text").load()

The planner asks each file only for its number of pages; a task opens the file and reads its range, and the
chain of parsers decides for each range. Filters on doc_id, path and page_no are pushed down: files and ranges that they rule out
are never opened. As a stream, an offset is the latest change that was seen, and a batch has the files changed
since the one before."""

from __future__ import annotations

import fnmatch
import hashlib
import io
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from granary.package import ship

SCHEMA = "doc_id string, path string, page_no int, text string, parser string, error string"
#: Pages of a task.
RANGE = 50


@dataclass(frozen=True)
class PageParser:
    """How many pages a file has, and the texts of a range of them (from 1, both ends included)."""

    count: Callable[[bytes], int]
    read: Callable[[bytes, int, int], list[str]]


def _text_pages(body: bytes) -> list[str]:
    return body.decode("utf-8").split("\f")


def _pypdf(body: bytes):
    from pypdf import PdfReader

    return PdfReader(io.BytesIO(body)).pages


def _pymupdf(body: bytes):
    import fitz

    return fitz.open(stream=body, filetype="pdf")


PARSERS: dict[str, PageParser] = {
    "text": PageParser(lambda b: len(_text_pages(b)), lambda b, i, j: _text_pages(b)[i - 1 : j]),
    "pypdf": PageParser(lambda b: len(_pypdf(b)), lambda b, i, j: [_pypdf(b)[k].extract_text() or "" for k in range(i - 1, j)]),
    "pymupdf": PageParser(lambda b: len(_pymupdf(b)), lambda b, i, j: [p.get_text() for p in _pymupdf(b).pages(i - 1, j)]),
}


@dataclass(frozen=True)
class Found:
    """A file: its path, name, size and time of change."""

    path: str
    name: str
    size: int
    changed: float

    @property
    def doc_id(self) -> str:
        return hashlib.md5(f"{self.name}{self.size}".encode()).hexdigest()[:12]


class _Folder:
    """A folder that driver and executors share: a local path, or any address that pyarrow knows."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.files, self.root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))

    def found(self, pattern: str) -> list[Found]:
        from pyarrow import fs

        infos = self.files.get_file_info(fs.FileSelector(self.root, recursive=True))
        return sorted((Found(i.path, i.base_name, i.size, i.mtime_ns / 1e9) for i in infos if i.is_file and fnmatch.fnmatch(i.base_name, pattern)), key=lambda f: f.path)

    def body(self, path: str) -> bytes:
        with self.files.open_input_file(path) as f:
            return f.read()


@dataclass
class PageRange(InputPartition):
    path: str
    doc_id: str
    first: int
    last: int
    error: str = ""


class _Pages:
    """What both readers share: planning ranges and reading one."""

    def __init__(self, options: dict, parsers: dict[str, PageParser]):
        self.folder, self.pattern = options["path"], options.get("pattern", "*")
        self.size = int(options.get("pagesPerTask", RANGE))
        self.parsers = {n: parsers[n] for n in options.get("parsers", "text").split(",")}
        self.least, self.most, self.documents, self.paths = 1, 2**31 - 1, None, None

    def planned(self, files: list[Found]) -> Iterator[PageRange]:
        folder = _Folder(self.folder)
        for f in files:
            if (self.documents is not None and f.doc_id not in self.documents) or (self.paths is not None and f.path not in self.paths):
                continue
            body, errors, count = folder.body(f.path), [], None
            for name, p in self.parsers.items():
                try:
                    count = p.count(body)
                    break
                except Exception as e:  # noqa: BLE001  what one parser can't open goes to the next
                    errors.append(f"{name}: {e}")
            if count is None:
                yield PageRange(f.path, f.doc_id, 0, 0, "; ".join(errors))
                continue
            for first in range(1, count + 1, self.size):
                last = min(first + self.size - 1, count)
                if last >= self.least and first <= self.most:
                    yield PageRange(f.path, f.doc_id, max(first, self.least), min(last, self.most))

    def rows(self, part: PageRange) -> Iterator[tuple]:
        if part.error:
            yield part.doc_id, part.path, None, None, None, part.error
            return
        body, texts, used, errors = _Folder(self.folder).body(part.path), None, None, []
        for name, p in self.parsers.items():
            try:
                texts, used = p.read(body, part.first, part.last), name
            except Exception as e:  # noqa: BLE001  as above, for this range alone
                errors.append(f"{name}: {e}")
                continue
            if any(t.strip() for t in texts):
                break
        if texts is None:
            yield part.doc_id, part.path, part.first, None, None, "; ".join(errors)
        for i, t in enumerate(texts or []):
            yield part.doc_id, part.path, part.first + i, t, used, None


class _Reader(_Pages, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes over bounds on page_no and equalities of doc_id and path. A file that can't be read has a row without a
        page, so bounds are applied again by Spark; equalities are left to it as well."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column == "page_no":
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.least = max(self.least, f.value + isinstance(f, GreaterThan))
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.most = min(self.most, f.value - isinstance(f, LessThan))
                elif isinstance(f, EqualTo):
                    self.least, self.most = max(self.least, f.value), min(self.most, f.value)
            elif column in ("doc_id", "path") and isinstance(f, (EqualTo, In)):
                name, own = ("documents", self.documents) if column == "doc_id" else ("paths", self.paths)
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                setattr(self, name, asked if own is None else own & asked)
            yield f

    def partitions(self) -> list[PageRange]:
        return list(self.planned(_Folder(self.folder).found(self.pattern))) or [PageRange("", "", 1, 0)]

    def read(self, partition: PageRange) -> Iterator[tuple]:
        if partition.path:
            yield from self.rows(partition)


class _StreamReader(_Pages, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"changed": -1.0}

    def latestOffset(self) -> dict:
        return {"changed": max((f.changed for f in _Folder(self.folder).found(self.pattern)), default=-1.0)}

    def partitions(self, start: dict, end: dict) -> list[PageRange]:
        return list(self.planned([f for f in _Folder(self.folder).found(self.pattern) if start["changed"] < f.changed <= end["changed"]]))

    def read(self, partition: PageRange) -> Iterator[tuple]:
        return self.rows(partition)


class PagedFiles(DataSource):
    """Options: path; pattern of file names (*); parsers, in order of preference (text); pagesPerTask. A file that no
    parser opens has one row with its errors, a range that none reads one with its first page."""

    parsers = PARSERS

    @classmethod
    def name(cls) -> str:
        return "paged_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), self.parsers)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options), self.parsers)



def register(spark: SparkSession, source: type[PagedFiles] = PagedFiles) -> None:
    """Makes a source known to a session, which pushes filters down to Python sources from then on."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
