"""Secret scans over an incremental blob ledger.

Every version of a text is addressed by its SHA-256. The ledger holds one row per (blob, rule, rule version)
ever scanned, with the spans found, empty ones too. A scan takes only the pairs that the ledger lacks: each
unseen blob is read once, however many paths hold it, and only with the rules it wasn't scanned with.
Findings are then joined back to all paths. Texts move once, to the row that stands for their blob; the
join back moves digests and spans."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.shared import ship, written


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, the shortest length of ``group``, and literals of which a text needs
    one (folded to lower case) before the pattern is tried; none means always."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    needs: tuple[str, ...] = ()


#: Kinds in the order in which equal starts are listed. The first three are the base kinds.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, ("passw", "secret", "token", "api")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16, ("akia",)),
    Rule("hex", 1, r"[0-9a-f]+", 0, 32),
    Rule("pem", 1, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 1, ("private key",)),
    Rule("jwt", 2, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 20, ("eyj",)),
)
BASE = ("assign", "access", "hex")
LEDGER = "blob binary, kind string, version int, spans array<struct<start:long,end:long>>"


def find(rule: Rule, text: str, folded: str | None = None) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of a rule, as code point spans, those too short dropped."""
    folded = text.lower() if folded is None else folded
    if rule.needs and not any(n in folded for n in rule.needs):
        return []
    if rule.kind == "hex" and rule.group == 0:
        return [m.span() for m in re.finditer(f"{rule.pattern[:-1]}{{{rule.least},}}", text, re.ASCII)]
    return [m.span() for m in re.finditer(rule.pattern, text, re.ASCII) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _scanned(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = {(r.kind, r.version): r for r in rules}
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            rows = []
            for blob, text, todo in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                folded = text.lower()
                for t in todo:
                    rule = by[t["kind"], t["version"]]
                    rows.append((blob, rule.kind, rule.version, [{"start": a, "end": b} for a, b in find(rule, text, folded)]))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            types = [pa.binary(), pa.string(), pa.int32(), spans_type]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["blob", "kind", "version", "spans"])

    return run


def paths(docs: DataFrame) -> DataFrame:
    """doc_id and blob (SHA-256 of the UTF-8 text, null as empty) of every row."""
    return docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("blob"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (see LEDGER): every (blob of docs, rule) that ``ledger`` doesn't hold, scanned once.

    Append them to the ledger. Empty tables give no rows; null texts are the empty blob."""
    spark = docs.sparkSession
    ship(spark)
    at = written(paths(docs), "paths")
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    blobs = at.groupBy("blob").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("at"))
    if ledger is None:
        blobs = blobs.withColumn("todo", wanted)
    else:
        seen = ledger.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("todo", F.when(F.col("seen").isNull(), wanted).otherwise(F.filter(wanted, lambda r: ~F.array_contains("seen", r)))).drop("seen").filter(F.size("todo") > 0)
    blobs = blobs.select(F.col("at.doc_id").alias("_id"), F.col("blob").alias("_blob"), "todo")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("blob"))
    todo = texts.join(blobs, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("blob") == F.col("_blob"))).select("blob", "text", "todo")
    found = written(todo.mapInArrow(_scanned(rules), LEDGER), "findings")
    # A blob met twice under one doc_id is listed once.
    return found.dropDuplicates(["blob", "kind", "version"])


def findings(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, found (array of kind, start, end by start, then kind as listed) of every row of ``docs``,
    joined from the ledger; repeated rows all have theirs, and no finding gives an empty array."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    current = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    hits = ledger.filter(F.array_contains(current, F.struct("kind", "version")) & (F.size("spans") > 0)).select("blob", "kind", F.explode("spans").alias("s"))
    hits = hits.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct(F.col("s.start").alias("start"), order[F.col("kind")].alias("place"), "kind", F.col("s.end").alias("end")))).alias("found"))
    out = paths(docs).join(hits, "blob", "left")
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return out.select("doc_id", F.when(F.col("found").isNull(), none).otherwise(F.transform("found", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the SHA-256 of the base spans and the text of all spans, per row."""
    told = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("found")).alias("spans"))
