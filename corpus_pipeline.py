"""The corpus pipeline: language ID, line dedup, near dedup, mixing, packing.

STAGES are (name, function) in order; each function takes (spark, docs, sf_dir) and returns what it keeps,
with the columns of its input but for the last, which returns packed pieces. Null and empty texts are
rejected by the first stage (no language can be told); later stages treat them as their operators say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm.language import known_language, learn_open_fold
from granary.llm.line_dedup import cleaned_documents
from granary.llm.mixing import mixed_documents
from granary.llm.near_dedup import one_of_each
from granary.llm.packing import pack
from granary.llm.queries import word_bpe_path
from granary.llm.shared import tables, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the classifier learns from the open fold of its input."""
    return known_language(docs, learn_open_fold(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of repeated three-line windows and long lines; documents of which
    nothing stays go."""
    return cleaned_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, by shingles of five words and a similarity of 0.8."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of 4096."""
    return pack(docs, word_bpe_path())


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Learned language models, signatures and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again as the next one's input."""
    docs = tables(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
