"""Cleans, deduplicates, redacts and packs ``documents``: STAGES in order, each written and read again.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.

Cases, for every stage: null and empty texts, nulls in other columns, repeated rows, an empty table and further columns of any
name pass without failing. Repeated rows are kept or dropped together, but for near_duplicates, which keeps one of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import quoted, saved, table
from tidemark.llm.linededup import dedup
from tidemark.llm.ngramjoin import one_of_each
from tidemark.llm.packing import pack_documents
from tidemark.llm.pii import redact
from tidemark.llm.quality import keep_good


def with_length(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, n_chars counted anew."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*map(quoted, columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: those of under ten words (so null and empty texts) or of repeated words, and
    outliers of their language and source."""
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go from every text; a text may become empty, null stays null, no row goes."""
    return with_length(dedup(docs), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 80 % of their five-word shingles, linked directly or by others, one stays: that of the smallest doc_id.
    Texts without words all stay."""
    return one_of_each(docs, width=5, percent=80)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes the name of its kind; null texts stay null, no row goes."""
    return with_length(redact(docs), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every token lies in sequences of 4096; null and empty texts are the end token alone."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("pii", pii), ("packing", packing)]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents in ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
