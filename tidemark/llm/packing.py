"""Operator 1: packing token sequences by first-fit decreasing over a tournament tree of bin capacities.

Texts become ids where they are read; only the pieces' lengths and checksums are shuffled. A document longer than a
sequence is cut at multiples of the sequence length. Pieces are dealt to random groups by a hash of the document, and each
group is packed by itself, longest piece first, into the leftmost bin that still has room: the tree over the bins holds in
each node the largest capacity below it, so that bin is found in log2(bins) steps. A group has a few thousand documents
whatever the input's size, and the padding falls with the group's size.

Cases: null and empty texts are a document of the end token alone; equal documents are packed each for itself; ties in
length are broken by doc_id and start, null ids first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import classes, encoder
from tidemark.llm.common import as_bytes, map_arrow, table

LENGTH = 4096
GROUP_DOCS = 4096
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, salt bigint"


def first_fit(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size, taken in the given order: the first bin with room, by a tournament tree."""
    width = 1 << max(0, len(sizes) - 1).bit_length()
    tree = [capacity] * (2 * width)
    bins = []
    for size in sizes:
        node = 1
        while node < width:
            node *= 2
            if tree[node] < size:
                node += 1
        bins.append(node - width)
        tree[node] -= size
        while node > 1:
            node //= 2
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
    return bins


def pieces(docs: DataFrame, path: str, end_id: int = 2, length: int = LENGTH) -> DataFrame:
    """One row for each piece of at most ``length`` tokens: doc_id, start, length, ids_crc32, doc_tokens, salt."""
    end, kinds = end_id.to_bytes(4, "little"), classes()

    def run(batch: pa.RecordBatch) -> pa.Table:
        rows = []
        for doc, salt, ids in zip(batch.column("doc_id").to_pylist(), batch.column("salt").to_pylist(), encoder(path, kinds, False).encode_ids(as_bytes(batch.column("text"))), strict=True):
            ids += end
            n = len(ids) // 4
            rows += [(doc, a, min(length, n - a), zlib.crc32(ids[4 * a : 4 * (a + length)]), n, salt) for a in range(0, n, length)]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 6, names)

    salted = docs.select("doc_id", "text", F.xxhash64("doc_id", F.length("text"), F.lit("pack")).alias("salt"))
    return map_arrow(salted, run, PIECES, keeps="bpe")


def pack(found: DataFrame, groups: int, length: int = LENGTH) -> DataFrame:
    """``pieces`` with sequence_id and offset."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable", na_position="first")
        bins = np.array(first_fit(rows["length"].tolist(), length), np.int64)
        rows["sequence_id"] = (int(key[0]) << 32) + bins
        rows["offset"] = rows.groupby("sequence_id")["length"].cumsum() - rows["length"]
        return rows.drop(columns=["salt", "grp"])

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return found.withColumn("grp", F.pmod("salt", F.lit(groups))).groupBy("grp").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, length: int = LENGTH, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Where every token of every document lies: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    groups = max(1, math.ceil(docs.count() / group_docs))
    return pack(pieces(docs, path, end_id, length), groups, length)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
