"""Operator 13: audit of how filters interact - who removes what in every order of application.

Filters A to D look at one text, E fails texts that a smaller doc_id has. Equal texts are found by radix tries:

1. Workers judge A to D while they read. Within a block of rows (``BLOCK`` bytes) equal texts become one row with their least
   id, so a text that a third of the table has is shuffled once for each block. Beside the text goes its path: its first bytes
   as a number, then hashes of ever longer prefixes.
2. Prefixes adapt to the data: where more than a share of all bytes lies below a prefix, the next longer prefix tells the
   texts apart. Each round is a sum over paths; at most as many prefixes are carried on as there are shares. A text's cell is
   its first prefix that is light enough, or the whole text.
3. Texts are range-partitioned by first bytes and cell. Each task inserts its full texts into a compressed trie whose terminals
   hold the least id; rows whose terminal knows a smaller id than their own block fail E as a whole.
4. Failure masks are counted by part, mask and labels; every order and step is read off these counts.

Cases: null texts are empty, and equal to each other; a null lang is the part of the empty string; rows without an id never
fail E and make no other row fail it; rows that repeat an id and a text do not fail by each other; each repeated row counts;
an id with several labels is good (or toxic) if one of them says so; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, release, saved, slices, table

BLOCK = 1 << 25
#: A task's texts, and the bytes that its worker may hold.
TASK = 1 << 26
#: Prefixes: so many bytes, then each time so many times longer.
HEAD, GROWTH = 8, 4
#: Shares of all bytes for each task: a prefix with more than one share is split.
SHARES = 4
UPPER = bytes(range(ord("A"), ord("Z") + 1))
CONTINUED = bytes(range(0x80, 0xC0))


def few_words(text: bytes, words: list[bytes]) -> bool:
    return len(words) < 100


def repetitive(text: bytes, words: list[bytes]) -> bool:
    return 100 * len(set(words)) < 80 * len(words)


def shouting(text: bytes, words: list[bytes]) -> bool:
    upper = len(text) - len(text.translate(None, UPPER))
    return bool(upper) and 100 * upper > 10 * len(text.translate(None, CONTINUED))


def marked_up(text: bytes, words: list[bytes]) -> bool:
    return len(text.translate(None, b"#$%&*|")) < len(text)


#: Filters by letter; that of equal texts comes last.
FILTERS: dict[str, Callable[[bytes, list[bytes]], bool]] = {"A": few_words, "B": repetitive, "C": shouting, "D": marked_up}
SAME = "E"


def mask_of(text: bytes) -> int:
    words = text.split()
    return sum(1 << k for k, fails in enumerate(FILTERS.values()) if fails(text, words))


def path_of(text: bytes) -> list[int]:
    """The first bytes as a number in their order, then hashes of prefixes up to the whole text."""
    path, size = [int.from_bytes(text[:HEAD].ljust(HEAD, b"\0"), "big") - (1 << 63)], HEAD
    while size < len(text):
        size *= GROWTH
        path.append(xxhash.xxh64_intdigest(text[:size]) - (1 << 63))
    return path


JUDGED = pa.schema([("rep", pa.int64()), ("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("text", pa.binary()), ("path", pa.list_(pa.int64())), ("size", pa.int64())])


def judged(docs: DataFrame) -> DataFrame:
    """Two kinds of rows: of each document its mask (A to D, and E within its block) and the number ``rep`` of its text; of
    each text of a block (``size`` not null) its least id, bytes and path. ``docs``: doc_id, text, part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        for block in blocks(slices(batches), BLOCK):
            numbers: dict[bytes, int] = {}
            ids, parts, reps = [], [], []
            for batch in block:
                ids += batch.column(0).to_pylist()
                parts += batch.column(2).to_pylist()
                reps += [numbers.setdefault(t, len(numbers)) for t in as_bytes(batch.column(1))]
            texts = list(numbers)
            masks, least = [mask_of(t) for t in texts], [None] * len(texts)
            for i, k in zip(ids, reps, strict=True):
                if i is not None and (least[k] is None or i < least[k]):
                    least[k] = i
            later = 1 << len(FILTERS)
            mask = [masks[k] | (later if i is not None and i > least[k] else 0) for i, k in zip(ids, reps, strict=True)]
            none = [None] * len(ids)
            yield pa.RecordBatch.from_pylist([], JUDGED) if not ids else pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([first + k for k in reps], ids, parts, mask, none, none, none), JUDGED.types, strict=True)], schema=JUDGED)
            for a in range(0, len(texts), 256):
                some = texts[a : a + 256]
                n = [None] * len(some)
                columns = ([first + a + k for k in range(len(some))], least[a : a + 256], n, n, some, [path_of(t) for t in some], [len(t) for t in some])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, JUDGED.types, strict=True)], schema=JUDGED)
            first += len(texts)

    return docs.mapInArrow(run, "rep long, doc_id long, part string, mask int, text binary, path array<long>, size long")


def blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches together until they have ``most`` bytes."""
    some, size = [], 0
    for batch in batches:
        some.append(batch)
        size += batch.nbytes
        if size >= most:
            yield some
            some, size = [], 0
    if some:
        yield some


def cells(texts: DataFrame, share: float) -> DataFrame:
    """``texts`` with ``cell``: the code of the first prefix below which at most ``share`` bytes lie, or of the longest."""
    spark, level, heavy = texts.sparkSession, 0, []
    depth = F.lit(0)
    paths = texts.select("path", "size")
    while True:
        sums = paths.groupBy(F.get("path", F.lit(level)).alias("code")).agg(F.sum("size").alias("n"), F.max(F.size("path")).alias("levels"))
        # those above a share are fewer than the shares there are
        codes = [r["code"] for r in sums.filter((F.col("n") > share) & (F.col("levels") > level + 1)).select("code").collect()]
        if not codes:
            break
        found = F.broadcast(spark.createDataFrame([(c,) for c in codes], "code long"))
        heavy.append(found)
        paths = paths.join(found, (F.get("path", F.lit(level)) == found["code"]) & (F.size("path") > level + 1), "left_semi")
        level += 1
    for k, found in enumerate(heavy):
        mark = found.select(F.col("code").alias(f"__code{k}"))
        texts = texts.join(mark, (F.get("path", F.lit(k)) == F.col(f"__code{k}")) & (F.size("path") > k + 1), "left")
    # as deep as every prefix before was heavy
    for k in reversed(range(len(heavy))):
        depth = F.when(F.col(f"__code{k}").isNotNull(), 1 + depth).otherwise(0)
    return texts.withColumn("cell", F.get("path", depth)).drop(*(f"__code{k}" for k in range(len(heavy))))


def common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common beginning of ``a`` and of ``b`` from ``at`` on."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Trie:
    """Compressed trie of byte strings: a node has the bytes that lead to it and its children by their first byte, a terminal
    the least id."""

    def __init__(self) -> None:
        self.label: list[bytes] = [b""]
        self.below: list[dict[int, int]] = [{}]
        self.least: list[int | None] = [None]

    def node(self, label: bytes) -> int:
        self.label.append(label)
        self.below.append({})
        self.least.append(None)
        return len(self.label) - 1

    def place(self, text: bytes) -> int:
        """The node where ``text`` ends, made if need be."""
        node, at = 0, 0
        while at < len(text):
            child = self.below[node].get(text[at])
            if child is None:
                child = self.below[node][text[at]] = self.node(text[at:])
                return child
            label = self.label[child]
            if text.startswith(label, at):
                node, at = child, at + len(label)
                continue
            k = common(label, text, at)
            upper = self.below[node][text[at]] = self.node(label[:k])
            self.label[child] = label[k:]
            self.below[upper][label[k]] = child
            node, at = upper, at + k
        return node

    def insert(self, text: bytes, doc_id: int | None) -> int:
        node = self.place(text)
        if doc_id is not None and (self.least[node] is None or doc_id < self.least[node]):
            self.least[node] = doc_id
        return node


def later_texts(texts: DataFrame) -> DataFrame:
    """``rep`` of the texts of a block that a smaller id has elsewhere. Each partition holds all copies of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, rows = Trie(), []
        for batch in slices(batches):
            for rep, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True):
                rows.append((rep, doc_id, trie.insert(text, doc_id)))
        later = [rep for rep, doc_id, node in rows if doc_id is not None and trie.least[node] < doc_id]
        yield pa.RecordBatch.from_arrays([pa.array(later, pa.int64())], ["rep"])

    return texts.select("rep", "doc_id", "text").mapInArrow(run, "rep long")


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask (bit k: the k-th filter fails) and the number n of such rows, saved. ``docs``: doc_id, text, part."""
    spark = docs.sparkSession
    rows = saved(judged(docs.select("doc_id", "text", "part")), "audit-judged")
    texts = rows.filter(F.col("size").isNotNull())
    total = texts.agg(F.sum("size")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK))
    dealt = cells(texts, total / (SHARES * tasks)).repartitionByRange(tasks, F.get("path", F.lit(0)), "cell")
    later = saved(later_texts(dealt), "audit-later")
    documents = rows.filter(F.col("size").isNull()).select("rep", "doc_id", "part", "mask").join(later.withColumn("later", F.lit(1 << len(FILTERS))), "rep", "left")
    fails = F.when(F.col("doc_id").isNotNull(), F.coalesce("later", F.lit(0))).otherwise(0)
    out = saved(documents.groupBy("doc_id", "part", F.col("mask").bitwiseOR(fails).alias("mask")).agg(F.count("*").alias("n")), "audit-masks")
    release(rows, later)
    return out


def labelled(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """``counts`` by part, mask and labels. Ids were counted before, so none holds many rows; those without one aren't joined."""
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = counts.filter(F.col("doc_id").isNotNull()).join(marks, "doc_id", "left").select("part", "mask", "n", "good", "toxic")
    rest = counts.filter(F.col("doc_id").isNull()).select("part", "mask", "n", F.lit(None).cast("boolean").alias("good"), F.lit(None).cast("boolean").alias("toxic"))
    marked = known.unionByName(rest)
    return marked.groupBy("part", "mask", *(F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic"))).agg(F.sum("n").alias("n"))


def orders() -> Column:
    """Each order of the filters and step of it, with the bit of its filter and the mask of those before."""
    names = [*FILTERS, SAME]
    steps = []
    for order in itertools.permutations(range(len(names))):
        before = 0
        for k, f in enumerate(order):
            steps.append({"filter_order": "".join(names[x] for x in order), "step": k + 1, "bit": 1 << f, "before": before})
            before |= 1 << f
    return F.inline(F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,bit:int,before:int>>"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, order and step how many documents stay, go, would have gone, and what the filters are worth: ``docs`` with
    doc_id, text, part; ``labels`` with doc_id, quality, toxic."""
    counts = labelled(masks(docs), labels).select("*", orders())
    mask, bit, before, n = F.col("mask"), F.col("bit"), F.col("before"), F.col("n")
    fails = mask.bitwiseAND(bit) != 0
    earlier = mask.bitwiseAND(before) != 0
    removed = fails & ~earlier
    every = len(list(itertools.permutations([*FILTERS, SAME])))

    def total(condition: Column, value: Column = n) -> Column:
        return F.sum(F.when(condition, value).otherwise(0)).cast("long")

    return counts.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~earlier).alias("kept"), total(removed).alias("removed"), total(fails & earlier).alias("redundant"), total(mask == bit).alias("unique_fails"),
        total(removed & F.col("good")).alias("good_lost"), total(removed & F.col("toxic")).alias("toxic_lost"),
        # first among the filters that it fails is each in equally many orders
        total(fails, F.expr(f"n * {every} div bit_count(mask)")).alias("shapley"),
    )


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("part"))
    return audit(docs, table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'),
  coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS x FROM d),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, x, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
s AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM s a, s b, s c, s d, s e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
p AS (SELECT filter_order, step::INTEGER AS step, ascii(filter_order[step]) - 64 AS k, list_transform(range(1, step), lambda i: ascii(filter_order[i]) - 64) AS before FROM o, range(1, 6) r(step)),
e AS (SELECT part, filter_order, step, n, good, toxic, x[k] AS fails, len(list_filter(before, lambda i: x[i])) > 0 AS earlier, len(list_filter(x, lambda v: v)) AS c FROM m, p)
SELECT part, filter_order, step, sum(n * (NOT fails AND NOT earlier)::INT)::BIGINT AS kept, sum(n * (fails AND NOT earlier)::INT)::BIGINT AS removed,
  sum(n * (fails AND earlier)::INT)::BIGINT AS redundant, sum(n * (fails AND c = 1)::INT)::BIGINT AS unique_fails, sum(n * (fails AND NOT earlier AND good)::INT)::BIGINT AS good_lost,
  sum(n * (fails AND NOT earlier AND toxic)::INT)::BIGINT AS toxic_lost, sum(CASE WHEN fails THEN n * 120 // c ELSE 0 END)::BIGINT AS shapley
FROM e GROUP BY part, filter_order, step
"""
