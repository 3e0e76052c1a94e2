"""Operator 5: drops recurring lines found by a log-template tree.

A line's tokens are its words, with a wildcard for those that hold a digit. The tree has a fixed depth: token count, then
the three leading tokens. In a leaf, lines that agree with a template in three quarters of the positions join it, and the
positions in which they differ become blanks, which agree with nothing. A template that recurs across documents is dropped wherever it occurs.

Copies of a document all share its lines without those being boilerplate, so a template's recurrence is counted over
distinct documents: a document's mark is its component of near copies, and a template recurs if it has ``min_docs`` marks.
Near copies are found by ``BANDS`` x ``ROWS`` min-hashes of the whole text's word pairs: texts that agree in all hashes of a
band meet the band's least and greatest member and are linked if ``PERCENT`` of all hashes agree. Operator 7's exact join at
that percentage takes more disk than the check tool allows. Lines of fewer than five words are left alone.

Only hashes are shuffled for all lines. Leaves that too few documents reach are put aside, and the texts of lines are
fetched for the remaining leaves alone, through a bitmap of fixed size that lets some others pass (an exact join follows).
A leaf with more than ``MAX_LEAF`` distinct lines or ``MAX_BYTES`` is dealt to parts, whose templates are then lines of a next
round, until one part holds what is left or a whole cycle of rounds merges nothing in that leaf, so no group grows with the
input and a leaf that still merges keeps no other going. A round deals by every k-th token, k being one more than the
positions in which lines of a template may differ: lines that agree in enough positions share all tokens of one such class,
so they meet within k rounds. Where k is over ``CYCLE`` a round deals by ``PROBES`` positions drawn by the round instead: two lines
that agree in three quarters of their positions then miss each other in all rounds of a cycle once in 8,000 times. A class that is
too large itself is dealt by chance, anew in each round.

Cases: null and empty texts stay as they are; repeated rows and near copies have one mark and count once; ties between templates go to
the first in the order of hashes; an empty table gives no rows; ``dedup`` keeps other columns of any
name; its own then have other names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import aside, as_bytes, free_name, map_arrow, release, saved, table
from tidemark.llm.ngramjoin import components, mix, sets_of

DEPTH = 3
SIMILARITY = 0.75
MIN_WORDS = 5
MIN_DOCS = 10
#: Texts that share such a percentage of their shingles of so many words are near copies, linked directly or by others. An
#: edited word costs two pairs of words but five runs of five, so short shingles keep groups of edited copies together.
WIDTH = 2
PERCENT = 60
BANDS = 24
ROWS = 4
TURNS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)).reshape(2, -1)
MAX_LEAF = 2000
MAX_BYTES = 4 << 20
#: So many rounds without a merge end a leaf at most; and the positions by which long lines are dealt in one of them.
CYCLE = 24
PROBES = 4
BITS = 1 << 24
#: A token with a digit; and a position in which lines of a template differ. No token holds a tab.
WILD = b"\t0"
BLANK = b"\t1"
DIGIT_BYTES = b"0123456789"


def hash64(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def masked(line: bytes) -> list[bytes]:
    """The line's tokens, those with digits as wildcards."""
    tokens = line.split()
    if len(line.translate(None, DIGIT_BYTES)) < len(line):
        tokens = [WILD if len(t.translate(None, DIGIT_BYTES)) < len(t) else t for t in tokens]
    return tokens


def leaf_of(tokens: list[bytes]) -> int:
    return hash64(b"%d " % len(tokens) + b" ".join(tokens[:DEPTH]))


def lines(docs: DataFrame, min_words: int) -> DataFrame:
    """Hashes of all lines with enough words: key (of the row), at (line number), leaf, line."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        key, at, leaf, line = [], [], [], []
        for k, text in zip(batch.column("key").to_pylist(), as_bytes(batch.column("text")), strict=True):
            for i, raw in enumerate(text.split(b"\n")):
                tokens = masked(raw)
                if len(tokens) >= min_words:
                    key.append(k), at.append(i), leaf.append(leaf_of(tokens)), line.append(hash64(b" ".join(tokens)))
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(at, pa.int32()), pa.array(leaf, pa.int64()), pa.array(line, pa.int64())], ["key", "at", "leaf", "line"])

    return map_arrow(docs.select("key", "text"), run, "key bigint, at int, leaf bigint, line bigint")


def min_hashes(tokens: np.ndarray) -> np.ndarray:
    """BANDS * ROWS min-hashes of a set of 64-bit tokens."""
    least = np.full(BANDS * ROWS, 1 << 63, np.uint64)
    for start in range(0, len(tokens), 4096):
        some = tokens[start : start + 4096].view(np.uint64)
        least = np.minimum(least, (((some[:, None] ^ TURNS[0]) * (TURNS[1] | np.uint64(1))) >> np.uint64(32)).min(axis=0))
    return least


def signatures(docs: DataFrame) -> DataFrame:
    """key (of the row), node (hash of its word pairs), bands, sig (a byte of each min-hash) of all rows with words."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        key, node, bands, sig = [], [], [], []
        for k, s in zip(batch.column("key").to_pylist(), sets_of(as_bytes(batch.column("text")), WIDTH), strict=True):
            if len(s):
                h = min_hashes(s)
                key.append(k), node.append(hash64(s.tobytes()))
                bands.append([hash64(b"%d " % i + row.tobytes()) for i, row in enumerate(h.reshape(BANDS, ROWS))])
                sig.append(h.astype(np.uint8).view(np.int8))
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(node, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.list_(pa.int8()))], ["key", "node", "bands", "sig"])

    return map_arrow(docs.select("key", "text"), run, "key bigint, node bigint, bands array<bigint>, sig array<tinyint>")


def near_copies(docs: DataFrame) -> DataFrame:
    """key, mark: rows whose texts are near copies, directly or by others, have equal marks."""
    rows = saved(signatures(docs), "lines-signatures")
    nodes = rows.select("node", "bands", "sig").dropDuplicates(["node"])
    index = nodes.select("node", F.explode("bands").alias("band"))
    turned = F.col("node").bitwiseXOR(F.col("band"))
    ends = index.groupBy("band").agg(F.count("*").alias("c"), F.min(turned).alias("x"), F.max(turned).alias("y")).filter("c > 1")
    ends = ends.select("band", F.col("x").bitwiseXOR(F.col("band")).alias("lo"), F.col("y").bitwiseXOR(F.col("band")).alias("hi"))
    order = lambda x, y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    pairs = index.join(ends, "band").select(F.explode(F.array(order("lo", "node"), order("node", "hi"))).alias("p")).select("p.*").filter("a < b").distinct()
    side = lambda s: nodes.select(F.col("node").alias(s), F.col("sig").alias(f"sig_{s}"))
    agree = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda e: e))
    links = saved(pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * agree >= PERCENT * BANDS * ROWS).select("a", "b"), "lines-links")
    comp, stars = components(links)
    out = saved(rows.join(comp, "node", "left").select("key", F.coalesce("comp", "node").alias("mark")).dropDuplicates(["key"]), "lines-marks")
    release(rows, links, stars)
    return out


def bitmap(hashes: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """A bitmap of fixed size in which every hash has set a bit: at most bits / 64 rows reach the driver."""
    place = F.pmod(F.col(column), F.lit(bits))
    placed = hashes.select(F.floor(place / 64).cast("int").alias("w"), (place % 64).cast("int").alias("p"))
    words = placed.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, p)")).alias("b"))
    out = np.zeros(bits // 64, np.int64)
    for r in words.toLocalIterator():
        out[r["w"]] = r["b"]
    return np.unpackbits(out.view(np.uint8), bitorder="little")


def classes(size: int, similarity: float) -> int:
    """In one of so many classes of positions, lines that agree in enough positions differ nowhere."""
    return int(size * (1 - similarity) + 1e-9) + 1


def templates(rows: list[tuple[int, list[bytes]]], similarity: float) -> list[tuple[int, bytes]]:
    """(line, template) for the lines or templates of a leaf, in the order given: each joins the template that agrees with
    it in most positions, if in enough, and else begins one; templates then join each other likewise."""
    out = []
    for size in sorted({len(t) for _, t in rows}):
        some = [(h, t) for h, t in rows if len(t) == size]
        code = {BLANK: 0}
        x = np.array([[code.setdefault(t, len(code)) for t in tokens] for _, tokens in some]).reshape(len(some), size)
        joined = np.arange(len(some))
        while True:
            made, count, to = np.empty_like(x), 0, []
            for row in x:
                same = ((made[:count] == row) & (row > 0)).sum(axis=1)
                best = int(same.argmax()) if count else -1
                if best < 0 or same[best] < similarity * size:
                    best, count = count, count + 1
                    made[best] = row
                else:
                    made[best][made[best] != row] = 0
                to.append(best)
            joined = np.array(to)[joined]
            if count == len(x):
                break
            x = made[:count]
        names = list(code)
        final = [b" ".join(names[c] for c in row) for row in made[:count].tolist()]
        out += [(h, final[i]) for (h, _), i in zip(some, joined.tolist(), strict=True)]
    return out


def tree_of(bodies: DataFrame, similarity: float) -> DataFrame:
    """line, template for the distinct lines (leaf, line, body) of all leaves."""

    def deal(turn: int):  # noqa: ANN202
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            kinds, cycles = [], []
            for body in batch.column("body").to_pylist():
                tokens = body.split(b" ")
                k = classes(len(tokens), similarity)
                if k <= CYCLE:
                    some = tokens[DEPTH + turn % k :: k]
                else:
                    some = [tokens[DEPTH + hash64(b"%d %d" % (turn, i)) % (len(tokens) - DEPTH)] for i in range(PROBES)]
                kinds.append(hash64(b" ".join(some)))
                cycles.append(min(k, CYCLE))
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(kinds, pa.int64()), pa.array(cycles, pa.int32())], [*batch.schema.names, "kind", "cycle"])

        return run

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        got = templates([(h, b.split(b" ")) for h, b in zip(rows["id"].tolist(), rows["body"].tolist(), strict=True)], similarity)
        made = pd.DataFrame(got, columns=["id", "body"])
        return made.assign(leaf=rows["leaf"].iloc[0], template=[hash64(b) for b in made["body"]])[["leaf", "id", "template", "body"]]

    kinds = "leaf bigint, id bigint, template bigint, body binary"
    seeds = bodies.select("leaf", F.col("line").alias("id"), "body")
    fits = (F.col("n") <= MAX_LEAF) & (F.col("bytes") <= MAX_BYTES)
    tree, turn, held = None, 0, None
    while True:
        sized = seeds.join(seeds.groupBy("leaf").agg(F.count("*").alias("n"), F.sum(F.octet_length("body")).alias("bytes")), "leaf")
        made = sized.filter(fits).select(F.col("leaf").alias("part"), "leaf", "id", "body").groupBy("part").applyInPandas(grow, kinds)
        large = saved(map_arrow(sized.filter(~fits).select("leaf", "id", "body"), deal(turn), "leaf bigint, id bigint, body binary, kind bigint, cycle int"), "lines-large")
        now = large.groupBy("leaf").agg(F.count("*").alias("n"), F.max("cycle").alias("cycle"))
        if held is not None:  # a leaf rests once nothing merged in it in a whole cycle: what is left are its templates
            now = now.join(held.select("leaf", F.col("n").alias("was"), F.col("idle").alias("waited")), "leaf", "left")
            now = now.select("leaf", "n", "cycle", F.when(F.col("n") == F.col("was"), F.col("waited") + 1).otherwise(0).alias("idle"))
        else:
            now = now.withColumn("idle", F.lit(0))
        held = saved(now.withColumn("rests", F.col("idle") > F.col("cycle")), "lines-leaves")
        left = held.filter("not rests").count()
        if held.filter("rests").limit(1).count():
            made = made.unionByName(large.join(held.filter("rests"), "leaf", "left_semi").select("leaf", "id", F.col("id").alias("template"), "body"))
        if left:
            open_ = large.join(held.filter("not rests").select("leaf"), "leaf", "left_semi")
            pieces = open_.groupBy("leaf", "kind").agg(F.ceil(F.greatest(F.count("*") / MAX_LEAF, F.sum(F.octet_length("body")) / MAX_BYTES)).alias("pieces"))
            part = F.xxhash64("leaf", "kind", F.pmod(F.xxhash64("id", F.lit(turn)), F.col("pieces")))
            made = made.unionByName(open_.join(pieces, ["leaf", "kind"]).select(part.alias("part"), "leaf", "id", "body").groupBy("part").applyInPandas(grow, kinds))
        made = saved(made, "lines-grown")
        step = made.select(F.col("id").alias("from"), "template")
        if tree is None:
            tree = step.withColumnRenamed("from", "line")
        else:
            tree = saved(tree.join(step.withColumnRenamed("template", "to"), tree["template"] == step["from"], "left").select("line", F.coalesce("to", "template").alias("template")), "lines-tree")
        if not left:
            return tree
        seeds = saved(made.join(held.filter("not rests").select("leaf"), "leaf", "left_semi").select("leaf", F.col("template").alias("id"), "body").dropDuplicates(["id"]), "lines-seeds")
        turn += 1


def recurring(found: DataFrame, marks: DataFrame, docs: DataFrame, min_words: int, min_docs: int, similarity: float) -> DataFrame:
    """Hashes of the lines whose template recurs: one column, line."""
    marked = found.select("leaf", "key").distinct().join(marks, "key").select("leaf", "mark").distinct()
    reached = saved(marked.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("leaf"), "lines-leaves")
    bits = docs.sparkSession.sparkContext.broadcast(np.packbits(bitmap(reached, "leaf")))  # BITS / 8 bytes, whatever the input

    def fetch(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen = np.unpackbits(bits.value)
        got: dict[int, tuple[int, int, bytes]] = {}
        for text in as_bytes(batch.column("text")):
            for raw in text.split(b"\n"):
                tokens = masked(raw)
                if len(tokens) >= min_words and seen[(leaf := leaf_of(tokens)) % BITS]:
                    body = b" ".join(tokens)
                    if (h := hash64(body)) not in got:
                        got[h] = (leaf, h, body)
        kinds = [pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([g[i] for g in got.values()], t) for i, t in enumerate(kinds)], ["leaf", "line", "body"])

    bodies = map_arrow(docs.select("text"), fetch, "leaf bigint, line bigint, body binary").groupBy("leaf", "line").agg(F.first("body").alias("body"))
    tree = tree_of(saved(bodies.join(reached, "leaf", "left_semi"), "lines-bodies"), similarity)
    uses = found.join(tree, "line").select("template", "key").distinct().join(marks, "key").select("template", "mark").distinct()
    often = uses.groupBy("template").agg(F.count("*").alias("docs")).filter(F.col("docs") >= min_docs)
    return tree.join(often, "template", "left_semi").select("line")


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` (doc_id, text, ...) with recurring lines dropped from ``text``, and n_lines, n_dropped (with underscores before
    them where ``docs`` has such columns)."""
    return aside(docs, ("doc_id", "text"), lambda d: _dedup(d, min_words, min_docs, similarity))


def _dedup(docs: DataFrame, min_words: int, min_docs: int, similarity: float) -> DataFrame:
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), "text")
    found = saved(lines(keyed, min_words), "lines-hashes")
    marks = near_copies(keyed)
    gone = found.join(recurring(found, marks, keyed, min_words, min_docs, similarity), "line", "left_semi")
    key, drops = free_name("key", docs.columns), free_name("drops", docs.columns)
    cuts = gone.select("key", "at").distinct().groupBy("key").agg(F.collect_set("at").alias(drops)).withColumnRenamed("key", key)
    all_lines = F.split("text", "\n", -1)
    cut = F.coalesce(drops, F.expr("cast(array() as array<int>)"))
    kept = F.filter(all_lines, lambda x, i: ~F.array_contains(cut, i))
    joined = docs.withColumn(key, F.xxhash64("doc_id", "text")).join(cuts, key, "left").withColumn("n_lines", F.coalesce(F.size(all_lines), F.lit(0)).cast("long")).withColumn("n_dropped", F.size(cut).cast("long"))
    return joined.withColumn("text", F.when(F.size(cut) > 0, F.array_join(kept, "\n")).otherwise(F.col("text"))).drop(key, drops)


def op5_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
