"""Operator 7: exact Jaccard join of word n-gram sets by prefixes of token combinations.

A token is the 64-bit hash of a shingle. Equal sets become one node. Tokens are ordered by an estimate of their frequency
and then by hash (any order is right; the estimate only keeps candidates few). Two sets that link with n_x <= n_y share at
least two tokens within the first n_x - ceil(2t/(1+t) n_x) + 2 of x (its short prefix) and n_y - ceil(t n_y) + 2 of y (its
long prefix). Tokens below ``FREQUENT`` are indexed singly; if none of those is shared, both shared tokens are frequent,
and their pair is: combinations of two index the frequent class. Large sets would have too many combinations, so from
``PAIR_SIZE`` * t tokens on they index frequent tokens singly too, and from ``PAIR_SIZE`` / t on only so; sets on either
side of a limit then still meet. Keys that no short prefix has are dropped.

Within a key no pairs are multiplied out at first: each member meets two members that one of ``TURNS`` hashes picks for the
key. Candidates pass a lossless bound from parity sketches of as many bits as the set has tokens, and are then verified on
whole sets. The verified links join most members of a key into few components. Members in another component than the two
that each key then picks anew meet those likewise. Only members that are in different components even then meet each other,
short with long, if what follows the key in both prefixes leaves room for enough common tokens: the first tokens that a
linked pair shares always pass. Links inside a component add nothing to it, so no link between components is lost.

Cases: null and empty texts, and texts without a word, have no shingles and link with nothing; with fewer words than the
width the whole sequence is the one shingle; repeated rows are equal sets; ties in component ids go to the smallest
doc_id, a null doc_id never being one unless all are; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, forget, free_name, map_arrow, release, saved, slices, table

FREQUENT = 256
LISTED = 16
MAX_LISTED = 200_000
PAIR_SIZE = 200
#: Bits of a sketch at least; sets with more tokens have as many, rounded up to a power of two.
SKETCH = 512
CHUNK_DOCS = 4096
#: Rows of a star table for each of its files: they are few, whatever the number of shuffle partitions.
STARS_A_FILE = 100_000
#: Ways to choose the two members that all others of a key meet first.
TURNS = 16
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


@lru_cache(2)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, MULTIPLIER, np.uint64), np.full(size, INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and how many words each text has."""
    raw = np.frombuffer(b" ".join(texts).translate(LOWER) + b" ", np.uint8)
    up, down = powers(1 << max(16, int(raw.size).bit_length()))
    total = np.r_[np.uint64(0), np.cumsum(BYTE[raw] * up[: raw.size])]
    gap = SPACE[raw]
    edge = np.flatnonzero(np.diff(np.r_[True, gap]))
    start, end = edge[::2], edge[1::2]
    ends = np.cumsum([len(t) + 1 for t in texts])
    return mix((total[end] - total[start]) * down[start]), np.diff(np.r_[0, np.searchsorted(start, ends)])


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct tokens."""
    words, counts = word_hashes(texts)
    whole = words[: max(0, len(words) - width + 1)].copy()
    for k in range(1, width):
        whole = mix(whole * np.uint64(0xA24BAED4963EE407) + words[k : len(words) - width + 1 + k])
    at = 0
    for n in counts.tolist():
        if n >= width:
            yield np.unique(whole[at : at + n - width + 1].view(np.int64))
        elif n:
            h = words[at : at + 1].copy()
            for k in range(1, n):
                h = mix(h * np.uint64(0xA24BAED4963EE407) + words[at + k : at + k + 1])
            yield mix(h + np.uint64(n)).view(np.int64)
        else:
            yield np.zeros(0, np.int64)
        at += n


def groups_of(texts: list[bytes], most: int = 1 << 20) -> Iterator[list[bytes]]:
    """Runs of texts of about a MB, so that a batch of long texts is hashed piece by piece."""
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size > most:
            yield some
            some, size = [], 0
    if some:
        yield some


def sets_of(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    for some in groups_of(texts):
        yield from shingle_sets(some, width)


def sketch(tokens: np.ndarray) -> list[int]:
    """The parity of each bit that tokens fall on; folding its halves together gives the sketch of half as many bits."""
    bits = 1 << max(SKETCH.bit_length() - 1, int(max(1, len(tokens)) - 1).bit_length())
    return np.packbits(np.bincount(tokens & (bits - 1), minlength=bits).astype(np.uint8) & 1, bitorder="little").view(np.int64).tolist()


def read(docs: DataFrame, width: int) -> DataFrame:
    """For each row of docs (key, doc_id, text): node (hash of its set), n, sketch; besides rows with tokens that several
    documents of a chunk share and their counts there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: list[np.ndarray] = []
        docs_held = 0

        def shared() -> tuple[np.ndarray, np.ndarray]:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            return tokens[counts > 1], counts[counts > 1]

        names, kinds = ["key", "doc_id", "node", "n", "sketch", "token", "times"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
        for batch in slices(batches, 1024):
            nodes, sizes, sketches = [], [], []
            for s in sets_of(as_bytes(batch.column("text")), width):
                nodes.append(int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True))
                sizes.append(len(s)), sketches.append(sketch(s)), held.append(s)
            none = pa.nulls(len(nodes), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.list_(pa.int64())), none, none], names)
            docs_held += len(nodes)
            if docs_held >= CHUNK_DOCS or sum(map(len, held)) > 8_000_000:
                tokens, times = shared()
                held, docs_held = [], 0
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(tokens), t) for t in kinds[:5]), pa.array(tokens), pa.array(times, pa.int64())], names)
        if held:
            tokens, times = shared()
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(tokens), t) for t in kinds[:5]), pa.array(tokens), pa.array(times, pa.int64())], names)

    return docs.select("key", "doc_id", "text").mapInArrow(run, "key bigint, doc_id bigint, node bigint, n bigint, sketch array<bigint>, token bigint, times bigint")


def keys_of(tokens: np.ndarray, listed: np.ndarray, times: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of a set and, for each, four times the number of tokens that follow it in the order, plus two for a pair
    of tokens, plus one if it lies in the short prefix. See the module's text."""
    n = len(tokens)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(listed, tokens)
    at[at == len(listed)] = 0
    count = np.where(listed[at] == tokens, times[at], 0) if len(listed) else np.zeros(n, np.int64)
    long = min(n, n + (-percent * n // 100) + 2)
    short = min(n, n + (-2 * percent * n // (100 + percent)) + 2)
    order = np.lexsort((tokens, count))[:long]
    prefix, often, place = tokens[order], count[order] >= FREQUENT, np.arange(long)
    one = ~often | (n >= PAIR_SIZE * percent / 100)
    keys = [prefix[one]]
    places = [place[one]]
    pairs = [np.zeros(int(one.sum()), np.int64)]
    at = np.flatnonzero(often)
    if n <= PAIR_SIZE * 100 / percent and len(at) > 1:
        i, j = at[np.array(list(combinations(range(len(at)), 2)))].T
        frequent = prefix.view(np.uint64)
        keys.append(mix(mix(frequent[i]) * np.uint64(3) + frequent[j]).view(np.int64))
        places.append(j)
        pairs.append(np.full(len(j), 2))
    place = np.concatenate(places)
    return np.concatenate(keys), 4 * (n - 1 - place) + np.concatenate(pairs) + (place < short)


def postings(docs: DataFrame, width: int, percent: int, listed: np.ndarray, times: np.ndarray) -> DataFrame:
    """key (of a row), keys and marks (of its index)."""
    shared = docs.sparkSession.sparkContext.broadcast((listed, times))  # at most MAX_LISTED tokens

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        some, counts = shared.value
        got = [keys_of(s, some, counts, percent) for s in sets_of(as_bytes(batch.column("text")), width)]
        return pa.RecordBatch.from_arrays([batch.column("key"), pa.array([k for k, _ in got], pa.list_(pa.int64())), pa.array([m.astype(np.int32) for _, m in got], pa.list_(pa.int32()))], ["key", "keys", "marks"])

    return map_arrow(docs.select("key", "text"), run, "key bigint, keys array<bigint>, marks array<int>")


def token_sets(docs: DataFrame, width: int) -> DataFrame:
    """node, tokens of each row of docs (node, text)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("node"), pa.array(list(sets_of(as_bytes(batch.column("text")), width)), pa.list_(pa.int64()))], ["node", "tokens"])

    return map_arrow(docs.select("node", "text"), run, "node bigint, tokens array<bigint>")


def sizes_fit(percent: int) -> Column:
    return 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")


def may_link(percent: int) -> Column:
    """The overlap that the parity sketches allow, (n_a + n_b - differing bits) / 2 at most, is enough."""

    def folded(x: str, other: str) -> Column:
        half = F.floor(F.size(x) / 2).cast("int")
        both = F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x) > F.size(other), both).otherwise(F.col(x))

    bits = F.zip_with(folded("sketch_a", "sketch_b"), folded("sketch_b", "sketch_a"), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    both = F.col("n_a") + F.col("n_b")
    most = F.floor((both - F.aggregate(bits, F.lit(0), lambda acc, x: acc + x)) / 2)
    return F.when(sizes_fit(percent), 100 * most >= percent * (both - most)).otherwise(F.lit(False))


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that link."""
    side = lambda s: nodes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))
    close = saved(pairs.join(side("a"), "a").join(side("b"), "b").filter(may_link(percent)).select("a", "b"), "join-close")
    wanted = close.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    rows = nodes.join(wanted, "node", "left_semi").select("key", "node")
    sets = saved(token_sets(docs.join(rows, "key").dropDuplicates(["node"]), width), "join-sets")
    both = close.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b")
    common = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("i"), (F.size("x") + F.size("y")).alias("s"))
    links = saved(common.filter(100 * F.col("i") >= percent * (F.col("s") - F.col("i"))).select("a", "b"), "join-links")
    release(close, sets)
    return links


def near_labels(links: DataFrame, hops: int = 3) -> DataFrame:
    """node, comp: the least node within so many links. Nodes of one label are in one component, not the other way round."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    label = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m")).withColumn("was", F.col("u"))
    for _ in range(hops - 1):
        # u has a label of least(u, v) at most already: the stars of a key's least member have nothing to tell; nor have those
        # whose label is what they told before
        told = label.filter("m < was").select(F.col("u").alias("from"), "m")
        seen = both.join(told, (F.col("v") == F.col("from")) & (F.col("m") < F.least("u", "v"))).select("u", "m", F.lit(None).cast("long").alias("was"))
        label = seen.unionByName(label.select("u", "m", F.col("m").alias("was"))).groupBy("u").agg(F.min("m").alias("m"), F.min("was").alias("was"))
    return label.select(F.col("u").alias("node"), F.col("m").alias("comp"))


def merged(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """u, m: every node of ``links`` (a, b) and the least one that a link gives it, itself included; and the distinct links
    u > v between such least nodes. Both are saved. A component's least node is its own m, so what the second table connects
    names the components of all, however many links a node has."""
    ends = links.select("a", "b").filter("a <> b")
    own = saved(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("m")).withColumnRenamed("a", "u"), "join-own")
    told = ends.join(own.select(F.col("u").alias("a"), F.col("m").alias("x")), "a").select("x", "b").distinct()
    left = told.join(own.select(F.col("u").alias("b"), F.col("m").alias("y")), "b").filter("x <> y")
    return own, saved(left.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "join-stars")


def components(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node, comp (its component's least node) of every node of ``links`` (a, b), by alternating large and small stars over what
    remains once each node has gone to its least neighbour; and the saved table to release."""
    sums = [F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    own, last = merged(links)
    before, edges = last.agg(*sums).first(), last
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.filter("m < u").select("u", F.col("m").alias("v"))).filter("u <> v")
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        edges = small.select("u", F.col("m").alias("v")).unionByName(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        edges = saved(edges.coalesce(-(-before[0] // STARS_A_FILE)), "join-stars")
        release(last)
        last = edges
        now = edges.agg(*sums).first()
        if now == before:
            break
        before = now
    out = saved(own.join(edges.select(F.col("u").alias("m"), F.col("v").alias("to")), "m", "left").select(F.col("u").alias("node"), F.coalesce("to", "m").alias("comp")), "join-components")
    release(own, last)
    return out, out


def still_apart(postings: DataFrame, links: DataFrame) -> DataFrame:
    """``postings`` (k, w, node) of the keys whose members the links leave in several components, with ``comp``."""
    named = postings.join(near_labels(links), "node", "left").select("k", "w", "node", F.coalesce("comp", "node").alias("comp"))
    several = named.groupBy("k").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("k")
    return named.join(several, "k", "left_semi")


def across(apart: DataFrame) -> DataFrame:
    """Pairs of each member with two of its key, others for each key, that are in other components: what the first meeting
    left alone tries again, and the many that it joined don't."""
    turned = F.struct(F.col("node").bitwiseXOR(F.col("k")), "node", "comp")
    ends = apart.groupBy("k").agg(F.min(turned).alias("lo"), F.max(turned).alias("hi"))
    others = F.filter(F.array("lo", "hi"), lambda e: e["comp"] != F.col("comp"))
    met = apart.join(ends, "k").select("node", F.explode(others).alias("end"))
    return met.select(F.least("node", "end.node").alias("a"), F.greatest("node", "end.node").alias("b")).distinct()


def link(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """For each row of ``docs`` (key, doc_id, text): key, doc_id, n_shingles, node, comp; rows link by equal comp."""
    docs = docs.select("key", "doc_id", "text")
    got = saved(read(docs, width), "join-read")
    rows = got.filter("node is not null")
    listed = got.filter("token is not null").groupBy("token").agg(F.sum("times").alias("times")).filter(F.col("times") >= LISTED).orderBy(F.desc("times"), "token").limit(MAX_LISTED).toPandas().sort_values("token")
    nodes = saved(rows.filter("n > 0").groupBy("node").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "join-nodes")
    keyed = postings(docs, width, percent, listed["token"].to_numpy(np.int64), listed["times"].to_numpy(np.int64)).join(nodes.select("key", "node"), "key").dropDuplicates(["node"])
    index = saved(keyed.select("node", F.inline(F.arrays_zip(F.col("keys").alias("k"), F.col("marks").alias("w")))), "join-index")
    # the members whose scrambled hash is least and greatest. There are TURNS ways to scramble, one for each key, so that a
    # member meets others by other keys, yet a group with many keys in common has few pairs to try.
    turn = F.xxhash64(F.pmod("k", F.lit(TURNS)))
    turned = F.col("node").bitwiseXOR(turn)
    ends = index.groupBy("k").agg(F.count("*").alias("c"), F.max(F.col("w") % 2).alias("short"), F.min(turned).alias("x"), F.max(turned).alias("y")).filter("c > 1 AND short = 1")
    ends = ends.select("k", "c", F.col("x").bitwiseXOR(turn).alias("lo"), F.col("y").bitwiseXOR(turn).alias("hi"))
    met = saved(index.join(ends, "k"), "join-met")
    release(index)
    order = lambda x, y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    pairs = met.select(F.explode(F.array(order("lo", "node"), order("node", "hi"))).alias("p")).select("p.*").filter("a < b").distinct()
    first = verified(pairs, nodes, docs, width, percent)
    # a key of up to three members has met already
    apart = saved(still_apart(met.filter("c > 3").select("k", "w", "node"), first), "join-apart")
    release(met)
    tried = verified(across(apart), nodes, docs, width, percent)
    open_ = saved(still_apart(apart.drop("comp"), first.unionByName(tried)).join(nodes.select("node", "n"), "node"), "join-open")
    release(apart)
    x, y = open_.filter("w % 2 = 1").alias("x"), open_.alias("y")
    n = F.col("x.n") + F.col("y.n")
    room = F.shiftright(F.col("x.w").bitwiseAND(F.lit(2)), 1) + 1 + F.least(F.shiftright("x.w", 2), F.shiftright("y.w", 2))
    rising = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.node") != F.col("y.node")))
    fits = rising & (F.col("x.comp") != F.col("y.comp")) & (100 * F.col("x.n") >= percent * F.col("y.n")) & ((100 + percent) * room >= percent * n)
    more = x.join(y, (F.col("x.k") == F.col("y.k")) & fits).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    second = verified(more, nodes, docs, width, percent)
    release(open_)
    comp, stars = components(first.unionByName(tried).unionByName(second))
    out = rows.join(comp, "node", "left").select("key", "doc_id", F.col("n").alias("n_shingles"), "node", F.when(F.col("n") > 0, F.coalesce("comp", "node")).alias("comp"))
    out = saved(out, "join-linked")
    release(got, nodes, first, tried, second, stars)
    return out


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id that links reach, for each row of ``docs``."""
    linked = link(keyed(docs), width, percent)
    least = linked.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return linked.join(least, "comp", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest doc_id, all columns kept.
    Rows without words stay."""
    key = free_name("key", docs.columns)
    with_key = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    linked = link(keyed(docs), width, percent)
    first = linked.filter("comp is not null").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "key")).alias("f")).select(F.col("f.key").alias(key))
    bare = with_key.join(linked.filter("comp is null").select(F.col("key").alias(key)).distinct(), key, "left_semi")
    return with_key.join(first, key, "left_semi").dropDuplicates([key]).unionByName(bare).drop(key)


def op7_ngramjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
