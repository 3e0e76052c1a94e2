"""Operator 3: exact top-k inner products by best-first search in M-trees.

Vectors are integers. One more component, sqrt(M - |x|^2) with M no less than any squared norm (0 for a query), makes the
inner product a distance: d^2 = |q|^2 + M - 2 q.x, so the nearest are the highest-scoring. The tree's top is distributed:
sampled pivots (at most ``MAX_PIVOTS``, so they fit any driver), around each up to ``RINGS`` rings of equal counts with
their least and greatest distance to the pivot, and in a ring blocks of about ``BLOCK`` vectors. A block is an M-tree of
pages with routing objects, covering radii and distances to the parent, kept as one row of an index table.

Queries are packed, ``QUERY_BLOCK`` to a row, those of one or of neighbouring pivots together. Each first searches the block
of its own ring at its nearest pivot; the k-th score there prunes pivots, rings, pages and vectors. A row is made for each
pair of a query row and a block that one of its queries may need, never for each query. Within a block all queries search
together: in each round every query takes the page whose lower bound is least, and a page is read once for the queries that
took it. Stored parent distances and radii decide first, by the triangle inequality, what needs no computing. Bounds are
never strict, so ties are found. Where nothing can be pruned, as with many dimensions, what is left is one matrix product for
each pair of a page and its queries.

Cases: vectors that are null or hold a null or a non-finite component take no part, nor do rows without vec_id; shorter
vectors count as padded with zeros; ties go to the smaller vec_id; with fewer than k others, all; rows that repeat a vec_id
are candidates each, though never for a query of that vec_id, and ask once, with the least of their vectors; components end
at 64 bits and scores wrap there; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.common import map_arrow, release, saved, table

MAX_PIVOTS = 256
RINGS = 64
BLOCK = 2048
PAGE = 128
FAN = 16
QUERY_BLOCK = 2048
#: Up to this squared norm doubles hold every score exactly; beyond, scores are 64-bit integers.
EXACT = 2.0**52


def matrix(rows: pa.Array | pd.Series, width: int) -> np.ndarray:
    """Integer vectors as the narrowest integers that hold them."""
    lists = rows.to_pylist() if isinstance(rows, pa.Array) else list(rows)
    out = np.zeros((len(lists), width), np.int64)
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return narrow(out)


def narrow(x: np.ndarray) -> np.ndarray:
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Vectors with the component that gives them all the squared norm ``top``."""
    x = x.astype(float)
    return np.hstack([x, np.sqrt(np.maximum(top - (x * x).sum(axis=1, keepdims=True), 0))])


def asking(q: np.ndarray) -> np.ndarray:
    """Queries as points among lifted vectors."""
    return np.hstack([q.astype(float), np.zeros((len(q), 1))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T), 0))


def slack(top: float) -> float:
    """What rounding may add to or take from a distance, with much to spare."""
    return 1e-6 * math.sqrt(2 * top + 1)


def build(x: np.ndarray, center: np.ndarray) -> list[tuple]:
    """Pages of an M-tree over lifted vectors. A page is (is_leaf, entries, distances to the page's routing object,
    covering radii, children): entries are rows of x, in a leaf the objects and else routing objects."""
    pages: list[tuple] = []

    def make(rows: np.ndarray, above: np.ndarray) -> int:
        at = len(pages)
        pages.append(())
        if len(rows) <= PAGE:
            pages[at] = (True, rows, distances(x[rows], above[None])[:, 0], None, None)
            return at
        fan = min(FAN, -(-len(rows) // PAGE) + 1)
        routing = rows[np.linspace(0, len(rows) - 1, fan).astype(int)]
        near = distances(x[rows], x[routing]).argmin(axis=1)
        if np.bincount(near, minlength=fan).max() > 0.9 * len(rows):
            near = np.arange(len(rows)) * fan // len(rows)  # equal or nearly equal vectors: deal them out
        used = [k for k in range(fan) if (near == k).any()]
        radii = [float(distances(x[rows[near == k]], x[routing[k]][None]).max()) for k in used]
        children = [make(rows[near == k], x[routing[k]]) for k in used]
        pages[at] = (False, routing[used], distances(x[routing[used]], above[None])[:, 0], np.array(radii), children)
        return at

    make(np.arange(len(x)), center)
    return pages


class Best:
    """The k best (score, id) of each query so far, and the score that a further one must reach."""

    def __init__(self, least: np.ndarray, k: int):
        self.k, self.least = k, least.copy()
        self.query, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        query, score, ids = np.r_[self.query, query], np.r_[self.score, score], np.r_[self.id, ids]
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        full = place == self.k - 1
        self.least[query[full]] = np.maximum(self.least[query[full]], score[full])
        keep = (place < self.k) & (score >= self.least[query])
        self.query, self.score, self.id = query[keep], score[keep], ids[keep]


def search(pages: list[tuple], x: np.ndarray, ids: np.ndarray, center: np.ndarray, q: np.ndarray, own: np.ndarray, top: float, k: int, least: np.ndarray) -> Best:
    """What of a block may be among the k best of each query. ``own``: the queries' ids, ``least``: scores known to be
    reached k times (-inf: none)."""
    best, eps = Best(least, k), slack(top)
    exact = top < EXACT
    plain = x.astype(float) if exact else x.astype(np.int64)
    asked = q.astype(plain.dtype)
    lift, points = lifted(x, top), asking(q)
    norm = (points * points).sum(axis=1) + top

    def bound(some: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.sqrt(np.maximum(norm[some] - 2 * best.least[some], 0)) + eps

    everyone = np.arange(len(q))
    start = distances(points, center[None])[:, 0]
    # open pages: query, lower bound, page, the query's distance to the page's routing object
    opened = [everyone, np.zeros(len(q)), np.zeros(len(q), np.int64), start]
    while len(opened[0]):
        live = opened[1] <= bound(opened[0])
        opened = [c[live] for c in opened]
        order = np.lexsort((opened[2], opened[1], opened[0]))
        query = opened[0][order]
        first = np.r_[True, query[1:] != query[:-1]] if len(query) else np.zeros(0, bool)
        taken, rest = [c[order[first]] for c in opened], [c[order[~first]] for c in opened]
        by_page = np.argsort(taken[2], kind="stable")
        cuts = np.flatnonzero(np.diff(taken[2][by_page])) + 1
        more, found = [rest], []
        for group in np.split(by_page, cuts):
            if not len(group):
                continue
            some, far = taken[0][group], taken[3][group]
            leaf, rows, stored, radii, children = pages[taken[2][group[0]]]
            reach = bound(some)[:, None]
            gap = np.abs(far[:, None] - stored)
            if leaf:
                near = (gap <= reach).any(axis=0)
                rows = rows[near]
                score = asked[some] @ plain[rows].T
                hits = (score >= best.least[some][:, None]) & (ids[rows] != own[some][:, None])
                at, obj = np.nonzero(hits)
                found.append((some[at], score[at, obj].astype(np.int64), ids[rows[obj]]))
                continue
            wanted = gap - radii <= reach
            use = wanted.any(axis=0)
            d = distances(points[some], lift[rows[use]])
            low = np.maximum(0, d - radii[use])
            at, obj = np.nonzero(wanted[:, use] & (low <= reach))
            more.append([some[at], low[at, obj], np.array(children)[use][obj], d[at, obj]])
        if found:
            best.add(*(np.concatenate(c) for c in zip(*found, strict=True)))
        opened = [np.concatenate(c) for c in zip(*more, strict=True)]
    return best


def home_of(d: np.ndarray, rings: dict[int, tuple], edges: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot (less its covering radius) and ring there of queries at the distances ``d`` from the pivots."""
    radii = np.full(d.shape[1], -math.inf)
    for r, (_, high, _) in rings.items():
        radii[r // RINGS] = max(radii[r // RINGS], high)
    pivot = (d - radii).argmin(axis=1)
    ring = np.array([p * RINGS + np.searchsorted(edges[p], a) for p, a in zip(pivot.tolist(), d[np.arange(len(d)), pivot].tolist(), strict=True)], np.int64)
    known = np.array(sorted(rings))
    at = np.searchsorted(known, ring)  # an empty ring's queries go to the pivot's next or last one
    at[at == len(known)] -= 1
    at[known[at] // RINGS != pivot] -= 1
    return pivot, known[at]


FOUND = "query_id bigint, vec_id bigint, score bigint"


class Index:
    """Pivots and rings (on the driver, bounded) and the table of blocks."""

    def __init__(self, vectors: DataFrame, block: int = BLOCK, max_pivots: int = MAX_PIVOTS):
        """vectors: vec_id bigint, v array<bigint>."""
        squares = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
        size = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max(squares).alias("top")).first()
        self.n, self.width, self.top = size["n"], size["width"] or 0, float(size["top"] or 0) * (1 + 1e-9)
        if not self.n:
            return
        count = min(max_pivots, max(1, math.ceil(self.n / block)))
        chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(count).collect()
        self.pivots = lifted(matrix(pd.Series([r["v"] for r in chosen]), self.width), self.top)
        pivots, width, top = self.pivots, self.width, self.top

        def nearest(batch: pa.RecordBatch) -> pa.RecordBatch:
            d = distances(lifted(matrix(batch.column("v"), width), top), pivots)
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.argmin(axis=1), pa.int64()), pa.array(d.min(axis=1))], ["vec_id", "v", "salt", "pivot", "away"])

        # the salt also deals out rows that repeat one vec_id; written, so a task that runs again sees the same
        salted = vectors.select("vec_id", "v", F.xxhash64("vec_id", F.monotonically_increasing_id()).alias("salt"))
        dealt = saved(map_arrow(salted, nearest, "vec_id bigint, v array<bigint>, salt bigint, pivot bigint, away double", rows=4096), "mtree-dealt")
        shares = F.array(*(F.lit(i / RINGS) for i in range(1, RINGS)))
        edges = {r["pivot"]: (r["n"], r["e"]) for r in dealt.groupBy("pivot").agg(F.count("*").alias("n"), F.percentile_approx("away", shares, F.lit(1000)).alias("e")).collect()}
        self.edges = {p: np.array(e)[RINGS // rings - 1 :: RINGS // rings][: rings - 1] for p, (n, e) in edges.items() for rings in [min(RINGS, 1 << max(0, math.ceil(math.log2(max(1, n / block)))))]}
        own_edges = self.edges

        def ring(batch: pa.RecordBatch) -> pa.RecordBatch:
            pivot, away = batch.column("pivot").to_numpy(), batch.column("away").to_numpy()
            out = np.zeros(len(pivot), np.int64)
            for p in np.unique(pivot):
                out[pivot == p] = np.searchsorted(own_edges[p], away[pivot == p])
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot * RINGS + out)], [*batch.schema.names, "ring"])

        placed = map_arrow(dealt, ring, "vec_id bigint, v array<bigint>, salt bigint, pivot bigint, away double, ring bigint", rows=4096)
        # at most MAX_PIVOTS * RINGS rows
        self.rings = {r["ring"]: (r["lo"], r["hi"], math.ceil(r["n"] / block)) for r in placed.groupBy("ring").agg(F.count("*").alias("n"), F.min("away").alias("lo"), F.max("away").alias("hi")).collect()}
        parts = dealt.sparkSession.createDataFrame([(r, n) for r, (_, _, n) in self.rings.items()], "ring bigint, parts bigint")

        def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("vec_id", kind="stable")
            x = matrix(rows["v"], width)
            page = pickle.dumps((build(lifted(x, top), pivots[int(key[0]) // RINGS]), x, rows["vec_id"].to_numpy()))
            return pd.DataFrame({"ring": [key[0]], "part": [key[1]], "tree": [page]})

        placed = placed.join(F.broadcast(parts), "ring").select("vec_id", "v", "ring", F.pmod("salt", "parts").alias("part"))
        self.blocks = saved(placed.groupBy("ring", "part").applyInPandas(grow, "ring bigint, part bigint, tree binary"), "mtree-blocks")
        release(dealt)

    def pack(self, queries: DataFrame) -> DataFrame:
        """Queries (query_id, v) as rows of many: qblock, held (pickled ids, vectors, home rings and parts)."""
        width, pivots, edges, rings = self.width, self.pivots, self.edges, self.rings

        def place(batch: pa.RecordBatch) -> pa.RecordBatch:
            pivot, ring = home_of(distances(asking(matrix(batch.column("v"), width)), pivots), rings, edges)
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot, pa.int64()), pa.array(ring, pa.int64())], ["query_id", "v", "salt", "pivot", "ring"])

        salted = queries.select("query_id", "v", F.xxhash64("query_id", F.lit("chunk")).alias("salt"))
        asked = saved(map_arrow(salted, place, "query_id bigint, v array<bigint>, salt bigint, pivot bigint, ring bigint", rows=4096), "mtree-asked")
        counts = {r["pivot"]: r["count"] for r in asked.groupBy("pivot").count().collect()}
        # neighbouring pivots share a query row, a pivot with more queries than a row holds has several
        left, at, row, room, base = set(counts), min(counts, default=0), -1, 0, {}
        apart = distances(pivots, pivots)
        while left:
            at = min(left, key=lambda p: (apart[at, p], p))
            left.discard(at)
            chunks = math.ceil(counts[at] / QUERY_BLOCK)
            if counts[at] > room:
                row, room = row + 1, QUERY_BLOCK * chunks
            base[at] = (row, chunks)
            room -= counts[at]
            if chunks > 1:
                row, room = row + chunks - 1, 0
        where = asked.sparkSession.createDataFrame([(p, b, c) for p, (b, c) in base.items()], "pivot bigint, base bigint, chunks bigint")

        def hold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("query_id")
            n = np.array([rings[r][2] for r in rows["ring"]])
            held = (rows["query_id"].to_numpy(), matrix(rows["v"], width), rows["ring"].to_numpy(), rows["salt"].to_numpy() % n)
            return pd.DataFrame({"qblock": [key[0]], "held": [pickle.dumps(held)]})

        rows = asked.join(F.broadcast(where), "pivot").withColumn("qblock", F.col("base") + F.pmod("salt", "chunks"))
        out = saved(rows.groupBy("qblock").applyInPandas(hold, "qblock bigint, held binary"), "mtree-queries")
        release(asked)
        return out

    def visit(self, visits: DataFrame, queries: DataFrame, k: int, home: bool) -> DataFrame:
        """Search of blocks. visits: qblock, ring, part; queries: qblock, held and, unless ``home``, least (pickled)."""
        top, pivots = self.top, self.pivots

        def run(key: tuple, tree: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            if tree.empty or rows.empty:
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
            pages, x, ids = pickle.loads(tree["tree"].iloc[0])
            own, q, ring, part = pickle.loads(rows["held"].iloc[0])
            here = (ring == key[1]) & (part == key[2])
            some = np.flatnonzero(here if home else ~here)
            least = np.full(len(some), -math.inf) if home else pickle.loads(rows["least"].iloc[0])[some]
            best = search(pages, x, ids, pivots[int(key[1]) // RINGS], q[some], own[some], top, k, least)
            return pd.DataFrame({"query_id": own[some][best.query], "vec_id": best.id, "score": best.score}).astype("int64")

        keys = ["qblock", "ring", "part"]
        trees = visits.join(self.blocks, ["ring", "part"])
        mine = [f"to_{c}" for c in keys]
        rows = visits.select(*(F.col(c).alias(m) for c, m in zip(keys, mine, strict=True))).join(queries.withColumnRenamed("qblock", "to_qblock"), "to_qblock")
        return trees.groupBy(*keys).cogroup(rows.groupBy(*mine)).applyInPandas(run, FOUND)

    def top_k(self, queries: DataFrame, k: int) -> DataFrame:
        """queries: vec_id, v. Returns query_id, rank, vec_id, score."""
        spark = queries.sparkSession
        if not self.n:
            return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
        pivots, rings, top = self.pivots, self.rings, self.top
        packed = self.pack(queries.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v")))

        def homes(batch: pa.RecordBatch) -> pa.Table:
            rows = [(b, r, p) for b, held in zip(batch.column("qblock").to_pylist(), batch.column("held").to_pylist(), strict=True) for r, p in sorted(set(zip(*(c.tolist() for c in pickle.loads(held)[2:]), strict=True)))]
            return pa.table([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["qblock", "ring", "part"])

        def others(batch: pa.RecordBatch) -> pa.Table:
            names, lo, hi, parts = np.array([(r, *v) for r, v in sorted(rings.items())]).T
            rows = []
            for b, held, reached in zip(batch.column("qblock").to_pylist(), batch.column("held").to_pylist(), batch.column("least").to_pylist(), strict=True):
                _, q, ring, part = pickle.loads(held)
                points, least = asking(q), pickle.loads(reached)
                d = distances(points, pivots)[:, names.astype(int) // RINGS]
                reach = np.sqrt(np.maximum((points * points).sum(axis=1) + top - 2 * least, 0)) + slack(top)
                open_ = np.maximum(d - hi, lo - d) <= reach[:, None]
                for n, r in enumerate(names.astype(int).tolist()):
                    asks = open_[:, n]
                    mine = asks & (ring == r)
                    # a query has seen its home part already
                    rows += [(b, r, p) for p in range(int(parts[n])) if (asks & ~(mine & (part == p))).any()]
            return pa.table([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["qblock", "ring", "part"])

        def bounds(key: tuple, rows: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
            if rows.empty:
                return pd.DataFrame({"qblock": [], "held": [], "least": []})
            ids = pickle.loads(rows["held"].iloc[0])[0]
            least = seen.set_index("query_id")["least"].reindex(ids).fillna(-math.inf).to_numpy(float)
            return rows.assign(least=[pickle.dumps(least)])

        pair = "qblock bigint, ring bigint, part bigint"
        first = saved(map_arrow(packed, homes, pair, rows=4), "mtree-homes")
        seen = saved(self.visit(first, packed, k, True), "mtree-first")
        rest = saved(self.bounded(packed, seen, k, bounds), "mtree-bounded")
        visits = saved(map_arrow(rest, others, pair, rows=4), "mtree-visits")
        found = seen.unionByName(self.visit(visits, rest, k, False))
        ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
        out = saved(ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "mtree-top")
        release(packed, first, seen, rest, visits)
        return out

    def bounded(self, packed: DataFrame, seen: DataFrame, k: int, fn) -> DataFrame:  # noqa: ANN001
        """``packed`` with the k-th score that each query's home block gave it."""
        ids = lambda b: pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(got := [pickle.loads(h)[0] for h in b.column("held").to_pylist()]), pa.int64()), pa.array(np.repeat(b.column("qblock").to_numpy(), [len(g) for g in got]), pa.int64())], ["query_id", "qblock"]
        )
        least = seen.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
        by_row = map_arrow(packed, ids, "query_id bigint, qblock bigint", rows=4).join(least, "query_id")
        return packed.groupBy("qblock").cogroup(by_row.withColumnRenamed("qblock", "to_qblock").groupBy("to_qblock")).applyInPandas(fn, "qblock bigint, held binary, least binary")


def integer_vectors(df: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and v: floor(scale * component); rows that are null or hold null or non-finite components go."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return df.filter(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).filter(fine).select("vec_id", F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def op3_mtree(spark: SparkSession, sf_dir: str, k: int = 20, every: int = 20) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    index = Index(vectors)
    out = index.top_k(vectors.filter(F.col("vec_id") % every == 0), k)
    if index.n:
        release(index.blocks)
    return out
