"""Runs, filter audit and PU learning against brute force, SQL and held-out labels."""

import collections
import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest

from tidemark.llm import audit, pulearn, runs
from tidemark.llm.queries import ORACLE_SQL, QUERIES

EDGE = [(1, None, None), (2, "", "en"), (3, "a b", "en"), (3, "a b", "en"), (None, "a b", None), (None, "x\x00\x01y", "en"), (4, "word " * 20_000, "de"), (5, "\n\n \t", ""), (-7, "a b", "de"), (6, "Ä# Ä é😀", "fr")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, "doc_id long, text string, lang string").selectExpr("*", "'clash' as part", "1 as rep", "2 as n", "3 as score", "4 as `a.b`", "5 as start")


def brute_runs(w, least=runs.LEAST, times=runs.TIMES):
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            s, size = i - q, j - i + q
            if size >= max(least, times * q) and not any(w[s + p : j] == w[s : j - p] for p in range(1, q)):
                out.append((s, size, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = [x for x in text.encode().split()]
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = sorted(found, key=lambda r: (-r[1], r[0], r[2]))[:1]
    start, length, period = best[0] if best else (None, None, None)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    listed = "".join(f"{s},{size},{q}\n" for s, size, q in found)
    return (doc_id, len(found), start, length, period, best and 1000 * length // period or None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_find_runs():
    r = random.Random(1)
    for _ in range(4000):
        n, letters = r.randrange(70), r.choice([1, 2, 2, 3, 5])
        w = [str(r.randrange(letters)) for _ in range(n)]
        if n and r.random() < 0.6:
            p = r.randrange(1, 12)
            w = w[: r.randrange(n)] + (w[:p] * r.randrange(3, 8))[: r.randrange(1, 60)] + w[-r.randrange(1, 5) :]
            for _ in range(2):
                if r.random() < 0.4:
                    w = w * r.randrange(3, 6)
            w = w[:300]
        assert runs.find_runs(w) == brute_runs(w), w
        least, times = r.choice([(1, 3), (20, 3), (9, 5), (2, 4), (30, 4)])
        assert runs.find_runs(w, least, times) == brute_runs(w, least, times), (w, least, times)
    with pytest.raises(ValueError):
        runs.find_runs(["a"] * 10, 2, 2)


def test_runs_of_very_long_texts():
    n = 300_000
    assert runs.find_runs([b"a"] * n) == [(0, n, 1)]
    r = random.Random(2)
    block = [b"%d" % r.randrange(500) for _ in range(n // 6)]
    assert (0, n, n // 6) in runs.find_runs(block * 6)
    nested = ([b"a"] * 8 + [b"b"]) * 10
    assert runs.find_runs(nested) == brute_runs(nested)


def test_op12(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    short = {r["doc_id"]: brute_row(r["doc_id"], r["text"] or "") for r in docs if len(r["text"] or "") < 8000}
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op12_runs"](spark, sf).collect()}
    assert len(got) == len(docs) and {d: got[d] for d in short} == short
    assert sum(r[1] > 0 for r in short.values()) > 10


def test_runs_edges(spark, edge):
    got = sorted(map(tuple, runs.repeated_runs(edge, plant=True).collect()), key=repr)
    assert got == sorted((brute_row(d, t or "") if len(t or "") < 1000 else (d, 1, 0, 20_000, 1, 20_000_000, hashlib.sha256(b"0,20000,1\n").hexdigest(), hashlib.sha256(b"word").hexdigest()) for d, t, _ in EDGE), key=repr)
    assert runs.repeated_runs(edge.limit(0)).count() == 0
    df = spark.createDataFrame([(1, "x y y y y y y y z", 9), (2, None, 8), (3, " a  b ", 7)], "id long, text string, `a.b` int")
    assert [tuple(r) for r in runs.without_repetitions(df).orderBy("id").collect()] == [(1, "x y z", 9), (2, None, 8), (3, " a  b ", 7)]


def brute_audit(docs, labels):
    """Counts by (part, order, step) in plain Python."""
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, t in labels if t == 1} - {None}
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    rows = []
    for d, t, lang in docs:
        t = t or ""
        w = t.encode().split()
        up = sum("A" <= c <= "Z" for c in t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * up > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": d is not None and d > least[t]}
        rows.append((lang or "", {k for k, v in fails.items() if v}, d in good, d in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        worth = collections.Counter(f for order in itertools.permutations("ABCDE") for _, x, _, _ in mine if x for f in [next(f for f in order if f in x)])
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                alive = [r for r in mine if not r[1] & before]
                gone = [r for r in alive if f in r[1]]
                out[part, "".join(order), k + 1] = (len(alive) - len(gone), len(gone), sum(f in r[1] and bool(r[1] & before) for r in mine), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone), worth[f])
    return out


COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def by_step(rows, key="part"):
    out = {(r[key], r["filter_order"], r["step"]): tuple(r[c] for c in COUNTS) for r in rows}
    assert len(out) == len(rows)
    return out


def test_op13(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(ORACLE_SQL["op13_audit"]).df().to_dict("records")
    docs, labels = ([tuple(r[c] for c in cols) for r in spark.read.parquet(f"{sf}/{t}.parquet").collect()] for t, cols in (("documents", ("doc_id", "text", "lang")), ("labels", ("doc_id", "quality", "toxic"))))
    got = by_step(QUERIES["op13_audit"](spark, sf).collect())
    assert got == by_step(want) == brute_audit(docs, labels)


def test_audit_edges(spark, edge, monkeypatch):
    docs = EDGE + [(k, "p" * 3000 + "q" * (k % 7) + "r" * 20, "en") for k in range(10, 200)] + [(k, "same", "de") for k in range(300, 900)]
    labels = [(3, 1, 0), (3, 0, 1), (None, 1, 1), (15, 1, None), (400, None, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(7).selectExpr("doc_id", "text", "coalesce(lang, '') as part", "1 as rep", "2 as later")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 as n", "2 as part")
    monkeypatch.setattr(audit, "BLOCK", 20_000)
    assert by_step(audit.audit(df, marks).collect()) == brute_audit(docs, labels)
    assert audit.audit(df.limit(0), marks).count() == 0
    assert audit.audit(edge, marks.limit(0)).count() == 600


def test_cells_part_long_equal_beginnings(spark):
    texts = [(k, b"x" * 5000 + b"%04d" % k + b"y" * 100) for k in range(400)]
    df = spark.createDataFrame([(k, t, audit.path_of(t), len(t)) for k, t in texts], "rep long, text binary, path array<long>, size long")
    cells = audit.cells(df, 50_000).groupBy("cell").sum("size").collect()
    assert len(cells) == 400
    assert audit.cells(df, 1e9).select("cell").distinct().count() == 1
    order = [audit.path_of(t)[0] for t in sorted([b"", b"a", b"ab", b"\xff\xff", b"zzzzzzzzzzz", b"b\x00"])]
    assert order == sorted(order)


def test_trie():
    r = random.Random(4)
    trie, least = audit.Trie(), {}
    texts = [bytes(r.choice(b"ab\x00") for _ in range(r.randrange(9))) for _ in range(3000)] + [b"", b"a" * 10_000, b"a" * 10_000 + b"b", b"a" * 9_999]
    nodes = []
    for k, t in enumerate(texts):
        d = None if k % 50 == 7 else r.randrange(1000)
        nodes.append(trie.insert(t, d))
        least[t] = min((x for x in (least.get(t), d) if x is not None), default=None)
    assert [trie.least[n] for n in nodes] == [least[t] for t in texts]
    assert len(set(nodes)) == len(set(texts))


def test_op11(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in QUERIES["op11_pulearn"](spark, sf).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for d, r in got.items())
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    good, bad = (np.array([got[d]["score"] for d, q in labels if q == k]) for k in (1, 0))
    assert (good[:, None] > bad[None, :]).mean() > 0.95
    assert (good >= 0.3).mean() > 0.97 and (bad < 0.3).mean() > 0.7


def test_non_negative_risk():
    """The slopes are those of the risk by differences, and of minus its second term where that is negative."""
    r = np.random.default_rng(0)
    for shift in (-1.0, 4.0):
        p, u = r.normal(shift, 1, 7), r.normal(-shift, 1, 9)
        value, d_p, d_u = pulearn.risk(p, u, 0.9)
        rest = lambda p, u: pulearn.softplus(u).mean() - 0.9 * pulearn.softplus(p).mean()
        negative = rest(p, u) < 0
        assert negative == (shift > 0) and (value >= 0)
        f = (lambda p, u: -rest(p, u)) if negative else (lambda p, u: pulearn.risk(p, u, 0.9)[0])
        for k in range(7):
            step = np.eye(7)[k] * 1e-6
            assert abs((f(p + step, u) - f(p - step, u)) / 2e-6 - d_p[k]) < 1e-6
        for k in range(9):
            step = np.eye(9)[k] * 1e-6
            assert abs((f(p, u + step) - f(p, u - step)) / 2e-6 - d_u[k]) < 1e-6


def test_prior_is_found():
    r = np.random.default_rng(1)
    for share in (0.3, 0.8):
        p = r.normal(0, 1, (2000, pulearn.WIDTH)).astype(np.float32)
        u = r.normal(0, 1, (3000, pulearn.WIDTH)).astype(np.float32)
        u[: int(3000 * (1 - share)), :20] += 2
        assert abs(pulearn.estimated_prior(p, r.permutation(u)) - share) < 0.08


def test_pu_edges(spark, edge):
    nets, prior = pulearn.train(edge, edge.selectExpr("doc_id", "1 as quality"), pulearn.F.lit(False), steps=5, networks=2)
    rows = pulearn.scored(edge, nets, keep=("doc_id", "a.b")).collect()
    assert len(nets) == 2 and len(rows) == len(EDGE) and {r["a.b"] for r in rows} == {4}
    by_text = collections.defaultdict(set)
    for r, (_, t, _) in zip(rows, EDGE, strict=True):
        by_text[t or ""].add(r["score"])
    assert all(len(s) == 1 for s in by_text.values())
    assert pulearn.train(edge.limit(0), edge.selectExpr("doc_id", "1 as quality"), pulearn.F.lit(False))[0] == []
    assert {r["score"] for r in pulearn.scored(edge, []).collect()} == {0.5}
    assert pulearn.scored(edge.limit(0), nets).count() == 0
    parts = pulearn.features(b"ab c\n" * 1000, part=64)[:-pulearn.STATISTICS]
    assert np.allclose(parts, pulearn.features(b"ab c\n" * 1000)[: -pulearn.STATISTICS], atol=1e-3)
