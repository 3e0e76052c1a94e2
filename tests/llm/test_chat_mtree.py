import hashlib

import numpy as np
import pytest

from tidemark.llm import chat, mtree


def brute_chat(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append(((t is not None, t if t is not None else 0), r or "", x or ""))
    out = {}
    for c, turns in convs.items():
        turns = [(r, x) for _, r, x in sorted(turns)]
        said = "".join(f"{r}\n{x}\n" for r, x in turns)
        loss = "".join(x for r, x in turns if r == "assistant")
        size = sum(len(chat.segment(r, x)[0]) for r, x in turns)
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size)
    return out


def as_dict(rows):
    return {r["conv_id"]: tuple(r[k] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")) for r in rows}


def test_op9_on_the_smallest_table(spark, sf):
    rows = [tuple(r[k] for k in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    rows += [(-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)]
    assert as_dict(chat.op9_chat(spark, sf).collect()) == brute_chat(rows)


EDGE = [(1, 0, "user", "a\\b<|\n\\n"), (1, 1, "assistant", None), (2, 0, "user", "a\\b<|\n\\n"), (2, 1, "assistant", "x<"), (3, None, None, "q"), (3, 0, "a\nb\\", "<|im_end|>\n"), (None, 0, "user", "z" * 5000), (4, 0, "user", "same"), (4, 0, "user", "same")]


@pytest.mark.parametrize("max_chars", [1, 1 << 18])
def test_edge_conversations_come_back(spark, max_chars):
    df = spark.createDataFrame(EDGE, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as path", "2 as turns")
    assert as_dict(chat.read_back(chat.prefix_trees(df, max_chars)).collect()) == brute_chat(EDGE)
    assert chat.read_back(chat.prefix_trees(df.limit(0))).count() == 0


def test_shared_turns_are_emitted_once_with_ancestors(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"t{t}" if t < 2 else f"c{c}t{t}") for c in range(6) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    trees = chat.prefix_trees(df).collect()
    assert sum(t["stream"].count("t0<") for t in trees) <= len(trees)
    for t in trees:
        for n in t["nodes"]:
            assert n["position"] == sum(s["end"] - s["start"] for s in n["attends"])
            assert all(s["end"] <= n["start"] for s in n["attends"])


def test_repeated_conversations_close_their_tree(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"t{t}") for c in range(500) for t in range(4)] + [(1000 + c, 0, "user", f"x{c}") for c in range(5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    trees = chat.prefix_trees(df, max_ends=64)
    assert max(len(t["ends"]) for t in trees.collect()) == 64
    assert as_dict(chat.read_back(trees).collect()) == brute_chat(rows)


def test_masks_inside_spans():
    draw = np.random.default_rng(1)
    for _ in range(200):
        cuts = np.unique(draw.integers(0, 60, 12)).tolist()
        masks = list(zip(cuts[::2], cuts[1::2], strict=False))
        ends = np.unique(draw.integers(0, 60, 6)).tolist()
        spans = [(a, b) for a, b in zip(ends[::2], ends[1::2], strict=False)]
        spans = [(a, b) for a, b in spans if all(b <= x or a >= y or (a <= x and y <= b) for x, y in masks)]
        assert chat.parts_within(masks, spans) == [(x, y) for a, b in spans for x, y in masks if a <= x and y <= b]


def brute_top(vectors, k, every):
    ids = [i for i, _ in vectors]
    x = np.array([v for _, v in vectors])
    out = []
    for a, i in enumerate(ids):
        if i % every:
            continue
        scores = x @ x[a]
        best = sorted(((-int(s), j) for b, (s, j) in enumerate(zip(scores, ids, strict=True)) if b != a))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def test_op3_on_the_smallest_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    fine = [(r["vec_id"], np.floor(64 * np.array(r["embedding"], float)).astype(int)) for r in rows if r["embedding"] is not None and all(c is not None and np.isfinite(c) for c in r["embedding"])]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in mtree.op3_mtree(spark, sf).collect())
    assert got == brute_top(fine, 20, 20)


@pytest.mark.parametrize(("block", "pivots", "page", "held"), [(100, 7, 16, 32), (40, 2, 8, 1000), (5000, 1, 64, 7)])
def test_many_blocks_ties_and_copies(spark, monkeypatch, block, pivots, page, held):
    monkeypatch.setattr(mtree, "PAGE", page)
    monkeypatch.setattr(mtree, "QUERY_BLOCK", held)
    r = np.random.default_rng(0)
    base = r.integers(-9, 9, (900, 6))
    x = np.vstack([base, np.repeat(base[:1], 400, axis=0), base[:100]])
    vectors = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(vectors, "vec_id long, v array<bigint>")
    got = sorted((q["query_id"], q["rank"], q["vec_id"], q["score"]) for q in mtree.Index(df, block=block, max_pivots=pivots).top_k(df.filter("vec_id % 20 = 0"), 20).collect())
    assert got == brute_top(vectors, 20, 20)


def test_search_prunes_and_finds_all():
    """Small clusters far apart: pages and vectors are left out, results are those of brute force; so with huge components."""
    r = np.random.default_rng(3)
    for scale in (1, 1 << 22):
        x = np.vstack([r.integers(-3, 3, (300, 4)) + c for c in r.integers(-200, 200, (8, 4))]) * scale
        top, ids = float((x.astype(float) ** 2).sum(axis=1).max()) * (1 + 1e-9), np.arange(len(x))
        lift = mtree.lifted(x, top)
        got = mtree.search(mtree.build(lift, lift[0]), mtree.narrow(x), ids, lift[0], x[::20], ids[::20], top, 20, np.full(len(x[::20]), -np.inf))
        for i, q in enumerate(ids[::20]):
            want = sorted((-int(s), j) for j, s in enumerate((x.astype(object) @ x[q].astype(object)).tolist()) if j != q)[:20]
            mine = got.query == i
            assert sorted(zip((-got.score[mine]).tolist(), got.id[mine].tolist(), strict=True)) == want


def test_repeated_ids_and_few_rows(spark):
    rows = [(0, [1, 2]), (0, [1, 1]), (1, [3]), (1, [3]), (2, [0, -5])] + [(20, [9, 9])] * 300
    df = spark.createDataFrame(rows, "vec_id long, v array<bigint>")
    got = mtree.Index(df, block=50).top_k(df.filter("vec_id % 20 = 0"), 3).collect()
    assert sorted((r["query_id"], r["vec_id"], r["score"]) for r in got) == [(0, 20, 18)] * 3 + [(20, 0, 27), (20, 1, 27), (20, 1, 27)]


def test_bad_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.5]), (20, None), (1, [float("nan"), 1.0]), (2, [None, 1.0]), (3, [float("inf"), 1.0]), (4, [-0.01, 0.0])]
    v = mtree.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as v"))
    assert sorted((r["vec_id"], list(r["v"])) for r in v.collect()) == [(0, [64, 32]), (4, [-1, 0])]
    assert [tuple(r) for r in mtree.Index(v).top_k(v, 20).collect() if r["query_id"] == 0] == [(0, 1, 4, -64)]
    assert mtree.Index(v.limit(0)).top_k(v.limit(0), 3).count() == 0
