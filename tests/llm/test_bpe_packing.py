import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)
ENC = bpe.Encoder(PATH, bpe.classes())
TRICKY = ["", "  ", "Hello  WORLD's 123 é", "x<|endoftext|>y <|startoftext|><|endoftext|>", "<|endoftext|", "a" * 5000, "the" * 300, "aaa aaaa", "ΣΑΣ İ", "é x\x1fy,\x1f|\xa0z\x85", "漢字🙂３", "\x00"]
ROWS = [(1, "ab cd", "en"), (1, "ab cd", "en"), (2, None, None), (None, "zz", "de"), (3, "", "en"), (4, "word " * 9000, "fr")]


def library(text):
    ids = LIB.encode(text, add_special_tokens=False).ids
    return ids, LIB.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", TRICKY)
def test_tricky_texts_encode_as_the_library(text):
    ids, decoded = ENC.encode_decode([text.encode()])[0]
    assert (np.frombuffer(ids, "<u4").tolist(), decoded.decode()) == library(text)


def test_every_code_point_encodes_as_the_library():
    """By itself among letters and digits; beyond plane 3 every 97th."""
    codes = [*range(1, 0xD800), *range(0xE000, 0x40000), *range(0x40000, 0x110000, 97)]
    for start in range(0, len(codes), 20_000):
        chunks = [f"a{chr(c)}B1{chr(c)}\u0301" for c in codes[start : start + 20_000]]
        got = ENC.encode_decode([c.encode() for c in chunks])
        for c, (ids, _), want in zip(chunks, got, LIB.encode_batch(chunks, add_special_tokens=False), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == want.ids, ascii(c)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list("aaabbcdeéÉßΣσ'sStTreE 12３.,!<|>\n\t́漢🙂İ")), max_size=60))
def test_fuzzed_texts_encode_as_the_library(text):
    ids, decoded = ENC.encode_decode([text.encode()])[0]
    assert (np.frombuffer(ids, "<u4").tolist(), decoded.decode()) == library(text)


def test_op6_on_the_smallest_table(spark, sf):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = bpe.op6_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids, decoded = library(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_encode_edge_rows_and_clashing_columns(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, ids string")
    got = bpe.encode(df, PATH).collect()
    assert len(got) == len(ROWS) and sorted(len(r["ids"]) for r in got)[:2] == [0, 0]
    assert bpe.digests(df.limit(0), PATH).count() == 0


def brute_first_fit(sizes, capacity):
    room, out = [], []
    for s in sizes:
        at = next((i for i, r in enumerate(room) if r >= s), len(room))
        if at == len(room):
            room.append(capacity)
        room[at] -= s
        out.append(at)
    return out


def test_tournament_tree_is_first_fit():
    r = random.Random(5)
    for _ in range(50):
        sizes = [r.randint(1, 100) for _ in range(r.randint(1, 80))]
        assert packing.first_fit(sizes, 100) == brute_first_fit(sizes, 100)


def check_packing(texts, rows, length=4096):
    """texts: list of (doc_id, text); every id once, gapless sequences."""
    seen = {}
    for r in rows:
        seen.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    want = {}
    for d, t in texts:
        ids = [*library(t or "")[0], 2]
        want.setdefault((d, len(ids)), []).append(ids)
    assert seen.keys() == want.keys()
    for k, pieces in seen.items():
        assert sum(p["length"] for p in pieces) == k[1] * len(want[k])
        crcs = {zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) for p in pieces for ids in want[k]}
        assert {p["ids_crc32"] for p in pieces} <= crcs
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= length
    return by


def test_op1_on_the_smallest_table(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = packing.op1_packing(spark, sf).collect()
    by = check_packing(docs, rows)
    used = sum(r["length"] for r in rows)
    assert used / (4096 * len(by)) > 0.95


def test_pack_edge_rows(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, salt string")
    check_packing([(d, t) for d, t, _ in ROWS], packing.pack_documents(df, PATH, group_docs=2).collect())
    assert packing.pack_documents(df.limit(0), PATH).count() == 0
