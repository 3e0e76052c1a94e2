"""Operator 6: BPE encoding and decoding in batched numpy merge rounds.

Texts are cut at ASCII white space; the tokenizer never joins symbols across it, so equal chunks have equal ids and a
bounded cache in each Python worker holds them. The chunks that a batch has and the cache has not are encoded together:
the symbols of all their words lie in one flat array, each round looks up every neighbouring pair in the sorted pair keys
by binary search, and every word applies its lowest-ranked pair. Normal form, lower case and the classes of characters are
the tokenizers library's, as its tables are of another Unicode version than Python's; splitting and merging are done here.

Cases: null and empty texts have no ids and decode to an empty text; repeated rows give repeated results; the strings of
the special tokens inside a text are those tokens, as in the library; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Regex, normalizers, pre_tokenizers

from tidemark.llm.common import KEPT, as_bytes, map_arrow, table

#: Entries of a worker's chunk cache, and bytes of chunks in it, before it starts anew.
CACHE_CHUNKS, CACHE_BYTES = 600_000, 1 << 25
NO_RANK = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in kept}
    for n, b in enumerate(b for b in range(256) if b not in names):
        names[b] = chr(256 + n)
    return [names[b] for b in range(256)]


@lru_cache(1)
def classes() -> tuple[str, str, str]:
    """Character classes of letters, numbers and white space, as ranges: those of the tokenizers library's own regular
    expressions, whose Unicode version is not Python's. Found on the driver by splitting a text of all code points that are or
    may become letters (planes 4 to 13 have none, planes 15 and 16 are private); workers get the ranges."""
    text = "".join(chr(c) for c in [*range(0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xE1000)])
    split = lambda pattern, how, t: pre_tokenizers.Split(Regex(pattern), how).pre_tokenize_str(t)
    out = {r"\p{L}": [], r"\p{N}": [], r"\s": []}
    for piece, _ in split(r"\p{L}+|\p{N}+|\s+", "isolated", text):
        for kind, ranges in out.items():
            if not split(kind, "removed", piece[0]):
                codes = np.array([ord(c) for c in piece])
                cut = np.flatnonzero(np.diff(codes) != 1)
                ranges += [f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(codes[np.r_[0, cut + 1]], codes[np.r_[cut, -1]], strict=True)]
    return tuple("".join(r) for r in out.values())


class Encoder:
    """A byte-level BPE with word ends, read from a tokenizers file."""

    ASCII_WORD = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+|\n")

    NORMAL = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])

    def __init__(self, path: str, kinds: tuple[str, str, str], named: bool = True):
        """kinds: output of ``classes``; named: keep the tokens' strings too, for decoding."""
        self.named, self.held = named, 0
        letters, numbers, spaces = kinds
        self.word = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+|\n")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], dict(spec["model"]["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.is_special = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        self.special_bytes = [s.encode() for s in self.special]
        end, names = model["end_of_word_suffix"], byte_symbols()
        self.first = np.array([vocab[c] for c in names], np.int64)
        self.last = np.array([vocab[c + end] for c in names], np.int64)
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        left, right, made = [], [], []
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left.append(vocab[a]), right.append(vocab[b]), made.append(vocab[a + b])
        left, right, made = (np.array(x, np.int64) for x in (left, right, made))
        key, rank = left * self.size + right, np.arange(len(left))
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], rank[order], made
        soonest = np.full(self.size, NO_RANK)
        np.minimum.at(soonest, left, rank)
        np.minimum.at(soonest, right, rank)
        # a pair whose product can take part only in later merges may be merged at all its places in one round
        self.at_once = soonest[made] > rank
        self.text = [b""] * self.size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.text[i] = b" " + token.encode()
        self.ids: dict[bytes, bytes] = {}
        self.names: dict[bytes, bytes] = {}

    def words(self, chunks: list[bytes]) -> list[bytes]:
        """The words of all chunks, with a line feed after each chunk's words."""
        blob = b"\n".join(chunks) + b"\n"
        if blob.isascii():
            return self.ASCII_WORD.findall(blob.lower())
        return [w.encode() for w in self.word.findall(self.NORMAL.normalize_str(blob.decode("utf-8", "replace")))]

    def rank_of(self, left: np.ndarray, right: np.ndarray, together: np.ndarray) -> np.ndarray:
        """Ranks of neighbouring symbols, by binary search in the sorted pair keys."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & together, self.ranks[at], NO_RANK)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and the number of ids of each word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        word = np.repeat(np.arange(len(words)), sizes)
        ids = self.first[raw]
        ends = np.cumsum(sizes) - 1
        ids[ends] = self.last[raw[ends]]
        counts = np.zeros(len(words), np.int64)
        done_ids, done_word = [], []
        rank = np.full(len(ids), NO_RANK)  # of the pair that begins here
        if len(ids) > 1:
            rank[:-1] = self.rank_of(ids[:-1], ids[1:], word[:-1] == word[1:])
        while len(ids):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.r_[starts, len(word)])
            if (final := lowest == NO_RANK).any():
                mine = np.repeat(final, lengths)
                done_ids.append(ids[mine]), done_word.append(word[mine])
                ids, word, rank = ids[~mine], word[~mine], rank[~mine]
                lowest, lengths = lowest[~final], lengths[~final]
                if not len(ids):
                    break
            hits = np.flatnonzero(rank == np.repeat(lowest, lengths))
            hit_rank, hit_word = rank[hits], word[hits]
            new_word = np.r_[True, hit_word[1:] != hit_word[:-1]]
            # runs of touching hits (aaa): every second one, counted from the left, as the library merges them
            run = np.r_[True, (np.diff(hits) != 1) | new_word[1:]]
            place = np.arange(len(hits)) - np.maximum.accumulate(np.where(run, np.arange(len(hits)), 0))
            keep = np.where(self.at_once[hit_rank], place % 2 == 0, new_word)
            hits, hit_rank = hits[keep], hit_rank[keep]
            ids[hits] = self.made[hit_rank]
            stay = np.ones(len(ids), bool)
            stay[hits + 1] = False
            ids, word, rank = ids[stay], word[stay], rank[stay]
            # only pairs at a merged symbol have changed
            here = hits - np.arange(len(hits))
            near = np.concatenate([here, here[here > 0] - 1])
            rank[near] = NO_RANK
            near = near[near < len(ids) - 1]
            rank[near] = self.rank_of(ids[near], ids[near + 1], word[near] == word[near + 1])
        if not done_ids:
            return np.zeros(0, np.int64), counts
        ids, word = np.concatenate(done_ids), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        np.add.at(counts, word, 1)
        return ids[order], counts

    def pieces(self, chunks: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Ids of each chunk, and their tokens with a blank before each."""
        words = self.words(chunks)
        index = {w: i for i, w in enumerate(dict.fromkeys([b"\n", *words]))}
        code = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        ids, counts = self.merge(list(index)[1:])
        counts = np.r_[0, counts]
        start = np.cumsum(counts) - counts
        sizes = counts[code]
        flat = ids[np.repeat(start[code] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
        to = np.r_[0, np.cumsum(sizes)[code == 0]].tolist()
        raw = flat.astype("<u4").tobytes()
        if not self.named:
            return [(raw[4 * a : 4 * b], b"") for a, b in zip(to[:-1], to[1:], strict=True)]
        names = [self.text[i] for i in flat.tolist()]
        return [(raw[4 * a : 4 * b], b"".join(names[a:b])) for a, b in zip(to[:-1], to[1:], strict=True)]

    def learn(self, chunks: list[bytes]) -> None:
        """Encode chunks that the cache lacks."""
        plain = [c for c in chunks if b"<|" not in c or not any(s in c for s in self.special_bytes)]
        if len(plain) < len(chunks):
            for c in set(chunks).difference(plain):
                text, at, ids, names = c.decode("utf-8", "replace"), 0, b"", b""
                for m in [*self.is_special.finditer(text), None]:
                    i, n = self.pieces([text[at : m.start() if m else len(text)].encode()])[0]
                    ids, names = ids + i, names + n
                    if m:
                        ids, names, at = ids + self.special[m[0]].to_bytes(4, "little"), names + b" " + m[0].encode(), m.end()
                self.ids[c], self.names[c] = ids, names
        ascii, other = [], []
        for c in plain:
            (ascii if c.isascii() else other).append(c)
        for some in (ascii, other):
            if some:
                for c, (ids, names) in zip(some, self.pieces(some), strict=True):
                    self.ids[c] = ids
                    if self.named:
                        self.names[c] = names

    def split(self, texts: list[bytes]) -> list[list[bytes]]:
        """The chunks of each text; afterwards the cache has them all."""
        split = [t.split() for t in texts]
        if len(self.ids) > CACHE_CHUNKS or self.held > CACHE_BYTES:
            self.ids.clear(), self.names.clear()
            self.held = 0
        if new := set().union(*split).difference(self.ids):
            self.learn(list(new))
            self.held += sum(map(len, new))
        return split

    def encode_ids(self, texts: list[bytes]) -> list[bytes]:
        """For each text its ids as little-endian 32-bit integers."""
        get = self.ids.__getitem__
        return [b"".join(map(get, chunks)) for chunks in self.split(texts)]

    def encode_decode(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        """For each text its ids and what they decode to."""
        get, name = self.ids.__getitem__, self.names.__getitem__
        return [(b"".join(map(get, chunks)), b"".join(map(name, chunks))[1:]) for chunks in self.split(texts)]


@lru_cache(4)
def encoder(path: str, kinds: tuple[str, str, str], named: bool = True) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path, kinds, named)


KEPT["bpe"] = encoder.cache_clear


def encode(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with ``ids`` (array of long) and ``decoded`` of every text."""
    fields, kinds = {f.name: f.dataType.simpleString() for f in df.schema}, classes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = encoder(path, kinds).encode_decode(as_bytes(batch.column(text)))
        ids = [np.frombuffer(i, "<u4").astype(np.int64) for i, _ in got]
        cols = [batch.column(k) for k in keep] + [pa.array(ids, pa.list_(pa.int64())), pa.array([d for _, d in got], pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(cols, [*keep, "ids", "decoded"])

    names = list(dict.fromkeys([*keep, text]))
    schema = ", ".join([*(f"`{k}` {fields[k]}" for k in keep), "ids array<bigint>", "decoded string"])
    return map_arrow(df.select(*names), run, schema, keeps="bpe")


def digests(df: DataFrame, path: str) -> DataFrame:
    """``encode`` with only the digests leaving the workers: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    kinds = classes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = encoder(path, kinds).encode_decode(as_bytes(batch.column("text")))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(i) // 4 for i, _ in got], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i, _ in got]), pa.array([hashlib.sha256(d).hexdigest() for _, d in got])],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return map_arrow(df.select("doc_id", "text"), run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", keeps="bpe")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
