"""Operator 12: runs of repeated words, found online by a sparse dynamic program over diagonals.

A run is a stretch of words with smallest period q that is at least ``max(LEAST, TIMES * q)`` words long and that no
neighbouring word extends. Cell (i, q) of the program is the length of the match between the words that end at i and those that
end q before; its row holds active diagonals only. For each word its earlier occurrences are looked up, the diagonal of each
lag grows by one, and a diagonal that isn't met again ends and, if long enough, is emitted at once.

Which earlier occurrences count: lags are taken in classes (a, b] with b <= 1.5 a, and in a class an occurrence counts if the K
words from it on agree too, K the matched length that the shortest run of the class has (``max(LEAST - a, (TIMES - 1) * a)``,
at least twice b). Then only the latest occurrence matters: K words that recur at two lags of at most K / 2 have the greatest
common divisor of both as a period (Fine and Wilf), so a later one inside the run would contradict its smallest period. Each
word therefore meets one diagonal of each class at most, and the work is n log n for texts of every kind, one word repeated
without end included. A class is entered only where a stretch of recurring words is long enough for it.

The query is a single pass over the rows; nothing is shuffled, a batch holds a bounded number of bytes or one text.

Cases: null and empty texts have no words, no run and nothing to collapse; a null doc_id plants no repetition; repeated rows
give repeated results; an empty table gives no rows; columns other than the text and the kept ones are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import as_bytes, map_arrow, quoted, table

LEAST, TIMES = 6, 4


def classes(longest: int, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """Lags first..last of each class up to ``longest`` and the words K that must agree: no more than the shortest run of each
    of its lags matches, no fewer than twice its longest lag."""
    if times < 3:
        raise ValueError("a run holds its period three times at least")
    out, first = [], 1
    while first <= longest:
        last, agree = first, max(least, times * first) - first
        while min(agree, more := max(least, times * (last + 1)) - last - 1) >= 2 * (last + 1):
            last, agree = last + 1, min(agree, more)
        out.append((first, last, agree))
        first = last + 1
    return out


def numbered(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def latest(ids: np.ndarray) -> np.ndarray:
    """How far back each id occurred last; 0 if it didn't."""
    order = np.argsort(ids, kind="stable")
    lag = np.zeros(len(ids), np.int64)
    same = ids[order[1:]] == ids[order[:-1]]
    lag[order[1:][same]] = (order[1:] - order[:-1])[same]
    return lag


def longest_stretch(flags: np.ndarray) -> int:
    edges = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return int((edges[1::2] - edges[::2]).max(initial=0))


def diagonals(lag: np.ndarray, first: int, last: int) -> Iterator[tuple[int, int, int]]:
    """(lag, first and last word) of every diagonal that the words in order meet. One is active in a class at a time."""
    active, start, before = 0, 0, -2
    for i in np.flatnonzero((lag >= first) & (lag <= last)).tolist():
        q = int(lag[i])
        if q != active or i != before + 1:
            if active:
                yield active, start, before
            active, start = q, i
        before = i
    if active:
        yield active, start, before


def find_runs(words: list, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``words``, by start and period."""
    n = len(words)
    index = {w: k for k, w in enumerate(dict.fromkeys(words))}
    if n < least or len(index) == n:
        return []
    words_ids = np.fromiter(map(index.__getitem__, words), np.int64, n)
    ids, covers = words_ids, 1
    found: list[tuple[int, int, int]] = []
    steps = classes(n // times, least, times)
    for k, (first, last, agree) in enumerate(steps):
        if covers > agree:
            ids, covers = words_ids, 1
        while covers < agree:  # numbers of stretches of `agree` words, from those of shorter ones
            step = min(covers, agree - covers)
            ids = numbered(ids[:-step] * (int(ids.max()) + 1) + ids[step:]) if covers + step <= n else ids[:0]
            covers += step
        if not len(ids):
            break
        lag = latest(ids)
        for q, a, b in diagonals(lag, first, last):
            length = b - a + agree + q
            if length >= max(least, times * q):
                found.append((a - q, length, q))
        # every stretch of `agree` words in what the later classes match has occurred before
        if longest_stretch(lag > 0) + agree - 1 < min((x for _, _, x in steps[k + 1 :]), default=n + 1):
            break
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """``words`` without those that a run holds after its first period."""
    if not runs:
        return words
    cover = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        cover[start + period] += 1
        cover[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, of every tenth document (by a checksum of its id) with a tail that repeats itself."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a : a + p]
    return words[:a] + (block * (-(-(n - a) // p)))[: n - a]


COLUMNS = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def summary(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    milli = None if period is None else 1000 * length // period
    return len(runs), start, length, period, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()


def repeated_runs(df: DataFrame, text: str = "text", key: str = "doc_id", plant: bool = False) -> DataFrame:
    """``key`` with the number of runs of each text, its longest run and digests of all runs and of the text without
    repetitions; with ``plant`` every tenth text is made to repeat itself first."""
    kind = df.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, t in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
            words = planted(t.split(), doc_id) if plant else t.split()
            rows.append(summary(words, find_runs(words)))
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        kinds = [pa.string() if c.endswith("string") else pa.int64() for c in COLUMNS.split(", ")]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], [key, *names])

    return map_arrow(df.select(quoted(key), quoted(text)), run, f"{quoted(key)} {kind}, {COLUMNS}")


def without_repetitions(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with each text's repeated words dropped and the rest joined by one blank; texts without a run and nulls stay as
    they are, as do all other columns."""
    columns = df.columns
    at = columns.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for t in batch.column(at).to_pylist():
            words = (t or "").encode().split()
            runs = find_runs(words)
            out.append(b" ".join(collapsed(words, runs)).decode() if runs else t)
        return pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if k == at else batch.column(k) for k in range(len(columns))], schema=batch.schema.set(at, pa.field(columns[at], pa.string())))

    return map_arrow(df, run, df.schema)


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_runs(table(spark, sf_dir, "documents"), plant=True)
