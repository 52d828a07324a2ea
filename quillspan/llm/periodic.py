"""Periodic runs of words: stretches that repeat with a smallest period, and texts without the repeats.

A run of period p with enough words holds a whole block of a grid whose step depends on p alone, and the
block equals the words p further on. The harmonic grid has every (period, grid point) of a text, n log n of
them. Prefix hashes of the words test all blocks at once; of the pairs that are left, a binary search, for all
of them together, finds how far the equality goes to either side. Runs found from several points, or as a multiple of
their period, are taken once, and every run's words are compared: should a hash ever be wrong, the text's runs are found
again by comparing words at every distance.

Words are runs of characters other than blanks and the control characters 9 to 13; they are told apart
exactly. Null and empty texts, or ones without words, have no run and collapse to an empty text. A text of any
length is one task's work, in slabs of so many pairs that memory is bounded by its words. Rows with null or
repeated keys are rows like others; an empty table gives an empty result; further columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, small_batches
from .shingles import powers

WORD = r"[^\x20\x09-\x0D]+"
#: Pairs of a period and a grid point that are looked at together.
PAIRS = 2_000_000
#: Bytes of texts without repeats that go between Python and the JVM at once.
OUT_BYTES = 4_000_000
RUNS = "array<struct<start:long,length:long,period:long>>"


def slabs(n: int, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The harmonic grid of a text of n words: period, grid point, words in the point's block."""
    if n < least:
        return
    period = np.arange(1, n // times + 1)
    # so many consecutive words equal those a period further on, and hold a whole block of half that size
    block = (np.maximum(least, times * period) - period + 1) // 2
    points = (n - period) // block
    part = np.cumsum(points) // PAIRS
    for at in np.split(np.arange(len(period)), np.flatnonzero(np.diff(part)) + 1):
        many = points[at]
        step = np.repeat(block[at], many)
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        yield np.repeat(period[at], many), nth * step, step


def _stretches(ids: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the stretches of words that equal those p further on."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids[p:] == ids[:-p]).view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def _once(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by start, end and period, and where in it a stretch is met first: there with its smallest period."""
    order = np.lexsort((period, end, start))
    s, e = start[order], end[order]
    return order, np.flatnonzero(np.concatenate(([True], (s[1:] != s[:-1]) | (e[1:] != e[:-1])))[: len(s)])


def runs_by_words(ids: np.ndarray, least: int, times: int) -> np.ndarray:
    """Rows (start, length, period) by comparing words at every distance, for texts in which a hash misled."""
    found = [np.zeros((0, 3), np.int64)]
    for p in range(1, len(ids) // times + 1):
        a, b = _stretches(ids, p)
        keep = b - a + p >= max(least, times * p)
        found.append(np.stack((a[keep], b[keep] + p, np.full(keep.sum(), p)), axis=1))
    every = np.concatenate(found)
    order, first = _once(*every.T)
    start, end, period = every[order[first]].T
    return _by_start(start, end, period)


def _by_start(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    order = np.lexsort((period, start))
    return np.stack((start, end - start, period), axis=1)[order]


def runs_of(ids: np.ndarray, least: int = 24, times: int = 3) -> np.ndarray:
    """Rows (start, length, period) of the runs of a sequence of word numbers, by start and period.

    A run has at least `least` words and `times` periods (2 or more), and goes on to neither side.
    """
    n = len(ids)
    power = powers(n + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(ids.astype(np.uint64) + np.uint64(1)) * power[:n])))

    def same(i: np.ndarray, p: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Whether the m words from i have the hash of those from i + p."""
        return (sums[i + m] - sums[i]) * power[p] == sums[i + p + m] - sums[i + p]

    def farthest(low: np.ndarray, high: np.ndarray, holds) -> np.ndarray:
        while (low < high).any():
            middle = (low + high + 1) // 2
            good = holds(middle)
            low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
        return low

    found = [np.zeros((4, 0), np.int64)]
    for period, point, block in slabs(n, least, times):
        may = np.flatnonzero(same(point, period, block))
        if not len(may):
            continue
        p, i, m = period[may], point[may], block[may]
        ahead = farthest(m, n - p - i, lambda k, i=i, p=p: same(i, p, k))
        back = farthest(np.zeros_like(i), i, lambda k, i=i, p=p: same(i - k, p, k))
        start, end = i - back, i + ahead + p
        keep = end - start >= np.maximum(least, times * p)
        start, end, p = start[keep], end[keep], p[keep]
        order, first = _once(start, end, p)
        found.append(np.stack((start[order[first]], end[order[first]], p[order[first]], np.gcd.reduceat(p[order], first) if len(first) else p)))
    start, end, period, common = np.concatenate(found, axis=1)
    order, first = _once(start, end, period)
    if not len(first):
        return np.zeros((0, 3), np.int64)
    smallest, common = period[order[first]], np.gcd.reduceat(common[order], first)
    wrong = (smallest != common).any()  # all periods of a stretch are multiples of the smallest, but for a wrong hash
    start, end = start[order[first]], end[order[first]]
    for a, b, p in zip(start.tolist(), end.tolist(), smallest.tolist(), strict=True):  # the words themselves
        inside = (ids[a : b - p] == ids[a + p : b]).all()
        if wrong or not inside or a and ids[a - 1] == ids[a - 1 + p] or b < n and ids[b] == ids[b - p]:
            return runs_by_words(ids, least, times)
    return _by_start(start, end, smallest)


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by blanks."""
    if not len(runs):
        return b" ".join(words)
    inside = np.zeros(len(words) + 1, np.int64)
    np.add.at(inside, runs[:, 0] + runs[:, 2], 1)
    np.add.at(inside, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(inside[:-1]) == 0).tolist()])


def find_runs(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """key, n_words, runs (by start, then period) and collapsed (the text without repeats) of every row."""
    if times < 2 or least < 2:
        raise ValueError("a run repeats its period at least once, and has two words at least")
    kind = df.schema[key].dataType.simpleString()
    small_batches(df.sparkSession)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

        def made(keys: pa.Array, held: list[tuple[int, np.ndarray, bytes]]) -> pa.RecordBatch:
            every = np.concatenate([r for _, r, _ in held])
            offsets = np.concatenate(([0], np.cumsum([len(r) for _, r, _ in held]))).astype(np.int32)
            structs = pa.StructArray.from_arrays([pa.array(every[:, k]) for k in range(3)], ["start", "length", "period"])
            texts = pa.array([t.decode("utf-8", "replace") for _, _, t in held], pa.string())
            return pa.RecordBatch.from_arrays([keys, pa.array([n for n, _, _ in held], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), structs).cast(runs_type), texts], names=["key", "n_words", "runs", "collapsed"])

        for batch in batches:
            keys, held, size, begun = batch.column(0), [], 0, 0
            for k, value in enumerate(batch.column(1).cast(pa.binary())):
                words = (value.as_py() or b"").split()  # bytes are cut at the same six characters
                number: dict[bytes, int] = {}
                runs = runs_of(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)), least, times)
                held.append((len(words), runs, collapsed(words, runs)))
                size += len(held[-1][2])
                if size > OUT_BYTES:
                    yield made(keys.slice(begun, k + 1 - begun), held)
                    held, size, begun = [], 0, k + 1
            if held:
                yield made(keys.slice(begun), held)

    found = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(search, f"key {kind}, n_words long, runs {RUNS}, collapsed string")
    return found.withColumnRenamed("key", key)


def with_planted_run(key: Column, text: Column) -> Column:
    """The text, in which one document of ten (by its key's checksum) repeats a passage to its end; rows with a null key stay as they are."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    h = F.crc32(key.cast("string"))
    g, n = F.floor(h / 10), F.size(words)
    a = (g % n).cast("int")
    rest = n - a
    p = (1 + F.floor(rest / (3 + g % 8))).cast("int")
    repeated = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil(rest / p).cast("int")))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(repeated, F.lit(1), rest)), " ")).otherwise(text)


def run_digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row of find_runs: its number of runs, the one with the greatest exponent, and digests of runs and text."""
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda best, r: F.when(better(best, r), r).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"], F.lit("\n")))), "")
    rows = found.select(key, F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select(
        key, "n_runs",
        F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256",
    )
