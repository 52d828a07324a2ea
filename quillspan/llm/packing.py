"""Packing by cutting-stock column generation.

Documents are encoded whole and cut after every `capacity` tokens. Pieces shorter than SHORT tokens are
bundled with their neighbours, so that rounding a length costs a bundle, not each of them. Pieces and
bundles go into a histogram of lengths in steps of `step` tokens. A linear program over patterns (how many pieces of each
length share a sequence) covers the histogram with the fewest sequences: its columns are priced by a
knapsack dynamic program over the duals, and it ends when no pattern could better it by `gap`. The
patterns' rounded-down counts and a best-fit of the few pieces left give whole numbers of sequences.
Pieces are ranked within their length, and a piece's rank says which pattern, and so which sequence,
takes it; a bundle's pieces follow one another there. The histogram has at most capacity/step rows however many documents there are.

Null and empty texts hold the end id alone; an empty table gives an empty result; equal rows are packed
each; columns other than the id and the text aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, by_frames, framed, saved
from .tokens import TOKENIZER, encoder, tokenizer_path

CAPACITY = 2048
STEP = 8
GAP = 1e-3
END_ID = 1
#: Pieces of fewer tokens are bundled, up to so many tokens together.
SHORT, BUNDLE = 64, 256


def knapsack(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """For every room up to this one, the greatest value of a pattern that fits, and the piece it takes (-1: none)."""
    best, take = np.zeros(room + 1), np.full(room + 1, -1, np.int64)
    order = np.argsort(sizes, kind="stable")
    fits = np.searchsorted(sizes[order], np.arange(room + 1), side="right")
    sized, valued = sizes[order], values[order]
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        if n := fits[c]:
            reached = best[c - sized[:n]] + valued[:n]
            k = int(np.argmax(reached))
            if reached[k] > best[c]:
                best[c], take[c] = reached[k], order[k]
    return best, take


def taken(take: np.ndarray, sizes: np.ndarray, room: int) -> np.ndarray:
    """The pattern behind a knapsack's value."""
    counts, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            counts[take[c]] += 1
            c -= int(sizes[take[c]])
    return counts


def best_pattern(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The pattern of greatest value that fits, each piece any number of times."""
    best, take = knapsack(values, sizes, room)
    return float(best[room]), taken(take, sizes, room)


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often each is used in the linear program's solution.

    A pricing gives a column for each size, the best that holds it; those that better the plan are
    brought in one by one, at the duals of that moment, before the next pricing. It ends when the best
    pattern's price shows that no plan is better by the gap, or when the plan is that near to the bound
    of filled rooms.
    """
    m = len(sizes)
    patterns = np.diag(room // sizes)
    inverse = np.diag(1.0 / np.diag(patterns))
    used = inverse @ demand
    bound = (1 + gap) * (sizes @ demand) / room
    for _ in range(20 * m + 100):
        duals = inverse.sum(axis=0)
        best, take = knapsack(duals, sizes, room)
        if best[room] <= 1 + gap or used.sum() <= bound:
            break
        priced = [k for k in range(m) if duals[k] + best[room - sizes[k]] > 1 + gap]
        pool = np.stack([taken(take, sizes, room - int(sizes[k])) + (np.arange(m) == k) for k in priced], axis=1)
        pool = np.unique(pool, axis=1).astype(np.float64)
        moved = False
        for _ in range(2 * m):
            price = inverse.sum(axis=0) @ pool
            k = int(np.argmax(price))
            if price[k] <= 1 + gap / 2 or used.sum() <= bound:
                break
            column = pool[:, k]
            direction = inverse @ column
            ratio = np.where(direction > 1e-9, used / np.where(direction > 1e-9, direction, 1), np.inf)
            out = int(np.argmin(ratio))
            if not np.isfinite(ratio[out]):
                break
            used -= ratio[out] * direction
            used[out] = ratio[out]
            np.maximum(used, 0, out=used)
            inverse[out] /= direction[out]
            direction[out] = 0
            inverse -= np.outer(direction, inverse[out])
            patterns[:, out] = column
            moved = True
        if not moved:
            break
    return patterns, used


def plan_sequences(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP) -> list[tuple[int, np.ndarray]]:
    """(times, pieces of each size) so that every piece has a place."""
    plan: list[tuple[int, np.ndarray]] = []
    left = demand.astype(np.int64).copy()
    if len(sizes):
        patterns, used = cutting_stock(sizes, demand.astype(float), room, gap)
        for k in np.argsort(-used, kind="stable"):
            pattern = patterns[:, k]
            times = min(int(used[k] + 1e-6), *(int(n) for n in left[pattern > 0] // pattern[pattern > 0]))
            if times > 0:
                plan.append((times, pattern))
                left -= times * pattern
    bins: list[tuple[int, np.ndarray]] = []  # room left, pieces
    for k in np.argsort(-sizes, kind="stable"):
        size = int(sizes[k])
        while left[k] > 0:
            fitting = [i for i, (free, _) in enumerate(bins) if free >= size]
            if fitting:
                i = min(fitting, key=lambda i: bins[i][0])
            else:
                if left[k] > 10_000 // size:  # many alike: whole sequences of them at once
                    whole, alike = room // size, np.zeros(len(sizes), np.int64)
                    if times := int(left[k]) // whole:
                        alike[k] = whole
                        plan.append((times, alike))
                        left[k] -= times * whole
                        continue
                bins.append((room, np.zeros(len(sizes), np.int64)))
                i = len(bins) - 1
            free, inside = bins[i]
            inside[k] += 1
            bins[i] = (free - size, inside)
            left[k] -= 1
    return plan + [(1, inside) for _, inside in bins]


def cut_pieces(df: DataFrame, key: str, text: str, tokenizer: str, capacity: int, step: int, end_id: int) -> DataFrame:
    """A row for each piece, with its size class, its partition, its rank among those of its class there, and its place in its bundle."""
    path = tokenizer_path(tokenizer)
    columns = ["key", "start", "length", "ids_crc32", "doc_tokens", "size", "part", "rank", "place"]
    most = min(BUNDLE, capacity) // step * step

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, part, ranks = encoder(path).encode, TaskContext.get().partitionId(), {}
        bundle: list[tuple] = []
        held = 0

        def ranked(pieces: list[tuple], total: int) -> Iterator[tuple]:
            """The rows of pieces that go together."""
            size, place = -(-total // step), 0
            rank = ranks.get(size, 0)
            ranks[size] = rank + 1
            for piece in pieces:
                yield (*piece, size, part, rank, place)
                place += piece[2]

        for block in blocks(frames):
            rows: list[tuple] = []
            for key_, ids in zip(block["key"].tolist(), encode(block["text"].tolist()), strict=True):
                ids = np.append(ids, end_id).astype("<u4")
                for start in range(0, len(ids), capacity):
                    cut_ids = ids[start : start + capacity]
                    piece = (key_, start, len(cut_ids), zlib.crc32(cut_ids), len(ids))
                    if len(cut_ids) >= min(SHORT, most):
                        rows += ranked([piece], len(cut_ids))
                        continue
                    if held + len(cut_ids) > most:
                        rows += ranked(bundle, held)
                        bundle, held = [], 0
                    bundle.append(piece)
                    held += len(cut_ids)
                    if held >= SHORT and held % step == 0:  # nothing is lost by rounding
                        rows += ranked(bundle, held)
                        bundle, held = [], 0
            yield framed(rows, columns)
        if bundle:
            yield framed(list(ranked(bundle, held)), columns)

    kind = df.schema[key].dataType.simpleString()
    return by_frames(df.select(F.col(key).alias("key"), F.col(text).alias("text")), cut, f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, size int, part int, rank long, place long")


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, capacity: int = CAPACITY, step: int = STEP, gap: float = GAP, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    room = capacity // step
    pieces = saved(cut_pieces(df, key, text, tokenizer, capacity, step, end_id))
    counts = pieces.groupBy("size", "part").agg((F.max("rank") + 1).alias("n"))
    histogram = counts.groupBy("size").agg(F.sum("n").alias("n")).orderBy("size").collect()  # at most `room` rows
    sizes = np.array([r["size"] for r in histogram], np.int64)
    plan = plan_sequences(sizes, np.array([r["n"] for r in histogram], np.int64), room, gap)
    first = np.concatenate(([0], np.cumsum([times for times, _ in plan]))).astype(np.int64)
    # for each size: from which rank on which pattern takes the pieces, from which sequence on, how many each
    takes = {}
    for k, size in enumerate(sizes.tolist()):
        own = [(first[i], times, int(pattern[k])) for i, (times, pattern) in enumerate(plan) if pattern[k]]
        ends = np.cumsum([times * each for _, times, each in own])
        takes[size] = (ends, np.array([x[0] for x in own]), np.array([x[2] for x in own]))

    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("size", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    ranked = pieces.join(starts, ["size", "part"]).withColumn("rank", F.col("rank") + F.col("ahead")).drop("ahead", "part")

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sequence = np.zeros(len(frame), np.int64)
            rank, size = frame["rank"].to_numpy(), frame["size"].to_numpy()
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                ends, firsts, each = takes[int(s)]
                k = np.searchsorted(ends, rank[at], side="right")
                inside = rank[at] - np.where(k > 0, ends[k - 1], 0)
                sequence[at] = firsts[k] + inside // each[k]
            yield frame.assign(sequence_id=sequence)

    kind = df.schema[key].dataType.simpleString()
    placed = by_frames(ranked, place, f"size int, key {kind}, start long, length long, ids_crc32 long, doc_tokens long, rank long, place long, sequence_id long")
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("size"), "rank", "place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(F.col("key").alias(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"))
