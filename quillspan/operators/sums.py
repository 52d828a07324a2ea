"""The best chunks of many queries by sums over shared terms: all queries are held against rows, block by block.

A task turns its chunks into numbers (row, slot, value), a slot being a term as some queries ask for it, adds up rough sums of a
stretch of rows with all queries, and keeps each query's best. What may be among these is added up again in the
query's own order, so scores and ties don't depend on blocks. Only what is kept leaves the task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Sums, or products behind them, that a task holds at once; chunks that it turns into numbers at once.
PRODUCTS, ROWS = 2_000_000, 1_000
FOUND = "q long, chunk_id string, score double, matched array<string>"
Entries = tuple[np.ndarray, np.ndarray, np.ndarray]


@dataclass
class Asked:
    """Queries as arrays. Slots are sorted; a query's are in the order in which its parts are added."""

    qids: list
    names: list[str]  # the term of each slot
    order: np.ndarray  # slots by query, filled up with a number that no slot has
    weight: np.ndarray  # of these
    at: np.ndarray  # where each slot's queries begin
    who: np.ndarray  # queries by slot
    by: np.ndarray  # their weights

    @staticmethod
    def of(rows: list[tuple], slots: dict, names: list[str]) -> Asked:
        """From rows (qid, slot's key, weight), in the order of adding."""
        number = {q: n for n, q in enumerate(dict.fromkeys(r[0] for r in rows))}
        q = np.array([number[r[0]] for r in rows], np.int64)
        s = np.array([slots[r[1]] for r in rows], np.int64)
        w = np.array([r[2] for r in rows], np.float64)
        turn = np.argsort(q, kind="stable")
        size = np.bincount(q, minlength=len(number))
        place = np.arange(len(q)) - np.repeat(np.cumsum(size) - size, size)
        order, weight = np.full((len(number), size.max(initial=0)), len(slots), np.int64), np.zeros((len(number), size.max(initial=0)))
        order[q[turn], place], weight[q[turn], place] = s[turn], w[turn]
        turn = np.argsort(s, kind="stable")
        return Asked(list(number), names, order, weight, np.concatenate(([0], np.cumsum(np.bincount(s, minlength=len(slots))))), q[turn], w[turn])


def spread(at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For numbers that own stretches of a list (begins: at), the places of each one's stretch, and whose they are."""
    size = at[which + 1] - at[which]
    owner = np.repeat(np.arange(len(which)), size)
    return at[which][owner] + np.arange(len(owner)) - (np.cumsum(size) - size)[owner], owner


class Best:
    """Each query's best chunks so far; all of them without a limit."""

    def __init__(self, asked: Asked, limit: int | None):
        self.asked, self.limit = asked, limit
        self.floor = np.full(len(asked.qids), -np.inf)  # a query's worst score of those kept, once there are enough
        self.parts: list[tuple[pd.DataFrame, np.ndarray]] = []
        self.n = 0

    def add(self, ids: np.ndarray, entries: Entries) -> None:
        """Chunks by id and their entries, sorted by row and slot, each pair once."""
        row, slot, value = entries
        queries = len(self.asked.qids)
        need = np.concatenate(([0], np.cumsum(np.bincount(row, np.diff(self.asked.at)[slot], len(ids)))))
        low = 0
        while low < len(ids):
            high = min(low + max(1, PRODUCTS // max(1, queries)), int(np.searchsorted(need, need[low] + PRODUCTS, side="right")) - 1)
            high = min(max(high, low + 1), len(ids))
            a, b = np.searchsorted(row, [low, high])
            self._stretch(ids[low:high], row[a:b] - low, slot[a:b], value[a:b])
            low = high

    def _stretch(self, ids: np.ndarray, row: np.ndarray, slot: np.ndarray, value: np.ndarray) -> None:
        asked, n, queries = self.asked, len(ids), len(self.asked.qids)
        place, owner = spread(asked.at, slot)
        if not len(place):
            return
        x, cell = value[owner] * asked.by[place], row[owner] * queries + asked.who[place]
        near = np.bincount(cell, x, n * queries).reshape(n, queries)
        met = near > 0 if x.min() > 0 else np.bincount(cell, minlength=n * queries).reshape(n, queries) > 0
        near[~met] = -np.inf
        width = asked.order.shape[1]
        if self.limit is not None:
            cut = self.floor
            if n > self.limit:
                cut = np.maximum(cut, np.partition(near, n - self.limit, axis=0)[n - self.limit])
            met &= near >= cut - 4 * np.finfo(float).eps * width * width * np.abs(x).max()  # more than sums in another order differ by
        i, q = np.nonzero(met)
        keys = row * (len(asked.names) + 1) + slot
        step = max(1, PRODUCTS // width)
        for at in range(0, len(i), step):
            r, who = i[at : at + step], q[at : at + step]
            wanted = r[:, None] * (len(asked.names) + 1) + asked.order[who]
            found = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            hit = keys[found] == wanted
            score = np.cumsum(np.where(hit, value[found] * asked.weight[who], 0.0), axis=1)[:, -1]
            self.parts.append((pd.DataFrame({"q": who, "score": score, "chunk_id": ids[r]}), np.packbits(hit, axis=1)))
            self.n += len(r)
        if self.limit is not None and self.n > 4 * self.limit * queries + 1000:
            self.settle()

    def settle(self) -> None:
        """Only the best are kept."""
        rows, bits = pd.concat([p for p, _ in self.parts], ignore_index=True), np.concatenate([b for _, b in self.parts])
        kept = rows.sort_values(["q", "score", "chunk_id"], ascending=[True, False, True]).groupby("q", sort=False).head(self.limit)
        full = kept.groupby("q")["score"].agg(["size", "min"])
        full = full[full["size"] >= self.limit]
        self.floor[full.index.to_numpy()] = full["min"].to_numpy()
        self.parts, self.n = [(kept, bits[kept.index.to_numpy()])], len(kept)

    def batches(self) -> Iterator[pa.RecordBatch]:
        """What is kept, which is forgotten then."""
        if self.limit is not None and self.parts:
            self.settle()
        parts, self.parts, self.n = self.parts, [], 0
        for rows, bits in parts:
            q = rows["q"].to_numpy()
            hit = np.unpackbits(bits, axis=1, count=self.asked.order.shape[1]).astype(bool)
            r, place = np.nonzero(hit)
            terms = pa.array([self.asked.names[s] for s in self.asked.order[q[r], place].tolist()], pa.string())
            ends = np.concatenate(([0], np.cumsum(hit.sum(axis=1)))).astype(np.int32)
            columns = [pa.array(q, pa.int64()), pa.array(rows["chunk_id"].to_numpy(), pa.string()), pa.array(rows["score"].to_numpy()), pa.ListArray.from_arrays(pa.array(ends), terms)]
            yield pa.RecordBatch.from_arrays(columns, names=["q", "chunk_id", "score", "matched"])


def best_sums(rows: DataFrame, asked: Asked, kind: StructField, entries: Callable[[pa.RecordBatch], Entries], limit: int | None) -> DataFrame:
    """qid, chunk_id, score, matched_terms: the best of each partition for each query, by the entries of rows (chunk_id, …)."""
    sent = rows.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(sent.value, limit)
        for batch in batches if best.asked.qids and limit != 0 else ():
            for low in range(0, len(batch), ROWS):
                some = batch.slice(low, ROWS)
                best.add(some.column(0).to_pandas().to_numpy(), entries(some))
                if limit is None:
                    yield from best.batches()
        yield from best.batches()

    numbers = rows.sparkSession.createDataFrame(list(enumerate(asked.qids)), StructType([StructField("q", LongType()), StructField("qid", kind.dataType)]))
    found = rows.where("chunk_id is not null").mapInArrow(run, FOUND)
    return found.join(F.broadcast(numbers), "q").select("qid", "chunk_id", "score", F.col("matched").alias("matched_terms"))
