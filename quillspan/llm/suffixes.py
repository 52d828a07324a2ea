"""Repeated byte strings across documents, by a logarithmic family of sampled suffix arrays.

Every window of `least` bytes has an anchor, the place of the smallest hash among its strings of half that
length; equal windows have it at the same place, so it's enough to index the suffixes that start at
anchors. A suffix stands for the consecutive windows that have its anchor: `a` is the hash of the string at the
anchor, by which suffix arrays are ordered, and `b` the hash of all bytes that those windows cover.

A batch of documents gets a suffix array, ordered by (a, b, doc, at) and stored in buckets of `a`. It is merge-scanned against each
level of the family, bucket by bucket and without a shuffle, for suffixes that begin with equal strings; then it becomes a level itself, and
levels of equal size are merged when the next batch comes, so there are few however many batches came.
What was matched is ordered once more: of suffixes with equal (a, b) all but the first are repeats with all their
windows. Where one string stands among different bytes, the first suffix of each kind is opened: its windows are
hashed one by one and the first of each kept. So each window is known to be first or to be repeated.

Hot strings: equal suffixes are taken together within each block of text before the shuffle, and where one string
has many surroundings in a task, these go on as single windows at once instead of meeting under one key. Windows are told apart by 128 bits.

Null texts are empty; texts shorter than a window have no repeat. Documents are ordered by their integer
key, null before all; rows that share key and text are one document and get equal results, of different texts under one key
the order is that of their checksums. A text of any length is cut in slices. An empty table gives an empty result;
further columns aren't read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, mix64, remove, setting, shared_dir, signed, small_batches

#: Bytes of text that are hashed together.
BLOCK = 1_000_000
#: Batches that a whole table is dealt in.
BATCHES = 4
#: Surroundings of one string in a block from which it is counted, and in a task from which they go on as windows.
SEVERAL, HOT = 8, 64
#: A position: checksum of the text (which tells texts of one key apart) and place in it.
PLACE_BITS, TAG = 40, (1 << 20) - 1
SUFFIX, REPEAT, OPENED = 0, 1, 2
_FIELDS = {"kind": pa.int32(), "a": pa.int64(), "b": pa.int64(), "doc": pa.int64(), "at": pa.int64(), "n": pa.int64()}
SCHEMA = "kind int, a long, b long, doc long, at long, n long"
_ORDER = np.uint64(0x9FB21C651E98DF25)
_LOW = np.uint64(24)


class Rolling:
    """Hashes of substrings from sums over prefixes: the same bytes have the same hash wherever they stand."""

    def __init__(self, seed: int):
        self.base = int(mix64(np.array([seed], np.uint64))[0]) | 1
        self.byte = mix64(np.arange(256, dtype=np.uint64) + np.uint64(seed << 8))
        self.power = self.inverse = np.zeros(0, np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self.power) < n + 1:
            steps = max(n, BLOCK + (BLOCK >> 4)) + 1
            line = lambda x: np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(steps, x, np.uint64))))
            self.power, self.inverse = line(self.base), line(pow(self.base, -1, 1 << 64))
        found = np.zeros(n + 1, np.uint64)
        np.cumsum(self.byte[data] * self.power[:n], out=found[1:])
        return found

    def between(self, sums: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (sums[high] - sums[low]) * self.inverse[low]


_STRINGS, _COVERS = Rolling(0x243F6A88), Rolling(0x13198A2E)


def _least_of(x: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w consecutive values."""
    span = 1
    while 2 * span <= w:
        x, span = np.minimum(x[:-span], x[span:]), 2 * span
    return np.minimum(x[: len(x) - (w - span)], x[w - span :]) if span < w else x


def anchored(data: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where windows get another anchor than the one before, each window's anchor, and the hash of the string at each place."""
    k = least // 2
    sums = _STRINGS.sums(data)
    strings = (sums[k:] - sums[:-k]) * _STRINGS.inverse[: len(data) - k + 1]
    ranked = (strings * _ORDER >> _LOW << _LOW) | np.arange(len(strings), dtype=np.uint64)  # the first of equal ones
    anchor = (_least_of(ranked, least - k + 1) & ((np.uint64(1) << _LOW) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    return first, anchor, strings


def _pieces(keys: np.ndarray, texts: list[bytes | None], least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of text: bytes, and of each piece in it where it begins, its document and the position of its first byte.

    A long text comes in slices that overlap by less than a window, so that each window is in one piece.
    """
    held: list[bytes] = []
    docs, ats, size = [], [], 0

    def block():
        sizes = np.array([len(p) for p in held])
        return np.frombuffer(b"".join(held), np.uint8), np.cumsum(sizes) - sizes, np.array(docs, np.int64), np.array(ats, np.int64)

    for doc, text in zip(keys.tolist(), texts, strict=True):
        if text is None or len(text) < least:
            continue
        tag = (zlib.crc32(text) & TAG) << PLACE_BITS
        for low in range(0, len(text) - least + 1, BLOCK):
            piece = text[low : low + BLOCK + least - 1]
            if held and size + len(piece) > BLOCK:
                yield block()
                held, docs, ats, size = [], [], [], 0
            held.append(piece)
            docs.append(doc)
            ats.append(tag | low)
            size += len(piece)
    if held:
        yield block()


def first_of_each(a: np.ndarray, b: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are the first of their (a, b) by position, and which repeat an earlier position's."""
    first, repeat = np.ones(len(a), bool), np.zeros(len(a), bool)
    order = np.lexsort((b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    of = np.cumsum(new) - 1
    several = np.bincount(of, minlength=1)[of] > 1 if len(of) else new
    if several.any():
        rows, of = order[several], of[several]
        inner = np.lexsort((at[rows], doc[rows], of))
        rows, of = rows[inner], of[inner]
        lead = np.concatenate(([True], of[1:] != of[:-1]))
        leader = rows[np.maximum.accumulate(np.where(lead, np.arange(len(rows)), 0))]
        first[rows] = lead
        repeat[rows] = ~lead & ((doc[rows] != doc[leader]) | (at[rows] != at[leader]))
    return first, repeat


def _joined(doc: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same windows, those that follow one another in one row."""
    order = np.lexsort((at, doc))
    doc, at, n = doc[order], at[order], n[order]
    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + n[:-1])))) if len(doc) else np.zeros(0, np.int64)
    return doc[new], at[new], np.add.reduceat(n, new) if len(new) else n


def _batch(kind: int, doc: np.ndarray, at: np.ndarray, n: np.ndarray, a: np.ndarray | None = None, b: np.ndarray | None = None) -> pa.RecordBatch:
    if a is None:  # dealt evenly
        a = signed(mix64(doc.astype(np.uint64) ^ mix64(at.astype(np.uint64))))
    values = (np.full(len(doc), kind, np.int32), a, np.zeros(len(doc), np.int64) if b is None else b, doc, at, n)
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, _FIELDS.values(), strict=True)], names=list(_FIELDS))


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, list[bytes | None]]:
    return batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).cast(pa.binary()).to_pylist()


def _suffixes(least: int):
    """A function from batches (doc, text) to rows of suffixes, of windows known to be repeated, and of suffixes to open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: Counter[int] = Counter()
        for batch in batches:
            for data, begin, docs, ats in _pieces(*_texts(batch), least):
                low, anchor, strings = anchored(data, least)
                # windows that reach over a piece's end are none
                end = np.concatenate((begin[1:], [len(data)])) - least + 1
                piece = np.searchsorted(begin, low, side="right") - 1
                stop = np.concatenate((low[1:], [len(anchor)]))
                low_, piece_, stop_ = low, piece, np.minimum(stop, end[piece])
                over = np.flatnonzero((stop > begin[np.minimum(piece + 1, len(begin) - 1)]) & (piece + 1 < len(begin)))
                if len(over):  # one anchor on both sides of a border
                    low_ = np.concatenate((low, begin[piece[over] + 1]))
                    piece_ = np.concatenate((piece, piece[over] + 1))
                    stop_ = np.concatenate((stop_, np.minimum(stop[over], end[piece[over] + 1])))
                good = stop_ > low_
                low, stop, piece = low_[good], stop_[good], piece_[good]
                if not len(low):
                    continue
                at_anchor, n = anchor[low], stop - low
                a = signed(mix64(strings[at_anchor]))
                b = signed(mix64(_COVERS.between(_COVERS.sums(data), low, stop + least - 1) + ((at_anchor - low) << 20 | n).astype(np.uint64)))
                doc, at = docs[piece], ats[piece] + low - begin[piece]
                first, repeat = first_of_each(a, b, doc, at)
                yield _batch(REPEAT, *_joined(doc[repeat], at[repeat], n[repeat]))
                doc, at, n, a, b = doc[first], at[first], n[first], a[first], b[first]
                wide = _many(a, met)
                if wide.any():
                    yield _batch(OPENED, doc[wide], at[wide], n[wide])
                    doc, at, n, a, b = doc[~wide], at[~wide], n[~wide], a[~wide], b[~wide]
                yield _batch(SUFFIX, doc, at, n, a, b)

    return run


def _many(a: np.ndarray, met: Counter[int]) -> np.ndarray:
    """Rows of strings that have had many surroundings in this task; of each, two stay, for others to meet."""
    wide = np.zeros(len(a), bool)
    strings, back, count = np.unique(a, return_inverse=True, return_counts=True)
    for k in np.flatnonzero(count >= SEVERAL).tolist():
        string = int(strings[k])
        met[string] += int(count[k])
        if met[string] > HOT:
            wide[np.flatnonzero(back == k)[2:]] = True
    if len(met) > 100_000:
        for string in [s for s, c in met.items() if c <= HOT]:
            del met[string]
    return wide


def _windows(least: int):
    """A function from batches (doc, text, spots: places of suffixes and their windows) to rows of single windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = _texts(batch)
            spots, bounds = batch.column(2), batch.column(2).offsets.to_numpy()
            place, many = (spots.values.field(f).to_numpy(zero_copy_only=False) for f in ("place", "n"))
            held: list[tuple[np.ndarray, ...]] = []
            size = 0
            for k, text in enumerate(texts):
                low, n = place[bounds[k] : bounds[k + 1]], many[bounds[k] : bounds[k + 1]]
                start = np.unique(np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum()))
                tag = (zlib.crc32(text) & TAG) << PLACE_BITS
                for begin in range(0, len(text), BLOCK):
                    some = start[np.searchsorted(start, begin) : np.searchsorted(start, begin + BLOCK)]
                    if len(some):
                        data = np.frombuffer(text, np.uint8, min(BLOCK + least - 1, len(text) - begin), begin)
                        low = some - begin
                        held.append(tuple(signed(mix64(h.between(h.sums(data), low, low + least))) for h in (_STRINGS, _COVERS)) + (np.full(len(some), keys[k]), tag | some))
                        size += len(some)
                    if size > 100_000:
                        yield from once(held)
                        held, size = [], 0
            if held:
                yield from once(held)

    def once(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        a, b, doc, at = (np.concatenate(x) for x in zip(*held, strict=True))
        first, repeat = first_of_each(a, b, doc, at)
        yield _batch(REPEAT, *_joined(doc[repeat], at[repeat], np.ones(repeat.sum(), np.int64)))
        yield _batch(SUFFIX, doc[first], at[first], np.ones(first.sum(), np.int64), a[first], b[first])

    return run


class SuffixFamily:
    """Levels of suffix arrays in the shared folder. `add` a batch; `close` deletes what was written."""

    def __init__(self, spark: SparkSession, least: int = 100):
        if not 16 <= least <= 1 << 16:
            raise ValueError("a string has 16 to 65536 bytes")
        self.spark, self.least = spark, least
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        shared_dir(spark)
        self.path = fresh_path(spark, "suffixes")
        self.levels: list[tuple[int, str]] = []  # size in batches, table
        self.arrays: list[str] = []  # folders of the batches' repeats and of what is opened
        self.matches: list[str] = []
        self._tables = 0

    def _stored(self, rows: DataFrame) -> str:
        """Rows (dealt by `a`) as a table in buckets of it, one file each; the name."""
        self._tables += 1
        name = f"{self.path.rsplit('/', 1)[-1].replace('-', '_')}_{self._tables}"
        rows.write.partitionBy("kind").bucketBy(self.buckets, "a").sortBy("a").option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def _suffixes_of(self, table: str) -> DataFrame:
        return self.spark.table(table).where(F.col("kind") == SUFFIX)

    def add(self, docs: DataFrame) -> None:
        """Index a batch (doc, text) and keep which suffixes match one of it or of a level."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            self._merge()
        small_batches(self.spark)
        made = docs.where(F.octet_length("text") >= self.least).select("doc", "text").mapInArrow(_suffixes(self.least), SCHEMA)
        beside = Window.partitionBy("a").orderBy("b", "doc", "at")
        met = (F.col("kind") == SUFFIX) & (F.lag("a").over(beside).isNotNull() | F.lead("a").over(beside).isNotNull())
        name = self._stored(made.repartition(self.buckets, "a").withColumn("met", met))
        array = self._suffixes_of(name)
        matched = array.where("met")
        # bucket by bucket, in order
        with setting(self.spark, "spark.sql.legacy.bucketedTableScan.outputOrdering", "true"):
            for _, table in self.levels:
                level = self._suffixes_of(table)
                matched = matched.union(array.where("NOT met").join(level.select("a"), "a", "left_semi").select(array.columns))
                matched = matched.union(level.join(array.select("a"), "a", "left_semi").select(array.columns))
            self.matches.append(f"{self.path}/matched-{len(self.matches)}")
            matched.select("a", "b", "doc", "at", "n").write.parquet(self.matches[-1])
        self.levels.append((1, name))
        self.arrays.append(name)

    def _merge(self) -> None:
        (n, one), (m, other) = self.levels[-2:]
        rows = self._suffixes_of(one).union(self._suffixes_of(other))
        name = self._stored(rows.repartition(self.buckets, "a"))
        for table in (one, other):
            self._forget(table)
        self.levels[-2:] = [(n + m, name)]

    def _forget(self, table: str) -> None:
        """Delete a table's suffixes; repeats and what is opened are still wanted."""
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        remove(self.spark, f"{self.path}/{table}/kind={SUFFIX}")

    def results(self) -> tuple[DataFrame, DataFrame]:
        """Windows known to be repeated, and suffixes whose windows have to be told apart, as (doc, at, n)."""
        for _, table in self.levels:
            self._forget(table)
        self.levels = []
        columns = ["doc", "at", "n"]
        matched = self.spark.read.schema("a long, b long, doc long, at long, n long").parquet(*self.matches)
        same, string = Window.partitionBy("a", "b").orderBy("doc", "at"), Window.partitionBy("a")
        ranked = matched.repartition("a").select(*columns, F.rank().over(same).alias("nth"), (F.min("b").over(string) < F.max("b").over(string)).alias("many"))
        ranked.where("nth > 1 OR many").select(*columns, (F.col("nth") > 1).alias("repeat")).write.parquet(f"{self.path}/classes")
        for match in self.matches:
            remove(self.spark, match)
        classes = self.spark.read.schema("doc long, at long, n long, repeat boolean").parquet(f"{self.path}/classes")
        stored = [self.spark.read.schema("b long, doc long, at long, n long, kind int").option("basePath", f"{self.path}/{t}").parquet(f"{self.path}/{t}") for t in self.arrays]
        repeats, opened = classes.where("repeat").select(*columns), classes.where("NOT repeat").select(*columns)
        for array in stored:
            repeats = repeats.union(array.where(F.col("kind") == REPEAT).select(*columns))
            opened = opened.union(array.where(F.col("kind") == OPENED).select(*columns))
        return repeats, opened

    def close(self) -> None:
        for _, table in self.levels:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.levels = []
        remove(self.spark, self.path)


def _spots(rows: DataFrame) -> DataFrame:
    """A row for each document: the places of windows in it."""
    place = F.struct((F.col("at").bitwiseAND((1 << PLACE_BITS) - 1)).alias("place"), "n")
    return rows.groupBy("doc", F.shiftright("at", PLACE_BITS).cast("int").alias("tag")).agg(F.collect_list(place).alias("spots"))


def _spans(text: bytes, place: np.ndarray, n: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the maximal runs of bytes that repeated windows cover."""
    order = np.argsort(place, kind="stable")
    low, high = place[order], (place + n - 1 + least)[order]
    high = np.minimum(np.maximum.accumulate(high), len(text)) if len(high) else high
    new = np.flatnonzero(np.concatenate(([True], low[1:] > high[:-1]))) if len(low) else np.zeros(0, np.int64)
    return low[new], high[np.append(new[1:], len(low)) - 1] if len(new) else low


def without_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = 100, batches: int = BATCHES) -> DataFrame:
    """key, n_bytes, spans (the runs of removed bytes) and kept (the bytes that are left) of every row.

    A byte is removed where a string of `least` bytes covers it that also starts earlier, in a document of
    smaller key or earlier in the same one. What the family wrote is deleted with the application's folder (`common.clean_up`).
    """
    if df.schema[key].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError("keys are integers")
    kind = df.schema[key].dataType.simpleString()
    doc = F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)))
    docs = df.select(doc.alias("doc"), F.col(key).alias("key"), F.col(text).alias("text"))
    cuts = sorted(set(docs.approxQuantile("doc", [k / batches for k in range(1, batches)], 0.02))) if batches > 1 else []
    family = SuffixFamily(df.sparkSession, least)
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        inside = F.lit(True) if low is None else F.col("doc") > low
        family.add(docs.where(inside if high is None else inside & (F.col("doc") <= high)))
    repeats, opened = family.results()
    tagged = docs.withColumn("tag", F.crc32("text").bitwiseAND(TAG).cast("int"))
    windows = tagged.join(_spots(opened), ["doc", "tag"]).select("doc", "text", "spots").mapInArrow(_windows(least), SCHEMA)
    nth = F.rank().over(Window.partitionBy("a", "b").orderBy("doc", "at"))
    told = windows.repartition("a").select("kind", "doc", "at", "n", nth.alias("nth")).where((F.col("kind") == REPEAT) | (F.col("nth") > 1)).select("doc", "at", "n")
    told.write.parquet(f"{family.path}/windows")
    told = df.sparkSession.read.schema("doc long, at long, n long").parquet(f"{family.path}/windows")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            begun, size, rows = 0, 0, []

            def made(end: int):
                part = [batch.column(0).slice(begun, end - begun), pa.array([r[0] for r in rows], pa.int64())]
                spans = pa.array([[{"start": a, "length": b - a} for a, b in zip(*r[1], strict=True)] for r in rows], span_type)
                return pa.RecordBatch.from_arrays([*part, spans, pa.array([r[2] for r in rows], pa.binary())], names=["key", "n_bytes", "spans", "kept"])

            for k in range(len(batch)):
                raw, spots = texts[k].as_py() or b"", batch.column(2)[k].values
                low, high = (x.tolist() for x in (_spans(raw, *(spots.field(f).to_numpy(zero_copy_only=False) for f in ("place", "n")), least) if spots is not None else (np.zeros(0, np.int64),) * 2))
                kept = b"".join(raw[a:b] for a, b in zip([0, *high], [*low, len(raw)], strict=True))
                rows.append((len(raw), (low, high), kept))
                size += len(kept)
                if size > 4 * BLOCK:
                    yield made(k + 1)
                    begun, size, rows = k + 1, 0, []
            if rows:
                yield made(len(batch))

    marked = tagged.join(_spots(repeats.union(told)), ["doc", "tag"], "left").select("key", "text", "spots")
    return marked.mapInArrow(cut, f"key {kind}, n_bytes long, spans array<struct<start:long,length:long>>, kept binary").withColumnRenamed("key", key)
