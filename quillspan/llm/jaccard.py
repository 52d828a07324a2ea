"""Exact Jaccard join of documents' shingle sets through a token-group matrix.

The tokens are parts of a set, shingles taken together by ranges of their hashes: these are divided into more ranges than two linked sets can differ in
elements, so linked sets share some parts whole, and where a set has few empty parts, filled
ones. A part's hash is a token; sets of like size use the same ranges, and sets near the end of a size
class take those of the next one too.
Similar documents, those that share a token with the same smallest set (the pivot), form a group, and
the matrix holds the union of the tokens that each group's members have. A query can only link into groups
whose token union it meets in as many tokens as linked sets share at least: those are opened, unless
all that holds those tokens is already connected with the query. Opening compares a tile of queries with a tile of members: queries whose
overlap with the tile's union of shingles is too small are dropped, the others' intersections are
counted by one matrix product, and what has the similarity is linked.

So links come by two routes, which `set_links` names: members of a group that share enough tokens with its
pivot are compared with it first, and what that leaves unconnected is found by opening groups.

No bucket, group or candidate list has a cap. Equal sets are taken together and once per task before
the shuffle; comparisons with the pivots come first, so that a large group of near copies collapses to
few components before any group is opened.

Null and empty texts, or ones without words, have no shingle and link with nothing; texts of fewer
words than a shingle are one shingle; equal rows share their component; rows with a null key get their
group's component; an empty table gives an empty result; further columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, arrow_rows, blocks, by_frames, framed, free_name, held, mix64, saved, signed
from .graph import components, local_components
from .shingles import shingle_sets
from .tokens import forget

#: Sets, and their shingles, in a tile of an opened group.
TILE, TILE_SHINGLES = 512, 200_000
#: Tokens that linked sets share at least; in classes that differ in few elements, one part counts as so many.
SHARED, FEW = 3, 16
#: Ranges beyond those needed, so that next to no set has to count empty ones.
SPARE = 10
BLOCK = 500_000
#: Bytes of packed texts that are opened at once for pairs.
PAIR_BYTES = 1_000_000
GROWTH = 1.5
#: Rows of tokens that go between the JVM and Python at once.
ROWS = 50_000
_SEEDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344], np.uint64)


def set_id(hashes: np.ndarray) -> tuple[int, int]:
    """A set's identity: two signed 64-bit hashes of its elements and their number."""
    sums = np.array([mix64(hashes ^ seed).sum(dtype=np.uint64) for seed in _SEEDS], np.uint64)
    a, b = signed(mix64(sums + np.uint64(len(hashes)))).tolist()
    return a, b


class Parts:
    """Tokens of sets: the hashes of their parts, by size class, for a similarity of num / den."""

    def __init__(self, num: int, den: int):
        if num * 10 < den * 7 or num > den:
            raise ValueError("the similarity must lie between 0.7 and 1")
        self.num, self.den = num, den
        self.ends = [1]
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def size_class(self, n: int) -> int:
        while self.ends[-1] <= n:
            self.ends.append(int(self.ends[-1] * GROWTH) + 1)
        return int(np.searchsorted(self.ends, n, side="right"))

    def differ(self, n: int, c: int) -> int:
        """In how many elements a set of n can differ from a linked one of at least its size, in a class."""
        return (n + min(n * self.den // self.num, self.ends[c] - 1)) * (self.den - self.num) // (self.den + self.num)

    def table(self, c: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Bounds of a class's ranges, a salt for each, and how many parts linked sets share."""
        if c not in self.tables:
            largest = self.ends[c] - 1
            most = self.differ(largest, c)
            shared = 1 if most < FEW else SHARED
            n = most + shared
            n += math.ceil(1.5 * n * math.exp(-largest / n)) + SPARE  # more than stay empty
            bounds = np.array([(j << 64) // n for j in range(1, n)], np.uint64)
            self.tables[c] = bounds, mix64(np.arange(n, dtype=np.uint64) + (np.uint64(c + 1) << np.uint64(40))), shared
        return self.tables[c]

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        n, sums, found = len(hashes), np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(hashes)))), []
        c = self.size_class(n)
        classes = [c]
        if n * self.den >= self.num * self.ends[c]:  # near enough to the next class's smallest sets
            self.size_class(self.ends[c])
            classes.append(c + 1)
        for each in classes:
            bounds, salts, shared = self.table(each)
            cut = np.concatenate(([0], np.searchsorted(hashes, bounds), [n]))
            tokens, filled = mix64(sums[cut[1:]] - sums[cut[:-1]] + salts), cut[1:] > cut[:-1]
            # where even then enough filled parts must be shared, empty ones, which many sets have in common, aren't needed
            if int(filled.sum()) >= self.differ(n, each) + shared:
                tokens = tokens[filled]
            found += [tokens] if shared == SHARED else [mix64(tokens + np.uint64(k)) for k in range(SHARED)]
        return signed(np.concatenate(found))


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


def open_tile(queries: list[np.ndarray], members: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (query, member) of the pairs that have the similarity."""
    union, column = np.unique(np.concatenate(members), return_inverse=True)
    inside = []
    for q in queries:
        at = np.searchsorted(union, q)
        at[at == len(union)] = 0
        inside.append(at[union[at] == q])
    size = np.array([len(q) for q in queries])
    may = np.flatnonzero(np.array([len(x) for x in inside]) * den >= num * size)
    if not len(may):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = np.array([len(m) for m in members])
    owner = np.repeat(np.arange(len(members)), sizes)
    count = np.zeros((len(may), len(members)), np.float32)
    rows = np.concatenate([np.full(len(inside[q]), k) for k, q in enumerate(may)])
    cols = np.concatenate([inside[q] for q in may])
    width = max(1024, 8_000_000 // (len(may) + len(members)))
    for low in range(0, len(union), width):  # the product by slices of the union, in bounded memory
        here, there = (cols >= low) & (cols < low + width), (column >= low) & (column < low + width)
        a = np.zeros((len(may), min(width, len(union) - low)), np.float32)
        b = np.zeros((len(members), a.shape[1]), np.float32)
        a[rows[here], cols[here] - low] = 1
        b[owner[there], column[there] - low] = 1
        count += a @ b.T
    both = count.astype(np.int64)
    i, j = np.nonzero(den * both >= num * (size[may][:, None] + sizes[None, :] - both))
    return may[i], j


def set_links(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, num: int = 90, den: int = 100, tile: int = TILE) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Rows (key, n, set), the least key of each set, and links (a, b, route) between sets that connect all linked ones.

    The route is `pivot` for links with a group's pivot, `group` for those that opened groups give.
    """
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = df.schema[key].dataType.simpleString()

    def to_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        for block in blocks(frames, chars=BLOCK):
            found = shingle_sets(block["text"].tolist(), words)
            yield framed([(k, len(h), *(set_id(h) if len(h) else (None, None))) for k, h in zip(block["key"].tolist(), found, strict=True)], ["key", "n", "set", "check"])

    sets = held(by_frames(docs, to_rows, f"key {kind}, n long, set long, check long"))
    # different sets of one 64-bit hash (next to none): all but the first get another
    clash = sets.where("set is not null").groupBy("set").agg(F.min("check").alias("first"), F.max("check").alias("last")).where("first < last").select("set", "first").collect()
    first = {r["set"]: r["first"] for r in clash}
    if first:
        sets = sets.join(df.sparkSession.createDataFrame(clash, "set long, first long"), "set", "left").withColumn("set", F.when(F.col("first").isNull() | (F.col("first") == F.col("check")), F.col("set")).otherwise(F.col("set").bitwiseXOR(F.col("check"))))

    def once(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, str, np.ndarray]]:
        """Set, text and hashes of each set, once in a task."""
        seen = set()
        for block in blocks(frames, chars=BLOCK):
            texts = block["text"].tolist()
            for text_, hashes in zip(texts, shingle_sets(texts, words), strict=True):
                if len(hashes):
                    me, check = set_id(hashes)
                    if first.get(me, check) != check:
                        me ^= check
                    if me not in seen:
                        seen.add(me)
                        yield me, text_, hashes

    def to_tokens(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, held, n = Parts(num, den), [], 0
        for me, _, hashes in once(frames):
            found = parts.tokens(hashes)
            held.append((found, np.full(len(found), me)))
            n += len(found)
            if n >= ROWS:
                yield pd.DataFrame({"token": np.concatenate([x for x, _ in held]), "set": np.concatenate([x for _, x in held])})
                held, n = [], 0
        if held:
            yield pd.DataFrame({"token": np.concatenate([x for x, _ in held]), "set": np.concatenate([x for _, x in held])})

    tokens = by_frames(docs.select("text"), to_tokens, "token long, set long")
    runs = tokens.repartition("token").sortWithinPartitions("token", "set")
    shared = saved(runs.mapInArrow(_pivots, "set long, token long, pivot long"), small=True)
    lead = sets.where("set is not null").groupBy("set").agg(F.min("key").alias("lead"))
    if shared.isEmpty():
        links = None
    else:
        enough = shared.groupBy("set").count().where(F.col("count") >= SHARED).select("set")
        wanted = enough.join(lead, "set").select(F.col("lead").alias("key")).distinct()

        def to_sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows: list[tuple[int, int, bytes]] = []
            size = 0
            for me, text_, hashes in once(frames):
                rows.append((me, len(hashes), _pack(text_)))
                size += len(rows[-1][2])
                if size > PAIR_BYTES:
                    yield framed(rows, ["set", "n", "body"])
                    rows, size = [], 0
            yield framed(rows, ["set", "n", "body"])

        wanted = saved(wanted, small=True)
        few = wanted.count() <= BROADCAST_KEYS  # beyond that size texts are shuffled to their keys
        found = by_frames(docs.join(F.broadcast(wanted) if few else wanted, docs["key"].eqNullSafe(wanted["key"]), "left_semi"), to_sets, "set long, n long, body binary")
        opened = saved(found.join(enough, "set", "left_semi").dropDuplicates(["set"]), small=True)
        links = _links(shared, opened, words, num, den, tile)
    return sets.select("key", "n", "set"), lead, links


def jaccard_components(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, num: int = 90, den: int = 100, tile: int = TILE) -> DataFrame:
    """key, n_shingles and component_id of every row; linked: den * intersection >= num * union."""
    rows, lead, links = set_links(df, key, text, words, num, den, tile)
    if links is None:
        whole = lead.select("set", F.col("lead").alias("component"))
    else:
        group = components(links, "a", "b")
        named = lead.join(group.withColumnRenamed("id", "set"), "set", "left").select("set", "lead", F.coalesce("component", "set").alias("group"))
        least = named.groupBy("group").agg(F.min("lead").alias("component"))
        whole = named.join(least, "group").select("set", "component")
    joined = rows.join(whole, "set", "left")
    return joined.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component_id"))


def _pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set, token, pivot) of tokens that several sets have, from rows sorted by token and set.

    The first set of a token's run is its pivot. Only the run that is open is kept in mind.
    """
    last = None  # the token met last, its pivot, the set met last
    alone = False  # whether that pivot is still the only set of the run
    for batch in batches:
        token, me = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        same = np.zeros(len(token), bool)
        if len(token):
            same[0] = bool(last) and (token[0], me[0]) == (last[0], last[2])
            same[1:] = (token[1:] == token[:-1]) & (me[1:] == me[:-1])
        token, me = token[~same], me[~same]
        if not len(token):
            continue
        goes_on = bool(last) and token[0] == last[0]
        opens = np.concatenate(([not goes_on], token[1:] != token[:-1]))
        begin = np.maximum.accumulate(np.where(opens, np.arange(len(token)), -1))
        pivot = np.where(begin >= 0, me[begin], last[1] if goes_on else 0)
        out = ~opens | np.concatenate((~opens[1:], [False]))
        if goes_on and alone:  # the pivot itself, which the batch before left open
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (last[1], last[0], last[1])], names=["set", "token", "pivot"])
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (me, token, pivot)], names=["set", "token", "pivot"])
        last, alone = (int(token[-1]), int(pivot[-1]), int(me[-1])), bool(opens[-1])


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows without those of a group's documents whose key isn't the group's smallest.

    Keys are taken as unique: rows that repeat one stay or go together. Rows with a null key stay.
    """
    name = free_name(df.columns, "copies")
    found = jaccard_components(df, key, text, words, num, den)
    copies = saved(found.where(F.col(key) != F.col("component_id")).select(F.col(key).alias(name)).distinct(), small=True)
    few = copies.count() <= BROADCAST_KEYS  # beyond that size both sides are shuffled
    return df.join(F.broadcast(copies) if few else copies, F.col(key) == F.col(name), "left_anti")


def _pack(text: str) -> bytes:
    """A text for the shuffle: a fraction of its hashes' size, which are found again where they are compared."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(text.encode("utf-8", "surrogatepass"))


def _unpack(bodies: Sequence[bytes], words: int) -> list[np.ndarray]:
    """The sets of packed texts; equal ones are found once."""
    import zstandard

    once = {b: n for n, b in enumerate(dict.fromkeys(bodies))}
    spread = zstandard.ZstdDecompressor().decompress
    sets = shingle_sets([spread(b).decode("utf-8", "surrogatepass") for b in once], words)
    return [sets[once[b]] for b in bodies]


def _links(shared: DataFrame, opened: DataFrame, words: int, num: int, den: int, tile: int) -> DataFrame:
    """Links (a, b, route) between sets that connect all those that have the similarity."""
    of_set = lambda name: opened.select(F.col("set").alias(name), F.col("body").alias(f"{name}_body"))
    pairs = shared.where("set != pivot").groupBy("set", "pivot").count().where(F.col("count") >= SHARED).select("set", "pivot")

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            size = frame["set_body"].map(len) + frame["pivot_body"].map(len)
            for _, some in frame.groupby(size.cumsum() // PAIR_BYTES):
                both = _unpack([*some["set_body"], *some["pivot_body"]], words)
                good = [similar(a, b, num, den) for a, b in zip(both[: len(some)], both[len(some) :], strict=True)]
                yield some.loc[good, ["set", "pivot"]].rename(columns={"set": "a", "pivot": "b"})

    near = pairs.join(of_set("set"), "set").join(of_set("pivot"), "pivot").select("set", "pivot", "set_body", "pivot_body")
    made = by_frames(near, verify, "a long, b long")
    with arrow_rows(shared.sparkSession, 64):
        first = saved(made, small=True)
    component = components(first, "a", "b").withColumnRenamed("id", "set")
    group = shared.groupBy("set").agg(F.min("pivot").alias("group"))
    known = saved(group.join(component, "set", "left").select("set", "group", F.coalesce("component", "set").alias("component")), small=True)

    # the token-group matrix, with the range of components of each cell
    rows = shared.select("set", "token").join(known, "set").repartition("token")
    pending = rows.groupBy("token").agg(F.min("component").alias("l"), F.max("component").alias("h")).where("l < h").select("token")
    rows = saved(rows.join(pending, "token", "left_semi").select("token", "set", "group", "component"), small=True)  # in one shuffle
    matrix = rows.groupBy("token", "group").agg(F.min("component").alias("low"), F.max("component").alias("high")).withColumnRenamed("group", "into")
    asked = rows.select("set", "token", "component").join(matrix, "token").where("low < high or low != component").groupBy("set", "into").count()
    asked = saved(asked.where(F.col("count") >= SHARED).select("set", "into"), small=True)  # the bound on the overlap
    met = first.withColumn("route", F.lit("pivot"))
    if asked.isEmpty():
        return met
    light = opened.select("set", "n")
    tiles = F.ceil(F.greatest(F.count("*") / tile, F.sum("n") / TILE_SHINGLES)).cast("int")
    held_by = known.join(light, "set").groupBy(F.col("group").alias("into")).agg(tiles.alias("m_tiles"))
    # a row for each group; joins with it are divided where a group is large
    sizes = saved(held_by.join(asked.join(light, "set").groupBy("into").agg(tiles.alias("q_tiles")), "into"), small=True)
    members = known.select(F.col("group").alias("into"), "set", "component")
    number = lambda tiles: F.pmod(F.xxhash64("set"), F.col(tiles)).cast("int")
    m = members.join(sizes, "into").withColumn("m", number("m_tiles")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("q_tiles") - 1))).withColumn("query", F.lit(False))
    q = asked.join(known.select("set", "component"), "set").join(sizes, "into").withColumn("q", number("q_tiles")).withColumn("m", F.explode(F.sequence(F.lit(0), F.col("m_tiles") - 1))).withColumn("query", F.lit(True))
    columns = ["into", "m", "q", "query", "set", "component"]
    both = m.select(*columns).union(q.select(*columns)).join(opened.drop("n"), "set")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        a, b = frame[frame["query"]], frame[~frame["query"]]
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        i, j = open_tile(_unpack(a["body"].tolist(), words), _unpack(b["body"].tolist(), words), num, den)
        ids, place = np.unique(np.concatenate([a["set"].to_numpy(), b["set"].to_numpy()]), return_inverse=True)
        label = local_components(len(ids), place[: len(a)][i], place[len(a) :][j])
        at = np.flatnonzero(label != np.arange(len(ids)))  # a link to the smallest set connected here
        return pd.DataFrame({"a": ids[at], "b": ids[label[at]]})

    opened_links = saved(both.groupBy("into", "m", "q").applyInPandas(compare, "a long, b long"), small=True)
    return met.union(opened_links.withColumn("route", F.lit("group")))

