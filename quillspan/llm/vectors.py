"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Equal vectors are taken together. The others are turned onto principal axes (fitted on a bounded
sample: any axes give the same links, good ones give them sooner), dealt into cells by the signs of
their leading components against the sample's medians, and packed into tiles. Cells whose boxes can't
hold a pair near enough are never paired. Neighbouring tiles make strips; a task takes two strips and compares
the pairs of tiles in them that are left, so that a vector is shipped once for each strip that its own is
paired with, not once for each tile. Within a pair of tiles, the products of the leading
dimensions come first; what the rest can add is at most the product of the suffix norms, and pairs
that can't reach the threshold any more are dropped, block of dimensions by block. Pairs still open are
compared whole, in double precision on the vectors as given. A pair of tiles returns at most a row for
each vector: how many links it has found, and its smallest linked neighbour's component there.

A vector that is null, zero or holds null or non-finite components links with nothing, as do vectors of
different lengths; equal rows count each; an empty table gives an empty result; further columns aren't
read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_frames, held, let_go, saved
from .graph import components, local_components

THRESHOLD = 0.9
TILE = 1024
#: Vectors, and their bytes, of a strip.
STRIP, STRIP_BYTES = 16_384, 64_000_000
#: Numbers (vectors times dimensions) in the sample that the axes are fitted on.
SAMPLE_NUMBERS = 2_000_000
#: Cells are 2 to this power at most; their pairs are listed on the driver.
MOST_SPLITS = 9
#: Strips whose meetings are listed on the driver at most; of more, each meets each.
MOST_LISTED = 512
LEAD = 8
SLACK = 1e-4  # of sums in single precision, which only rule pairs out


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; halved or doubled first, which is exact, so that no square overflows or vanishes."""
    y = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return y / np.linalg.norm(y, axis=1, keepdims=True)


def principal_axes(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Axes (columns, the strongest first) of unit vectors, and the medians along them."""
    unit = unit_rows(sample)
    _, axes = np.linalg.eigh(unit.T @ unit)
    axes = np.ascontiguousarray(axes[:, ::-1])
    return axes, np.median(unit @ axes, axis=0)


def cell_pairs(low: np.ndarray, high: np.ndarray, rest: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Pairs of cells whose boxes (low, high) and suffix norms (rest) leave room for a cosine at the threshold."""
    found = []
    for i in range(len(low)):
        ends = np.stack([low[i] * low[i:], low[i] * high[i:], high[i] * low[i:], high[i] * high[i:]])
        bound = ends.max(axis=0).sum(axis=1) + rest[i] * rest[i:]
        gap = np.maximum(0, np.maximum(low[i:] - high[i], low[i] - high[i:]))
        bound = np.minimum(bound, 1 - (gap**2).sum(axis=1) / 2)
        found += [(i, i + int(j)) for j in np.flatnonzero(bound >= threshold - SLACK)]
    return found


def linked(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (in a, in b) of the pairs with a cosine at the threshold; a and b in double precision, as given."""
    ua, ub = unit_rows(a), unit_rows(b)
    ra, rb = (ua @ axes).astype(np.float32), (ub @ axes).astype(np.float32)
    d, at, total, open_ = ra.shape[1], 0, None, None
    step = max(8, d // 4)
    while at < d:
        upto = min(d, at + step)
        if open_ is None:
            part = ra[:, at:upto] @ rb[:, at:upto].T
            total = part if total is None else total + part
            sa, sb = (np.sqrt(np.maximum(0, np.einsum("ij,ij->i", x[:, upto:], x[:, upto:]))) for x in (ra, rb))
            keep = total >= (threshold - SLACK) - sa[:, None] * sb[None, :]
            n = int(np.count_nonzero(keep))
            if not n:
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            if n * 8 < keep.size:  # few enough to go on one by one
                open_ = np.nonzero(keep)
                total = total[open_]
        else:
            i, j = open_
            total = total + np.einsum("ij,ij->i", ra[i, at:upto], rb[j, at:upto])
            sa, sb = (np.sqrt(np.maximum(0, np.einsum("ij,ij->i", x[:, upto:], x[:, upto:]))) for x in (ra, rb))
            keep = total >= threshold - SLACK - sa[i] * sb[j]
            open_, total = (i[keep], j[keep]), total[keep]
        at = upto
    i, j = open_ if open_ is not None else np.nonzero(keep)
    good = [np.zeros(0, bool)]
    for k in range(0, len(i), 1 << 16):
        x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
        good.append(np.einsum("ij,ij->i", ua[x], ub[y]) >= threshold)
    good = np.concatenate(good)
    return i[good], j[good]


def _of_one_length(df: DataFrame, d: int, threshold: float, tile: int) -> DataFrame:
    """id, n, parent for vectors (id, n copies, embedding) of d components; ids may repeat."""
    spark = df.sparkSession
    real = np.float32 if isinstance(df.schema["embedding"].dataType.elementType, T.FloatType) else np.float64
    total = df.count()
    sample = df.orderBy(F.xxhash64("id")).limit(max(d, SAMPLE_NUMBERS // d)).select("embedding").toPandas()
    axes, middle = principal_axes(np.stack(sample["embedding"].to_numpy()).astype(np.float64))
    splits = min(MOST_SPLITS, d, max(0, math.ceil(math.log2(max(1, total / tile)))))
    lead = min(max(LEAD, splits), d)

    def locate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.stack(frame["embedding"].to_numpy()).astype(real)
            turned = unit_rows(x.astype(np.float64)) @ axes
            cell = ((turned[:, :splits] > middle[:splits]) << np.arange(splits)).sum(axis=1) if splits else np.zeros(len(x), np.int64)
            rest = np.linalg.norm(turned[:, lead:], axis=1)
            yield pd.DataFrame({"cell": cell, "id": frame["id"], "n": frame["n"], "lead": list(turned[:, :lead]), "rest": rest, "vector": [v.tobytes() for v in x]})

    located = held(by_frames(df, locate, "cell int, id long, n long, lead array<double>, rest double, vector binary"))
    boxes = located.groupBy("cell").agg(
        F.count("*").alias("size"), F.max("rest").alias("rest"),
        *[f(F.get("lead", F.lit(k))).alias(f"{name}{k}") for k in range(lead) for name, f in (("low", F.min), ("high", F.max))],
    ).orderBy("cell").toPandas()  # a row for each cell, 2**MOST_SPLITS at most
    low, high = (boxes[[f"{name}{k}" for k in range(lead)]].to_numpy() for name in ("low", "high"))
    chunks = -(-boxes["size"].to_numpy() // tile)
    cells = boxes["cell"].to_numpy()
    open_cells = np.zeros((1 << splits, 1 << splits), bool)
    for i, j in cell_pairs(low, high, boxes["rest"].to_numpy(), threshold):
        open_cells[cells[i], cells[j]] = open_cells[cells[j], cells[i]] = True
    # tiles numbered through the cells, and strips of as many as a task may hold, but enough to keep the cores busy
    width = 16 + d * np.dtype(real).itemsize
    n_tiles = int(chunks.sum())
    fewest = math.ceil(2 * math.sqrt(spark.sparkContext.defaultParallelism))
    tiles_each = max(1, min(STRIP // tile, STRIP_BYTES // (tile * width), -(-n_tiles // fewest)))
    first_tile = np.concatenate(([0], np.cumsum(chunks)))
    cell_of_tile = np.repeat(cells, chunks)
    n_strips = -(-n_tiles // tiles_each)
    in_strip = [np.unique(cell_of_tile[k * tiles_each : (k + 1) * tiles_each]) for k in range(n_strips)] if n_strips <= MOST_LISTED else None
    sizes = spark.createDataFrame([(int(c), int(n), int(at)) for c, n, at in zip(cells, chunks, first_tile[:-1], strict=True)], "cell int, chunks int, first int")
    place = F.col("first") + F.pmod(F.xxhash64("id"), "chunks")
    dealt = located.join(F.broadcast(sizes), "cell").select("cell", place.cast("int").alias("tile"), "id", "n", "vector")
    partners = F.sequence(F.lit(0), F.lit(n_strips - 1))
    if in_strip is not None:  # strips whose cells are all apart never meet
        meet = [[k for k in range(n_strips) if open_cells[np.ix_(in_strip[s], in_strip[k])].any()] for s in range(n_strips)]
        listed = spark.createDataFrame(list(enumerate(meet)), "strip int, partners array<int>")
    shipped = dealt.withColumn("strip", F.floor(F.col("tile") / tiles_each).cast("int"))
    shipped = shipped.join(F.broadcast(listed), "strip") if in_strip is not None else shipped.withColumn("partners", partners)
    shipped = shipped.withColumn("other", F.explode("partners")).select(F.least("strip", "other").alias("a"), F.greatest("strip", "other").alias("b"), "cell", "tile", "id", "n", "vector")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["tile", "id"], ignore_index=True)
        a, b = int(frame["a"].iloc[0]), int(frame["b"].iloc[0])
        tiles, starts = np.unique(frame["tile"].to_numpy(), return_index=True)
        ends = np.append(starts[1:], len(frame))
        ids, copies, of = frame["id"].to_numpy(np.int64), frame["n"].to_numpy(np.int64), frame["cell"].to_numpy()
        vectors = np.frombuffer(b"".join(frame["vector"]), real).reshape(len(frame), d)
        links, left, right = np.zeros(len(frame), np.int64), [], []
        for p, (s, e) in enumerate(zip(starts, ends, strict=True)):
            x = vectors[s:e].astype(np.float64)
            for q in range(p, len(tiles)):
                if sorted((tiles[p] // tiles_each, tiles[q] // tiles_each)) != [a, b] or not open_cells[of[s], of[starts[q]]]:
                    continue
                y = x if p == q else vectors[starts[q] : ends[q]].astype(np.float64)
                i, j = linked(x, y, axes, threshold)
                if p == q:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    i, j = i + s, j + starts[q]
                    links += np.bincount(i, copies[j], len(frame)).astype(np.int64) + np.bincount(j, copies[i], len(frame)).astype(np.int64)
                    found = local_components(len(frame), np.concatenate([*left, i]), np.concatenate([*right, j]))
                    at = np.flatnonzero(found != np.arange(len(frame)))
                    left, right = [at], [found[at]]  # what is linked so far, in as few links as rows
        at = np.flatnonzero(links)
        label = local_components(len(frame), np.concatenate(left), np.concatenate(right)) if len(at) else np.zeros(0, np.int64)
        least = np.full(len(frame), np.iinfo(np.int64).max)  # the smallest id stands for a component
        if len(at):
            np.minimum.at(least, label, ids)
        return pd.DataFrame({"id": ids[at], "n": links[at], "parent": least[label[at]] if len(at) else ids[at]})

    found = saved(shipped.groupBy("a", "b").applyInPandas(compare, "id long, n long, parent long"), small=True)
    let_go(located)
    return found


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """key, n_links, component_id and kept of every row."""
    if threshold <= 0:
        raise ValueError("the threshold must be positive")
    v = F.col("embedding")
    usable = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(key).alias("id"), F.col(vector).alias("embedding")).withColumn("usable", F.coalesce(usable, F.lit(False)))
    keyed = rows.select("id", F.when(F.col("usable"), F.xxhash64("embedding")).alias("h1"), F.when(F.col("usable"), F.xxhash64(F.lit(1), "embedding")).alias("h2"), F.when(F.col("usable"), F.col("embedding")).alias("embedding"))
    unique = saved(keyed.where("h1 is not null and id is not null").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.min_by("embedding", "id").alias("embedding")))
    lengths = [r[0] for r in unique.select(F.size("embedding")).distinct().collect()]
    found = None
    for d in sorted(lengths):
        part = _of_one_length(unique.where(F.size("embedding") == d).select("id", "n", "embedding"), d, threshold, tile)
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    linked_to = found.groupBy("id").agg(F.sum("n").alias("links"))
    groups = components(found, "id", "parent")
    whole = unique.select("h1", "h2", "n", "id").join(linked_to, "id", "left").join(groups, "id", "left").select("h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component"))
    joined = keyed.drop("embedding").join(whole, ["h1", "h2"], "left")
    component = F.coalesce("component", "id")
    return joined.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
