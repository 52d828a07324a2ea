"""Dense, learned-sparse and metadata legs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.text import tokenize
from .lexical import SENT_ROWS
from .ranking import ranked
from .sums import Asked, Entries, best_sums


def dot(a: Column, b: Column) -> Column:
    """Raw dot product, added in order in double precision; unlike lengths are an error."""
    same = F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x))
    return F.coalesce(same, F.raise_error(F.lit("query and chunk vectors differ in length")).cast("double"))


#: Bytes of query vectors that are held against all rows at once; more go block by block. Products that a task holds at once.
BLOCK_BYTES, PRODUCTS = 64_000_000, 4_000_000


def dense(chunks: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """qid, chunk_id, score, rank: every chunk (chunk_id, vector) against each query (qid, vector).

    A stated set of queries is held against all rows, block by block of bounded size. A task multiplies the
    block with blocks of its rows and keeps each query's best, so only those are shuffled. What may be among
    the best is added up in order in double precision, so scores and ties don't depend on blocks. Vectors of another length, or
    none, are an error; a score that isn't a number isn't ranked.
    """
    asked = queries.select("qid", F.col("vector").cast("array<double>").alias("vector"))
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("numbers")).first()
    blocks = max(1, -(-size["n"] * max(1, size["numbers"] or 1) * 8 // BLOCK_BYTES))
    parts = [_against(chunks, asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == k) if blocks > 1 else asked, max(0, limit)) for k in range(blocks)]
    return ranked(reduce(DataFrame.union, parts), limit)


def _against(chunks: DataFrame, block: DataFrame, limit: int) -> DataFrame:
    """The best of each partition for each query of a block."""
    spark, rows = chunks.sparkSession, block.collect()  # bounded by BLOCK_BYTES
    lengths = {len(r["vector"] or ()) for r in rows}
    if len(lengths) > 1:
        raise ValueError("query vectors differ in length")
    sent = spark.sparkContext.broadcast(np.array([r["vector"] for r in rows], np.float64).reshape(len(rows), max(lengths, default=0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        norms = np.sqrt((q * q).sum(axis=1))
        floor = np.full(len(q), -np.inf)  # a query's worst score of those kept, once there are enough
        held = pd.DataFrame({"q": np.zeros(0, np.int64), "score": np.zeros(0), "chunk_id": np.zeros(0, object)})

        def best(rows: pd.DataFrame) -> pd.DataFrame:
            kept = rows.sort_values(["q", "score", "chunk_id"], ascending=[True, False, True]).groupby("q", sort=False).head(limit)
            full = kept.groupby("q")["score"].agg(["size", "min"])
            full = full[full["size"] >= limit]
            floor[full.index.to_numpy()] = full["min"].to_numpy()
            return kept

        for batch in batches:
            vectors = batch.column(1)
            if len(q) and limit and (vectors.null_count or (np.diff(vectors.offsets.to_numpy()) != q.shape[1]).any()):
                raise ValueError("query and chunk vectors differ in length")
            if not len(q) or not limit:
                continue
            ids, every = batch.column(0).to_pandas().to_numpy(), vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), q.shape[1])
            step = max(1, min(PRODUCTS // len(q), PRODUCTS // q.shape[1]))
            for low in range(0, len(batch), step):
                v = every[low : low + step]
                near = q @ v.T
                near[np.isnan(near)] = -np.inf
                long = np.sqrt((v * v).sum(axis=1))
                cut = floor.copy()
                if len(v) > limit:
                    cut = np.maximum(cut, np.partition(near, -limit, axis=1)[:, -limit])
                cut -= 1e-10 * norms * long[np.isfinite(long)].max(initial=0.0)  # more than products in another order differ by
                i, j = np.nonzero((near >= cut[:, None]) & (near > -np.inf))
                for at in range(0, len(i), max(1, PRODUCTS // q.shape[1])):
                    a, b = i[at : at + PRODUCTS // q.shape[1]], j[at : at + PRODUCTS // q.shape[1]]
                    score = np.cumsum(q[a] * v[b], axis=1)[:, -1] if q.shape[1] else np.zeros(len(a))
                    held = pd.concat([held, pd.DataFrame({"q": a, "score": score, "chunk_id": ids[low + b]})], ignore_index=True)
                if len(held) > 4 * limit * len(q):
                    held = best(held)
        held = best(held)
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array(held["q"].to_numpy(), pa.int64()), pa.array(held["chunk_id"].to_numpy(), pa.string()), pa.array(held["score"].to_numpy())], names=["q", "chunk_id", "score"])

    found = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, "q long, chunk_id string, score double")
    numbers = spark.createDataFrame([(k, r["qid"]) for k, r in enumerate(rows)], StructType([StructField("q", LongType()), StructField("qid", block.schema["qid"].dataType)]))
    return found.join(F.broadcast(numbers), "q").select("qid", "chunk_id", "score")


def missing_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks that have no vector."""
    return chunks.select("chunk_id").join(vectors.select("chunk_id"), "chunk_id", "left_anti")


def check_vectors(chunks: DataFrame, vectors: DataFrame) -> None:
    """An error, with how many and the first, where chunks have no vector."""
    missing = missing_vectors(chunks, vectors).agg(F.count("*").alias("n"), F.min("chunk_id").alias("first")).first()
    if missing["n"]:
        raise ValueError(f"{missing['n']} chunks have no vector, the first of them {missing['first']}")


def sparse(chunk_weights: DataFrame, query_weights: DataFrame, eligible: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """Sum over shared terms of the weights' products; chunks without one rank too, with 0.

    chunk_weights: chunk_id, term, weight; query_weights: qid, term, weight.
    """
    limit = max(0, limit)
    asked = query_weights.where("qid is not null and term is not null").select("qid", "term", F.col("weight").cast("double").alias("weight"))
    blocks = max(1, -(-asked.count() // SENT_ROWS))
    ids = eligible.select("chunk_id").distinct()
    found = reduce(DataFrame.union, [_sparse(chunk_weights, asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == k) if blocks > 1 else asked, ids, limit) for k in range(blocks)])
    best = held_rows(ranked(found.select("qid", "chunk_id", "score"), limit))  # `limit` rows for each query, read several times
    # chunks with nothing in common come last, by id: only queries with fewer hits than the limit need them
    short = queries.select("qid").distinct().join(best.groupBy("qid").agg(F.count("*").alias("n")), "qid", "left").where(F.coalesce("n", F.lit(0)) < limit).select("qid")
    first = eligible.select("chunk_id").orderBy("chunk_id").limit(2 * limit)
    rest = short.join(F.broadcast(first), F.lit(True), "inner").join(best.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti").withColumn("score", F.lit(0.0))
    return ranked(best.drop("rank").union(rest.select("qid", "chunk_id", "score")), limit)


def _sparse(chunk_weights: DataFrame, asked: DataFrame, ids: DataFrame, limit: int) -> DataFrame:
    """The best of each partition for each query of a block: a chunk's weights of the terms asked for come together first, in one row."""
    rows = sorted(asked.collect(), key=lambda r: r["term"])  # about SENT_ROWS at most; a query's parts are added by term
    slots = {t: n for n, t in enumerate(sorted({r["term"] for r in rows}))}
    wanted = chunk_weights.sparkSession.createDataFrame(list(slots.items()), "term string, slot long")
    few = chunk_weights.join(F.broadcast(wanted.select("term")), "term", "left_semi")  # goes below an aggregate by terms that makes the weights
    own = few.join(F.broadcast(wanted), "term").groupBy("chunk_id").agg(F.collect_list(F.struct("slot", F.col("weight").cast("double").alias("weight"))).alias("weights"))

    def entries(batch: pa.RecordBatch) -> Entries:
        lists = batch.column("weights")
        flat = lists.flatten()
        row = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
        cells, place = np.unique(row * len(slots) + flat.field(0).to_numpy(), return_inverse=True)
        return cells // len(slots), cells % len(slots), np.bincount(place, flat.field(1).to_numpy(), len(cells))

    made = Asked.of([(r["qid"], r["term"], r["weight"]) for r in rows], slots, list(slots))
    return best_sums(own.join(ids, "chunk_id", "left_semi").select("chunk_id", "weights"), made, asked.schema["qid"], entries, limit)


def held_rows(rows: DataFrame) -> DataFrame:
    """A bounded number of rows that is read several times."""
    return rows.persist(StorageLevel.DISK_ONLY)


def late_interaction(queries: DataFrame) -> DataFrame:
    """The leg that is switched off: no row."""
    return queries.where(F.lit(False)).select("qid", F.lit("").alias("chunk_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))


def metadata_leg(chunks: DataFrame, queries: DataFrame, fields: list[str], limit: int = 10) -> DataFrame:
    """How many of the query's distinct terms stand in a chunk's path, metadata and attribute values; one at least.

    Queries that ask for the same terms, of those that any chunk has, are scored once. Counted where the
    chunk lies; the best of each partition are ranked. Of `attributes`, a map, all values count.
    """
    values = [F.col(f).cast("string") for f in fields if f != "attributes"]
    if "attributes" in chunks.columns:
        values.append(F.concat_ws(" ", F.map_values("attributes")))
    terms = chunks.select("chunk_id", F.array_distinct(tokenize(F.concat_ws(" ", *values))).alias("terms")).repartition("chunk_id")
    have = terms.select("chunk_id", F.explode("terms").alias("term"))
    asked = queries.select("qid", F.explode(F.array_distinct(tokenize(F.col("query")))).alias("term"))
    met = asked.join(have.select("term").distinct(), "term", "left_semi").groupBy("qid").agg(F.array_join(F.array_sort(F.collect_list("term")), " ").alias("form"))
    forms = met.select("form").distinct().select("form", F.explode(F.split("form", " ")).alias("term"))
    scored = have.join(forms, "term").groupBy("chunk_id", "form").agg(F.count("*").cast("double").alias("score"))
    best = ranked(scored.select("form", "chunk_id", "score"), limit, by="form")
    return met.join(best, "form").select("qid", "chunk_id", "score", "rank")
