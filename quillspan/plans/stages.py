"""Retrieval stages: which legs are ranked, how they are fused, and what follows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dense import check_vectors, dense, metadata_leg, sparse
from ..operators.encoders import embedded, weighted
from ..operators.filters import filter_chunks
from ..operators.fusion import reciprocal_rank_fusion, rerank
from ..operators.lexical import bm25
from ..operators.query_plan import expand_query
from ..operators.selection import diversify, scored_by

STAGES = ("bm25", "bge_dense", "hybrid", "rerank", "rerank_bge", "rerank_jev", "specialists")
ALIASES = {"advanced": "specialists"}
METADATA = ["source_path", "section", "language", "created_at"]
CANDIDATES = 50


@dataclass
class Models:
    """What stands behind the neural legs: tables of vectors and weights, and rerankers as functions."""

    chunk_vectors: DataFrame | None = None  # chunk_id, vector
    query_vectors: DataFrame | None = None  # qid, vector
    chunk_weights: DataFrame | None = None  # chunk_id, term, weight
    query_weights: DataFrame | None = None  # qid, term, weight
    splade_chunk_weights: DataFrame | None = None
    splade_query_weights: DataFrame | None = None
    rerankers: Mapping[str, Callable] = field(default_factory=dict)


def models_from(chunks: DataFrame, queries: DataFrame, embed: Callable | None = None, sparse_encoder: Callable | None = None, splade_encoder: Callable | None = None, rerankers: Mapping[str, Callable] | None = None) -> Models:
    """The tables behind the legs from providers: each text is encoded once, whatever the number of its forms."""
    tables: dict[str, DataFrame] = {}
    if embed:
        tables |= {"chunk_vectors": embedded(chunks, "chunk_id", "text", embed), "query_vectors": embedded(queries, "qid", "query", embed)}
    for name, encoder in (("", sparse_encoder), ("splade_", splade_encoder)):
        if encoder:
            tables |= {f"{name}chunk_weights": weighted(chunks, "chunk_id", "text", encoder), f"{name}query_weights": weighted(queries, "qid", "query", encoder)}
    return Models(**tables, rerankers=rerankers or {})


def needed(stage: str, **given: object) -> None:
    """An error that names what a stage lacks."""
    missing = [name for name, value in given.items() if value is None]
    if missing:
        raise ValueError(f"stage {stage} needs {', '.join(missing)}")


def variants(queries: DataFrame, supplied: str | None = None) -> DataFrame:
    """qid, n, query: each query's search forms."""
    forms = expand_query(F.col("query"), F.col(supplied) if supplied else None)
    return queries.select("qid", F.posexplode(forms).alias("n", "query"))


def legs(chunks: DataFrame, queries: DataFrame, models: Models, splade: bool, limit: int = CANDIDATES) -> DataFrame:
    """qid, list, chunk_id, rank, score of every leg of every variant."""
    forms = variants(queries).withColumn("key", F.struct("qid", "n"))
    asked = forms.select(F.col("key").alias("qid"), "query")
    name = lambda df, leg: df.select(F.col("qid.qid").alias("qid"), F.concat(F.lit("query_"), F.col("qid.n").cast("string"), F.lit(f":{leg}")).alias("list"), "chunk_id", "rank", "score")
    found = name(bm25(chunks, asked, limit), "bm25")
    fields = [f for f in METADATA if f in chunks.columns]  # attribute values count too
    found = found.union(name(metadata_leg(chunks, asked, fields, limit), "metadata"))
    keys = forms.select("qid", F.col("key"))
    every = lambda found: keys.join(found, "qid").select(F.col("key").alias("qid"), "chunk_id", "rank", "score")  # noqa: E731  the query's own result, for each of its forms
    if models.chunk_vectors is not None:
        needed("hybrid", query_vectors=models.query_vectors)
        here = models.chunk_vectors.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
        wanted = models.query_vectors.join(keys.select("qid"), "qid", "left_semi")
        found = found.union(name(every(dense(here, wanted, limit)), "vector"))
    for leg, own, theirs, on in (("sparse", models.chunk_weights, models.query_weights, True), ("splade", models.splade_chunk_weights, models.splade_query_weights, splade)):
        if on and own is not None:
            weights = theirs.join(keys.select("qid"), "qid", "left_semi")
            found = found.union(name(every(sparse(own, weights, chunks, keys.select("qid"), limit)), leg))
    return found


def search(chunks: DataFrame, queries: DataFrame, stage: str = "hybrid", limit: int = 10, filters: Iterable[Mapping[str, str]] | Mapping[str, object] | None = None, models: Models | None = None) -> DataFrame:
    """qid, chunk_id, score, rank of a stage; filters come first, so statistics are of what is left."""
    stage, models = ALIASES.get(stage, stage), models or Models()
    eligible = filter_chunks(chunks, filters)
    if stage not in STAGES:
        raise ValueError(f"Unknown retrieval stage: {stage}")
    columns = ["qid", "chunk_id", "score", "rank"]
    if stage == "bm25":
        return bm25(eligible, queries, limit).select(*columns)
    if stage == "bge_dense":
        needed(stage, chunk_vectors=models.chunk_vectors, query_vectors=models.query_vectors)
        check_vectors(eligible, models.chunk_vectors)
        here = models.chunk_vectors.join(eligible.select("chunk_id"), "chunk_id", "left_semi")
        return dense(here, models.query_vectors.join(queries.select("qid"), "qid", "left_semi"), limit).select(*columns)
    fused = reciprocal_rank_fusion(legs(eligible, queries, models, stage == "specialists"), CANDIDATES)
    if stage == "hybrid":
        return fused.where(F.col("rank") <= limit).select(*columns)
    name = "rerank_jev" if stage == "rerank_jev" else "rerank_bge"
    needed(stage, **{name: models.rerankers.get(name)})
    texts = fused.join(eligible.select("chunk_id", "text"), "chunk_id").join(queries.select("qid", "query"), "qid")
    scores = scored_by(texts, models.rerankers[name])
    better = rerank(fused.select(*columns), scores).join(eligible.select("chunk_id", "text"), "chunk_id")
    picked = diversify(better, limit)
    return picked.join(better.select("qid", "chunk_id", "score"), ["qid", "chunk_id"]).select(*columns)
