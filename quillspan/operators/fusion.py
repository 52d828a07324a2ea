"""Reciprocal-rank fusion and reranking."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import ranked


def reciprocal_rank_fusion(lists: DataFrame, limit: int, constant: int = 60, weights: Mapping[str, float] | None = None) -> DataFrame:
    """qid, chunk_id, score, best_rank, rank, signals from lists (qid, list, chunk_id, rank, score).

    A list counts a chunk by its best rank. Scores add up in the lists' order by name; ties go to the
    better single rank, then to the id.
    """
    if limit < 0:
        raise ValueError("limit cannot be negative")
    if constant <= 0:
        raise ValueError("rank constant must be positive")
    if limit and any(w < 0 for w in (weights or {}).values()):
        raise ValueError("weights cannot be negative")
    weight = F.lit(1.0)
    if weights:
        weight = F.coalesce(F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, float(w))])[F.col("list")], F.lit(1.0))
    best = lists.groupBy("qid", "list", "chunk_id").agg(F.min(F.struct("rank", "score")).alias("b"))
    part = weight / (F.lit(float(constant)) + F.col("b.rank"))
    parts = best.select("qid", "chunk_id", F.struct("list", F.col("b.rank").alias("rank"), F.col("b.score").alias("raw_score"), part.alias("rrf_contribution")).alias("s"))
    fused = parts.groupBy("qid", "chunk_id").agg(F.array_sort(F.collect_list("s")).alias("signals"))
    scored = fused.select("qid", "chunk_id", F.aggregate("signals", F.lit(0.0), lambda a, s: a + s["rrf_contribution"]).alias("score"), F.array_min("signals.rank").alias("best_rank"), "signals")
    return ranked_with_best(scored, limit)


def fuse_candidates(limit: int, constant: int = 60, weights: Mapping[str, float] | None = None, **lists: DataFrame) -> DataFrame:
    """Fused results of named lists (qid, chunk_id, rank, score): lexical, vector and any others."""
    named = [df.select("qid", F.lit(name).alias("list"), "chunk_id", "rank", "score") for name, df in lists.items()]
    if not named:
        raise ValueError("there is no list to fuse")
    return reciprocal_rank_fusion(reduce(DataFrame.union, named), limit, constant, weights)


def ranked_with_best(scored: DataFrame, limit: int) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("qid").orderBy(F.desc("score"), "best_rank", "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def fuse_variants(lists: DataFrame, limit: int) -> DataFrame:
    """Results of one variant as they are; of several, fused (qid, list, chunk_id, rank, score)."""
    n = lists.groupBy("qid").agg(F.count_distinct("list").alias("n"))
    with_n = lists.join(n, "qid")
    single = with_n.where("n = 1").select("qid", "chunk_id", "score", "rank").where(F.col("rank") <= limit)
    fused = reciprocal_rank_fusion(with_n.where("n > 1").drop("n"), limit)
    return single.unionByName(fused.select("qid", "chunk_id", "score", "rank"))


def rerank(candidates: DataFrame, scores: DataFrame, limit: int | None = None) -> DataFrame:
    """candidates (qid, chunk_id, score, rank) by new scores (qid, chunk_id, new_score), the old rank and score beside.

    Each candidate needs a score.
    """
    joined = candidates.join(scores, ["qid", "chunk_id"], "left")
    checked = F.coalesce("new_score", F.raise_error(F.lit("reranker must return exactly one score per candidate")).cast("double"))
    rescored = joined.select("qid", "chunk_id", checked.alias("score"), F.col("rank").alias("pre_rank"), F.col("score").alias("pre_score"))
    return ranked(rescored, limit)
