"""Ranking of scored candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(scored: DataFrame, limit: int | None = None, by: str = "qid", score: str = "score", tie: str = "chunk_id") -> DataFrame:
    """scored with `rank` from 1 in each query: best score first, then by id; up to a limit."""
    order = Window.partitionBy(by).orderBy(F.desc(score), tie)
    out = scored.withColumn("rank", F.row_number().over(order))
    return out if limit is None else out.where(F.col("rank") <= max(0, limit))
