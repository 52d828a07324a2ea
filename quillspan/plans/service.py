"""The service's calls as functions over tables: ingest a corpus, search it, read its state."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.chunking import ChunkingPolicy
from ..operators.fusion import fuse_variants
from ..operators.lifecycle import IndexState
from ..operators.query_plan import plan_queries
from ..sources.files import decode_upload, media_type
from ..functions.text import safe_path, tokenize
from .ingestion import POLICY, Embed, add_files, refusal
from .stages import Models, search, variants

#: What one call may hold: a query's characters, hits, files of an upload.
MOST_QUERY, MOST_HITS, MOST_FILES = 500, 50, 100
#: Stages that the test page offers.
PAGE_STAGES = ("bm25", "bge_dense", "hybrid", "rerank_bge", "rerank_jev")


def add_uploads(state: IndexState, uploads: DataFrame, versions: str = "1", policy: ChunkingPolicy = POLICY, embed: Embed | None = None, embedding: str = "") -> tuple[DataFrame, DataFrame]:
    """Uploads (relative_path, media_type, content_base64) into the state: the actions, and what was skipped and why.

    Of several uploads of a path the last row counts. One call takes MOST_FILES files.
    """
    if (n := uploads.limit(MOST_FILES + 1).count()) > MOST_FILES:
        raise ValueError(f"a call takes {MOST_FILES} files, not {n} or more")
    content = decode_upload(F.col("content_base64"))
    path = safe_path(F.col("relative_path"))
    rows = uploads.select(path.alias("source_path"), media_type(path, F.col("media_type")).alias("media_type"), content.alias("content"))
    judged = rows.withColumn("why", F.coalesce(F.when(F.col("source_path").isNull(), "file path is empty").when(F.col("content").isNull(), "not valid base64, or too large"), refusal()))
    last = Window.partitionBy("source_path").orderBy(F.desc("n"))
    good = judged.where("why is null").withColumn("n", F.monotonically_increasing_id()).withColumn("n", F.row_number().over(last)).where("n = 1")
    done = add_files(state, good.withColumn("error", F.lit(None).cast("string")), versions, policy, embed, embedding)
    return done, judged.where("why is not null").select("source_path", "why").distinct()


def delete_source(state: IndexState, spark: SparkSession, source_path: str) -> DataFrame:
    return state.delete(spark.createDataFrame([(source_path,)], "source_path string"))


def health() -> dict[str, str]:
    return {"status": "ok"}


def skip_source(state: IndexState, source_path: str) -> None:
    """Leave a source out of commits from now on."""
    state.cancel(source_path)


def skipped_ledger(ledger: DataFrame | None, more: DataFrame) -> DataFrame:
    """The files that were left out (source_path, why), appended to those before; a cancelled one is noted once."""
    rows = more if ledger is None else ledger.unionByName(more)
    cancelled = F.col("why") == "cancelled"
    return rows.where(~cancelled).unionByName(rows.where(cancelled).distinct())


def checked_queries(queries: DataFrame) -> DataFrame:
    """Queries that are neither blank nor longer than MOST_QUERY; another one ends the read."""
    good = F.col("query").rlike(r"\S") & (F.length("query") <= MOST_QUERY)
    return queries.withColumn("query", F.when(good, F.col("query")).otherwise(F.raise_error(F.lit(f"a query needs 1 to {MOST_QUERY} characters, not all blank")).cast("string")))


def ranked_answers(chunks: DataFrame, queries: DataFrame, planned: DataFrame, stage: str, limit: int, models: Models | None, filters: Iterable[Mapping[str, str]] | None) -> DataFrame:
    forms = planned.select("qid", F.posexplode("search_queries").alias("n", "query"))
    if stage == "bm25":  # all forms in one search
        found = search(chunks, forms.select(F.struct("qid", "n").alias("qid"), "query"), stage, limit, filters).cache()  # `limit` rows for each form, read several times
        return fuse_variants(found.select("qid.qid", F.concat(F.lit("query_"), F.col("qid.n").cast("string")).alias("list"), "chunk_id", "rank", "score"), limit)
    listed = None
    for n in range(forms.agg(F.coalesce(F.max("n"), F.lit(-1)).alias("n")).first()["n"] + 1):  # forms of a query are few
        part = search(chunks, forms.where(F.col("n") == n).select("qid", "query"), stage, limit, filters, models)
        part = part.select("qid", F.lit(f"query_{n}").alias("list"), "chunk_id", "rank", "score")
        listed = part if listed is None else listed.union(part)
    if listed is None:
        return queries.where(F.lit(False)).select("qid", F.lit("").alias("chunk_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    return fuse_variants(listed, limit)


def answer_search(chunks: DataFrame, queries: DataFrame, today: date, stage: str = "bm25", limit: int = 10, models: Models | None = None, filters: Iterable[Mapping[str, str]] | None = None) -> DataFrame:
    """Planned search: every form of each query is ranked, and several are fused.

    qid, chunk_id, score, rank, and for each hit its text, source_path, the terms of the query's forms that
    it holds and the stage it comes from; beside them the query's plan: query_variants, exact_terms, filters.
    """
    if stage not in PAGE_STAGES:
        raise ValueError(f"Unknown retrieval stage: {stage}")
    if not 1 <= limit <= MOST_HITS:
        raise ValueError(f"limit must lie between 1 and {MOST_HITS}")
    planned = plan_queries(checked_queries(queries), today)
    hits = ranked_answers(chunks, queries, planned, stage, limit, models, filters)
    plan = planned.select("qid", F.col("search_queries").alias("query_variants"), "exact_terms", "filters", F.array_distinct(tokenize(F.array_join("search_queries", " "))).alias("_terms"))
    found = hits.join(plan, "qid").join(chunks.select("chunk_id", "text", "source_path"), "chunk_id")
    matched = F.array_intersect("_terms", tokenize(F.col("text"))).alias("matched_terms")
    return found.select("qid", "chunk_id", "score", "rank", "text", "source_path", matched, F.lit(stage).alias("source"), "query_variants", "exact_terms", "filters")


def search_forms(queries: DataFrame) -> DataFrame:
    return variants(queries)
