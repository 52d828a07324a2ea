"""Comparison of retrieval stages on labelled queries, as typed or planned."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce
from statistics import median
from time import perf_counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.evaluation import evaluate_retrieval, macro
from ..operators.filters import active, filter_key, with_filter_keys
from ..operators.fusion import fuse_variants
from ..operators.lexical import bm25_by_filters
from ..operators.query_plan import plan_queries
from .stages import Models, search


def planned_search(chunks: DataFrame, queries: DataFrame, stage: str, k: int, today: date, models: Models | None = None) -> DataFrame:
    """qid, chunk_id, score, rank with each query's explicit filters and all its forms.

    Corpus statistics depend on the filters. For BM25 they are counted for all sets of filters in one pass over
    the chunks, and all forms are searched at once. Other stages are searched once for each set of filters; of those there are as
    many as the labelled queries name, which people write.
    """
    planned = plan_queries(queries, today).withColumn("filters", active(F.col("filters"))).withColumn("key", filter_key(F.col("filters"))).select("qid", "key", "filters", "search_queries").cache()  # a row for each query, read several times
    if stage == "bm25":
        sets = planned.groupBy("key").agg(F.first("filters").alias("filters"))
        forms = planned.select("qid", "key", F.posexplode("search_queries").alias("n", "query"))
        found = bm25_by_filters(with_filter_keys(chunks, sets), forms.select(F.struct("qid", "n").alias("qid"), "key", "query"), k).cache()  # k rows for each form, read several times
        return fuse_variants(found.select("qid.qid", F.concat(F.lit("query_"), F.col("qid.n").cast("string")).alias("list"), "chunk_id", "rank", "score"), k)
    parts = []
    for row in planned.groupBy("key").agg(F.first("filters").alias("filters"), F.max(F.size("search_queries")).alias("forms")).collect():
        own = planned.where(F.col("key") == row["key"]).select("qid", F.posexplode("search_queries").alias("n", "query"))
        kept = [f.asDict() for f in row["filters"]]
        lists = [search(chunks, own.where(F.col("n") == n).select("qid", "query"), stage, k, kept, models).withColumn("list", F.lit(f"query_{n}")) for n in range(row["forms"])]
        if lists:
            parts.append(fuse_variants(reduce(DataFrame.unionByName, lists), k))
    empty = queries.where(F.lit(False)).select("qid", F.lit("").alias("chunk_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    return reduce(DataFrame.unionByName, parts, empty)


def compare(chunks: DataFrame, gold: DataFrame, stages: Sequence[str] = ("bm25",), modes: Sequence[str] = ("raw", "processed"), k: int = 3, today: date | None = None, models: Models | None = None, timed: int = 0) -> DataFrame:
    """A row for each stage and mode: recall, mrr, no_headroom, batch_ms, and first_ms and warm_median_ms.

    gold has qid, query, relevant_chunk_ids. `timed` queries, the first by id, are run one by one for the
    latencies; the batch has all of them.
    """
    rows = []
    queries = gold.select("qid", "query")
    truth = gold.select(F.col("qid").alias("case_id"), F.explode("relevant_chunk_ids").alias("chunk_id"))
    singles = queries.orderBy("qid").limit(timed).collect() if timed else []

    def run(asked: DataFrame, stage: str, mode: str) -> DataFrame:
        return search(chunks, asked, stage, k, models=models) if mode == "raw" else planned_search(chunks, asked, stage, k, today or date.today(), models)

    for stage in stages:
        for mode in modes:
            took = []
            for one in singles:
                began = perf_counter()
                run(gold.sparkSession.createDataFrame([one], queries.schema), stage, mode).collect()
                took.append((perf_counter() - began) * 1000)
            began = perf_counter()
            found = run(queries, stage, mode)
            one = macro(evaluate_retrieval(truth, found.select(F.col("qid").alias("case_id"), "chunk_id", "rank"), k)).first()
            rows.append((stage, mode, one["recall"], one["mrr"], one["no_headroom"], (perf_counter() - began) * 1000, took[0] if took else None, median(took[1:]) if took[1:] else None))
    return gold.sparkSession.createDataFrame(rows, "stage string, query_mode string, recall double, mrr double, no_headroom boolean, batch_ms double, first_ms double, warm_median_ms double")


def report(results: DataFrame, path: str) -> None:
    """The comparison as tab-separated text."""
    results.coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
