"""Statistics of many filters in one pass, dense search by blocks, and the range join of chunks and blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.operators import chunking, dense
from quillspan.operators.filters import filter_chunks, filter_key, with_filter_keys
from quillspan.operators.lexical import bm25, bm25_by_filters

FILTERS = "array<struct<field:string,operator:string,value:string>>"


def test_filters_of_all_queries_are_counted_in_one_pass(spark):
    draw = random.Random(6)
    rows = [(f"c{k}", f"d/{k}{draw.choice(('.pdf', '.PY', '.md'))}", f"2026-0{draw.randrange(1, 8)}-03", " ".join(draw.choice("ab cd ef gh".split()) for _ in range(draw.randrange(12))), {"origin": draw.choice(("Scan", "mail"))}) for k in range(60)]
    chunks = spark.createDataFrame(rows, "chunk_id string, source_path string, created_at string, text string, attributes map<string,string>")
    sets = [
        [], [("file_extension", "equals", ".pdf")], [("file_extension", "equals", ".py"), ("created_at", "gte", "2026-03-01")],
        [("created_at", "lt", "2026-03-01")], [("source_path", "ends_with", "7.MD")], [("origin", "equals", "scan")], [("nothing", "equals", "x")],
    ]
    asked = spark.createDataFrame([(n, "ab gh ab ef", list(reversed(s)) if n % 2 else s) for n, s in enumerate(sets * 2)], f"qid long, query string, filters {FILTERS}").withColumn("key", filter_key(F.col("filters")))
    assert asked.select("key").distinct().count() == len(sets)
    keyed = with_filter_keys(chunks, asked.groupBy("key").agg(F.first("filters").alias("filters")))
    got = bm25_by_filters(keyed, asked.select("qid", "query", "key"), 5)
    want = []
    for n, s in enumerate(sets * 2):
        eligible = filter_chunks(chunks, [{"field": f, "operator": o, "value": v} for f, o, v in s])
        want += bm25(eligible, asked.where(F.col("qid") == n).select("qid", "query"), 5).collect()
    order = lambda rows: sorted((r.qid, r["rank"], r.chunk_id, r.score, tuple(r.matched_terms)) for r in rows)
    assert order(got.collect()) == order(want) and len(want) > 20


@pytest.mark.parametrize("block_bytes", [64_000_000, 100])
def test_dense_by_blocks_equals_sums_in_order(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(dense, "BLOCK_BYTES", block_bytes)
    draw = np.random.default_rng(3)
    vectors = draw.integers(-3, 4, (200, 6)).astype(float)  # many ties
    asked = draw.integers(-3, 4, (9, 6)).astype(float)
    rows = spark.createDataFrame([(f"c{k:03d}", v.tolist()) for k, v in enumerate(vectors)], "chunk_id string, vector array<float>").repartition(5)
    queries = spark.createDataFrame([((k, "x"), v.tolist()) for k, v in enumerate(asked)], "qid struct<n:long,s:string>, vector array<double>")
    got = {(r.qid.n, r["rank"]): (r.chunk_id, r.score) for r in dense.dense(rows, queries, 7).collect()}
    want = {(k, n): x for k, q in enumerate(asked) for n, x in enumerate(sorted(((f"c{j:03d}", float(v @ q)) for j, v in enumerate(vectors)), key=lambda x: (-x[1], x[0]))[:7], 1)}
    assert got == want
    assert dense.dense(rows.limit(0), queries, 7).count() == 0 == dense.dense(rows, queries.limit(0), 7).count() == dense.dense(rows, queries, 0).count()


def test_dense_vectors_must_fit(spark):
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0])], "chunk_id string, vector array<double>")
    queries = spark.createDataFrame([(1, [1.0, 1.0])], "qid long, vector array<double>")
    with pytest.raises(Exception, match="differ in length"):
        dense.dense(rows, queries, 3).collect()
    with pytest.raises(ValueError, match="differ in length"):
        dense.dense(rows, queries.union(spark.createDataFrame([(2, [1.0])], queries.schema)), 3)
    unlike = spark.createDataFrame([("a", [float("nan"), 2.0]), ("b", [1.0, 1.0])], "chunk_id string, vector array<double>")
    assert [r.chunk_id for r in dense.dense(unlike, queries, 3).collect()] == ["b"]


def test_spans_of_a_large_group_meet_in_linear_time(spark):
    n, width = 50_000, 12
    blocks = spark.range(n).select(F.lit("d").alias("document_id"), F.lit(1).alias("group_no"), F.col("id").alias("block_no"), F.lit("ten signs.").alias("text"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("section"), F.lit(1).alias("line_start"), F.lit(0).alias("char_start"), (F.col("id") * width).alias("span_start"), (F.col("id") * width + 10).alias("span_end"))
    size = 500
    chunks = spark.range(-(-n * width // size)).select(F.lit("d").alias("document_id"), F.lit(1).alias("group_no"), F.col("id").cast("int").alias("chunk_no"), (F.col("id") * size).alias("start"), (F.col("id") * size + size).alias("end"))
    got = chunking.project_spans(chunks, blocks).groupBy("chunk_no").agg(F.count("*").alias("n"), F.min("block_no").alias("a"), F.max("block_no").alias("b")).collect()
    want = {c: [k for k in range(c * size // width - 1, (c + 1) * size // width + 1) if 0 <= k < n and max(k * width, c * size) < min(k * width + 10, (c + 1) * size)] for c in range(-(-n * width // size))}
    assert {r.chunk_no: (r.n, r.a, r.b) for r in got} == {c: (len(k), k[0], k[-1]) for c, k in want.items()}
    plan = chunking.project_spans(chunks, blocks)._jdf.queryExecution().executedPlan().toString()
    assert "_stretch" in plan.split("Join", 2)[2]
