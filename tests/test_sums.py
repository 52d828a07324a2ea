import random

import numpy as np
from pyspark.sql import functions as F

from quillspan.operators import dense, lexical, sums


def brute(rows, queries, limit):
    """rows: id, {term: value}; queries: qid, [(term, weight)]."""
    out = set()
    for qid, asked in queries:
        scored = []
        for name, has in rows:
            score = 0.0
            for t, w in asked:
                score += has.get(t, 0.0) * w
            if any(t in has for t, _ in asked):
                scored.append((-score, name))
        out |= {(qid, name, -s) for s, name in sorted(scored)[:limit]}
    return out


def test_blocks_of_rows_and_ties_change_no_sum(monkeypatch):
    monkeypatch.setattr(sums, "PRODUCTS", 40)
    rng = random.Random(3)
    rows = [(f"c{n:03d}", {t: rng.choice([-1.5, 0.25, 0.5, 2.0]) for t in rng.sample("abcdefgh", rng.randint(0, 5))}) for n in range(150)]
    queries = [(q, [(t, rng.choice([0.5, 1.0])) for t in rng.sample("abcdefgh", 4)]) for q in range(9)]
    slots = {t: n for n, t in enumerate("abcdefgh")}
    asked = sums.Asked.of([(q, t, w) for q, ts in queries for t, w in ts], slots, list(slots))
    best = sums.Best(asked, 7)
    for low in range(0, len(rows), 32):
        some = rows[low : low + 32]
        flat = sorted((r, slots[t], x) for r, (_, has) in enumerate(some) for t, x in has.items())
        best.add(np.array([n for n, _ in some], object), tuple(np.array([f[k] for f in flat], float if k == 2 else np.int64) for k in range(3)))
    found = {(b["q"], b["chunk_id"], b["score"]) for batch in best.batches() for b in batch.to_pylist()}
    assert found == brute(rows, queries, 7)


def shuffled(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bm25_leaves_the_words_of_texts_where_they_lie(spark):
    chunks = spark.range(50).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.concat_ws(" ", F.lit("common words"), F.col("id").cast("string")).alias("text"))
    asked = spark.createDataFrame([(n, f"common words {n}") for n in range(5)], "qid long, query string")
    found = lexical.bm25(chunks, asked, 3)
    assert "hashpartitioning(chunk_id" not in shuffled(found) and "Generate" not in shuffled(found)
    assert {(r["qid"], r["chunk_id"]) for r in found.where("rank = 1").collect()} == {(n, f"c{n}") for n in range(5)}
    assert found.where("rank = 1 and qid = 2").first()["matched_terms"] == ["common", "words", "2"]


def test_weights_are_cut_to_the_terms_asked_for_before_they_are_shuffled(spark):
    weights = spark.createDataFrame([(f"c{n}", t, float(n + 1)) for n in range(6) for t in ("x", "y", f"z{n}")], "chunk_id string, term string, weight double")
    asked = spark.createDataFrame([(1, "x", 2.0), (2, "q", 1.0)], "qid long, term string, weight double")
    ids = weights.select("chunk_id").distinct()
    found = dense.sparse(weights, asked, ids, asked, 2)
    assert {tuple(r) for r in found.select("qid", "chunk_id", "score", "rank").collect()} == {(1, "c5", 12.0, 1), (1, "c4", 10.0, 2), (2, "c0", 0.0, 1), (2, "c1", 0.0, 2)}
    rows = dense._sparse(weights, asked, ids, 2)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "slot" in plan and "hashpartitioning(qid" not in shuffled(rows)


def test_postings_are_counted_where_texts_lie(spark):
    from quillspan.operators.inverted import chunk_postings

    chunks = spark.createDataFrame([("a", "p", "x y x"), ("b", "q", None), ("c", "r", "y")], "chunk_id string, source_path string, text string")
    found = chunk_postings(chunks)
    assert "Exchange" not in shuffled(found)
    assert {tuple(r) for r in found.collect()} == {("x", "a", "p", 3, 2), ("y", "a", "p", 3, 1), ("y", "c", "r", 1, 1)}
