import math

import pytest
from pyspark.sql import functions as F

from quillspan.operators import dense, evaluation, fusion, lexical, selection
from quillspan.plans import stages

CHUNKS = [
    ("doc-march-report:000", "march/report.txt", "Retrieval latency", "The March report has an orange chart of retrieval latency."),
    ("doc-seoul-address:000", "shots/address.txt", "Delivery", "서울특별시 강남구 delivery address"),
    ("doc-retry-example:000", "src/retry_example.py", "fetch_with_retries", "def fetch_with_retries(url): pass"),
]


@pytest.fixture
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id string, source_path string, section string, text string")


def asked(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "qid long, query string")


def test_bm25_ranks_the_matching_chunk_first(spark, chunks):
    rows = lexical.bm25(chunks, asked(spark, "orange chart March", "volcano astronomy")).collect()
    assert [(r.qid, r.chunk_id) for r in rows] == [(0, "doc-march-report:000")]
    assert set(rows[0].matched_terms) == {"orange", "chart", "march"}


def test_bm25_equals_its_formula(spark, chunks):
    texts = [c[3].lower().replace("(", " ").replace(")", " ").replace(":", " ").split() for c in CHUNKS]
    average = sum(map(len, texts)) / 3
    tf, n = 1, len(texts[0])
    want = math.log(1 + (3 - 1 + 0.5) / 1.5) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / average))
    assert lexical.bm25(chunks, asked(spark, "orange")).first().score == pytest.approx(want)


def test_bm25_of_nothing(spark, chunks):
    assert lexical.bm25(chunks.where("false"), asked(spark, "orange")).count() == 0


def test_dense_rejects_other_lengths(spark):
    c = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.5, 0.5])], "chunk_id string, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 1.0])], "qid long, vector array<double>")
    assert [(r.chunk_id, r.score) for r in dense.dense(c, q, 5).orderBy("rank").collect()] == [("a", 1.0), ("b", 1.0)]
    with pytest.raises(Exception, match="differ in length"):
        dense.dense(c, spark.createDataFrame([(1, [1.0])], "qid long, vector array<double>"), 5).collect()


def test_fusion_counts_a_list_once(spark):
    rows = [(1, "lexical", "a:0", 1, 9.0), (1, "lexical", "a:0", 3, 5.0), (1, "lexical", "b:0", 2, 7.0), (1, "vector", "b:0", 1, 0.9), (1, "vector", "a:0", 2, 0.8)]
    lists = spark.createDataFrame(rows, "qid long, list string, chunk_id string, rank int, score double")
    got = fusion.reciprocal_rank_fusion(lists, 10).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["a:0", "b:0"]
    assert got[0].score == got[1].score == pytest.approx(1 / 61 + 1 / 62)
    for bad in ({"limit": -1}, {"limit": 1, "constant": 0}, {"limit": 1, "weights": {"a": -1.0}}):
        with pytest.raises(ValueError):
            fusion.reciprocal_rank_fusion(lists, **bad)
    assert fusion.reciprocal_rank_fusion(lists, 0, weights={"a": -1.0}).count() == 0


def candidates(spark, rows):
    return spark.createDataFrame(rows, "qid long, chunk_id string, document_id string, text string, score double, rank int")


def test_budget_passes_over_what_does_not_fit(spark):
    df = candidates(spark, [(1, "a", "x", "alpha", 3.0, 1), (1, "b", "x", "beta beta beta", 2.0, 2), (1, "c", "y", "c", 1.0, 3)])
    got = selection.select_context(df, 6).orderBy("context_order").collect()
    assert [(r.chunk_id, r.cost) for r in got] == [("a", 5), ("c", 1)]
    same = candidates(spark, [(1, "a", "x", "alpha", 3.0, 1), (1, "b", "y", "alpha", 2.0, 2)])
    assert [r.cost for r in selection.select_context(same, 6).collect()] == [5]
    with pytest.raises(ValueError):
        selection.fill_budget(df.withColumn("position", F.col("rank")), -1)


def test_documents_come_first(spark):
    df = candidates(spark, [(1, "a", "x", "one", 3.0, 1), (1, "b", "x", "two", 2.0, 2), (1, "c", "y", "three", 1.0, 3)])
    got = selection.document_first(df).orderBy("position").collect()
    assert [r.chunk_id for r in got] == ["a", "c", "b"]


def test_diversity(spark):
    df = candidates(spark, [(1, "a", "x", "one two", 1.0, 1), (1, "b", "x", "one two", 0.9, 2), (1, "c", "y", "three", 0.8, 3), (1, "d", "y", "five", 0.0, 4)])
    got = selection.diversify(df, 3).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["a", "c", "b"]
    assert got[2].diversity_score == pytest.approx(0.8 * 0.9 - 0.2)
    with pytest.raises(ValueError):
        selection.diversify(df, 3, 1.5)


def test_recall_and_reciprocal_rank(spark):
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (2, "z"), (3, "r")], "case_id long, chunk_id string")
    found = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3), (3, "w", 1), (3, "r", 2), (3, "r", 3)], "case_id long, chunk_id string, rank int")
    got = {r.case_id: (r.recall, r.reciprocal_rank) for r in evaluation.evaluate_retrieval(gold, found, 2).collect()}
    assert got == {1: (0.5, 1.0), 2: (0.0, 0.0), 3: (1.0, 0.5)}
    with pytest.raises(ValueError):
        evaluation.evaluate_retrieval(gold, found, 0)


def test_stages(spark, chunks):
    q = asked(spark, "orange chart March")
    for stage in ("bm25", "hybrid"):
        assert stages.search(chunks, q, stage).orderBy("rank").first().chunk_id == "doc-march-report:000"
    model = stages.Models(rerankers={"rerank_bge": lambda queries, texts: [1.0 if "retries" in t else 0.1 for t in texts]})
    top = stages.search(chunks, asked(spark, "orange retry_example.py"), "advanced", models=model).orderBy("rank").first()
    assert top.chunk_id == "doc-retry-example:000" and top.score == 1.0
    with pytest.raises(ValueError):
        stages.search(chunks, q, "unknown")


def test_comparison_of_raw_and_planned_queries(spark, tmp_path):
    from datetime import date

    from quillspan.plans import compare

    rows = [
        ("f:0", "harbour/tides.pdf", "2026-02-03", "Tide tables of the northern harbour, with a purple diagram of currents by hour."),
        ("f:1", "harbour/lighthouse.txt", None, "The lighthouse keeper's diary tells of fog, two ferries and a lost anchor."),
        ("f:2", "tools/anchor_weights.py", None, "Weighs anchors: a script that sums chain links and prints kilograms."),
    ]
    chunks = spark.createDataFrame(rows, "chunk_id string, source_path string, created_at string, text string")
    said = ["a PDF with the purple diagram from February", "the keeper's diary about fog", "the markdown file where anchors are weighed"]
    gold = spark.createDataFrame([(n, query, [rows[n][0]]) for n, query in enumerate(said)], "qid long, query string, relevant_chunk_ids array<string>")
    got = compare.compare(chunks, gold, today=date(2026, 9, 22), timed=2)
    assert all(r.first_ms > 0 and r.warm_median_ms > 0 for r in got.collect())
    found = {r.query_mode: (round(r.recall, 3), round(r.mrr, 3), r.no_headroom) for r in got.collect()}
    assert found == {"raw": (1.0, 1.0, True), "processed": (0.667, 0.667, False)}
    compare.report(got, str(tmp_path / "report"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "report")).count() == 2


def test_query_ids_of_any_type(spark, chunks):
    asked = spark.createDataFrame([("q-1", "orange retry_example.py")], "qid string, query string")
    model = stages.Models(rerankers={"rerank_bge": lambda queries, texts: [float(len(t)) for t in texts]})
    assert {r.qid for r in stages.search(chunks, asked, "rerank", models=model).collect()} == {"q-1"}


def test_missing_models_are_named(spark, chunks):
    q = asked(spark, "orange")
    for stage, name in (("bge_dense", "chunk_vectors"), ("rerank_jev", "rerank_jev"), ("specialists", "rerank_bge")):
        with pytest.raises(ValueError, match=name):
            stages.search(chunks, q, stage)
    some = stages.Models(chunk_vectors=spark.createDataFrame([(CHUNKS[0][0], [1.0])], "chunk_id string, vector array<double>"), query_vectors=spark.createDataFrame([(0, [1.0])], "qid long, vector array<double>"))
    with pytest.raises(ValueError, match="2 chunks have no vector"):
        stages.search(chunks, q, "bge_dense", models=some)


def test_nothing_to_find_is_an_error(spark):
    gold = spark.createDataFrame([(1, "a"), (2, None)], "case_id long, chunk_id string")
    found = spark.createDataFrame([(1, "a", 1)], "case_id long, chunk_id string, rank int")
    with pytest.raises(Exception, match="needs a relevant chunk"):
        evaluation.evaluate_retrieval(gold, found, 2).collect()


def test_scorers(spark):
    score = selection.cross_encoder(lambda pairs: [0.0, 800.0, -800.0][: len(pairs)])
    assert score(["a"] * 3, ["b"] * 3) == [0.5, 1.0, 0.0]
    assert selection.cross_encoder(lambda pairs: 0.0)(["a"], ["b"]) == [0.5]
    pairs = spark.createDataFrame([(1, "q", f"c{n}", "t" * n) for n in range(40)], "qid long, query string, chunk_id string, text string")
    got = selection.scored_by(pairs, selection.client_scorer(lambda: lambda query, text: len(query + text)))
    assert {r.chunk_id: r.new_score for r in got.collect()} == {f"c{n}": n + 1.0 for n in range(40)}


def test_attributes_count_as_metadata(spark):
    rows = [("a", "x.txt", {"owner": "marine office"}), ("b", "y.txt", {}), ("c", "marine.txt", None)]
    c = spark.createDataFrame(rows, "chunk_id string, source_path string, attributes map<string,string>")
    assert {(r.chunk_id, r.score) for r in dense.metadata_leg(c, asked(spark, "marine office"), ["source_path"]).collect()} == {("a", 2.0)}


def test_latencies_by_group(spark):
    runs = spark.createDataFrame([("a", 5, 9.0), ("a", 6, 1.0), ("a", 7, 3.0), ("b", 0, 4.0)], "who string, n long, ms double")
    assert {r.who: (r.first_ms, r.warm_median_ms) for r in evaluation.latencies(runs, "who").collect()} == {"a": (9.0, 2.0), "b": (4.0, 0.0)}
    assert tuple(evaluation.latencies(runs.where("who = 'a'")).first()) == (9.0, 2.0)


def test_legs_from_providers(spark, chunks):
    asked_ = spark.createDataFrame([("q", "latency of the chart")], "qid string, query string")

    def build():
        return lambda texts: [[float("latency" in t), 1.0] for t in texts]

    build.factory = True
    words = lambda texts: [{w: 1.0 for w in t.lower().split()} for t in texts]
    models = stages.models_from(chunks, asked_, build, words, words, {"rerank_bge": lambda q, t: [float("latency" in x) for x in t]})
    assert models.chunk_vectors.count() == 3 and {r.term for r in models.splade_query_weights.collect()} == {"latency", "of", "the", "chart"}
    for stage in ("bge_dense", "hybrid", "specialists"):
        assert stages.search(chunks, asked_, stage, models=models).orderBy("rank").first().chunk_id == "doc-march-report:000"
    with pytest.raises(Exception, match="one vector per text"):
        stages.models_from(chunks, asked_, lambda texts: []).chunk_vectors.collect()


def test_named_lists_are_fused(spark):
    one, two = (spark.createDataFrame(r, "qid long, chunk_id string, rank int, score double") for r in ([(1, "a", 1, 2.0)], [(1, "a", 2, 0.5), (1, "b", 1, 0.9)]))
    got = fusion.fuse_candidates(5, lexical=one, vector=two).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["a", "b"] and [s.list for s in got[0].signals] == ["lexical", "vector"]
    with pytest.raises(ValueError):
        fusion.fuse_candidates(5)
