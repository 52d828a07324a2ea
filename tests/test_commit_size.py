"""What a commit shuffles and what one of its tasks sorts: texts once, postings in lists, no more rows than a task should have."""

import pytest
from pyspark.sql import functions as F

from quillspan.operators import inverted, lifecycle, storage
from quillspan.operators.lifecycle import IndexState

from test_state import chunks, put, source, texts


@pytest.mark.parametrize("most", [0, 1, 2, 1_000_000])
def test_rows_met_by_many_or_few_keys(spark, monkeypatch, most):
    monkeypatch.setattr(lifecycle, "SENT_KEYS", most)
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), (None, 4), ("a", 5)], "source_path string, n int")
    for keys in ([], ["a"], ["a", "b"], ["a", "b", "x"], ["a", "b", "c"]):
        which = spark.createDataFrame([(k,) for k in keys], "source_path string")
        for some, ns in ((rows, {1, 2, 3, 4, 5}), (rows.where("source_path is not null"), {1, 2, 3, 5})):
            met, not_met = ({r.n for r in lifecycle._met(some, which, len(keys), how).collect()} for how in ("left_semi", "left_anti"))
            assert met == {r.n for r in some.collect() if r.source_path in keys} and met | not_met == ns and not met & not_met


def test_a_commit_shuffles_texts_once(spark, tmp_path, monkeypatch):
    plans, put_rows = {}, storage.Versions._put if hasattr(storage.Versions, "_put") else storage.Versions.written

    def seen(self, table, rows, *order):
        plans[table] = rows._jdf.queryExecution().executedPlan().toString()
        return put_rows(self, table, rows, *order)

    monkeypatch.setattr(storage.Versions, "_put" if hasattr(storage.Versions, "_put") else "written", seen)
    state = IndexState(spark, str(tmp_path / "state"), buckets=2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        put(state, ("a", "one two"), ("b", "two three"))
        put(state, ("a", "one four"), ("b", "two three"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert all("SortMergeJoin [source_path" not in plans[table] for table in ("chunks", "postings"))
    assert plans["chunks"].count("REBALANCE_PARTITIONS_BY_COL") == 1
    assert texts(state.pin()) == {"a": "one four", "b": "two three"}


def test_sources_without_chunks_are_committed(spark, tmp_path):
    state = IndexState(spark, str(tmp_path / "state"))
    state.apply(source(spark, ("a", "t")), chunks(spark, ("a", "t")).limit(0))
    assert texts(state.pin()) == {} and state.sources().count() == 1 and state.pin().manifest.n_chunks == 0


def test_unseen_texts_are_found_by_keys(spark, tmp_path):
    state = IndexState(spark, str(tmp_path / "state"))
    vectors = spark.createDataFrame([("k", "m", [1.0])], "key string, model string, vector array<double>")
    state.apply(source(spark, ("a", "t")), chunks(spark, ("a", "t")).withColumn("vector_key", F.lit("k")), vectors)
    rows = spark.createDataFrame([("k", "t"), ("new", "u"), ("new", "u"), ("other", "w")], "key string, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = state.pin().unseen(rows)
        assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(tuple(r) for r in found.collect()) == [("new", "u"), ("new", "u"), ("other", "w")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_postings_go_in_lists_by_bucket(spark):
    rows = spark.createDataFrame([("a", "p", "x y x -z_1.5"), ("b", "q", None), ("c", "r", "y ÄÖ é")], "chunk_id string, source_path string, text string")
    lists = inverted.posting_lists(rows, 4)
    assert lists.count() <= 2 * 4 and lists.select("chunk_id", "bucket").distinct().count() == lists.count()
    found = inverted.in_rows(lists)
    assert found.where(F.col("bucket") != storage.bucket_of(F.col("term"), 4)).count() == 0
    assert {tuple(r) for r in found.drop("bucket").collect()} == {tuple(r) for r in inverted.chunk_postings(rows).collect()}
    assert found.count() == 6 and inverted.in_rows(inverted.posting_lists(rows.limit(0), 4)).count() == 0


@pytest.mark.parametrize("buckets", [2, 64])
def test_a_task_sorts_a_bounded_number_of_postings(spark, tmp_path, monkeypatch, buckets):
    monkeypatch.setattr(storage, "TASK_ROWS", 500, raising=False)
    state = IndexState(spark, str(tmp_path / "state"), buckets=buckets)
    rows = [(f"p{k}", " ".join(f"w{(k * 7 + i) % 97}" for i in range(20))) for k in range(400)]
    put(state, *rows)
    stored = spark.read.parquet(f"{state.path}/data/postings/{state.pin().manifest.segments[0]['folder']}")
    assert stored.count() == 8_000
    by_file = stored.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    assert by_file <= 1_000
    state.compact()
    stored = spark.read.parquet(f"{state.path}/data/postings/{state.pin().manifest.segments[0]['folder']}")
    assert stored.count() == 8_000 and stored.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= 1_000


def test_contents_are_neither_cached_nor_shuffled_before_they_are_read(spark, tmp_path, monkeypatch):
    from quillspan.plans import ingestion

    plans, staged = [], storage.Versions.staged

    def seen(self, rows):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return staged(self, rows)

    monkeypatch.setattr(storage.Versions, "staged", seen)
    state = IndexState(spark, str(tmp_path / "state"), buckets=2)
    files = spark.createDataFrame([(f"p/{k}.txt", "text/plain", bytearray(f"Some words of {k}.".encode()), None) for k in range(3)] + [("p/x.txt", "text/plain", bytearray(b" "), None)], "source_path string, media_type string, content binary, error string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        first = {r.source_path: r.action for r in ingestion.add_files(state, files).collect()}
        again = {r.source_path: r.action for r in ingestion.add_files(state, files).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert set(first.values()) == {"added"} and again == first | {f"p/{k}.txt": "skipped" for k in range(3)}
    assert not any("InMemoryTableScan" in p for p in plans)
    assert any("content" in p and "hashpartitioning(source_path" not in p for p in plans)
    assert texts(state.pin()) == {f"p/{k}.txt": f"Some words of {k}." for k in range(3)}
