"""The index on storage: versions, buckets, conflicts, vectors by content and the stored postings."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quillspan.operators import encoders, inverted
from quillspan.operators.lexical import bm25
from quillspan.operators.lifecycle import CHUNKS, Conflict, IndexState, vector_key

SOURCES = "source_path string, document_id string, checksum string, versions string, n_chunks int, n_vectors int, cancelled boolean"


def source(spark, *rows):
    return spark.createDataFrame([(path, f"d-{path}", text, "1", 1, 0, False) for path, text in rows], SOURCES)


def chunks(spark, *rows):
    return spark.createDataFrame([(f"d-{path}:0", f"d-{path}", path, 0, text, *[None] * 8) for path, text in rows], CHUNKS)


def put(state, *rows, on=None):
    return {r.source_path: r.action for r in state.apply(source(state.spark, *rows), chunks(state.spark, *rows), on=on).collect()}


def gone(state, *paths, on=None):
    return {r.source_path: r.action for r in state.delete(state.spark.createDataFrame([(p,) for p in paths], "source_path string"), on=on).collect()}


def texts(pinned):
    return {r.source_path: r.text for r in pinned.chunks().collect()}


def written(path):
    return {os.path.relpath(os.path.join(d, f), path) for d, _, files in os.walk(path) for f in files if f.endswith(".parquet")}


def test_writers_with_other_numbers_of_changes_conflict(spark, tmp_path):
    one, two = (IndexState(spark, str(tmp_path / "state")) for _ in range(2))
    put(one, ("a", "first"))
    start = two.pin()
    put(one, ("b", "x"), ("c", "y"), ("d", "z"))  # three changes
    with pytest.raises(Conflict):
        put(two, ("a", "other"), on=start)  # one change
    with pytest.raises(Conflict):
        gone(two, "a", on=start)
    assert texts(one.pin()) == {"a": "first", "b": "x", "c": "y", "d": "z"} and one.revision() == 4
    assert put(two, ("a", "other"))["a"] == "updated" and two.revision() == 5  # planned again


def test_commit_between_planning_and_publishing_is_noticed(spark, tmp_path, monkeypatch):
    one, two = (IndexState(spark, str(tmp_path / "state")) for _ in range(2))
    put(one, ("a", "first"))
    asked, calls = IndexState._without_cancelled, []

    def meanwhile(self, rows):
        if self is two and not calls:
            calls.append(1)
            put(one, ("b", "meanwhile"), ("c", "too"))
        return asked(self, rows)

    monkeypatch.setattr(IndexState, "_without_cancelled", meanwhile)
    with pytest.raises(Conflict):
        put(two, ("d", "late"))
    assert texts(two.pin()) == {"a": "first", "b": "meanwhile", "c": "too"}


def test_reader_sees_one_version_throughout(spark, tmp_path):
    state = IndexState(spark, str(tmp_path / "state"))
    put(state, ("a", "old words"), ("b", "stays"))
    pinned = state.pin()
    put(state, ("a", "new words"), ("e", "more"))
    gone(state, "b")
    assert texts(pinned) == {"a": "old words", "b": "stays"} and {r.source_path for r in pinned.sources().collect()} == {"a", "b"}
    asked = spark.createDataFrame([(1, "old new stays")], "qid long, query string")
    assert {r.chunk_id for r in pinned.bm25(asked).collect()} == {"d-a:0", "d-b:0"} and {r.chunk_id for r in state.pin().bm25(asked).collect()} == {"d-a:0"}
    assert texts(state.at(1)) == texts(pinned) and texts(state.at(2))["a"] == "new words" and texts(state.at(0)) == {}
    state.vacuum()  # what is young stays, but no manifest names it
    with pytest.raises(ValueError, match="no version 1"):
        state.at(1)
    state.vacuum(age=0)
    assert texts(state.pin()) == {"a": "new words", "e": "more"} and state.revision() == 5


def test_one_changed_source_of_many_rewrites_one_bucket(spark, tmp_path):
    state = IndexState(spark, str(tmp_path / "state"), buckets=16)
    rows = spark.range(10_000).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("source_path"))
    of = lambda df, text: (
        df.select("source_path", F.concat(F.lit("d-"), "source_path").alias("document_id"), F.lit(text).alias("checksum"), F.lit("1").alias("versions"), F.lit(1).alias("n_chunks"), F.lit(0).alias("n_vectors"), F.lit(False).alias("cancelled")),
        df.select(F.concat(F.lit("d-"), "source_path", F.lit(":0")).alias("chunk_id"), F.concat(F.lit("d-"), "source_path").alias("document_id"), "source_path", F.lit(0).alias("ordinal"), F.concat_ws(" ", F.lit(text), "source_path").alias("text"), *[F.lit(None).alias(c) for c in ("media_type", "page", "section", "line_start", "line_end", "char_start", "char_end", "chunker")]),
    )
    state.apply(*of(rows, "one"))
    before = written(state.path)
    state.apply(*of(rows.where("source_path = 'p77'"), "two"))
    new = [f.split("/") for f in written(state.path) - before]
    for table in ("sources", "attempts", "chunks"):
        assert [f[3].startswith("bucket=") for f in new if f[1] == table] == [True], table
    assert {f[1] for f in new} == {"sources", "attempts", "chunks", "postings", "dead", "actions"}
    assert state.sources().count() == 10_000 == state.chunks().count() and state.get("p77").first().checksum == "two"
    assert "bucket=" in state.get("p77").inputFiles()[0] and len(state.get("p77").inputFiles()) == 1


def test_versions_of_another_layout_and_strangers_rows(spark, tmp_path):
    state = IndexState(spark, str(tmp_path / "state"))
    vectors = spark.createDataFrame([("k", "m", [1.0]), ("unused", "m", [2.0])], "key string, model string, vector array<double>")
    state.apply(source(spark, ("a", "t")), chunks(spark, ("a", "t"), ("stranger", "t")).withColumn("vector_key", F.when(F.col("source_path") == "a", "k")), vectors)
    state.versions.files.put(f"_manifests/{9:012d}", json.dumps({"layout": 99, "manifest": {}}))
    assert texts(state.pin()) == {"a": "t"} and state.revision() == 1
    assert [(r.chunk_id, r.vector) for r in state.vectors().collect()] == [("d-a:0", [1.0])] and state.vectors("other").count() == 0
    state.compact()
    assert state.pin().read("vectors", "key string").count() == 1 and state.vectors().count() == 1


def test_stored_postings_equal_bm25_over_the_texts(spark, tmp_path):
    state = IndexState(spark, str(tmp_path / "state"), buckets=8)
    asked = spark.createDataFrame([(1, "alpha beta alpha"), (2, "delta"), (3, "nothing"), (4, "beta gamma delta r1 r2")], "qid long, query string")
    draw = lambda k, n: " ".join(("alpha", "beta", "gamma", "delta", f"r{k % 5}")[(k * i + i * i) % 5] for i in range(1 + (k + n) % 9))
    for n in range(5):  # more commits than a tier has segments
        put(state, *[(f"p{k}", draw(k, n)) for k in range(n * 3, n * 3 + 8)])
        if n % 2:
            gone(state, f"p{n}", f"p{n * 3 + 1}")
        pinned = state.pin()
        if n not in (1, 4):
            continue
        want = [tuple(r) for r in bm25(pinned.chunks(), asked, 5).orderBy("qid", "rank").collect()]
        assert [tuple(r) for r in pinned.bm25(asked, 5).orderBy("qid", "rank").collect()] == want and want
        assert pinned.manifest.n_chunks == pinned.chunks().count()
    tiers = [s["tier"] for s in pinned.manifest.segments]
    assert len(set(tiers)) > 1 and all(tiers.count(t) < inverted.MERGED for t in tiers)
    state.compact()
    assert len(state.pin().manifest.segments) == 1 and not state.pin().manifest.dead
    assert [tuple(r) for r in state.pin().bm25(asked, 5).orderBy("qid", "rank").collect()] == want


def test_stored_postings_are_read_by_the_terms_buckets_and_no_text_is(spark, tmp_path):
    state = IndexState(spark, str(tmp_path / "state"), buckets=32)
    put(state, *[(f"p{k}", f"word{k} common") for k in range(60)])
    found = state.pin().bm25(spark.createDataFrame([(1, "word7")], "qid long, query string"))
    plan = found._jdf.queryExecution().toString()
    assert "regexp_extract_all(replace(lower(coalesce(text" not in plan and "/data/chunks/" not in plan
    read = {f.split("bucket=")[1].split("/")[0] for f in found.inputFiles()}
    assert len(read) == 1 and [r.chunk_id for r in found.collect()] == ["d-p7:0"]


def upload(spark, *rows):
    import base64

    return spark.createDataFrame([(p, "", base64.b64encode(t.encode()).decode()) for p, t in rows], "relative_path string, media_type string, content_base64 string")


def test_only_unseen_texts_are_embedded(spark, tmp_path):
    from quillspan.operators.chunking import ChunkingPolicy
    from quillspan.plans import service

    state, log = IndexState(spark, str(tmp_path / "state"), buckets=4), tmp_path / "log"
    log.mkdir()

    def embed(texts):
        import uuid

        (log / uuid.uuid4().hex).write_text("\n".join(t.replace("\n", " ") for t in texts))
        return [[float(len(t)), 1.0] for t in texts]

    def seen():
        found = sorted(line for f in log.iterdir() for line in f.read_text().split("\n"))
        for f in log.iterdir():
            f.unlink()
        return found

    policy = ChunkingPolicy(target_size=20, overlap=0, strategy="windows") if "windows" in getattr(ChunkingPolicy, "STRATEGIES", ()) else ChunkingPolicy(target_size=20, overlap=0)
    first = "One sentence here. Two sentence here. Six sentence here."
    service.add_uploads(state, upload(spark, ("a.txt", first), ("b.txt", first)), policy=policy, embed=embed, embedding="m1")
    once = seen()
    assert len(once) == len(set(once)) == 3  # both files have the same texts
    changed = first.replace("Two", "New")
    done, _ = service.add_uploads(state, upload(spark, ("a.txt", changed)), policy=policy, embed=embed, embedding="m1")
    assert done.first().action == "updated" and [t.strip() for t in seen()] == ["New sentence here."]
    assert state.vectors().count() == 6 == state.vectors("m1").count()
    service.add_uploads(state, upload(spark, ("a.txt", changed)), policy=policy, embed=embed, embedding="m2")
    assert len(seen()) == 3 and state.vectors("m2").count() == 3  # another model's vectors are none of this one's


def test_vector_keys_tell_texts_and_models_apart(spark):
    row = spark.range(1).select(vector_key(F.lit("a"), "m").alias("x"), vector_key(F.lit("a"), "n").alias("y"), vector_key(F.lit("b"), "m").alias("z")).first()
    assert len(set(row)) == 3


def test_factory_is_called_once_in_a_process(spark, tmp_path):
    folder = str(tmp_path)

    def loaded():
        import os
        import uuid

        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda texts: [[float(len(t))] for t in texts]

    model = encoders.provider(f"counted-{tmp_path.name}")(loaded)
    rows = spark.range(48).select("id", F.col("id").cast("string").alias("text")).repartition(24)
    for _ in range(3):
        assert encoders.embedded(rows, "id", "text", model).count() == 48
    made = [f.split("-")[0] for f in os.listdir(folder)]
    assert len(made) == len(set(made)) <= 8  # 72 tasks
