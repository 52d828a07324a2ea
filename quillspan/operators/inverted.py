"""A stored inverted index: segments of postings by buckets of terms, kept up by each commit.

A commit adds a segment with the postings of its new chunks, and notes the sources whose earlier
postings are dead. Within a segment, postings lie in buckets of their term, in order of it. A query reads the buckets of its own
terms in all segments, leaves out the dead, and counts how many chunks have each term among what is left; the number of chunks and of their tokens
stands in the manifest. When enough segments of one tier have come, the commit merges them, without the dead, into one of the next tier,
so the segments stay few and a posting is written again a logarithmic number of times.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokenize
from .lexical import B, K1, query_terms, score_postings, sent
from .sums import ROWS
from .storage import Manifest, Snapshot, Versions, bucket_number, bucket_of

POSTINGS = "term string, chunk_id string, source_path string, n_tokens int, tf int"
#: Of a chunk, in one bucket of terms; these, which hold no blank, with blanks between them.
LISTS = "bucket int, chunk_id string, source_path string, n_tokens int, terms string, tf array<int>"
DEAD = "source_path string, before int"
#: Segments of a tier that become one of the next.
MERGED = 4


def posting_lists(chunks: DataFrame, buckets: int) -> DataFrame:
    """The postings of chunks (chunk_id, source_path, text), counted where the texts lie: a row for each chunk and bucket of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), ROWS):
                some = batch.slice(low, ROWS)
                tokens = some.column(2)
                sizes = np.diff(tokens.offsets.to_numpy()).astype(np.int64)
                words = tokens.flatten().dictionary_encode()
                cells, tf = np.unique(np.repeat(np.arange(len(some)), sizes) * max(1, len(words.dictionary)) + words.indices.to_numpy(), return_counts=True)
                row, term = np.divmod(cells, max(1, len(words.dictionary)))
                bucket = np.array([bucket_number(w, buckets) for w in words.dictionary.to_pylist()], np.int64)[term]
                turn = np.argsort(row * buckets + bucket, kind="stable")
                row, bucket, term, tf = row[turn], bucket[turn], term[turn], tf[turn]
                begins = np.flatnonzero(np.diff(row * buckets + bucket, prepend=-1))
                at = pa.array(np.append(begins, len(row)), pa.int32())
                own = pa.array(row[begins])
                lists = [pc.binary_join(pa.ListArray.from_arrays(at, words.dictionary.take(pa.array(term))), " "), pa.ListArray.from_arrays(at, pa.array(tf, pa.int32()))]
                columns = [pa.array(bucket[begins], pa.int32()), some.column(0).take(own), some.column(1).take(own), pa.array(sizes[row[begins]], pa.int32()), *lists]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [c.split()[0] for c in LISTS.split(", ")]
    return chunks.select("chunk_id", "source_path", tokenize(F.col("text")).alias("tokens")).mapInArrow(run, LISTS)


def in_rows(lists: DataFrame) -> DataFrame:
    """Lists of postings, a row for each, with its bucket."""
    return lists.select("bucket", "chunk_id", "source_path", "n_tokens", F.inline(F.arrays_zip(F.split("terms", " ").alias("term"), "tf"))).select("bucket", "term", "chunk_id", "source_path", "n_tokens", "tf")


def chunk_postings(chunks: DataFrame) -> DataFrame:
    """The postings of chunks (chunk_id, source_path, text)."""
    return in_rows(posting_lists(chunks, 1)).drop("bucket")


def _segments(snapshot: Snapshot, segments: list[dict], buckets: set[str] | None = None) -> DataFrame:
    """Postings with the number of their segment, of some buckets of terms."""
    parts = []
    for s in segments:
        folders = [f"{snapshot.path}/data/postings/{s['folder']}/bucket={b}" for b in s["buckets"] if buckets is None or b in buckets]
        if folders:
            parts.append(snapshot.spark.read.schema(POSTINGS).parquet(*folders).withColumn("number", F.lit(s["number"])))
    return reduce(DataFrame.union, parts) if parts else snapshot.spark.createDataFrame([], f"{POSTINGS}, number int")


def _alive(snapshot: Snapshot, rows: DataFrame) -> DataFrame:
    if not snapshot.manifest.dead:
        return rows
    dead = snapshot.spark.read.schema(DEAD).parquet(*[f"{snapshot.path}/data/dead/{d}" for d in snapshot.manifest.dead])
    last = dead.groupBy("source_path").agg(F.max("before").alias("before"))
    return rows.join(last, (rows["source_path"] == last["source_path"]) & (rows["number"] < last["before"]), "left_anti")


def alive_postings(snapshot: Snapshot) -> DataFrame:
    """Every posting of the version's chunks."""
    return _alive(snapshot, _segments(snapshot, snapshot.manifest.segments))


def wanted_postings(snapshot: Snapshot, terms: DataFrame) -> DataFrame:
    """chunk_id, n_tokens, term, tf of terms (term): only their buckets' files are read."""
    n = snapshot.manifest.buckets
    buckets = {str(r[0]) for r in terms.select(bucket_of(F.col("term"), n)).distinct().collect()}  # as many as there are buckets at most
    found = _segments(snapshot, snapshot.manifest.segments, buckets).join(sent(terms.select("term").distinct()), "term", "left_semi")
    return _alive(snapshot, found).select("chunk_id", "n_tokens", "term", "tf")


def bm25_stored(snapshot: Snapshot, queries: DataFrame, limit: int | None = 10, k1: float = K1, b: float = B) -> DataFrame:
    """qid, chunk_id, score, rank, matched_terms as `bm25` gives them, from the stored postings: no text is read."""
    terms = sent(query_terms(queries))
    m = snapshot.manifest
    average = m.n_tokens / m.n_chunks if m.n_chunks else 0.0
    return score_postings(wanted_postings(snapshot, terms).repartition("chunk_id"), terms, F.lit(m.n_chunks), F.lit(average), limit, k1, b)


def with_segment(versions: Versions, before: Snapshot, after: Manifest, chunks: DataFrame | None, gone: DataFrame, n_tokens: int) -> Manifest:
    """The manifest with a segment for new chunks (of so many tokens) and the postings of sources that were replaced or deleted (source_path) dead.

    `after` has the number of the commit as its version.
    """
    number = before.version + 1
    segments, dead = list(before.manifest.segments), list(before.manifest.dead)
    if segments and not gone.isEmpty():
        dead.append(uuid.uuid4().hex)
        gone.select("source_path", F.lit(number).alias("before")).write.parquet(f"{versions.path}/data/dead/{dead[-1]}")
    if chunks is not None:
        folder, buckets = versions.written_dealt("postings", posting_lists(chunks, after.buckets), in_rows, n_tokens, F.xxhash64("chunk_id"), after.buckets, "term")
        if buckets:
            segments.append({"folder": folder, "number": number, "tier": 0, "buckets": buckets})
    after = replace(after, segments=segments, dead=dead)
    while len(same := [s for s in after.segments if s["tier"] == after.segments[-1]["tier"]]) >= MERGED if after.segments else False:
        after = _merged(versions, before, after, same)
    return after


def _merged(versions: Versions, before: Snapshot, after: Manifest, some: list[dict]) -> Manifest:
    """The newest segments as one. Once all are in it, nothing dead is left to note."""
    snapshot = Snapshot(before.spark, versions.path, after)
    rows = _alive(snapshot, _segments(snapshot, some)).drop("number")
    n = _segments(snapshot, some).count()
    folder, buckets = versions.written_dealt("postings", rows.withColumn("bucket", bucket_of(F.col("term"), after.buckets)), lambda dealt: dealt, n, F.xxhash64("chunk_id"), after.buckets, "term")
    rest = [s for s in after.segments if s not in some]
    made = [{"folder": folder, "number": max(s["number"] for s in some), "tier": some[0]["tier"] + 1, "buckets": buckets}] if buckets else []
    return replace(after, segments=rest + made, dead=after.dead if rest else [])


def merge_all(versions: Versions, snapshot: Snapshot) -> Manifest:
    """The version's postings in one segment, without the dead."""
    return _merged(versions, snapshot, snapshot.manifest, snapshot.manifest.segments) if snapshot.manifest.segments else snapshot.manifest

