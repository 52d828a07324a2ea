"""Index lifecycle: what to do with incoming sources, and versioned state on storage."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokenize
from .inverted import alive_postings, bm25_stored, merge_all, with_segment
from .storage import BUCKETS, Conflict, Manifest, Snapshot, Versions, bucket_of, replaced

__all__ = ["Conflict", "IndexState", "State"]

STATE = "source_path string, document_id string, checksum string, versions string, n_chunks int, n_vectors int"
ATTEMPTS = "source_path string, status string, error string, revision long"
ACTIONS = "source_path string, document_id string, action string, error string, n_chunks int, n_vectors int"
CHUNKS = "chunk_id string, document_id string, source_path string, ordinal int, text string, media_type string, page int, section string, line_start int, line_end int, char_start int, char_end int, chunker string"
STORED_CHUNKS = f"{CHUNKS}, vector_key string, n_tokens int"
#: By the hash of a text and the model that embedded it.
VECTORS = "key string, model string, vector array<double>"


#: Keys that are sent to all tasks at most (some 64 MB).
SENT_KEYS = 1_000_000


def _met(rows: DataFrame, which: DataFrame, n: int, how: str, key: str = "source_path") -> DataFrame:
    """Rows whose key is among the n of `which` (how: left_semi) or isn't (left_anti).

    Rows may hold texts, so they stay where they are as long as these keys, or the other keys that rows have, are few.
    """
    which = which.select(key)
    if n <= SENT_KEYS:
        return rows.join(F.broadcast(which), key, how)
    others = rows.select(key).distinct().join(which, key, "left_anti")
    n_others = others.count()
    if n_others > SENT_KEYS:
        return rows.join(which, key, how)
    if n_others == 0 and how == "left_semi":
        return rows
    others = others.select(F.col(key).alias("_other"))
    return rows.join(F.broadcast(others), F.col(key).eqNullSafe(F.col("_other")), "left_anti" if how == "left_semi" else "left_semi")


def _counts(chunks: DataFrame) -> tuple[int, int]:
    """How many chunks and tokens there are."""
    return tuple(chunks.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first())


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def vector_key(text: Column, model: str) -> Column:
    """What a text's vector is stored under: another text or model has another key."""
    return F.sha2(F.concat_ws("\n", F.lit(model), text), 256)


def _stored(chunks: DataFrame) -> DataFrame:
    """Chunks as they are stored."""
    key = F.col("vector_key") if "vector_key" in chunks.columns else F.lit(None)
    own = [F.col(f.split()[0]).cast(f.split()[1]) for f in CHUNKS.split(", ")]
    return chunks.select(*own, key.cast("string").alias("vector_key"), F.size(tokenize(F.col("text"))).alias("n_tokens"))


def action() -> Column:
    """added, skipped, updated or rebuilt, from columns of the state (now_…) and of what comes in."""
    same = (F.col("checksum") == F.col("now_checksum")) & F.col("versions").eqNullSafe(F.col("now_versions"))
    return F.when(F.col("now_checksum").isNull(), "added").when(same, "skipped").when(F.col("checksum") != F.col("now_checksum"), "updated").otherwise("rebuilt")


def plan_changes(incoming: DataFrame, state: DataFrame) -> DataFrame:
    """incoming (source_path, document_id, checksum, versions) with action, and the document's stable id."""
    now = state.select("source_path", F.col("document_id").alias("now_id"), F.col("checksum").alias("now_checksum"), F.col("versions").alias("now_versions"))
    joined = incoming.join(now, "source_path", "left")
    return joined.withColumn("action", action()).withColumn("document_id", F.coalesce("now_id", "document_id")).drop("now_id", "now_checksum", "now_versions")


def plan_deletes(wanted: DataFrame, state: DataFrame) -> DataFrame:
    """wanted (source_path) with action deleted, or missing where there is no such source; and what goes with it."""
    have = state.select("source_path", "n_chunks", "n_vectors", F.lit(True).alias("_have"))
    joined = wanted.select("source_path").join(have, "source_path", "left")
    return joined.select("source_path", F.when(F.col("_have"), "deleted").otherwise("missing").alias("action"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("n_vectors", F.lit(0)).alias("n_vectors"))


def prune(state: DataFrame, present: DataFrame) -> DataFrame:
    """Sources of the state that are no longer present."""
    return state.select("source_path").join(present.select("source_path"), "source_path", "left_anti")


def checked(changes: DataFrame) -> DataFrame:
    """changes (…, n_chunks, n_vectors, cancelled, and error where reading failed) with an error for those that must not be committed."""
    found = F.col("error") if "error" in changes.columns else F.lit(None).cast("string")
    error = (
        F.when(F.col("action") == "skipped", F.lit(None).cast("string"))
        .when(found.isNotNull(), found)
        .when(F.col("n_chunks") == 0, "document produced no searchable chunks")
        .when((F.col("n_vectors") != 0) & (F.col("n_vectors") != F.col("n_chunks")), "embedding provider must return one vector per chunk")
        .when(F.coalesce("cancelled", F.lit(False)), "cancelled")
    )
    return changes.withColumn("error", error)


def duplicate_ordinals(chunks: DataFrame) -> DataFrame:
    """document_id, ordinal, n where a document has two chunks of one ordinal, or a chunk no document."""
    return chunks.groupBy("document_id", "ordinal").agg(F.count("*").alias("n")).where("n > 1 or document_id is null")


def snapshot(chunks: DataFrame) -> DataFrame:
    """Chunks in the order of their files and of their places there."""
    return chunks.orderBy("source_path", "ordinal")


class State(Snapshot):
    """One version of the index: its sources, attempts, chunks, vectors and postings."""

    def sources(self, buckets: Iterable[int] | None = None) -> DataFrame:
        return self.read("sources", STATE, buckets)

    def attempts(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """The latest attempt of each source."""
        return self.read("attempts", ATTEMPTS, buckets)

    def stored_chunks(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """Chunks as stored, with the number of their tokens and the key of their vector."""
        return self.read("chunks", STORED_CHUNKS, buckets)

    def chunks(self) -> DataFrame:
        """The chunks of all sources, as search takes them."""
        return self.stored_chunks().select(*names(CHUNKS))

    def vectors(self, model: str | None = None) -> DataFrame:
        """source_path, chunk_id, vector of the chunks that were embedded; of one model, where it is named."""
        stored = self.read("vectors", VECTORS)
        stored = stored.select("key", "vector") if model is None else stored.where(F.col("model") == model).select("key", "vector")
        keyed = self.stored_chunks().where("vector_key is not null").select("source_path", "chunk_id", F.col("vector_key").alias("key"))
        return keyed.join(stored, "key").select("source_path", "chunk_id", "vector")

    def unseen(self, keys: DataFrame) -> DataFrame:
        """Rows (key, …) whose key has no vector yet; only the keys' buckets are read."""
        if not self.manifest.tables.get("vectors"):
            return keys
        own = keys.select("key").distinct()
        stored = self.read("vectors", VECTORS, self._buckets(own, F.col("key")))
        seen = own.join(stored.select("key"), "key", "left_semi")
        return _met(keys, seen, seen.count(), "left_anti", "key")

    def _buckets(self, rows: DataFrame, key: Column) -> list[int]:
        """The buckets that rows fall in: as many as there are buckets at most."""
        return [r[0] for r in rows.select(bucket_of(key, self.manifest.buckets)).distinct().collect()]

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of rows' sources."""
        return self._buckets(rows, F.col("source_path"))

    def bm25(self, queries: DataFrame, limit: int | None = 10) -> DataFrame:
        """BM25 over all chunks, from the stored postings."""
        return bm25_stored(self, queries, limit)

    def lexical_index(self) -> DataFrame:
        """chunk_id, n_tokens, term, tf of all chunks."""
        return alive_postings(self).select("chunk_id", "n_tokens", "term", "tf")


class IndexState:
    """The index on storage, version by version (see `storage`): sources, attempts, chunks, vectors and postings.

    A change is planned on one version, read through one handle, and rewrites the buckets of the sources it touches.
    Another writer's commit in between is a Conflict, after which the change can be planned again. Vectors are stored by the hash of the
    text and the model: what has been embedded once isn't again. Versions of another layout are passed over; chunks of sources
    that aren't committed aren't stored, and vectors are read through the chunks that have them.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self.versions = Versions(spark, path, buckets)

    def pin(self) -> State:
        """The current version; all that is read from it is of that version."""
        return State(self.spark, self.path, self.versions.current())

    def at(self, version: int) -> State:
        """An earlier version, until it is vacuumed."""
        return State(self.spark, self.path, self.versions.at(version))

    def revision(self) -> int:
        return self.pin().revision

    def sources(self) -> DataFrame:
        return self.pin().sources()

    def attempts(self) -> DataFrame:
        """The latest attempt of each source."""
        return self.pin().attempts()

    def chunks(self) -> DataFrame:
        """The chunks of all sources, as search takes them."""
        return self.pin().chunks()

    def vectors(self, model: str | None = None) -> DataFrame:
        """The vectors of chunks that were embedded."""
        return self.pin().vectors(model)

    def get(self, source_path: str) -> DataFrame:
        """A source's row, or none: one bucket is read."""
        return self._one(source_path, self.pin().sources)

    def latest_attempt(self, source_path: str) -> DataFrame:
        return self._one(source_path, self.pin().attempts)

    def _one(self, source_path: str, table: Callable[[Iterable[int]], DataFrame]) -> DataFrame:
        n = self.versions.current().buckets
        bucket = int(hashlib.sha256(source_path.encode()).hexdigest()[:8], 16) % n
        return table([bucket]).where(F.col("source_path") == source_path)

    def source_paths(self) -> DataFrame:
        return self.sources().select("source_path").distinct()

    def document_count(self) -> int:
        return self.sources().select("document_id").distinct().count()

    def snapshot(self) -> tuple[int, DataFrame]:
        """The revision, and its chunks in order."""
        pinned = self.pin()
        return pinned.revision, snapshot(pinned.chunks())

    def lexical_index(self) -> DataFrame:
        """chunk_id, n_tokens, term, tf of all chunks."""
        return self.pin().lexical_index()

    def cancel(self, source_path: str) -> None:
        """Have a source left out of every commit from now on, one that is under way included."""
        self.versions.files.put(f"_cancelled/{hashlib.sha256(source_path.encode()).hexdigest()}", "")

    def cancelled(self) -> DataFrame:
        """The hashes of cancelled sources' paths."""
        found = [(n,) for n in self.versions.files.names("_cancelled") if not n.startswith(".")]
        return self.spark.createDataFrame(found, "_path_hash string")

    def _without_cancelled(self, rows: DataFrame) -> DataFrame:
        """Rows with an error for those that have been cancelled since."""
        marked = rows.withColumn("_path_hash", F.sha2("source_path", 256)).join(self.cancelled().withColumn("_off", F.lit(True)), "_path_hash", "left")
        off = F.coalesce("_off", F.lit(False)) & (F.col("action") != "skipped")
        return marked.withColumn("error", F.coalesce("error", F.when(off, "cancelled"))).drop("_path_hash", "_off")

    def _commit(self, pinned: State, gone: DataFrame, sources: DataFrame | None, rows: DataFrame, chunks: DataFrame | None, vectors: DataFrame | None, steps: int, actions: DataFrame) -> DataFrame:
        """A version in which sources (gone: source_path) are replaced by others or by none; the actions, as written.

        rows are the attempts. Only the buckets of gone and of rows are read and written.
        """
        versions, m = self.versions, pinned.manifest
        tables = {name: dict(own) for name, own in m.tables.items()}
        by_source = bucket_of(F.col("source_path"), m.buckets)
        without = lambda old, which: old.join(which.select("source_path"), "source_path", "left_anti").select(*old.columns)
        of = gone.select("source_path", F.lit(True).alias("gone")).unionByName(rows.select("source_path", F.lit(False).alias("gone")))
        hit = of.groupBy(by_source.alias("bucket")).agg(F.max("gone").alias("gone")).collect()  # as many as there are buckets at most
        asked, touched = [r["bucket"] for r in hit], [r["bucket"] for r in hit if r["gone"]]
        told = f"{self.path}/data/actions/{uuid.uuid4().hex}"
        old, now = pinned.stored_chunks(touched), pinned.sources(touched)
        new = None if chunks is None else _met(_stored(chunks), gone, steps, "left_semi").select(*old.columns)
        work: dict[str, Callable[[], object]] = {
            "attempts": lambda: versions.written("attempts", without(pinned.attempts(asked), rows).unionByName(rows), by_source),
            "actions": lambda: actions.write.parquet(told),
        }
        if touched:
            kept = _met(old, gone, steps, "left_anti").select(*old.columns)

            def texts() -> tuple[tuple[str, list[str]], tuple[int, int], Manifest]:
                """Chunks are written, then read from there: what is counted and indexed is what is stored."""
                folder, filled = versions.written("chunks", kept if new is None else kept.unionByName(new), by_source, "source_path", "ordinal")
                won = None
                if new is not None:
                    stored = self.spark.read.schema(STORED_CHUNKS).parquet(f"{self.path}/data/chunks/{folder}").select(*old.columns)
                    won = _met(stored, gone, steps, "left_semi").select(*old.columns)
                less, more = _counts(_met(old.select("source_path", "n_tokens"), gone, steps, "left_semi")), (0, 0) if won is None else _counts(won)
                after = with_segment(versions, pinned, m, won, gone.join(now.select("source_path"), "source_path", "left_semi"), more[1])
                return (folder, filled), (more[0] - less[0], more[1] - less[1]), after

            work |= {
                "sources": lambda: versions.written("sources", without(now, gone) if sources is None else without(now, gone).unionByName(sources), by_source),
                "texts": texts,
            }
            if vectors is not None:
                work["vectors"] = lambda: versions.written("vectors", pinned.unseen(vectors.select(*names(VECTORS)).dropDuplicates(["key"])), bucket_of(F.col("key"), m.buckets))
        with ThreadPoolExecutor(len(work)) as pool:  # jobs side by side: none waits for another's result
            done = {name: running.result() for name, running in [(name, pool.submit(inheritable_thread_target(job))) for name, job in work.items()]}
        replaced(tables, "attempts", asked, *done["attempts"])
        after = m
        if touched:
            stored, change, after = done["texts"]
            replaced(tables, "sources", touched, *done["sources"])
            replaced(tables, "chunks", touched, *stored)
            after = replace(after, n_chunks=m.n_chunks + change[0], n_tokens=m.n_tokens + change[1])
        if "vectors" in done:
            folder, buckets = done["vectors"]
            own = tables.setdefault("vectors", {})
            tables["vectors"] = own | {b: [*own.get(b, []), folder] for b in buckets}
        versions.publish(m, replace(after, tables=tables, revision=m.revision + steps))
        return self.spark.read.parquet(told)

    def apply(self, incoming: DataFrame, chunks: DataFrame | None = None, vectors: DataFrame | None = None, on: State | None = None) -> DataFrame:
        """Add, update, rebuild or skip sources (source_path, document_id, checksum, versions, n_chunks, n_vectors, cancelled, perhaps error).

        Chunks (with vector_key where embedded) and vectors (key, model, vector) are stored for sources that are committed.
        Failed ones keep their earlier version. Who has cancelled is asked before the work and again when it
        is done. The change is planned on the version `on`, or the current one. The actions are returned.
        """
        pinned = on or self.pin()
        done = self.versions.staged(self._without_cancelled(checked(plan_changes(incoming, pinned.sources(pinned.touched(incoming))))))
        late = self._without_cancelled(done)
        ready = late.where("action != 'skipped' and error is null")
        steps = ready.count()
        actions = late.select("source_path", "document_id", "action", "error", "n_chunks", "n_vectors")
        if steps or not late.where("action != 'skipped'").isEmpty():
            status = F.when(F.col("error").isNull(), "ready").otherwise("failed")
            rows = late.where("action != 'skipped'").select("source_path", status.alias("status"), "error", F.lit(pinned.revision + steps).cast("long").alias("revision"))
            actions = self._commit(pinned, ready.select("source_path"), ready.select(*names(STATE)), rows, chunks, vectors, steps, actions)
            self.versions.unstage()
        else:
            self.versions.leave_staged()  # the actions are read from there
        return actions

    def delete(self, wanted: DataFrame, on: State | None = None) -> DataFrame:
        """Remove sources; ones that aren't there are noted too."""
        pinned, wanted = on or self.pin(), wanted.select("source_path").distinct()
        plan = self.versions.staged(plan_deletes(wanted, pinned.sources(pinned.touched(wanted))))
        steps = plan.where("action = 'deleted'").count()
        rows = plan.select("source_path", F.lit("deleted").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(pinned.revision + steps).cast("long").alias("revision"))
        actions = self._commit(pinned, plan.where("action = 'deleted'").select("source_path"), None, rows, None, None, steps, plan)
        self.versions.unstage()
        return actions

    def prune(self, present: DataFrame, on: State | None = None) -> DataFrame:
        """Delete sources that aren't present any more."""
        pinned = on or self.pin()
        return self.delete(prune(pinned.sources(), present), pinned)

    def compact(self) -> None:
        """A version of the same rows with one segment of postings and only the vectors that chunks have."""
        pinned = self.pin()
        after = merge_all(self.versions, pinned)
        wanted = pinned.stored_chunks().select(F.col("vector_key").alias("key")).distinct()
        folder, buckets = self.versions.written("vectors", pinned.read("vectors", VECTORS).join(wanted, "key", "left_semi"), bucket_of(F.col("key"), after.buckets))
        self.versions.publish(pinned.manifest, replace(after, tables=after.tables | {"vectors": {b: [folder] for b in buckets}}))

    def vacuum(self, keep: int = 1, age: float = 3600) -> None:
        """Delete all but the last versions, and what only they need; folders younger than `age` seconds stay."""
        self.versions.vacuum(keep, age)
