"""Ingestion: admitted files are normalized, chunked and embedded, and become the index state's next version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.chunking import ChunkingPolicy, chunk_documents
from ..operators.encoders import embedded_texts
from ..operators.lifecycle import CHUNKS, SENT_KEYS, IndexState, names, plan_changes, vector_key
from ..sources.files import checksum, document_id, paged_blocks, route, skip_reason, text_documents
from ..sources.registry import Parsers

Embed = Callable[[list[str]], list[list[float]]]
#: How files are cut where the caller doesn't say.
POLICY = ChunkingPolicy(target_size=1200, overlap=150)
PLACE = ("page", "section", "line_start", "char_start")


def refusal() -> Column:
    """Why a file (source_path, media_type, content) isn't admitted; null if it is."""
    path, kind = F.col("source_path"), F.col("media_type")
    return F.coalesce(F.when(path.isNull(), "file path is empty"), skip_reason(path, F.length("content"), kind), F.when(route(path, kind) == "unsupported", "unsupported file type"))


def _nothing() -> dict[str, Column]:
    return {c: F.lit(None).cast(t).alias(c) for c, t in zip(PLACE, ("int", "string", "int", "int"), strict=True)}


def _text(files: DataFrame) -> DataFrame:
    nothing = _nothing()
    return text_documents(files).select("source_path", F.lit(0).alias("block_no"), "kind", "text", nothing["page"], nothing["section"], "line_start", "char_start", "error")


def _paged(kind: str) -> Callable[[DataFrame], DataFrame]:
    def parse(files: DataFrame) -> DataFrame:
        nothing = _nothing()
        number = F.coalesce("page", F.regexp_extract("section", r"(\d+)$", 1).try_cast("int"))
        return paged_blocks(files, kind).select("source_path", number.alias("block_no"), F.lit("paragraph").alias("kind"), "text", "page", "section", nothing["line_start"], nothing["char_start"], "error")

    return parse


def default_parsers() -> Parsers:
    """PDF, DOCX and text, as files are routed; more can be registered."""
    parsers = Parsers()
    for name, parse in (("pdf", _paged("pdf")), ("docx", _paged("docx")), ("text", _text)):
        parsers.register(name, lambda path, kind, name=name: route(path, kind) == name, parse)
    return parsers


def normalize(files: DataFrame, parsers: Parsers | None = None) -> DataFrame:
    """Files (source_path, media_type, content) as blocks: source_path, block_no, kind, text, page, section, line_start, char_start; or a row with the error."""
    return (parsers or default_parsers()).parse(files.select(F.col("source_path").alias("path"), "media_type", "content"))


def add_files(state: IndexState, files: DataFrame, versions: str = "1", policy: ChunkingPolicy = POLICY, embed: Embed | None = None, embedding: str = "", parsers: Parsers | None = None) -> DataFrame:
    """Files (source_path, media_type, content, error: why refused) into the state, one a path; the actions.

    Only what is new or changed is read, and of its chunks only texts are embedded that the state has no vector for. `versions`,
    the policy and the name of the embedding are the version that a source is rebuilt for. A file that is refused, can't be read, has no searchable chunk
    or can't be embedded is a failed attempt and keeps its earlier version.
    """
    model = (embedding or getattr(embed, "version", None) or "embedded") if embed else ""
    version = "/".join([versions, policy.version, *([model] if embed else [])])
    path, digest = F.col("source_path"), checksum(F.col("content"))
    pinned = state.pin()
    coming = files.select("source_path", "media_type", "content", "error", digest.alias("checksum"), document_id(path, digest).alias("document_id"), F.lit(version).alias("versions"))
    now = pinned.sources(pinned.touched(files))
    few = now.count() <= SENT_KEYS  # contents stay where they are, then
    planned = state.versions.staged(plan_changes(coming, F.broadcast(now) if few else now))  # a file is read once
    fresh = planned.where("action <> 'skipped' and error is null")
    about = fresh.select("source_path", "document_id", "media_type")
    blocks = state.versions.staged(normalize(fresh, parsers))
    good = blocks.where("error is null").join(about.drop("media_type"), "source_path").withColumn("language", F.lit(None).cast("string"))
    cut = chunk_documents(good.drop("error"), policy, embed)
    chunks = cut.join(about, "document_id").withColumnRenamed("chunk_text", "text").select(*names(CHUNKS))
    chunks = state.versions.staged(chunks.withColumn("vector_key", vector_key(F.col("text"), model) if embed else F.lit(None).cast("string")))
    errors = blocks.where("error is not null").select("source_path", "error")
    counts = chunks.groupBy("source_path").agg(F.count("*").cast("int").alias("n_chunks"))
    counts = counts.withColumn("n_vectors", F.col("n_chunks") if embed else F.lit(0))
    vectors = None
    if embed:  # texts that have no vector yet
        texts = pinned.unseen(chunks.select(F.col("vector_key").alias("key"), "text")).dropDuplicates(["key"])
        vectors = state.versions.staged(embedded_texts(texts, embed).withColumn("model", F.lit(model)))
        failed = vectors.where("error is not null").select(F.col("key").alias("vector_key"), "error")
        errors = errors.union(chunks.join(failed, "vector_key").groupBy("source_path").agg(F.min("error").alias("error")).select("source_path", "error"))
    had = now.select("source_path", F.col("n_chunks").alias("had_chunks"), F.col("n_vectors").alias("had_vectors"))
    known = planned.drop("content", "media_type").join(errors.select("source_path", F.col("error").alias("why")), "source_path", "left").join(counts, "source_path", "left").join(had, "source_path", "left")
    count = lambda c: F.coalesce(F.when(F.col("action") == "skipped", F.col(f"had_{c}")), F.col(f"n_{c}"), F.lit(0)).alias(f"n_{c}")
    incoming = known.select("source_path", "document_id", "checksum", "versions", count("chunks"), count("vectors"), F.lit(False).alias("cancelled"), F.coalesce("error", "why").alias("error"))
    return state.apply(state.versions.staged(incoming), chunks, None if vectors is None else vectors.where("error is null"), on=pinned)
