"""Citations: markers, their claims, and whether the evidence supports them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import claim_before, has_support

MARKER = r"\[([^\[\]\s]+)\]"


def markers(answers: DataFrame) -> DataFrame:
    """answer_id, pos, chunk_id, claim of each marker in answers (answer_id, text), in order."""
    text = F.col("text")
    pieces = F.split(text, r"\[[^\[\]\s]+\]")
    ids = F.regexp_extract_all(text, F.lit(MARKER), F.lit(1))
    found = answers.select("answer_id", "text", F.posexplode(ids).alias("pos", "chunk_id"), pieces.alias("pieces"), ids.alias("ids"))
    # where the marker starts: the pieces up to it, and the markers before it with their brackets
    start = F.aggregate(F.slice("pieces", 1, F.col("pos") + 1), F.lit(0), lambda s, p: s + F.length(p)) + F.aggregate(F.slice("ids", 1, F.col("pos")), F.lit(0), lambda s, i: s + F.length(i) + 2)
    return found.select("answer_id", "pos", "chunk_id", claim_before(text, start).alias("claim"))


def check_citations(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each marker with its evidence (answer_id, chunk_id, text, source_path, page, section) and a status."""
    have = evidence.select("answer_id", "chunk_id", F.col("text").alias("evidence_text"), "source_path", "page", "section")
    joined = markers(answers).join(have, ["answer_id", "chunk_id"], "left")
    status = (
        F.when(F.col("evidence_text").isNull(), "cited chunk ID is not present in selected evidence")
        .when(F.col("claim") == "", "cited chunk ID has no associated claim")
        .when(~has_support(F.col("claim"), F.col("evidence_text")), "cited chunk does not support its associated claim")
        .otherwise("ok")
    )
    return joined.withColumn("status", status).drop("evidence_text")


def assemble_citations(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Checked citations; an answer's first one that fails ends the read with its reason."""
    checked = check_citations(answers, evidence)
    first = F.min(F.when(F.col("status") != "ok", F.struct("pos", "status", "chunk_id"))).over(Window.partitionBy("answer_id"))
    failed = F.when(first.isNotNull(), F.raise_error(F.concat_ws(": ", first["status"], first["chunk_id"])))
    return checked.withColumn("_", failed).where(F.col("_").isNull()).select("answer_id", "pos", "claim", "chunk_id", "source_path", "page", "section")
