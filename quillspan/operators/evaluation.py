"""Retrieval and grounded-answer metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_fact, has_support


def evaluate_retrieval(gold: DataFrame, results: DataFrame, k: int) -> DataFrame:
    """case_id, recall, reciprocal_rank for gold (case_id, chunk_id) and results (case_id, chunk_id, rank).

    A case whose only chunk_id is null names nothing to find, which is an error.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    truth = gold.select("case_id", "chunk_id").distinct()
    top = results.where(F.col("rank") <= k).groupBy("case_id", "chunk_id").agg(F.min("rank").alias("rank"))
    joined = truth.join(top, ["case_id", "chunk_id"], "left")
    return joined.groupBy("case_id").agg(
        F.when(F.count("chunk_id") > 0, F.count("rank") / F.count("chunk_id")).otherwise(F.raise_error(F.lit("a case needs a relevant chunk")).cast("double")).alias("recall"),
        F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("reciprocal_rank"),
    )


def macro(cases: DataFrame) -> DataFrame:
    """One row: mean recall, mean reciprocal rank, and whether nothing is left to gain."""
    return cases.agg(
        F.coalesce(F.avg("recall"), F.lit(0.0)).alias("recall"),
        F.coalesce(F.avg("reciprocal_rank"), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.bool_and((F.col("recall") == 1) & (F.col("reciprocal_rank") == 1)), F.lit(False)).alias("no_headroom"),
    )


def latencies(runs: DataFrame, *by: str) -> DataFrame:
    """From runs (n, ms), a row for each `by`: the first query's time and the median of the others."""
    first = runs.groupBy(*by).agg(F.min("n").alias("_first"))
    numbered = runs.join(first, list(by)) if by else runs.join(F.broadcast(first), F.lit(True), "inner")  # one row
    return numbered.groupBy(*by).agg(F.min_by("ms", "n").alias("first_ms"), F.coalesce(F.expr("percentile(ms, 0.5) filter (where n > _first)"), F.lit(0.0)).alias("warm_median_ms"))


def evaluate_answers(gold: DataFrame, answers: DataFrame, retrieved: DataFrame, evidence: DataFrame, citations: DataFrame) -> DataFrame:
    """Case by case: evidence found, used, supported, citations right; notes.

    gold: case_id, relevant_chunk_ids, required_facts; answers: case_id, text, abstained; retrieved:
    case_id, chunk_id; evidence: case_id, chunk_id, text, source_path, page, section; citations: case_id,
    pos, claim, chunk_id, source_path, page, section.
    """
    got = retrieved.groupBy("case_id").agg(F.collect_set("chunk_id").alias("got"))
    texts = evidence.groupBy("case_id").agg(F.collect_list("text").alias("texts"))  # selected under a budget
    have = evidence.select("case_id", "chunk_id", F.col("text").alias("e_text"), F.col("source_path").alias("e_path"), F.col("page").alias("e_page"), F.col("section").alias("e_section"))
    cited = citations.join(have, ["case_id", "chunk_id"], "left")
    there = F.col("e_text").isNotNull()
    placed = there & F.col("source_path").eqNullSafe(F.col("e_path")) & F.col("page").eqNullSafe(F.col("e_page")) & F.col("section").eqNullSafe(F.col("e_section"))
    supported = there & has_support(F.col("claim"), F.col("e_text"))
    note = F.array_compact(F.array(
        F.when(~there, F.concat(F.lit("cited without being selected: "), "chunk_id")),
        F.when(there & ~placed, F.concat(F.lit("cited at another place than its own: "), "chunk_id")),
        F.when(there & ~supported, F.concat(F.lit("cited for a claim that it doesn't bear out: "), "chunk_id")),
    ))
    judged = cited.groupBy("case_id").agg(F.bool_and(placed).alias("placed"), F.bool_and(supported).alias("supported"), F.array_sort(F.collect_list(F.struct("pos", note.alias("notes")))).alias("cite_notes"))
    none = F.array().cast("array<string>")
    joined = gold.join(answers, "case_id").join(got, "case_id", "left").join(texts, "case_id", "left").join(judged, "case_id", "left")
    missing = F.array_sort(F.array_except("relevant_chunk_ids", F.coalesce("got", none)))
    facts = (F.size("required_facts") > 0) & F.forall("required_facts", lambda f: contains_fact(F.col("text"), f) & F.exists(F.coalesce("texts", none), lambda t: contains_fact(t, f)))
    score = lambda c: F.when(~F.col("abstained"), c)
    used = F.coalesce(facts, F.lit(False))
    notes = F.array_compact(F.array(
        F.when(F.size(missing) > 0, F.concat(F.lit("not retrieved: "), F.array_join(missing, ", "))),
        F.when(F.col("abstained"), "no answer was given: use, support and citations have no score"),
        F.when(~F.col("abstained") & ~used, "a required fact is missing from the answer or from the evidence"),
    ))
    last = F.when(~F.col("abstained") & F.col("cite_notes").isNull(), F.array(F.lit("nothing is cited"))).otherwise(none)
    own = F.when(~F.col("abstained"), F.coalesce(F.flatten("cite_notes.notes"), none)).otherwise(none)
    return joined.select(
        "case_id",
        (F.size(missing) == 0).alias("retrieval_found_evidence"),
        score(used).alias("answer_used_evidence"),
        score(F.coalesce("supported", F.lit(False))).alias("answer_supported"),
        score(F.coalesce("placed", F.lit(False))).alias("citations_correct"),
        F.concat(notes, own, last).alias("notes"),
    )
