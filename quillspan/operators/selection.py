"""Diversification and budgeted selection: folds over each query's bounded candidate list."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard, tokenize
from .encoders import made

NEAR = 0.85
#: Calls of a remote scorer that one worker has open.
MOST_CALLS = 12


def _kind(rows: DataFrame) -> str:
    """The type of a table's query ids."""
    return rows.schema["qid"].dataType.simpleString()


def diversify(candidates: DataFrame, limit: int, relevance: float = 0.8) -> DataFrame:
    """Maximal marginal relevance over candidates (qid, chunk_id, text, score, rank).

    qid, chunk_id, diversity_score, rank; a query's candidates are a fused list, of bounded length.
    """
    if not 0 <= relevance <= 1:
        raise ValueError("relevance_weight must be between zero and one")
    rows = candidates.select("qid", "chunk_id", "score", F.col("rank").cast("int").alias("rank"), F.array_distinct(tokenize(F.col("text"))).alias("terms"))

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        terms = {c: set(t) for c, t in zip(frame["chunk_id"], frame["terms"], strict=True)}
        low, span = frame["score"].min(), frame["score"].max() - frame["score"].min()
        left = {r.chunk_id: (1.0 if span == 0 else (r.score - low) / span, int(r.rank)) for r in frame.itertuples()}
        nearest = dict.fromkeys(left, 0.0)
        out = []
        while left and len(out) < limit:
            value = {c: relevance * rel - (1.0 - relevance) * nearest[c] for c, (rel, _) in left.items()}
            best = min(left, key=lambda c: (-value[c], left[c][1], c))
            out.append((frame["qid"].iloc[0], best, value[best], len(out) + 1))
            del left[best]
            for c in left:
                both = len(terms[c] & terms[best])
                nearest[c] = max(nearest[c], both / len(terms[c] | terms[best]) if terms[c] and terms[best] else 0.0)
        return pd.DataFrame(out, columns=["qid", "chunk_id", "diversity_score", "rank"])

    return rows.groupBy("qid").applyInPandas(pick, f"qid {_kind(candidates)}, chunk_id string, diversity_score double, rank int")


def _folded(candidates: DataFrame, *columns: str) -> DataFrame:
    """qid and its candidates in rank order."""
    return candidates.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", *columns))).alias("items"))


def near_duplicates_out(candidates: DataFrame, threshold: float = NEAR) -> DataFrame:
    """Candidates (qid, chunk_id, rank, text, …) of which no accepted one before has the id or near the same terms."""
    keep = candidates.withColumn("_terms", F.array_distinct(tokenize(F.col("text"))))
    item = "struct<rank:int,chunk_id:string,_terms:array<string>>"
    empty = F.array().cast(f"array<{item}>")

    def step(kept: Column, x: Column) -> Column:
        seen = F.exists(kept, lambda k: (k["chunk_id"] == x["chunk_id"]) | (jaccard(k["_terms"], x["_terms"]) >= threshold))
        return F.when(seen, kept).otherwise(F.array_append(kept, x))

    folded = _folded(keep.withColumn("rank", F.col("rank").cast("int")), "chunk_id", "_terms")
    accepted = folded.select("qid", F.explode(F.aggregate("items", empty, step)).alias("x")).select("qid", F.col("x.chunk_id").alias("chunk_id"), F.col("x.rank").alias("rank"))
    return candidates.join(accepted, ["qid", "chunk_id", "rank"], "left_semi")


def document_first(candidates: DataFrame) -> DataFrame:
    """candidates with `position`: each document's best first, then the rest, by rank."""
    nth = F.row_number().over(Window.partitionBy("qid", "document_id").orderBy("rank"))
    order = Window.partitionBy("qid").orderBy(F.col("_again"), "rank")
    return candidates.withColumn("_again", nth > 1).withColumn("position", F.row_number().over(order)).drop("_again")


def fill_budget(candidates: DataFrame, budget: int) -> DataFrame:
    """Those that still fit when they come, in position order; one that doesn't is passed over.

    qid, chunk_id, position, cost, context_order.
    """
    if budget < 0:
        raise ValueError("budget cannot be negative")
    costed = candidates.select("qid", F.col("position").cast("int").alias("rank"), "chunk_id", F.length("text").cast("long").alias("cost"))
    item = "struct<rank:int,chunk_id:string,cost:bigint>"
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{item}>").alias("taken"))

    def step(state: Column, x: Column) -> Column:
        fits = state["used"] + x["cost"] <= budget
        return F.when(fits, F.struct((state["used"] + x["cost"]).alias("used"), F.array_append(state["taken"], x).alias("taken"))).otherwise(state)

    folded = _folded(costed, "chunk_id", "cost").select("qid", F.aggregate("items", start, step, lambda s: s["taken"]).alias("taken"))
    out = folded.select("qid", F.posexplode("taken").alias("n", "x"))
    return out.select("qid", F.col("x.chunk_id").alias("chunk_id"), F.col("x.rank").alias("position"), F.col("x.cost").alias("cost"), (F.col("n") + 1).alias("context_order"))


def select_context(candidates: DataFrame, budget: int, threshold: float = NEAR) -> DataFrame:
    """Near duplicates out, documents first, then as the budget allows."""
    return fill_budget(document_first(near_duplicates_out(candidates, threshold)), budget)


def scored_by(pairs: DataFrame, score: object, batch: int = 64) -> DataFrame:
    """qid, chunk_id, new_score of pairs (qid, query, chunk_id, text) by a model.

    score(queries, texts) returns a number for each pair; a factory makes it, once in a worker process where it
    names its version (`encoders.provider`).
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = made(score)
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                values = list(model(part["query"].tolist(), part["text"].tolist()))
                if len(values) != len(part):
                    raise ValueError("reranker must return exactly one score per candidate")
                yield pd.DataFrame({"qid": part["qid"], "chunk_id": part["chunk_id"], "new_score": [float(v) for v in values]})

    return pairs.select("qid", "query", "chunk_id", "text").mapInPandas(run, f"qid {_kind(pairs)}, chunk_id string, new_score double")


def cross_encoder(logits: Callable[[list[tuple[str, str]]], object]) -> Callable[[list[str], list[str]], list[float]]:
    """A model that gives a logit for each pair as a scorer of values between 0 and 1; a bare number counts as one."""

    def score(queries: list[str], texts: list[str]) -> list[float]:
        found = logits(list(zip(queries, texts, strict=True)))
        values = [found] if isinstance(found, (int, float)) else list(found)
        return [1 / (1 + math.exp(-v)) if v >= 0 else math.exp(v) / (1 + math.exp(v)) for v in map(float, values)]

    return score


def client_scorer(make_client: Callable[[], Callable[[str, str], float]], most: int = MOST_CALLS, version: str | None = None) -> Callable:
    """A remote scorer of single pairs as a scorer of batches: calls side by side, in order.

    One client for each worker process where a version is named, for each task else.
    """

    def build() -> Callable[[list[str], list[str]], list[float]]:
        client = make_client()

        def score(queries: list[str], texts: list[str]) -> list[float]:
            with ThreadPoolExecutor(max_workers=max(1, min(most, len(texts)))) as pool:
                return list(pool.map(client, queries, texts))

        return score

    build.factory, build.version = True, version
    return build
