"""Token counts by an exact histogram of encoded lengths.

Documents are encoded whole and counted by length where they lie; what is shuffled is a row for each
length. Suffix sums over the lengths then answer, for every context limit: how many documents are
longer, how many tokens they hold, and how many tokens are left when each document is cut at the limit.

Null and empty texts have length 0; an empty table gives an empty histogram; equal rows count each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, by_frames, saved
from .tokens import TOKENIZER, encoder, tokenizer_path

#: Lengths that are summed up together before the sums of such blocks are.
SUM_BLOCK = 64


def length_histogram(df: DataFrame, text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """n_tokens, n_docs: how many documents have each encoded length; kept, as every answer reads it again."""
    path = tokenizer_path(tokenizer)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path).encode
        total: dict[int, int] = {}
        for block in blocks(frames):
            sizes, counts = np.unique(np.fromiter(map(len, encode(block["text"].tolist())), np.int64, len(block)), return_counts=True)
            for size, n in zip(sizes.tolist(), counts.tolist(), strict=True):
                total[size] = total.get(size, 0) + n
        yield pd.DataFrame({"n_tokens": list(total), "n_docs": list(total.values())}, dtype=np.int64)

    counted = by_frames(df.select(F.col(text).alias("text")), count, "n_tokens long, n_docs long")
    return saved(counted.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")))


def context_table(histogram: DataFrame) -> DataFrame:
    """Totals for each length as the context limit.

    context_limit, n_docs (of this length), n_longer, tokens_longer (of longer documents),
    truncated_tokens (each document cut at the limit), total_tokens and at_most (share of documents no
    longer than the limit). For a limit between two lengths see `truncated_total`.
    """
    rows = histogram.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.floor(F.col("n_tokens") / SUM_BLOCK).alias("block"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy(F.lit(1))
    sums = (
        rows.groupBy("block")
        .agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
        .select("block", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"), F.sum("d").over(all_rows).alias("d_all"), F.sum("t").over(all_rows).alias("t_all"))
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    longer = F.coalesce(F.sum("n_docs").over(inside), F.lit(0)) + F.col("d_above")
    tokens = F.coalesce(F.sum("tokens").over(inside), F.lit(0)) + F.col("t_above")
    return (
        rows.join(sums, "block")
        .withColumn("n_longer", longer)
        .withColumn("tokens_longer", tokens)
        .select(
            F.col("n_tokens").alias("context_limit"),
            "n_docs",
            "n_longer",
            "tokens_longer",
            (F.col("t_all") - F.col("tokens_longer") + F.col("n_longer") * F.col("n_tokens")).alias("truncated_tokens"),
            F.col("t_all").alias("total_tokens"),
            ((F.col("d_all") - F.col("n_longer")) / F.col("d_all")).alias("at_most"),
        )
    )


def truncated_total(contexts: DataFrame, limit: int) -> DataFrame:
    """One row: n_longer, truncated_tokens and total_tokens for any limit, met by a document or not."""
    over = F.col("context_limit") > limit
    n = F.coalesce(F.sum(F.when(over, F.col("n_docs"))), F.lit(0))
    kept = F.coalesce(F.sum(F.when(~over, F.col("context_limit") * F.col("n_docs"))), F.lit(0))
    return contexts.agg(n.alias("n_longer"), (kept + n * limit).alias("truncated_tokens"), F.coalesce(F.max("total_tokens"), F.lit(0)).alias("total_tokens"))


def length_quantile(contexts: DataFrame, share: float) -> DataFrame:
    """One row: the least length that at least `share` of the documents don't exceed."""
    return contexts.where(F.col("at_most") >= share).agg(F.min("context_limit").alias("n_tokens"))
