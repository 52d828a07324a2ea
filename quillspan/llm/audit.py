"""Interaction of filters: what each removes in every order of them, by a trie over their permutations.

All orders that begin with the same filters, whatever the order among these, leave the same survivors. So the trie of n! orders
has 2**n states, walked depth first: a state's survivors are a persisted DataFrame made from those of the state it was
reached from, each edge to a further filter counts the rows that this filter removes from them, and a state that has been visited is not
built again. At most one state for each filter is kept at a time; counts go to a table in the shared folder, so that
a lost executor costs the open state alone, which is made again from the checkpoint of the rows' flags.

A filter is a boolean column, true where a row fails; null counts as passing. Rows with a null part belong to the part ''.
Every part has a row for each order and step, zeros included; an empty table has no part and gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from itertools import permutations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, saved

WORD = r"[^\x20\x09-\x0D]+"
#: Filters at most: the result has a row for each part, order of the filters and step.
MOST_FILTERS = 8


def text_failures(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """key, part and the failures A to E of every row.

    A: under 200 words; B: fewer distinct words than half of them; C: over 3 % of the characters are A to Z;
    D: holds one of #$%&*|; E: a row of smaller key has the same text. Words are runs of characters other than blanks and the control characters 9
    to 13, case counts; null texts are empty. Rows that share a key and a text are equal here, neither is
    the other's copy; a row with a null key is neither a copy nor makes one. Texts are told apart by their SHA-256.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    # one pass over the words for both numbers
    words = F.transform(F.array(F.regexp_extract_all(whole, F.lit(WORD), F.lit(0))), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    seen = docs.select(
        F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), words.alias("words"),
        (100 * F.regexp_count(whole, F.lit("[A-Z]")) > 3 * F.length(whole)).alias("C"), whole.rlike("[#$%&*|]").alias("D"), F.unhex(F.sha2(whole, 256)).alias("digest"),
    )
    light = saved(seen.select("key", "part", (F.col("words.n") < 200).alias("A"), (100 * F.col("words.distinct") < 50 * F.col("words.n")).alias("B"), "C", "D", "digest"))
    # by key and text, not by text alone: a much-copied text is no hot key
    firsts = light.where("key IS NOT NULL").groupBy("digest").agg(F.min("key").alias("key")).withColumn("first", F.lit(True))
    return light.join(firsts, ["key", "digest"], "left").select(F.col("key").alias(key), "part", "A", "B", "C", "D", (F.col("first").isNull() & F.col("key").isNotNull()).alias("E"))


def with_labels(rows: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows with good (a label says quality 1) and toxic (one says toxic 1); without a label, neither."""
    said = labels.groupBy(key).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return rows.join(said, key, "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})


def audit_filters(rows: DataFrame, fails: Mapping[str, Column], lost: Mapping[str, Column], part: str = "part") -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, shapley and the lost counts.

    `fails` names each filter by a letter; `lost` names boolean columns whose rows are counted where a step removes them.
    """
    letters = list(fails)
    if not 0 < len(letters) <= MOST_FILTERS or any(len(x) != 1 for x in letters):
        raise ValueError(f"one to {MOST_FILTERS} filters are named by a letter each")
    spark, bit, every = rows.sparkSession, {x: 1 << k for k, x in enumerate(letters)}, (1 << len(letters)) - 1
    flag = lambda c: F.coalesce(c, F.lit(False))
    base = saved(rows.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), *[flag(c).alias(f"fails_{x}") for x, c in fails.items()], *[flag(c).alias(name) for name, c in lost.items()]))
    path = fresh_path(spark, "audit")
    visited: set[int] = set()

    def visit(state: int, survivors: DataFrame) -> None:
        visited.add(state)
        todo = [x for x in letters if not state & bit[x]]
        sums = {x: F.struct(F.count_if(f"fails_{x}").alias("removed"), *[F.count_if(F.col(f"fails_{x}") & F.col(name)).alias(name) for name in lost]) for x in todo}
        edges = survivors.groupBy("part").agg(F.count("*").alias("alive"), *[s.alias(x) for x, s in sums.items()])
        each = F.array(*[F.struct(F.lit(x).alias("filter"), F.col(x).alias("at")) for x in todo])
        edges.select("part", "alive", F.inline(each)).select("part", F.lit(state).alias("state"), "filter", "alive", "at.*").write.parquet(f"{path}/{state}")
        for x in todo:
            after = state | bit[x]
            if after not in visited and after != every:
                kept = survivors.where(~F.col(f"fails_{x}")).persist(StorageLevel.DISK_ONLY)
                visit(after, kept)
                kept.unpersist()

    visit(0, base)
    counted = spark.read.parquet(*[f"{path}/{state}" for state in sorted(visited)])
    return _by_order(counted, letters, bit, list(lost))


def _by_order(counted: DataFrame, letters: list[str], bit: dict[str, int], lost: list[str]) -> DataFrame:
    """The edges' counts (part, state, filter, alive, removed, lost counts), spread over the orders that pass them."""
    spark, n, every = counted.sparkSession, len(letters), (1 << len(letters)) - 1
    steps = [("".join(order), k + 1, sum(bit[x] for x in order[:k]), order[k]) for order in permutations(letters) for k in range(n)]
    edges = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(x).alias("filter"), F.lit(_orders(s, n)).alias("orders")) for s in range(every) for x in letters if not s & bit[x]])
    of_part = counted.where("state = 0").select("part").distinct().select("part", F.inline(edges))
    whole = of_part.join(counted, ["part", "state", "filter"], "left").fillna(0, ["alive", "removed", *lost])  # a part without survivors
    over = Window.partitionBy("part", "filter")
    only = F.element_at(F.create_map(*[F.lit(v) for x in letters for v in (x, every ^ bit[x])]), F.col("filter"))
    rows = whole.select(
        "part", "state", "filter", "removed", *lost, (F.col("alive") - F.col("removed")).alias("kept"),
        (F.sum(F.when(F.col("state") == 0, F.col("removed"))).over(over) - F.col("removed")).alias("redundant"),
        F.sum(F.when(F.col("state") == only, F.col("removed"))).over(over).alias("unique_fails"),
        F.sum(F.col("orders") * F.col("removed")).over(over).alias("shapley"),
    )
    orders = spark.createDataFrame(steps, "filter_order string, step int, state int, filter string")  # as many rows as the filters have orders and steps
    return rows.join(F.broadcast(orders), ["state", "filter"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *lost, "shapley")


def _orders(state: int, n: int) -> int:
    """How many of the n! orders pass an edge that leaves a state."""
    before = state.bit_count()
    return math.factorial(before) * math.factorial(n - 1 - before)
