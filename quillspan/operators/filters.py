"""Metadata filters over chunk tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import path_suffix


def field_value(df: DataFrame, field: str) -> Column:
    """A filterable value: the path's suffix, a column, or else an attribute."""
    if field == "file_extension":
        return path_suffix(F.col("source_path"))
    if field in df.columns:
        return F.col(field)
    return F.col("attributes")[field] if "attributes" in df.columns else F.lit(None)


def _holds(df: DataFrame, field: str, operator: str, value: str) -> Column:
    actual, wanted = F.lower(field_value(df, field).cast("string")), value.lower()
    test = {
        "equals": lambda: actual == wanted,
        "ends_with": lambda: F.replace(actual, F.lit("\\"), F.lit("/")).endswith(wanted),
        "gte": lambda: actual >= wanted,
        "lt": lambda: actual < wanted,
    }[operator]()
    return F.coalesce(test, F.lit(False))


def predicate(df: DataFrame, filters: Iterable[Mapping[str, str]] | Mapping[str, object] | None) -> Column:
    """All filters together; a mapping asks for equal values, null included."""
    if not filters:
        return F.lit(True)
    if isinstance(filters, Mapping):
        tests = [field_value(df, k).eqNullSafe(F.lit(v)) for k, v in filters.items()]
    else:
        tests = [_holds(df, f["field"], f["operator"], f["value"]) for f in filters]
    return reduce(lambda a, b: a & b, tests)


def filter_chunks(df: DataFrame, filters: Iterable[Mapping[str, str]] | Mapping[str, object] | None) -> DataFrame:
    return df.where(predicate(df, filters))


#: Fields that filters name, where a table has them; others are looked for among the attributes.
FIELDS = ("source_path", "created_at", "language", "media_type", "section", "page", "document_id", "chunk_id")


def filter_key(filters: Column) -> Column:
    """What a set of filters (an array of structs) is known by: the same filters in any order have one key."""
    return F.to_json(F.array_sort(F.array_distinct(F.transform(filters, lambda f: F.struct(f["field"].alias("field"), f["operator"].alias("operator"), F.lower(f["value"]).alias("value"))))))


def with_filter_keys(df: DataFrame, sets: DataFrame, name: str = "keys") -> DataFrame:
    """Chunks with the keys of the sets (key, filters) that they meet, all judged in one pass over the chunks.

    The sets go to every task in one row: they are as many as the different filters that queries name.
    """
    known = {f: F.lower(field_value(df, f).cast("string")) for f in ("file_extension", *[c for c in FIELDS if c in df.columns])}
    values = F.create_map(*[x for f, v in known.items() for x in (F.lit(f), v)])
    more = F.transform_values("attributes", lambda _, v: F.lower(v.cast("string"))) if "attributes" in df.columns else None

    def holds(f: Column) -> Column:
        actual = values[f["field"]] if more is None else F.when(F.map_contains_key(values, f["field"]), values[f["field"]]).otherwise(more[f["field"]])
        wanted = F.lower(f["value"])
        test = (
            F.when(f["operator"] == "equals", actual == wanted)
            .when(f["operator"] == "ends_with", F.replace(actual, F.lit("\\"), F.lit("/")).endswith(wanted))
            .when(f["operator"] == "gte", actual >= wanted)
            .when(f["operator"] == "lt", actual < wanted)
        )
        return F.coalesce(test, F.lit(False))

    listed = sets.agg(F.collect_list(F.struct("key", "filters"))).scalar()
    met = F.filter("_sets", lambda s: F.forall(s["filters"], holds))
    return df.withColumn("_sets", listed).withColumn(name, F.transform(met, lambda s: s["key"])).drop("_sets")


def active(filters: Column, include_inferred: bool = False) -> Column:
    """Of an array of filters, those that are applied."""
    return filters if include_inferred else F.filter(filters, lambda f: f["source"] == "explicit")
