"""Query planning: variants, exact terms, metadata filters and what was done to get them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, fold, path_suffix

#: Patterns of the query language, months and suffixes by name.
QUOTED = r"""(["'])(.+?)\1"""
IDENTIFIER = r"(?<!\w)(?:[A-Za-z]:[\\/][^\s]+|[^\s]+[\\/][^\s]+|[A-Za-z][\w-]*\.[A-Za-z0-9]{1,12}|[A-Za-z_]\w*(?:_\w+)+)(?!\w)"
FILE_TYPE = r"(?i)(?:filetype|type|ext(?:ension)?)\s*:\s*\.?([a-z0-9]+)|\b(pdf|docx?|text|txt|markdown|md|csv|json|python|py)\b(?:\s+files?)?"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MONTH = rf"(?i)\b(?:(last)\s+)?({'|'.join(MONTHS)})\b(?:\s+(20\d{{2}}))?"
SUFFIXES = {"document": ".docx", "doc": ".doc", "docx": ".docx", "markdown": ".md", "md": ".md", "pdf": ".pdf", "python": ".py", "py": ".py", "text": ".txt", "txt": ".txt", "csv": ".csv", "json": ".json"}


def split_identifiers(query: Column) -> Column:
    """Names taken apart at separators and before capitals."""
    camel = F.regexp_replace(query, r"(?<=[a-z0-9])(?=[A-Z])", " ")
    return collapse(F.regexp_replace(camel, r"[_./\\\-]+", " "))


def expand_query(query: Column, supplied: Column | None = None) -> Column:
    """The query, its identifiers taken apart, and supplied variants: each once, none blank."""
    original = collapse(query)
    found = F.array(original, split_identifiers(original))
    if supplied is not None:
        found = F.concat(found, F.transform(F.coalesce(supplied, F.array().cast("array<string>")), collapse))
    return F.when(original == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(found, lambda x: x.isNotNull() & (x != ""))))


def exact_terms(query: Column) -> Column:
    """Quoted phrases, then paths, file names and code identifiers, each once."""
    quoted = F.transform(F.regexp_extract_all(query, F.lit(QUOTED), F.lit(2)), lambda t: F.trim(t))  # a function of two would get the index too
    names = F.transform(F.regexp_extract_all(query, F.lit(IDENTIFIER), F.lit(0)), lambda t: F.regexp_replace(t, r"[.,;:!?]+$", ""))
    return F.array_distinct(F.filter(F.concat(quoted, names), lambda t: t != ""))


def _filter(field: str, operator: str, value: Column, source: Column | str, evidence: Column) -> Column:
    given = F.lit(source) if isinstance(source, str) else source
    return F.struct(F.lit(field).alias("field"), F.lit(operator).alias("operator"), value.alias("value"), given.alias("source"), evidence.alias("evidence"))


def file_type_filters(query: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])

    def one(evidence: Column) -> Column:
        named = F.lower(F.regexp_extract(evidence, FILE_TYPE, 1))
        name = F.when(named != "", named).otherwise(F.lower(F.regexp_extract(evidence, FILE_TYPE, 2)))
        return _filter("file_extension", "equals", F.coalesce(known[name], F.concat(F.lit("."), name)), "explicit", evidence)

    return F.transform(F.regexp_extract_all(query, F.lit(FILE_TYPE), F.lit(0)), one)


def path_filters(terms: Column) -> Column:
    tidy = lambda t: F.replace(t, F.lit("\\"), F.lit("/"))
    return F.transform(F.filter(terms, lambda t: path_suffix(t) != ""), lambda t: _filter("source_path", "ends_with", tidy(t), "explicit", t))


def month_filters(query: Column, today: date) -> Column:
    """Two filters for each month named: from its first day, and before the next month's."""
    numbers = F.create_map(*[F.lit(x) for n, name in enumerate(MONTHS, 1) for x in (name, n)])

    def two(evidence: Column) -> Column:
        month = numbers[F.lower(F.regexp_extract(evidence, MONTH, 2))]
        said = F.regexp_extract(evidence, MONTH, 3)
        last = F.regexp_extract(evidence, MONTH, 1) != ""
        year = F.when(said != "", F.expr("1") * said.try_cast("int")).otherwise(F.lit(today.year) - F.when(last & (month >= today.month), 1).otherwise(0))
        start = F.make_date(year, month, F.lit(1))
        source = F.when(said != "", "explicit").otherwise("inferred")
        text = lambda d: F.date_format(d, "yyyy-MM-dd")
        return F.array(_filter("created_at", "gte", text(start), source, evidence), _filter("created_at", "lt", text(F.add_months(start, 1)), source, evidence))

    return F.flatten(F.transform(F.regexp_extract_all(query, F.lit(MONTH), F.lit(0)), two))


def first_of_each(filters: Column) -> Column:
    """Each filter once, with the evidence of its first mention."""
    same = lambda a, b: (a["field"] == b["field"]) & (a["operator"] == b["operator"]) & (a["value"] == b["value"]) & (a["source"] == b["source"])
    empty = F.array().cast("array<struct<field:string,operator:string,value:string,source:string,evidence:string>>")
    return F.aggregate(filters, empty, lambda kept, x: F.when(F.exists(kept, lambda k: same(k, x)), kept).otherwise(F.array_append(kept, x)))


def metadata_filters(query: Column, today: date) -> Column:
    return first_of_each(F.concat(file_type_filters(query), path_filters(exact_terms(query)), month_filters(query, today)))


def protect_variant(variant: Column, terms: Column) -> Column:
    """A supplied variant with the exact terms that it lacks."""
    clean = collapse(variant)
    missing = F.filter(terms, lambda t: ~F.contains(fold(clean), fold(t)))
    return F.trim(F.concat_ws(" ", clean, F.array_join(missing, " ")))


def plan_queries(queries: DataFrame, today: date, query: str = "query", supplied: str | None = None) -> DataFrame:
    """queries with raw_query, normalized_query, search_queries, exact_terms, filters and transformations."""
    none = F.array().cast("array<string>")
    given = F.coalesce(F.col(supplied), none) if supplied else none
    raw = F.col(query)
    step = lambda kind, before, after, reason: F.struct(F.lit(kind).alias("kind"), before.alias("input"), after.alias("output"), F.lit(reason).alias("reason"))
    with_terms = queries.withColumn("raw_query", raw).withColumn("normalized_query", collapse(raw)).withColumn("exact_terms", exact_terms(raw))
    normal, terms = F.col("normalized_query"), F.col("exact_terms")
    expanded = expand_query(normal)
    protected = F.transform(given, lambda v: F.struct(v.alias("v"), protect_variant(v, terms).alias("p")))
    protected = F.filter(protected, lambda x: x["p"] != "")
    steps = F.array_compact(F.array(
        F.when(normal != raw, step("normalize", raw, normal, "Runs of white space became single blanks.")),
        F.when(F.size(expanded) > 1, step("identifier_expansion", normal, F.get(expanded, 1), "Names were taken apart where they join words.")),
    ))
    kept = F.transform(protected, lambda x: step("supplied_variant", x["v"], x["p"], "A form from outside, with the exact terms that it lacked."))
    return (
        with_terms.withColumn("search_queries", F.array_distinct(F.concat(expanded, F.transform(protected, lambda x: x["p"]))))
        .withColumn("filters", metadata_filters(normal, today))
        .withColumn("transformations", F.concat(steps, kept))
    )
