from datetime import date

import pytest

from quillspan.operators import filters, query_plan

TODAY = date(2026, 9, 22)


def plan(spark, query, supplied=()):
    df = spark.createDataFrame([(query, list(supplied))], "query string, supplied array<string>")
    return query_plan.plan_queries(df, TODAY, supplied="supplied").first()


def test_exact_terms_are_kept_and_restored(spark):
    got = plan(spark, '  find  "ERR_CONNECTION_RESET" in fetch_withRetries.py  ', ["look for the reset"])
    assert got.raw_query.startswith("  find")
    assert {"ERR_CONNECTION_RESET", "fetch_withRetries.py"} <= set(got.exact_terms)
    assert all(t in got.search_queries[-1] for t in ("ERR_CONNECTION_RESET", "fetch_withRetries.py"))
    assert [t.kind for t in got.transformations] == ["normalize", "identifier_expansion", "supplied_variant"]


def test_expansion_takes_names_apart(spark):
    assert plan(spark, "find fetch_withRetries.py").search_queries == ["find fetch_withRetries.py", "find fetch with Retries py"]
    assert plan(spark, "   ").search_queries == []


def test_explicit_and_inferred_filters(spark):
    got = plan(spark, "find PDF files from last March")
    found = {(f.field, f.operator, f.value, f.source) for f in got.filters}
    assert ("file_extension", "equals", ".pdf", "explicit") in found
    assert ("created_at", "gte", "2026-03-01", "inferred") in found
    assert ("created_at", "lt", "2026-04-01", "inferred") in found
    december = plan(spark, "last December and May 2024").filters
    assert {(f.value, f.source) for f in december} == {("2025-12-01", "inferred"), ("2026-01-01", "inferred"), ("2024-05-01", "explicit"), ("2024-06-01", "explicit")}


def test_repeated_filters_count_once(spark):
    assert len([f for f in plan(spark, "pdf or PDF files").filters if f.field == "file_extension"]) == 1


@pytest.mark.parametrize(("wanted", "left"), [
    ([{"field": "file_extension", "operator": "equals", "value": ".pdf"}], {"a"}),
    ([{"field": "created_at", "operator": "gte", "value": "2026-01-01"}], {"b"}),
    ({"created_at": None}, {"a"}),
    ([], {"a", "b"}),
    ([{"field": "file_extension", "operator": "equals", "value": ".pdf"}, {"field": "file_extension", "operator": "equals", "value": ".txt"}], set()),
])
def test_filters(spark, wanted, left):
    df = spark.createDataFrame([("a", "taxes.pdf", None), ("b", "taxes.txt", "2026-02-01")], "chunk_id string, source_path string, created_at string")
    assert {r.chunk_id for r in filters.filter_chunks(df, wanted).collect()} == left
