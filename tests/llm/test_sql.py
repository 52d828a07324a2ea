"""Registered corpus queries against their SQL, and held-out accuracy, at the smallest scale."""

from pathlib import Path

import duckdb
import pytest

from quillspan.llm import queries as registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def rows(frame):
    columns = sorted(frame.columns)
    return sorted(tuple("" if v is None or v != v else str(int(v)) if isinstance(v, (int, float)) else str(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.astype(object).where(got.notna(), None)) == rows(want.astype(object).where(want.notna(), None))


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = registry.op1_kneser_ney_language(spark, SF).where("held_out").join(docs, "doc_id").collect()
    assert len(got) > 40 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
