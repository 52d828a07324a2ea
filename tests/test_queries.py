"""Registered queries of the library against their SQL, at the smallest scale."""

from pathlib import Path

import duckdb
import pytest

from quillspan.plans import queries as library

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object).where(frame[sorted(frame.columns)].notna(), None)
    return sorted([tuple(str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in frame.itertuples(index=False)])


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(library.QUERIES))
def test_query(spark, sql, name):
    got = library.QUERIES[name](spark, SF).toPandas()
    if name in library.SQL:
        assert rows(got) == rows(sql.execute(library.SQL[name]).df())
    else:
        assert len(got)
