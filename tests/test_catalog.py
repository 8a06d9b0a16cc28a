"""Every query with SQL gives what DuckDB gives on the smallest tables; the others run."""

import math
import os

import duckdb
import pytest

from lodewell import catalog, queries  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    made = duckdb.connect()
    for t in TABLES:
        path = f"{data}/{t}.parquet"
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return made


def rows(frame):
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
            return "~"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        try:
            return f"{float(v):.7g}"
        except (TypeError, ValueError):
            return str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_sql(spark, data, duck, name):
    got, expected = catalog.QUERIES[name](spark, data).toPandas(), duck.execute(catalog.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_runs(spark, data, name):
    frame = catalog.QUERIES[name](spark, data)
    assert frame.columns and frame.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
