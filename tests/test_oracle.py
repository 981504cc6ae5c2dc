"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tessera.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list[str]:
    cells = frame[sorted(frame.columns)].map(lambda v: None if v is None or v is pd.NA or v != v else v.item() if hasattr(v, "item") else v)
    return sorted(map(repr, cells.astype(object).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_agrees_with_sql(spark, sql, name):
    ours, theirs = catalog.queries()[name](spark, FOLDER).toPandas(), sql.sql(catalog.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_sql_belongs_to_queries():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_flagship(spark):
    assert catalog.flagship(spark, FOLDER).count() > 0
