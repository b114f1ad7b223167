"""Every registered query against its DuckDB statement (sf0.001; the driver repeats this at sf0.01)."""

import duckdb
import pytest

from conftest import SMALL
import __spark_entry__ as entry
from envspark import catalog
from tools.check_oracle import rows_of
from tools.check_types import SPARK_TO_DUCK

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]
QUERIES, ORACLE = catalog.QUERIES, catalog.ORACLE  # the corpus operators have tests of their own


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SMALL)
    got = sdf.toPandas()
    rel = con.sql(ORACLE[name])
    want = rel.df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
    duck_types = dict(zip(rel.columns, map(str, rel.types)))
    for f in sdf.schema.fields:
        assert SPARK_TO_DUCK[type(f.dataType).__name__] == duck_types[f.name], (name, f.name)


def test_every_query_registered_has_oracle_or_is_declared_rows_only():
    rows_only = set(QUERIES) - set(ORACLE)
    assert rows_only == {"forest_importance"}


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"bucket", "series", "value", "n"}
