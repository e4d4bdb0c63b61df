"""Every registered query against its SQL oracle on sf0.001 (the driver does
the same at sf0.01).  Queries without an oracle must at least run and keep a
stable schema."""

import duckdb
import pytest

import __spark_entry__ as E
from tools.check_oracle import TABLES, frame_hash

from .conftest import SF_SMALL

QUERIES = E.queries()
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF_SMALL).toPandas()
    if name not in ORACLES:
        assert len(sdf.columns) > 0
        return
    odf = con.execute(ORACLES[name]).df()
    assert sorted(sdf.columns) == sorted(odf.columns)
    assert len(sdf) == len(odf)
    assert frame_hash(sdf)[0] == frame_hash(odf)[0]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "tag_strength" in df.columns
