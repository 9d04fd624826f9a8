"""Driver contract: entry smoke and Spark vs DuckDB on every oracle query."""

import duckdb
import pytest

import __spark_entry__ as E
from crowdrank.sources.tables import TABLES
from tools.check_oracle import frame_digest

SF = "/root/testdata/sf0.001"


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1
    assert "best_video_id" in df.columns


def test_every_oracle_key_is_registered():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF).toPandas()
    odf = duck.execute(E.oracle_sql()[name]).df()
    assert frame_digest(sdf) == frame_digest(odf)
