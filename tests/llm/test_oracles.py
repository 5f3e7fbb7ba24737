"""The operators' queries against their SQL on the driver's tables."""

import os

import duckdb
import pytest

from jsonspark.llm.queries import ORACLE_SQL, QUERIES
from tests.test_catalogue import TABLES, table

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    wanted = con.sql(ORACLE_SQL[name])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(wanted.columns, wanted.fetchall())
