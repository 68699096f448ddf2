"""The corpus queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

from linkwright.llm.oracles import ORACLES
from linkwright.llm.queries import queries

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = db.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    want = sorted(map(str, found.fetchall()))
    df = queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(str(tuple(r)) for r in df.select(*columns).collect()) == want
