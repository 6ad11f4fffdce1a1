"""Every registered SQL of the training-data operators against its query, on the smallest tables, if these are there."""

import math
import os

import pytest

from cedarlog.llm import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF_DIR)

    def norm(v):
        return None if isinstance(v, float) and math.isnan(v) else round(v, 5) if isinstance(v, float) else v

    cur = con.execute(queries.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    mine = sorted(repr([norm(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    assert mine == sorted(repr([norm(r[names.index(c)]) for c in sorted(names)]) for r in cur.fetchall())
