"""Compare a text query with its SQL."""

import duckdb

from gleanframe.llm.queries import ORACLES, QUERIES
from tools.check_oracle import TABLES, canonical


def assert_matches_sql(spark, name, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = QUERIES[name](spark, sf)
    res = con.execute(ORACLES[name])
    columns = [d[0] for d in res.description]
    assert sorted(columns) == sorted(df.columns)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    assert got == canonical(res.fetchall(), columns)
    assert got
