import datetime
import math

import duckdb
import pytest

from tidemark.llm.queries import ORACLES, QUERIES


def plain(v):
    v = v.tolist() if hasattr(v, "tolist") else v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 8)
    return str(v) if isinstance(v, datetime.datetime) else int(v) if isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    df, got = QUERIES[name](spark, sf), con.execute(ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    assert sorted(repr([plain(v) for v in r]) for r in df.collect()) == sorted(repr([plain(r[i]) for i in order]) for r in got.fetchall())
