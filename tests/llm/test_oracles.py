"""The SQL of operators against their queries."""

import math

import duckdb
import pytest

from quillet.llm import oracles, queries


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "sales"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = queries.QUERIES[name](spark, sf)
    res = con.execute(oracles.ORACLES[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    want, got = sorted(res.fetchall(), key=repr), sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    assert len(got) == len(want)
    assert all(x == y or isinstance(x, float) and math.isclose(x, y) for g, w in zip(got, want, strict=True) for x, y in zip(g, w, strict=True)), [(g, w) for g, w in zip(got, want, strict=True) if g != w][:3]
