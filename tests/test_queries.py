"""Every registered query with SQL agrees with it, on the smallest tables."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from corvane.plans import catalogue

WHERE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in Path(WHERE).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    return ("nan" if math.isnan(v) else float(f"{v:.8g}") + 0.0) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_agrees_with_sql(spark, sql, name):
    df, want = catalogue.QUERIES[name](spark, WHERE), sql.sql(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in df.columns]
    assert Counter(tuple(map(plain, r)) for r in df.collect()) == Counter(tuple(plain(r[k]) for k in order) for r in want.fetchall())
