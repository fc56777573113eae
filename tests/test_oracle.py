"""Every query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from memtide.catalog_stores import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck() -> duckdb.DuckDBPyConnection:
    if not DATA.is_dir():
        pytest.skip("no driver tables")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(value: object) -> object:
    value = value.item() if hasattr(value, "item") else value
    if value is None or isinstance(value, float) and math.isnan(value) or type(value).__name__ == "NAType":
        return None
    return int(value) if isinstance(value, float) and value.is_integer() else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name: str) -> None:
    ours, theirs = QUERIES[name](spark, str(DATA)).toPandas(), duck.execute(ORACLES[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    rows = lambda df: sorted((tuple(map(plain, r)) for r in df[columns].itertuples(index=False)), key=repr)
    assert rows(ours) == rows(theirs)
