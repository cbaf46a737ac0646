"""Every catalogue query against its DuckDB SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from glasswing.plans import catalogue, mechanisms  # noqa: F401


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def rows(frame, columns):
    plain = lambda v: None if pd.isna(v) else v.item() if hasattr(v, "item") else v
    number = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted(repr(tuple(number(plain(v)) for v in r)) for r in frame[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, sf_dir, name):
    out = catalogue.QUERIES[name](spark, sf_dir)
    columns = sorted(out.columns)
    got = out.toPandas()
    if name not in catalogue.ORACLES:
        assert len(got)
        return
    want = duck.sql(catalogue.ORACLES[name]).df()
    assert sorted(want.columns) == columns and rows(got, columns) == rows(want, columns)


def test_entry(spark, sf_dir):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["vec_id", "grp", "label", "p"]
