"""Every query against its SQL twin, on tables that are large enough for rare cases."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from vitrine.plans import catalogue

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def cells(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) else round(x, 6) if isinstance(x, float) else x
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    if name not in catalogue.ORACLE_SQL:
        assert df.count() > 0
        return
    found = duck.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    assert cells(df.collect(), df.columns) == cells(found.fetchall(), names)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 24
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
