"""Every core query against DuckDB on the smallest tables; the others run and keep their schema."""

import decimal
import glob
import math
import os

import duckdb
import pytest

from toolweave import catalogue

SQL = catalogue.oracle_sql()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, (float, decimal.Decimal)):
        return repr(round(float(v), 6) + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(sf + "/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, duck, name):
    df = catalogue.queries()[name](spark, sf)
    columns = sorted(df.columns)
    mine = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    got = duck.execute(SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert mine == sorted(tuple(plain(r[i]) for i in at) for r in got.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_runs(spark, sf, name):
    df = catalogue.queries()[name](spark, sf)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)
    # Some value stands in every column of some row: no column is lost on the way.
    assert all(any(r[c] is not None for r in rows) for c in df.columns)


def test_core_imports_without_the_subpackage():
    import pathlib
    import re

    root = pathlib.Path(catalogue.__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"toolweave\.llm|from \.llm", f.read_text()), f


def test_tool_lists_of_all_conversations(spark, sf, duck):
    lists = catalogue.queries()["hybrid_toollist"](spark, sf)
    assert lists.select("conv_id").distinct().count() == duck.execute("SELECT count(*) FROM orders").fetchone()[0]
