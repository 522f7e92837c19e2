"""Every query with SQL against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import numpy as np
import pytest

from corpusloom.plans.registry import QUERIES, SQL

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, list | tuple | np.ndarray):
        return [plain(x) for x in v]
    if isinstance(v, float):
        return round(v, 6)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    assert "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()
    if name in SQL:
        result = duck.execute(SQL[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        assert got == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in result.fetchall())


def test_sort_nulls_keeps_all_rows_in_order(spark, duck):
    got = [(r.doc_id, r.quality) for r in QUERIES["sort_nulls_all"](spark, str(DATA)).collect()]
    assert got == duck.execute(SQL["sort_nulls_all"]).fetchall()
    assert len(got) == duck.execute("select count(*) from documents").fetchone()[0]
    assert got[-1][1] is None and got[0][1] == 1
