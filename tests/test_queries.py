import math
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

from lexmill import queries, skew_queries  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
ALL = queries.QUERIES | skew_queries.QUERIES
SQL = queries.SQL | skew_queries.SQL
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in DATA.iterdir():
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", ALL)
def test_like_sql(spark, con, name):
    df = ALL[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = sorted(repr(tuple(map(norm, r))) for r in df.select(*cols).collect())
    if name not in SQL:
        assert got or name == "q_match_none"
        return
    rel = con.execute(SQL[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == cols
    assert got == sorted(repr(tuple(norm(r[names.index(c)]) for c in cols)) for r in rel.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert set(ALL) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 10
