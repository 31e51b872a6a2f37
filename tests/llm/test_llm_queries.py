import math
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

from lexmill.llm import queries  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def norm(v):
    return (None if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", queries.QUERIES)
def test_like_sql(spark, name):
    df = queries.QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = sorted(repr(tuple(map(norm, r))) for r in df.select(*cols).collect())
    if name.endswith("_found"):
        assert len(set(got)) == len(got)
    if name in queries.SQL:
        c = duckdb.connect()
        for p in DATA.iterdir():
            c.execute(f"create view {p.stem} as select * from '{p}'")
        rel = c.execute(queries.SQL[name])
        names = [x[0] for x in rel.description]
        assert sorted(names) == cols
        assert got == sorted(repr(tuple(norm(r[names.index(x)]) for x in cols)) for r in rel.fetchall())
