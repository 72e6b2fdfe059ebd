"""Every core query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from corpusloom import queries


def plain(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def value(x):
        if isinstance(x, float):
            return None if math.isnan(x) else int(x) if x == int(x) else x
        return x

    return sorted((tuple(value(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def con(folder):
    c = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, folder, con, name):
    df = queries.QUERIES[name](spark, folder)
    got = [tuple(r) for r in df.collect()]
    if name in queries.SQL:
        r = con.execute(queries.SQL[name])
        want, cols = r.fetchall(), [c[0] for c in r.description]
        assert sorted(cols) == sorted(df.columns)
        assert plain(df.columns, got) == plain(cols, want)
    else:
        assert got or name == "exact_search"
