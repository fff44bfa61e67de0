"""Every registered query with SQL against DuckDB, on the small tables."""

import math
import os

import duckdb
import pytest

from sievebook import queries, registry_queries  # noqa: F401 (registers more queries)

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows, names):
    def value(v):
        if hasattr(v, "date") and not hasattr(v, "strftime"):
            v = v.date()
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        return str(v) if hasattr(v, "isoformat") else v

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([value(r[i]) for i in order] for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    rows = got.collect()
    if name not in queries.ORACLES:
        assert rows
        return
    want = duck.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    a, b = plain(rows, got.columns), plain(want.fetchall(), names)
    assert len(a) == len(b)
    assert a == b, [x for x in zip(a, b) if x[0] != x[1]][:2]
