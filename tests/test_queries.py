"""Registered queries against their DuckDB equivalents on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from paxlens import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(rows):
    def one(v):
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted(str([one(v) for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    names = sorted(got.columns)
    rows = [tuple(r) for r in got.select(*[f"`{n}`" for n in names]).collect()]
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    want = duck.execute(catalog.ORACLE_SQL[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == names
    order = [cols.index(n) for n in names]
    assert plain(rows) == plain([tuple(r[i] for i in order) for r in want.fetchall()])
