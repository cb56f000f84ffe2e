"""Every query of the reference's operators against its SQL, on the smallest tables."""

import math
import os

import pytest

from chirplake.plans import planes, search, streams
from chirplake.plans import queries as plans

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(v):
        if v is None or isinstance(v, bool | str):
            return v
        return None if isinstance(v, float) and math.isnan(v) else round(float(v), 5) + 0.0

    return [columns[i] for i in order], sorted(repr([one(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_matches_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, DATA)
    want = duck.execute(plans.SQL[name])
    assert canonical(got.columns, [tuple(r) for r in got.collect()]) == canonical([c[0] for c in want.description], want.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_gives_rows(spark, name):
    assert plans.QUERIES[name](spark, DATA).count() > 0


@pytest.mark.parametrize("name", sorted(search.SQL))
def test_search_matches_sql(spark, duck, name):
    got = search.QUERIES[name](spark, DATA)
    want = duck.execute(search.SQL[name])
    assert canonical(got.columns, [tuple(r) for r in got.collect()]) == canonical([c[0] for c in want.description], want.fetchall())


@pytest.mark.parametrize("name", sorted(set(search.QUERIES) - set(search.SQL)))
def test_search_gives_rows(spark, name):
    assert search.QUERIES[name](spark, DATA).count() > 0


MORE = [(module, name) for module in (planes, streams) for name in sorted(module.QUERIES)]


@pytest.mark.parametrize(("module", "name"), MORE, ids=[n for _, n in MORE])
def test_more_match_sql(spark, duck, module, name):
    got = module.QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in got.collect()]
    assert rows
    if name in module.SQL:
        want = duck.execute(module.SQL[name])
        assert canonical(got.columns, rows) == canonical([c[0] for c in want.description], want.fetchall())
