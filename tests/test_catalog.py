"""Every registered trace query against its DuckDB SQL on the same tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from flamewright.plans import catalog, catalog_sections  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def rows(frame, columns):
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, sf, name):
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), con.execute(catalog.ORACLES[name]).df()
    assert set(got.columns) == set(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_children_of_every_thread(spark, sf):
    """Against brute force over all threads of both traces."""
    want = {}
    events = [r for r in catalog.tev(spark, sf).collect()]
    tasks = [r for r in events if r.name == "RunTask"]
    for t in tasks:
        for k in events:
            if k.name != "RunTask" and (k.trace_id, k.tid) == (t.trace_id, t.tid) and t.ts <= k.ts <= t.ts + t.dur:
                key = (t.trace_id, int(t.tid), t.seq, k.name)
                n, total = want.get(key, (0, 0.0))
                want[key] = (n + 1, total + k.dur)
    got = catalog.QUERIES["interval_children"](spark, sf).collect()
    assert {(r.trace_id, r.tid, r.task, r.name): (r["count"], r.total) for r in got} == want
    assert len({r.tid for r in got}) == 8
