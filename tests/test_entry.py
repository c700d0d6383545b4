"""Every registered query against its check SQL on the smallest tables."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
import __spark_entry__ as entry  # noqa: E402
from check import norm  # noqa: E402
from kbspark import catalog  # noqa: E402
from kbspark.sources.tables import BASE_TABLES  # noqa: E402


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in BASE_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def test_every_query_has_a_check():
    assert set(catalog.QUERIES) == set(catalog.CHECKS)
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, con, name):
    df = entry.queries()[name](spark, sf_dir)
    got = [tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    cur = con.execute(entry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = [tuple(norm(r[i]) for i in order) for r in cur.fetchall()]
    assert sorted(df.columns) == sorted(names)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
