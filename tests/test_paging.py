"""Keyset pages over several keys with directions and nulls, and jumps by the page index."""

from __future__ import annotations

import itertools
import random

import pytest

from kbspark.operators import paging as T


@pytest.mark.parametrize("kinds", list(itertools.product([True, False], [None, True, False], repeat=1)) + [(True, False)])
def test_keyset_pages_give_the_whole_order(spark, kinds):
    r = random.Random(5)
    df = spark.createDataFrame([(r.choice([None, 1, 2, 2, 3]), r.choice([None, "x", "y"]), i) for i in range(70)], "a int, b string, id int")
    keys = [T.Key("a", *kinds), T.Key("b", not kinds[0]), T.Key("id")]
    want = [tuple(x) for x in df.orderBy(*[k.sort() for k in keys]).collect()]
    got, last = [], None
    while True:
        page = [tuple(x) for x in T.next_page(df, keys, last, 16).collect()]
        got += page
        if len(page) < 16:
            break
        last = page[-1]
    assert got == want


def test_jumps_read_one_range(spark, tmp_path):
    r = random.Random(6)
    rows = [(r.choice([None, *range(40)]), i) for i in range(3000)] + [(7, 10_000 + i) for i in range(1500)]  # a third of the rows share a key
    df = spark.createDataFrame(rows, "a int, id int").repartition(4)
    keys = [T.Key("a", False), T.Key("id")]
    want = [tuple(x) for x in df.orderBy(*[k.sort() for k in keys]).collect()]
    index = T.PageIndex.build(df, keys, str(tmp_path / "i"), rows_per_range=300)
    counts = index.counts()
    assert sum(n for _, n in counts) == 4500 and len(counts) >= 12 and max(n for _, n in counts) < 1500
    for number, size in ((0, 10), (1, 10), (200, 10), (449, 10), (450, 10), (3, 1000), (4, 1000), (9, 500)):
        assert [tuple(x) for x in index.jump(number, size).collect()] == want[number * size:(number + 1) * size]
    plan = index.jump(300, 10)._jdf.queryExecution().executedPlan().toString()
    assert "range#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert index.read().filter("range = 3").select("_metadata.file_path").distinct().count() == 1
