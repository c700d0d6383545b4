"""Runs against a plain search of all periods, and the digest columns of the query."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbspark.llm import periodic, queries

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [(1, None, "en", None, 0), (2, "", None, "a", 0), (3, "   \n\t", "en", "a", 5), (4, "word " * 30_000, "en", "a", 0), (4, "word " * 30_000, "en", "a", 0),
       (None, "a b " * 9 + "c", "en", "b", 0), (6, "日本語 text " * 20, "fr", "c", 0), (7, "x", "en", "c", 1)]


def plain(words, least=12):
    """Runs by comparing all words q apart for each q, smallest period of a stretch first."""
    n, found = len(words), {}
    ids = np.unique(words, return_inverse=True)[1] if n else np.zeros(0)
    for q in range(1, n // 2 + 1):
        same = np.concatenate([[False], ids[:-q] == ids[q:], [False]])
        edge = np.flatnonzero(np.diff(same.astype(int)))
        for s, e in zip(edge[::2], edge[1::2] + q):
            if e - s >= max(least, 2 * q):
                found.setdefault((int(s), int(e)), q)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda x: (x[0], x[2]))


def rows_of(rng):
    for letters in (1, 2, 3, 5):
        for n in [*range(0, 30), 64, 200, 500]:
            yield [str(x) for x in rng.integers(0, letters, n)]
    for _ in range(60):  # stretches of all periods, next to one another and with errors
        w = []
        for _ in range(rng.integers(1, 6)):
            unit = rng.integers(0, 4 if rng.random() < 0.7 else 1000, rng.integers(1, 70))
            w += np.tile(unit, 8)[:rng.integers(1, 8 * len(unit) + 1)].tolist()
        if w and rng.random() < 0.5:
            w[rng.integers(0, len(w))] = -1
        yield [str(x) for x in w]
    yield list("ababababab" "babababab") + list("xy")
    fib = ["a", "ab"]
    while len(fib[-1]) < 700:
        fib.append(fib[-1] + fib[-2])
    yield list(fib[-1])
    yield list("abcabcabd" * 30)


def test_runs_equal_a_plain_search():
    texts = list(rows_of(np.random.default_rng(3)))
    want = [plain(w) for w in texts]
    assert periodic.runs_of_texts(texts) == want and sum(map(len, want)) > 300
    for w, x in zip(texts, want):
        assert periodic.runs_of_texts([w]) == [x]
    gone = set()
    for s, n, q in want[-1]:
        gone |= set(range(s + q, s + n))
    assert periodic.collapsed(texts[-1], want[-1]) == [w for i, w in enumerate(texts[-1]) if i not in gone]


def test_least_length():
    w = list("ab" * 10) + list("cdefgh" * 2) + list("klmnopq" * 2)
    assert periodic.runs_of_texts([w]) == [[(0, 20, 2), (20, 12, 6), (32, 14, 7)]] and periodic.runs_of_texts([w], 13) == [[(0, 20, 2), (32, 14, 7)]]
    with pytest.raises(ValueError):
        periodic.periodic_runs(None, least=5)


def test_odd_rows_and_clashing_names(spark):
    odd = spark.createDataFrame(ODD, DOCS).withColumn("runs", F.lit(1)).withColumn("collapsed", F.lit("x")).withColumn("__text", F.lit(2))
    got = periodic.periodic_runs(odd)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "__text", "runs", "collapsed"]
    rows = got.collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(ODD) and all(by[k].runs == [] for k in (1, 2, 3, 7)) and [by[k].collapsed for k in (1, 2, 3, 7)] == ["", "", "", "x"]
    assert by[4].runs[0].asDict() == {"start": 0, "length": 30_000, "period": 1} and by[4].collapsed == "word"
    assert by[None].runs[0].asDict() == {"start": 0, "length": 18, "period": 2} and by[None].collapsed == "a b c"
    assert periodic.periodic_runs(spark.createDataFrame([], DOCS)).count() == 0
    million = ["w%d" % (i % 99_991) for i in range(250_000)]
    assert periodic.runs_of_texts([million]) == [[(0, 250_000, 99_991)]]


def expected(doc_id, text):
    words = periodic.WORDS.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain(words)
    best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_equals_a_plain_search(spark, sf_dir):
    got = queries.op11_periodic_runs(spark, sf_dir)
    assert got.dtypes == [("doc_id", "bigint"), *((c, "bigint") for c in ("n_runs", "start", "length", "period", "exponent_milli")), ("runs_sha256", "string"), ("collapsed_sha256", "string")]
    src = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = sorted(expected(r.doc_id, r.text) for r in src)
    assert sorted(map(tuple, got.collect())) == want and sum(r[1] > 0 for r in want) > 5
