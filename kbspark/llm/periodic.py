"""Runs (maximal periodic stretches of words) by internal pattern matching.

A run of period q holds an aligned block that stands again q words later. Blocks have dyadic lengths; the period ranges of the
lengths tile all periods. Prefix doubling gives every block's interval of the suffix array, and a wavelet matrix over that array
counts and selects the block's occurrences in the neighbouring windows of its period range. Windows are as wide as the block, so occurrences in one form an
arithmetic progression: two of them and their number give all candidate periods. A candidate is settled by the longest common extensions to both sides,
read from the ranks that prefix doubling left. Words are compared exactly, by numbers given within each text.

Time is n log n for a text of n words; memory is about 12 bytes a word and level of doubling. A text is never cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbspark.llm import common as C

#: A run has max(MIN_LENGTH, 2 * period) words at least.
MIN_LENGTH = 12
#: Base level: blocks of four words, one at each third word, meet every period that a run of twelve words may have.
BASE, BASE_STRIDE = 2, 3
WORDS = re.compile(C.WORD)
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def doubling(ids: np.ndarray, levels: int | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Ranks of all stretches of 1, 2, 4, ... words (the first place of equal ones in the suffix order), suffixes in order, and those still tied.

    The last rank has no ties, unless ``levels`` ends the doubling before.
    """
    n = len(ids)
    count = np.bincount(ids)
    rank = (np.cumsum(count) - count)[ids].astype(np.int32)
    order = np.argsort(ids, kind="stable").astype(np.int32)
    tied, out, h = order[count[ids[order]] > 1], [rank], 1
    while len(tied) and (levels is None or len(out) < levels):
        after = np.minimum(tied + h, n - 1)
        key = rank[tied].astype(np.int64) * (n + 1) + np.where(tied + h < n, rank[after] + 1, 0)
        by = np.argsort(key, kind="stable")
        tied, key = tied[by], key[by]
        old = rank[tied]
        place = np.arange(len(tied))
        start = np.maximum.accumulate(np.where(np.diff(old, prepend=-1) != 0, place, 0))  # of the old group
        first = np.diff(key, prepend=-1) != 0
        sub = np.maximum.accumulate(np.where(first, place, 0))
        order[old + place - start] = tied
        rank = rank.copy()
        rank[tied] = old + sub - start
        size = np.diff(np.append(np.flatnonzero(first), len(tied)))
        tied = tied[np.repeat(size, size) > 1]
        out.append(rank)
        h *= 2
    return out, order, tied


class Wavelet:
    """Wavelet matrix of the positions in suffix order: counts and selects positions of an interval by value."""

    def __init__(self, values: np.ndarray) -> None:
        self.n, self.zeros = len(values), []
        for bit in range(max(int(self.n - 1).bit_length(), 1) - 1, -1, -1):
            one = (values >> bit) & 1 == 1
            self.zeros.append((bit, np.concatenate([[0], np.cumsum(~one, dtype=np.int32)]).astype(np.int32)))
            values = np.concatenate([values[~one], values[one]])

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of each interval are smaller than ``x``."""
        whole, out = np.where(x >= self.n, hi - lo, 0), np.zeros(len(lo), np.int64)
        for bit, zeros in self.zeros:
            a, b = zeros[lo], zeros[hi]
            one = (x >> bit) & 1 == 1
            out += np.where(one, b - a, 0)
            lo, hi = np.where(one, zeros[-1] + lo - a, a), np.where(one, zeros[-1] + hi - b, b)
        return np.where(x >= self.n, whole, out)

    def select(self, lo: np.ndarray, hi: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The value of each interval with ``j`` smaller ones: after ``below(x)`` of them comes the successor of x."""
        out = np.zeros(len(lo), np.int64)
        for bit, zeros in self.zeros:
            a, b = zeros[lo], zeros[hi]
            one = j >= b - a
            j = j - np.where(one, b - a, 0)
            out += one.astype(np.int64) << bit
            lo, hi = np.where(one, zeros[-1] + lo - a, a), np.where(one, zeros[-1] + hi - b, b)
        return out


def extension(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray, forward: bool) -> np.ndarray:
    """How many words from i and j on are alike, or before them where not ``forward``."""
    out, n = np.zeros(len(i), np.int64), len(ranks[0])
    for k in range(len(ranks) - 1, -1, -1):
        r, m = ranks[k], 1 << k
        x, y = (i + out, j + out) if forward else (i - out - m, j - out - m)
        inside = (x < n) & (y < n) if forward else (x >= 0) & (y >= 0)
        out += np.where(inside & (r[np.where(inside, x, 0)] == r[np.where(inside, y, 0)]), m, 0)
    return out


def _candidates(ranks: list[np.ndarray], tree: Wavelet, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Block starts and candidate periods of one level."""
    r, m = ranks[k], 1 << k
    b = np.arange(0, len(r), BASE_STRIDE if k == BASE else m)
    lo = r[b].astype(np.int64)
    hi = lo + np.bincount(r, minlength=len(r))[lo]
    least, most = 1 if k == BASE else 2 * m - 1, 4 * m - 2
    again = hi - lo > 1
    b, lo, hi = b[again], lo[again], hi[again]
    before, end = tree.below(lo, hi, b + least), tree.below(lo, hi, b + most + 1)
    near = end > before
    b, lo, hi, before = b[near], lo[near], hi[near], before[near]
    starts, periods = [], []
    for begin in range(least, most + 1, m):
        upto = tree.below(lo, hi, b + min(begin + m, most + 1))
        w = np.flatnonzero(upto > before)
        s, number = b[w], (upto - before)[w]
        first = tree.select(lo[w], hi[w], before[w])
        step = np.zeros(len(w), np.int64)
        more = np.flatnonzero(number > 1)
        step[more] = tree.select(lo[w[more]], hi[w[more]], before[w[more]] + 1) - first[more]
        # a progression that begins at the block itself is one stretch of period ``step``, its only smallest one
        own = np.flatnonzero((number > 2) & ((first - s) % np.maximum(step, 1) == 0))
        last = first[own] + (number[own] - 1) * step[own]
        own = own[extension(ranks, s[own], s[own] + step[own], True) >= last + m - step[own] - s[own]]
        first[own], number[own] = s[own] + step[own], 1
        at = np.repeat(np.arange(len(w)), number)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(number) - number, number)
        starts.append(s[at])
        periods.append(first[at] + nth * step[at] - s[at])
        before = upto
    return np.concatenate(starts), np.concatenate(periods)


def runs(ids: np.ndarray, least: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of all runs of at least ``max(least, 2 * period)`` numbers, by start and end; ``least`` is 12 or more."""
    ranks, order, _ = doubling(ids)
    none = np.zeros(0, np.int64)
    if len(ranks) <= BASE:
        return none, none, none
    tree = Wavelet(order)
    found = [_candidates(ranks, tree, k) for k in range(BASE, len(ranks))]
    b, q = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
    start, end = b - extension(ranks, b, b + q, False), b + q + extension(ranks, b, b + q, True)
    long = end - start >= np.maximum(least, 2 * q)
    start, end, q = start[long], end[long], q[long]
    by = np.lexsort((q, end, start))
    start, end, q = start[by], end[by], q[by]
    new = (np.diff(start, prepend=-1) != 0) | (np.diff(end, prepend=-1) != 0)  # the smallest period of a stretch comes first
    return start[new], end[new], q[new]


def numbered(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of all texts, other ones in each text and a number of its own after each, and where the texts begin."""
    ids, begin, at, used = [], [], 0, 0
    for words in texts:
        known: dict[str, int] = {}
        own = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        ids += [own + used, [used + len(known)]]
        used += len(known) + 1
        begin.append(at)
        at += len(words) + 1
    return np.concatenate(ids), np.array(begin, np.int64)


def runs_of_texts(texts: list[list[str]], least: int = MIN_LENGTH) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of each text's runs, by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    chosen = [i for i, words in enumerate(texts) if len(words) >= least]
    if not chosen:
        return out
    # a text without a repeated stretch of four words has no run
    ids, begin = numbered([texts[i] for i in chosen])
    _, _, tied = doubling(ids, BASE + 1)
    repeats = np.unique(np.searchsorted(begin, tied, side="right") - 1).tolist()
    if not repeats:
        return out
    chosen = [chosen[i] for i in repeats]
    ids, begin = numbered([texts[i] for i in chosen])
    start, end, q = runs(ids, least)
    owner = np.searchsorted(begin, start, side="right") - 1
    for i, s, length, period in zip(owner.tolist(), (start - begin[owner]).tolist(), (end - start).tolist(), q.tolist()):
        out[chosen[i]].append((s, length, period))
    for found in out:
        found.sort(key=lambda x: (x[0], x[2]))
    return out


def collapsed(words: list[str], found: list[tuple[int, int, int]]) -> list[str]:
    """Words that no run contains after its first period."""
    if not found:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for s, length, period in found:
        edge[s + period] += 1
        edge[s + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]


def periodic_runs(docs: DataFrame, text: str = "text", least: int = MIN_LENGTH) -> DataFrame:
    """Columns of ``docs`` without ``text``, ``runs`` (start, length and period of each, by start and period) and ``collapsed``, the words left joined by one space.

    Words are ``[^\\x20\\x09-\\x0D]+``. Null and empty texts have no runs and an empty ``collapsed``. Columns of those two names are replaced. Each row is
    treated alone, so repeated rows return as often, and rows need no id.
    """
    if least < MIN_LENGTH:
        raise ValueError(f"runs of fewer than {MIN_LENGTH} words are not found")
    others = [c for c in docs.columns if c not in (text, "runs", "collapsed")]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, texts in C.text_slices(b.column(b.num_columns - 1)):
                words = [WORDS.findall(t) for t in texts]
                found = runs_of_texts(words, least)
                rows = [[{"start": s, "length": n, "period": q} for s, n, q in x] for x in found]
                left = [" ".join(collapsed(w, x)) for w, x in zip(words, found)]
                own = [b.column(c).slice(i, j - i) for c in range(b.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(rows, kind), pa.array(left, pa.string())], [*others, "runs", "collapsed"])

    rows = docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`").alias("text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("runs", T.DataType.fromDDL(RUNS)), T.StructField("collapsed", T.StringType())])
    return rows.mapInArrow(kernel, schema)
