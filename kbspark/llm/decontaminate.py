"""Benchmark passages in training texts: BM25 retrieval with block-max bounds, then a check of question and answer.

The index is built of the benchmark, and every passage of every text is a query. Items are indexed in segments of at most
``SEGMENT`` words, passages are windows of twice as many words that start every ``SEGMENT`` words, so a segment lies whole in some passage.
Impacts are divided by the segment's score for itself; the threshold is a share of it. Segments stand in blocks, and a block keeps
the largest impact of each term. A passage passes over every block whose summed maxima stay below the threshold; in the others it
scores each segment exactly, and all at or above the threshold are retrieved. An item counts when enough three-word runs of its question
and of its answer stand around the passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm import common as C

SEGMENT, BLOCK, ENTRIES = 32, 8, 512
K1, B = 1.2, 0.75
#: Terms of more than this share of the segments don't count in the maxima of blocks that need other terms to reach the threshold.
COMMON_SHARE = 0.1
#: Sums of float32 impacts are off by less; the bound must not fall below the score by it.
ROUNDING = 1e-4
#: Characters of benchmark text in one index; a larger benchmark is taken in several.
INDEX_CHARS = 8 << 20
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _alnum(c: str) -> int:
    low = c.lower()
    return (ord(low) if len(low) == 1 else ord(c)) if c.isalnum() else 0


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each lower-cased run of letters and digits, the words before each text, and how many question marks stand before each word's end."""
    cp, first, _ = C.code_points(texts)
    low = C.per_code_point(cp, _alnum, np.uint32)
    begin, end = C.runs(low > 0)
    marks = np.searchsorted(np.flatnonzero(cp == 63), end, side="right") if (cp == 63).any() else np.zeros(len(end), np.int64)
    return C.word_hashes(low, low > 0, begin, end), np.concatenate([np.searchsorted(begin, first), [len(begin)]]), marks


def grams(w: np.ndarray, n: int) -> np.ndarray:
    """Hashes of runs of ``n`` words."""
    if len(w) < n or not n:
        return np.zeros(0, np.uint64)
    return C.mix(sum(w[k:len(w) - n + 1 + k] * FACTORS[k] for k in range(n)))


def sequences(w: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each place on."""
    h = np.zeros(max(len(w) - n + 1, 0), np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9FB21C651E98DF25) + w[k:k + len(h)]
    return C.mix(h + np.uint64(n))


def parts(w: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of question and answer: cut behind the last question mark, or after two thirds of the words where there is none inside."""
    total = int(marks[-1]) if len(marks) else 0
    cut = int(np.searchsorted(marks, total)) + 1 if total and marks[0] < total else 0
    if not 0 < cut < len(w):
        cut = max(1, (2 * len(w) + 2) // 3)
    return w[:cut], w[cut:]


class Index:
    """Items as hashed words; ``blocks`` are the block-max index of each ``ENTRIES`` segments."""

    def __init__(self, ids: list[int], texts: list[str], min_words: int):
        w, first, marks = words(texts)
        self.items, segments, short = [], [], {}
        for i, item in enumerate(ids):
            own = w[first[i]:first[i + 1]]
            if len(own) < min_words:
                if len(own):
                    short.setdefault(len(own), []).append((int(sequences(own, len(own))[0]), item))
                continue
            m = marks[first[i]:first[i + 1]]
            question, answer = parts(own, m - (m[0] if m[0] and first[i] == 0 else (marks[first[i] - 1] if first[i] else 0)))
            runs = [np.unique(grams(x, min(3, len(x)))) for x in (question, answer)]
            self.items.append((item, len(own), min(3, len(question)), runs[0], min(3, len(answer)), runs[1]))
            segments += [(len(self.items) - 1, x) for x in np.array_split(own, -(-len(own) // SEGMENT))]
        # items too short for a score are looked for word by word: hashes of their sequences, and their ids, by number of words
        self.short = {n: (np.array([h for h, _ in x], np.uint64), [i for _, i in x]) for n, x in ((n, sorted(x)) for n, x in short.items())}
        self.blocks = []
        n = len(segments)
        if not n:
            return
        length = np.array([len(x) for _, x in segments])
        entry = np.repeat(np.arange(n), length)
        vocabulary, term = np.unique(np.concatenate([x for _, x in segments]), return_inverse=True)
        pair, tf = np.unique(entry * len(vocabulary) + term, return_counts=True)
        entry, term = pair // len(vocabulary), pair % len(vocabulary)
        df = np.bincount(term, minlength=len(vocabulary))
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[entry] / length.mean()))
        impact /= np.bincount(entry, weights=impact)[entry]
        for a in range(0, n, ENTRIES):
            here = (entry >= a) & (entry < a + ENTRIES)
            used = np.unique(term[here])
            exact = np.zeros((len(used) + 1, -(-min(ENTRIES, n - a) // BLOCK) * BLOCK), np.float32)  # the last row is for unknown words
            exact[np.searchsorted(used, term[here]), entry[here] - a] = impact[here]
            # terms of many segments are left out of the maxima; what they can add to a segment at most lowers its block's bar
            often = np.append(df[used] > COMMON_SHARE * n, True)
            slack = exact[often].sum(axis=0).reshape(-1, BLOCK).max(axis=1)
            most = np.ceil(exact.reshape(len(exact), -1, BLOCK).max(axis=2) * 1000).astype(np.uint16)
            exact = exact.reshape(len(exact), -1, BLOCK)
            self.blocks.append((vocabulary[used], exact, most, often, slack, [i for i, _ in segments[a:a + ENTRIES]]))

    def search(self, texts: list[str], threshold: float, overlap: float) -> list[tuple]:
        """(text, item, score, question overlap, answer overlap) of each item found, the best score over passages."""
        found: dict[tuple[int, int], tuple] = {}
        w, first, _ = words(texts)
        if not len(w):
            return []
        count = np.diff(first)
        owner = np.repeat(np.arange(len(texts)), count)
        place = np.arange(len(w)) - np.repeat(first[:-1], count)
        halves = -(-count // SEGMENT)
        half_first = np.concatenate([[0], np.cumsum(halves)]).astype(np.int64)
        half = half_first[owner] + place // SEGMENT
        half_owner = np.repeat(np.arange(len(texts)), halves)
        half_start = first[half_owner] + (np.arange(half_first[-1]) - half_first[half_owner]) * SEGMENT
        follows = np.append(half_owner[1:] == half_owner[:-1], False)
        window_end = np.minimum(half_start + 2 * SEGMENT, first[half_owner + 1])
        for vocabulary, exact, most, often, slack, items in self.blocks:
            at = np.minimum(np.searchsorted(vocabulary, w), len(vocabulary) - 1)
            at = np.where(vocabulary[at] == w, at, len(vocabulary))
            known = np.flatnonzero(at < len(vocabulary))
            before = np.full(len(w), -1, np.int64)  # where the word stands before in its text
            order = known[np.argsort(owner[known] * len(vocabulary) + at[known], kind="stable")]
            same = (at[order[1:]] == at[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
            before[order[1:][same]] = order[:-1][same]
            # where common terms alone can reach the threshold they count in the maxima too, and nothing is taken off the bar
            reached = slack > threshold - ROUNDING
            bar = np.ceil(1000 * (threshold - ROUNDING - np.where(reached, 0, slack))).clip(1)
            bound = np.zeros((2, len(half_start), most.shape[1]), np.uint16)
            for blocks, counted in ((np.flatnonzero(~reached), known[~often[at[known]]]), (np.flatnonzero(reached), known)):
                peaks = most if len(blocks) == most.shape[1] else most[:, blocks]
                for back, out in enumerate(bound):  # maxima of the words new in this half, and of those new since the half before
                    new = counted[before[counted] < half_start[half[counted]] - back * SEGMENT]
                    begin = np.flatnonzero(np.diff(half[new], prepend=-1))
                    if len(new) and len(blocks):
                        out[half[new][begin][:, None], blocks] = np.add.reduceat(peaks[at[new]], begin, axis=0, dtype=np.uint16)
            bound[0, :-1] += np.where(follows[:-1, None], bound[1, 1:], np.uint16(0))
            window, block = np.nonzero(bound[0] >= bar)
            for k in range(0, len(window), 4096):
                h, blk = window[k:k + 4096], block[k:k + 4096]
                lo = half_start[h][:, None]
                spot = lo + np.arange(2 * SEGMENT)
                inside = spot < window_end[h][:, None]
                spot = np.where(inside, spot, 0)
                term = np.where(inside & (before[spot] < lo), at[spot], len(vocabulary))
                scores = exact[term, blk[:, None]].sum(axis=1)
                for i, e in zip(*(x.tolist() for x in np.nonzero(scores >= threshold))):
                    t, item = int(half_owner[h[i]]), items[int(blk[i]) * BLOCK + e]
                    if found.get((t, item), (0,))[0] < scores[i, e]:
                        size = self.items[item][1]
                        around = w[max(int(first[t]), int(lo[i, 0]) - size):min(int(first[t + 1]), int(window_end[h[i]]) + size)]
                        verified = self._overlaps(item, around)
                        if min(verified) >= overlap:
                            found[t, item] = (float(scores[i, e]), *verified)
        out = {(t, self.items[i][0]): rest for (t, i), rest in found.items()}
        for n, (hashes, ids) in self.short.items():
            h = sequences(w, n)
            begin, end = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            inside = (place[:len(h)] + n <= count[owner[:len(h)]]) & (end > begin)
            for at in np.flatnonzero(inside).tolist():
                out |= {(int(owner[at]), i): (1.0, 1.0, 1.0) for i in ids[begin[at]:end[at]]}
        return [(*k, *rest) for k, rest in out.items()]

    def _overlaps(self, item: int, around: np.ndarray) -> tuple[float, float]:
        _, _, nq, question, na, answer = self.items[item]
        return tuple(float(np.isin(x, grams(around, n)).mean()) if len(x) else 1.0 for n, x in ((nq, question), (na, answer)))


def _indexes(benchmark: DataFrame, item: str, text: str, min_words: int) -> Iterator[Index]:
    """An index for each part of the benchmark; no part has more than about ``INDEX_CHARS`` characters."""
    rows = benchmark.select(F.col(item).cast("bigint").alias("id"), F.col(text).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL").distinct()
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    many = -(-size // INDEX_CHARS)
    for part in range(many):
        got = rows.filter(F.pmod(F.xxhash64("id"), F.lit(many)) == part).orderBy("id", "text").toArrow()
        yield Index(got["id"].to_pylist(), got["text"].to_pylist(), min_words)


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
            threshold: float = 0.7, overlap: float = 0.6, min_words: int = 8) -> DataFrame:
    """(key, ``item_id``, ``score``, ``question_overlap``, ``answer_overlap``): a row for each benchmark item in each document.

    The key column is called ``doc_id`` where the documents' key is ``item_id``. ``score`` is the BM25 score of the best passage as a share of the segment's own. Null and empty texts match nothing; items without
    id, text or any word are left out. An item of fewer than ``min_words`` words is found where all its words stand in sequence, with 1.0 in the three last columns. Repeated documents match as often.
    """
    out = None
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    key = "doc_id" if key == "item_id" else key
    schema = f"`{key}` bigint, item_id bigint, score double, question_overlap double, answer_overlap double"
    names = [key, "item_id", "score", "question_overlap", "answer_overlap"]
    for index in _indexes(benchmark, item, item_text, min_words):
        def kernel(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i, _, texts in C.text_slices(b.column(1)):
                    got = index.search(texts, threshold, overlap)
                    t, *rest = [list(x) for x in zip(*got)] if got else [[] for _ in range(5)]
                    cols = [b.column(0).take(pa.array([i + x for x in t], pa.int64())), pa.array(rest[0], pa.int64()), *(pa.array(x, pa.float64()) for x in rest[1:])]
                    yield pa.RecordBatch.from_arrays(cols, names)

        part = rows.mapInArrow(kernel, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def without_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
                      threshold: float = 0.7, overlap: float = 0.6, min_words: int = 8) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item, by the rules of ``matches``; one pass over the texts for each index, no shuffle."""
    for index in _indexes(benchmark, item, item_text, min_words):
        def kernel(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                for i, _, texts in C.text_slices(b.column(b.num_columns - 1)):
                    clean[[i + x[0] for x in index.search(texts, threshold, overlap)]] = False
                yield b.filter(pa.array(clean)).select(range(b.num_columns - 1))

        docs = C.with_text(docs, text).mapInArrow(kernel, docs.schema)
    return docs
