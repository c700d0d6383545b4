"""Document fingerprints by threshold-scaled sketches.

A text's shingles are its runs of eight code points. The sketch keeps every distinct
shingle hash below one sixteenth of the hash range, so its size follows the text, and
sketches of parts merge by union. A text of at most ``WHOLE`` distinct shingles, of which at most ``FEW``
lie below the limit, keeps all of them (a text below eight code points is one shingle); its sketch is cut to one sixteenth before it meets a larger one. Containment is the share
of one sketch found in the other, which holds between texts of very unequal length too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbspark.llm import common as C

WIDTH, SCALE, WHOLE, FEW = 8, 16, 64, 16
LIMIT = np.uint64((1 << 32) // SCALE)


def sketches(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys, the text's place in the high and a hash in the low 32 bits, and for each text whether all shingles are kept."""
    cp, first, length = C.code_points(texts)
    h = cp.astype(np.uint64) + np.uint64(1)
    factor = 0xD1B54A32D192ED03
    for step in (1, 2, 4):  # windows of 2, 4 and 8
        h[:-step] = h[:-step] * np.uint64(factor) + h[step:] * np.uint64(0x9FB21C651E98DF25)
        factor = factor * factor % (1 << 64)
    low = C.mix(h) >> np.uint64(32)
    windows = np.maximum(length - WIDTH + 1, 0)
    at = np.flatnonzero(low < LIMIT)
    owner = np.searchsorted(first, at, side="right") - 1
    inside = at < first[owner] + windows[owner]
    keys = np.unique((owner[inside].astype(np.uint64) << np.uint64(32)) | low[at[inside]])
    kept = np.bincount((keys >> np.uint64(32)).astype(np.int64), minlength=len(texts))
    whole, extra = length < WIDTH, []
    for i in np.flatnonzero((kept <= FEW) & (length > 0)):
        if length[i] < WIDTH:
            all_of = np.frombuffer(hashlib.sha256(texts[i].encode("utf-8", "surrogatepass")).digest()[:4], ">u4").astype(np.uint64)
        else:
            all_of = np.unique(low[first[i]:first[i] + windows[i]])
        if len(all_of) <= WHOLE:
            whole[i] = True
            extra.append((np.uint64(i) << np.uint64(32)) | all_of)
    return np.unique(np.concatenate([keys, *extra])), whole


def encode(keys: np.ndarray, whole: np.ndarray) -> list[str]:
    """One string for each text: kept share (``1`` or ``16``), a colon and the hashes in ascending order, eight hex digits each."""
    digits = (keys & np.uint64(0xFFFFFFFF)).astype(">u4").tobytes().hex()
    bound = np.searchsorted(keys, np.arange(len(whole) + 1, dtype=np.uint64) << np.uint64(32)) * 8
    return [("1:" if w else f"{SCALE}:") + digits[a:b] for w, a, b in zip(whole, bound, bound[1:])]


def decode(fingerprint: str) -> tuple[int, np.ndarray]:
    scale, _, digits = fingerprint.partition(":")
    return int(scale), np.frombuffer(bytes.fromhex(digits), ">u4").astype(np.uint64)


def merge(a: str, b: str) -> str:
    """Fingerprint of the shingles of both; it keeps the smaller share of the two."""
    (s, x), (t, y) = decode(a), decode(b)
    scale = max(s, t)
    both = np.union1d(x, y)
    if scale > 1:
        both = both[both < LIMIT]
    return f"{scale}:" + both.astype(">u4").tobytes().hex()


def compare(keys: np.ndarray, whole: np.ndarray, other: np.ndarray, other_whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the containment of the smaller sketch in the larger and the Jaccard likeness; two empty sketches are equal, one is unlike any other."""
    n = len(whole)
    cut = whole != other_whole
    a, b = (k[(k & np.uint64(0xFFFFFFFF)) < np.where(cut, LIMIT, np.uint64(1 << 32))[(k >> np.uint64(32)).astype(np.int64)]] for k in (keys, other))
    size = [np.bincount((k >> np.uint64(32)).astype(np.int64), minlength=n) for k in (a, b, np.intersect1d(a, b, assume_unique=True))]
    least, union = np.minimum(size[0], size[1]), size[0] + size[1] - size[2]
    empty = (union == 0) & ~cut
    return np.where(empty, 1.0, size[2] / np.maximum(least, 1)), np.where(empty, 1.0, size[2] / np.maximum(union, 1))


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with a column ``out``; a null text has the fingerprint of an empty one, ``1:``. A column of that name is replaced."""
    kept = docs.drop(out)
    names = [*kept.columns, out]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = C.strings(b.column(b.num_columns - 1))
            for i, j in C.slices(texts):
                yield pa.RecordBatch.from_arrays([*b.slice(i, j - i).columns[:-1], pa.array(encode(*sketches(texts[i:j])), pa.string())], names)

    return C.with_text(docs, text, out).mapInArrow(kernel, T.StructType([*kept.schema.fields, T.StructField(out, T.StringType())]))


def _cuts(docs: DataFrame, key: str, rows: int) -> tuple[np.ndarray, int | None]:
    """Keys that begin a bucket of about ``rows`` rows, at most 65,535 of them, and the smallest key; reads the key column only."""
    n, least = docs.agg(F.count(key), F.min(key)).first()
    buckets = min(max(1, -(-n // rows)), 1 << 16)
    if buckets == 1:
        return np.zeros(0, np.int64), least
    at = [float(x) for x in np.arange(1, buckets) / buckets]
    found = docs.select(F.percentile_approx(key, at, max(10_000, 8 * buckets))).first()[0]
    return np.unique(np.array(found, np.int64))[np.unique(np.array(found, np.int64)) > least], least


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", rows_per_bucket: int = 4096) -> DataFrame:
    """Fingerprints of each text and of an edited text, and their likeness to each other and to the next document.

    The edited text has the last quarter of the code points (rounded down) replaced by as many first ones of the next
    document, or by all it has; next in ascending order of ``key``, equal keys by the hash of the text, the first after the last.
    A row without key has no next: its edited text is its text and ``near_next`` is null. Null texts count as empty.

    Texts are shuffled once, into key ranges. A row that begins a range is also sent to the range before, so no range needs another.
    """
    docs = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cuts, least = _cuts(docs, "doc_id", rows_per_bucket)
    ranged = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("marker", T.BooleanType()), *docs.schema.fields])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids = b.column(0).fill_null(0).to_numpy()
            bucket = np.where(known, np.searchsorted(cuts, ids, side="right"), -1 - np.arange(len(ids)) % 64)
            before = np.where(known & np.isin(ids, cuts), bucket - 1, np.where(known & (ids == least), len(cuts), -1))
            also = np.flatnonzero(before >= 0)
            rows = np.concatenate([np.arange(len(ids)), also])
            place, marks = np.concatenate([bucket, before[also]]), np.arange(len(rows)) >= len(ids)
            picked = b.take(pa.array(rows)) if len(also) else b
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(marks), *picked.columns], ["bucket", "marker", "doc_id", "text"])

    def report(rows: list[tuple], texts: list[str]) -> tuple[pa.RecordBatch | None, int]:
        """Rows whose next row is known too; the number of rows done."""
        n = len(rows)
        own, whole = sketches(texts)
        names = encode(own, whole)
        done, after = [], []
        for i, (bucket, marker, doc) in enumerate(rows):
            if marker or (doc is not None and i + 1 == n):
                continue
            done.append(i)
            after.append(i + 1 if doc is not None else i)
        if not done:
            return None, 0
        edited = []
        for i, k in zip(done, after):
            cut = len(texts[i]) // 4 if k != i else 0
            edited.append(texts[i][:len(texts[i]) - cut] + texts[k][:cut])
        new, new_whole = sketches(edited)
        spot = np.zeros(n, np.int64)
        spot[done] = np.arange(len(done))

        def moved(which: np.ndarray) -> np.ndarray:
            """Keys of the chosen rows under their new places."""
            bound = np.searchsorted(own, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))
            size = np.diff(bound)[which]
            at = np.repeat(bound[which] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            return (np.repeat(np.arange(len(which), dtype=np.uint64), size) << np.uint64(32)) | (own[at] & np.uint64(0xFFFFFFFF))

        here, there = moved(np.array(done)), moved(np.array(after))
        near, jac = compare(here, whole[done], new, new_whole)
        nxt, jac_next = compare(here, whole[done], there, whole[after])
        alone = np.array([k == i for i, k in zip(done, after)])
        hashed = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]
        cols = [pa.array([rows[i][2] for i in done], pa.int64()), pa.array([len(texts[i]) for i in done], pa.int64()), pa.array(hashed),
                pa.array([names[i] for i in done]), pa.array(encode(new, new_whole)), pa.array(near), pa.array(nxt, mask=alone),
                pa.array(jac), pa.array(jac_next, mask=alone)]
        return pa.RecordBatch.from_arrays(cols, out.names), len(done)

    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()),
                        *(T.StructField(n, T.StringType()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")),
                        *(T.StructField(n, T.DoubleType()) for n in ("near_edited", "near_next", "jaccard_edited", "jaccard_next"))])

    def compare_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        texts: list[str] = []

        def flush() -> Iterator[pa.RecordBatch]:
            got, _ = report(rows, texts)
            if got is not None:
                yield got
            del rows[:-1], texts[:-1]  # the last row waits for its next one

        for b in batches:
            cols = [b.column(k).to_pylist() for k in range(4)]
            size = 0
            for bucket, marker, doc, text in zip(*cols):
                if rows and rows[-1][1] and marker and rows[-1][0] == bucket:
                    continue  # a further row with the key of the next range's first
                rows.append((bucket, marker, doc))
                texts.append(text)
                size += len(text)
                if size > 1 << 20:
                    yield from flush()
                    size = len(texts[-1])
                    if rows[-1][2] is None or rows[-1][1]:
                        rows.clear(), texts.clear()
        if rows:
            yield from flush()

    dealt = docs.mapInArrow(deal, ranged).repartition("bucket").sortWithinPartitions("bucket", "marker", "doc_id", F.xxhash64("text"))
    return dealt.mapInArrow(compare_all, out)
