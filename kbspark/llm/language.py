"""Language identification of texts that may mix languages.

Each word gets a score for each learned language from its character n-grams. The
script of the word leaves only languages written in it. Viterbi over the words, with
a penalty for every change of language, labels spans; a document takes the language
of most of its letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm import common as C

# First and last code point of scripts, as the Unicode blocks have them.
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("arabic", 0x0750, 0x077F), ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F),
    ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x2FA1F),
)
NAMES = sorted({s for s, _, _ in SCRIPTS}) + ["other"]
#: n-grams share a table of so many rows; their orders.
BUCKETS, ORDERS = 1 << 16, (1, 2, 3, 4)
FAR = np.float32(-1e4)


@dataclass(frozen=True)
class LanguageModel:
    """``table`` holds the log probability of each n-gram bucket by language, with a last row of zeros; ``writes`` the scripts of each language."""

    languages: tuple[str, ...]
    table: np.ndarray
    writes: np.ndarray
    switch: float


def _script(c: str) -> int:
    code = ord(c)
    return next((NAMES.index(s) for s, low, high in SCRIPTS if low <= code <= high), len(NAMES) - 1)


def _words(texts: list[str]):
    """Letters in lower case, words as runs of letters, and the words before each text."""
    cp, first, _ = C.code_points(texts)
    low = C.lower_letters(cp)
    begin, end = C.runs(low > 0)
    return cp, low, first, begin, end, np.concatenate([np.searchsorted(begin, first), [len(begin)]])


def _ngrams(low: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[np.ndarray]:
    """For each order the bucket of the n-gram at each place of each word, the boundary before it included; BUCKETS where it leaves the word."""
    padded = np.concatenate([[0], low, np.zeros(max(ORDERS), np.uint32)]).astype(np.uint32)
    size = end - begin + 1
    at = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
    last = np.repeat(end + 1, size)
    key = np.zeros(len(padded), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        key = key * np.uint32(0x2C1B3C6D) + np.concatenate([padded[n - 1:], np.zeros(n - 1, np.uint32)]) + np.uint32(n)
        if n in ORDERS:
            spread = (key ^ (key >> np.uint32(15))) * np.uint32(0x9E3779B1)
            yield np.where(at + n - 1 <= last, (spread >> np.uint32(16))[at], BUCKETS)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", docs_per_language: int = 4000, switch: float = 12.0, most_languages: int = 200) -> LanguageModel:
    """Learns from about ``docs_per_language`` documents of each language (the documented bound), chosen by the hash of the text.

    Of more than ``most_languages`` values of ``lang`` those with the most documents are learned. Rows without text or language teach nothing. No rows give a model without languages, which answers ``und``.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    counts = {r[0]: r[1] for r in 
              labelled.filter(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()}
    languages = tuple(sorted(counts))
    L = len(languages)
    if not L:
        return LanguageModel((), np.zeros((BUCKETS + 1, 0), np.float32), np.zeros((len(NAMES), 0), bool), switch)
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, docs_per_language / counts[k])))])
    chosen = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < F.element_at(share, F.col("lang")) * 1_000_000)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, letters = np.zeros((L, BUCKETS + 1), np.int64), np.zeros((L, len(NAMES)), np.int64)
        for b in batches:
            texts, langs = C.strings(b.column(0)), b.column(1).to_pylist()
            for k, name in enumerate(languages):
                own = [t for t, x in zip(texts, langs) if x == name]
                for i, j in C.slices(own):
                    cp, low, _, begin, end, _ = _words(own[i:j])
                    for g in _ngrams(low, begin, end):
                        grams[k] += np.bincount(g, minlength=BUCKETS + 1)
                    letters[k] += np.bincount(C.per_code_point(cp[low > 0], _script, np.uint8), minlength=len(NAMES))
        both = np.concatenate([grams[:, :BUCKETS], letters], axis=1)
        k, cell = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(cell, pa.int32()), pa.array(both[k, cell], pa.int64())], ["k", "cell", "n"])

    # at most languages x BUCKETS rows, however large the corpus
    got = chosen.mapInArrow(kernel, "k int, cell int, n bigint").groupBy("k", "cell").agg(F.sum("n").alias("n")).toArrow()
    both = np.zeros((L, BUCKETS + len(NAMES)))
    both[got["k"].to_numpy(), got["cell"].to_numpy()] = got["n"].to_numpy()
    grams, letters = both[:, :BUCKETS] + 0.5, both[:, BUCKETS:]
    table = np.concatenate([np.log(grams / grams.sum(axis=1, keepdims=True)), np.zeros((L, 1))], axis=1)
    table[:, :BUCKETS] -= table[:, :BUCKETS].mean(axis=0, keepdims=True)
    writes = letters >= 0.01 * np.maximum(letters.sum(axis=1, keepdims=True), 1)
    return LanguageModel(languages, np.ascontiguousarray(table.T.astype(np.float32)), np.ascontiguousarray((writes & (letters > 0)).T), switch)


def word_scores(m: LanguageModel, cp: np.ndarray, low: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score of each word by language: candidates by script, then the mean over orders of the summed n-gram scores; and whether any language writes its script."""
    size = end - begin + 1
    at = np.concatenate([[0], np.cumsum(size)[:-1]])
    total = sum(m.table[g] for g in _ngrams(low, begin, end))
    scores = np.add.reduceat(total, at, axis=0) / np.float32(len(ORDERS))
    may = m.writes[C.per_code_point(cp[begin], _script, np.uint8)]
    known = may.any(axis=1, keepdims=True)
    return np.where(known, np.where(may, scores, FAR), np.float32(0)), known[:, 0]


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float, chunk: int = 64) -> np.ndarray:
    """Best label of each word; ``first`` has the words before each text, one entry more than texts.

    Texts are cut into chunks. A chunk maps scores at its begin to scores at its end by a
    max-plus matrix, so all chunks advance together, word by word; then the chunks of each
    text are joined, forwards for scores and backwards for labels. Equal scores keep the language, then take the first.
    """
    n, L = scores.shape
    labels = np.zeros(n, np.uint8)
    length = np.diff(first)
    pieces = (length + chunk - 1) // chunk
    if not pieces.sum():
        return labels
    text = np.repeat(np.arange(len(length)), pieces)
    step = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)  # place of the chunk in its text
    start = first[:-1][text] + step * chunk
    size = np.minimum(chunk, first[1:][text] - start)
    order = np.argsort(-size, kind="stable")  # chunks still running are a prefix
    start, size, rank = start[order], size[order], np.argsort(order, kind="stable")
    live = [int(np.searchsorted(-size, -t, side="left")) for t in range(int(size.max()))]  # size > t
    pen = np.float32(switch)
    through = np.full((len(start), L, L), FAR * 1e3, np.float32)
    through[:, np.arange(L), np.arange(L)] = 0
    for t, k in enumerate(live):
        v = through[:k]
        through[:k] = np.maximum(v, v.max(axis=2, keepdims=True) - pen) + scores[start[:k] + t][:, None, :]
    # scores at the begin of each chunk, text by text
    by_step = np.argsort(step, kind="stable")
    bounds = np.searchsorted(step[by_step], np.arange(int(step.max()) + 2))
    begin = np.zeros((len(start), L), np.float32)
    final = np.zeros(len(text), np.int64)
    for s in range(len(bounds) - 1):
        now = by_step[bounds[s]:bounds[s + 1]]
        out = (begin[rank[now]][:, :, None] + through[rank[now]]).max(axis=1)
        out -= out.max(axis=1, keepdims=True)
        final[now] = out.argmax(axis=1)
        follows = step[np.minimum(now + 1, len(step) - 1)] == s + 1
        begin[rank[now[follows] + 1]] = out[follows]
    # forwards in the chunks with the way back of each state
    back = np.zeros((int(size.max()), len(start), L), np.uint8)
    own = np.arange(L, dtype=np.uint8)
    v = begin
    for t, k in enumerate(live):
        top = v[:k].argmax(axis=1)
        best = v[np.arange(k), top][:, None] - pen
        back[t, :k] = np.where(v[:k] >= best, own, top[:, None].astype(np.uint8))
        v[:k] = np.maximum(v[:k], best) + scores[start[:k] + t]
    # backwards for every state at the end of a chunk: the labels, and the state before the chunk
    ways = np.zeros((int(size.max()), len(start), L), np.uint8)
    state = np.broadcast_to(own, (len(start), L)).copy()
    for t in range(len(live) - 1, -1, -1):
        k = live[t]
        ways[t, :k] = state[:k]
        state[:k] = np.take_along_axis(back[t, :k], state[:k], axis=1)
    at_end = np.zeros(len(text), np.int64)
    for s in range(len(bounds) - 2, -1, -1):
        now = by_step[bounds[s]:bounds[s + 1]]
        after = np.minimum(now + 1, len(step) - 1)
        follows = (step[after] == s + 1) & (now + 1 < len(step))
        at_end[now] = np.where(follows, state[rank[after], at_end[after]], final[now])
    end_state = at_end[order]
    for t, k in enumerate(live):
        labels[start[:k] + t] = ways[t, np.arange(k), end_state[:k]]
    return labels


def identify(docs: DataFrame, m: LanguageModel, text: str = "text", spans: bool = True) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (share of the letters that stand in spans of that language and in a script of a learned one) and ``lang_spans``.

    A span is (begin, end, lang) in code points, from the first letter of its first word to behind its
    last letter. Texts that are null or have no letter get ``und``, score 0 and no span. Columns of these names are replaced.
    """
    from pyspark.sql import types as T

    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    if spans:
        new.append(T.StructField("lang_spans", T.ArrayType(T.StructType([
            T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))))
    kept = docs.drop("lang_pred", "score", "lang_spans")
    names, out_names = pa.array([*m.languages, "und"]), [*kept.columns, *(f.name for f in new)]
    L = len(m.languages)

    def label(texts: list[str]):
        cp, low, first, begin, end, before = _words(texts)
        n = len(texts)
        if not L or not len(begin):
            return np.full(n, L), np.zeros(n), np.zeros(n + 1, np.int32), (np.zeros(0, np.int32),) * 3
        scores, known = word_scores(m, cp, low, begin, end)
        labels = viterbi(scores, before, m.switch)
        owner = np.repeat(np.arange(n), np.diff(before))
        # words in a script of no learned language are no evidence for the language of the span they stand in
        share = np.bincount(owner * L + labels, weights=(end - begin) * known, minlength=n * L).reshape(n, L)
        letters = np.bincount(owner, weights=end - begin, minlength=n)
        pred = np.where(letters > 0, share.argmax(axis=1), L)
        head = np.flatnonzero((np.diff(labels, prepend=labels[0]) != 0) | (np.diff(owner, prepend=-1) != 0))
        tail = np.concatenate([head[1:], [len(labels)]]) - 1
        offsets = np.concatenate([np.searchsorted(owner[head], np.arange(n)), [len(head)]]).astype(np.int32)
        base = first[owner[head]]
        return pred, share.max(axis=1) / np.maximum(letters, 1), offsets, (begin[head] - base, end[tail] - base, labels[head])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, texts in C.text_slices(b.column(b.num_columns - 1), 1 << 19):
                pred, score, offsets, (lo, hi, lab) = label(texts)
                out = [*b.slice(i, j - i).columns[:-1], names.take(pa.array(pred)), pa.array(score)]
                if spans:
                    items = pa.StructArray.from_arrays([pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), names.take(pa.array(lab))], ["begin", "end", "lang"])
                    out.append(pa.ListArray.from_arrays(pa.array(offsets), items))
                yield pa.RecordBatch.from_arrays(out, out_names)

    # the text travels once more at the end, so that it is found whatever the columns are called
    return C.with_text(docs, text, "lang_pred", "score", "lang_spans").mapInArrow(kernel, T.StructType([*kept.schema.fields, *new]))
