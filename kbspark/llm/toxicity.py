"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are words, their first five and six letters, pairs of neighbours and pairs with one word between,
each counted once in a text and hashed to 2**20 coordinates. Every coordinate has its own learning rate, and L1
leaves few weights other than zero, which every scoring task receives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbspark.llm import common as C

BITS = 20


@dataclass(frozen=True)
class ToxicityModel:
    """Coordinates with a weight, ascending, their weights, and the bias."""

    at: np.ndarray
    weight: np.ndarray
    bias: float


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and coordinate of each n-gram, with repeats."""
    cp, first, _ = C.code_points(texts)
    low = C.lower_letters(cp)
    begin, end = C.runs(low > 0)
    owner = np.searchsorted(first, begin, side="right") - 1
    inside = low > 0
    word = C.word_hashes(low, inside, begin, end)
    sets, owners = [word], [owner]
    for most in (5, 6):
        long = end - begin > most
        sets.append(C.mix(C.word_hashes(low, inside, begin, end, most)[long] + np.uint64(most)))
        owners.append(owner[long])
    for gap in (1, 2):
        same = owner[:-gap] == owner[gap:]
        sets.append(C.mix(word[:-gap] * np.uint64(0xA0761D6478BD642F) + word[gap:] * np.uint64(0xE7037ED1A0B428DB) + np.uint64(gap))[same])
        owners.append(owner[gap:][same])
    return np.concatenate(owners), (np.concatenate(sets) >> np.uint64(64 - BITS)).astype(np.int64)


def _distinct(owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((owner << BITS) | at)
    return both >> BITS, both & ((1 << BITS) - 1)


def _weights(z: np.ndarray, n: np.ndarray, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))


def fit(labelled: DataFrame, text: str = "text", label: str = "toxic", max_rows: int = 20_000, shards: int = 4, rounds: int = 5,
        alpha: float = 1.0, beta: float = 1.0, l1: float = 3.0, l2: float = 0.1) -> ToxicityModel:
    """Learns from about ``max_rows`` rows (the documented bound) chosen by the hash of the text; rows without text or label teach nothing.

    Each shard of the sample runs the sequential update over its rows from the shared state. After a round the state of a
    coordinate moves by the mean change of the shards that met it. State is two numbers for each of 2**20 coordinates.
    """
    n_rows = labelled.filter(F.col(label).isNotNull()).count()
    sample = (labelled.select(F.col(text).alias("text"), F.col(label).cast("int").alias("y"), F.xxhash64(F.col(text)).alias("h"))
              .filter("text IS NOT NULL AND y IS NOT NULL").filter(F.pmod("h", F.lit(1_000_000)) < 1_000_000 * min(1.0, max_rows / max(n_rows, 1)))
              .withColumn("shard", F.pmod(F.shiftright("h", 20), F.lit(shards)).cast("int")))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = C.strings(b.column(0))
            for i, j in C.slices(texts):
                owner, at = _distinct(*features(texts[i:j]))
                bound = np.searchsorted(owner, np.arange(j - i + 1)).astype(np.int32)
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(3), part.column(1), part.column(2), pa.ListArray.from_arrays(pa.array(bound), pa.array(at, pa.int32()))], ["shard", "y", "h", "x"])

    rows = C.written(sample.mapInArrow(extract, "shard int, y int, h bigint, x array<int>").repartition(shards, "shard"), "toxic-sample")
    dims = (1 << BITS) + 1  # the last is the bias
    z, n = np.zeros(dims, np.float32), np.zeros(dims, np.float32)
    for _ in range(rounds):
        hold = {"z": z, "n": n}

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A pass over the task's rows in order of their hashes; the state after it, and which coordinates it met."""
            parts = [b for b in batches if b.num_rows]
            if not parts:
                return
            table = pa.Table.from_batches(parts)
            z, n = hold["z"].astype(np.float64), hold["n"].astype(np.float64)
            met = np.zeros(dims, bool)
            x, y = table["x"].combine_chunks(), table["y"].to_pylist()
            flat, bound = x.flatten().to_numpy(), np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy())])
            for k in np.argsort(table["h"].to_numpy(), kind="stable"):
                at = np.append(flat[bound[k]:bound[k + 1]], dims - 1)
                w = _weights(z[at], n[at], alpha, beta, np.where(at == dims - 1, 0.0, l1), l2)
                g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y[k]
                z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
                n[at] += g * g
                met[at] = True
            yield pa.RecordBatch.from_pydict({"z": [z.astype(np.float32).tobytes()], "n": [n.astype(np.float32).tobytes()], "met": [met.tobytes()]})

        # a row of 9 MB from each shard, whatever the corpus
        states = [[np.frombuffer(r[k], kind) for k, kind in enumerate((np.float32, np.float32, bool))] for r in rows.mapInArrow(learn, "z binary, n binary, met binary").collect()]
        times = np.maximum(sum((m.astype(np.int32) for _, _, m in states), np.zeros(dims, np.int32)), 1)
        z, n = (old + sum((np.where(s[2], s[k] - old, 0) for s in states), np.zeros(dims, np.float32)) / times for k, old in enumerate((z, n)))
        z, n = z.astype(np.float32), n.astype(np.float32)
    w = _weights(z[:-1], n[:-1], alpha, beta, l1, l2)
    at = np.flatnonzero(w)
    return ToxicityModel(at, w[at].astype(np.float32), float(_weights(z[-1:], n[-1:], alpha, beta, 0.0, l2)[0]))


def score(docs: DataFrame, m: ToxicityModel, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 from ``threshold`` on); a null text scores as an empty one, the bias alone. Columns of these names are replaced."""
    kept = docs.drop("score", "predicted")
    names = [*kept.columns, "score", "predicted"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.zeros(1 << BITS, np.float32)
        weight[m.at] = m.weight
        for b in batches:
            texts = C.strings(b.column(b.num_columns - 1))
            for i, j in C.slices(texts):
                owner, at = features(texts[i:j])
                known = weight[at] != 0
                owner, at = _distinct(owner[known], at[known])
                total = m.bias + np.bincount(owner, weights=weight[at], minlength=j - i)
                p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
                yield pa.RecordBatch.from_arrays([*b.slice(i, j - i).columns[:-1], pa.array(p), pa.array((p >= threshold).astype(np.int32))], names)

    fields = [*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return C.with_text(docs, text, "score", "predicted").mapInArrow(kernel, T.StructType(fields))
