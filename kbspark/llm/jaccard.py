"""Exact n-gram Jaccard self-join with skipping by set relations.

A document's set holds the hashes of its distinct shingles of five words; equal sets are one set from then on. Sets
are put in one global order (frequent shingles last), and the first ``n - ceil(t n) + 1`` shingles of each are indexed by
shingle and position. Two linked sets share an indexed shingle, so a list of the index holds every link of its sets.
A list is sorted by set size; a set skips, by position, the blocks of sizes too small or with too few shingles left.

Answers are derived from those of similar sets: a first round tries only neighbours in each list. Sets that it links share
a class, and every answer within a class follows from theirs. A second tries sets against one of the largest class of a list, and the
last tries all pairs of a list that still cross classes, so a large group of near copies costs about its size and not the square of it.

Pairs whose parity bits prove too many differences are dropped, which loses no link; the others are verified on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm import common as C
from kbspark.llm.components import components

#: Shingles of five words; linked when 100 * intersection >= PERCENT * union.
WORDS, PERCENT = 5, 75
#: Bytes of text that are cut into shingles at once; it bounds the arrays of a task.
SLICE = 1 << 19
#: Shingles known as frequent, which only orders them; the number bounds what every task receives.
FREQUENT = 1 << 17
#: Entries of a list that meet in one group; longer lists are cut, and their parts meet in pairs.
LIST_PART = 4096
#: Lists up to this length are searched for entries that no other set of the list can be linked with; longer ones keep all.
SHORT = 16
ENTRY = np.dtype([("h", "<u8"), ("s", "<i8"), ("n", "<i4"), ("p", "<i4")])
#: Rows of texts or full sets that travel to Python at once; Spark's own number of them takes tens of MB for each task, on both sides.
BATCH = 1 << 10
#: Bits of the filter that keeps texts of other documents out of a join; it passes more when it fills up, never less.
FILTER = 1 << 22


def shingle_sets(texts: list[str], n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and the bounds of each text's part (one entry more than texts)."""
    word, first = C.space_words(texts)
    h = np.zeros(len(word), np.uint64)
    for k in range(min(n, len(word))):
        h[:len(word) - k] = h[:len(word) - k] * np.uint64(0xD6E8FEB86659FD93) + word[k:]
    count = np.diff(first)
    owner = np.repeat(np.arange(len(texts)), count)
    place = np.arange(len(word)) - np.repeat(first[:-1], count)
    h = C.mix(h + np.uint64(n))
    keep = place + n <= count[owner]
    for i in np.flatnonzero((count > 0) & (count < n)):  # the whole short sequence is one shingle
        a = first[i]
        sequence = word[a:first[i + 1]] * C.powers(n, 0xA24BAED4963EE407)[:count[i]]
        h[a] = C.mix(sequence.sum(keepdims=True) + np.uint64(count[i]))[0]
        keep[a] = True
    h, owner = h[keep], owner[keep]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(texts) + 1))


def _set_ids(h: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """64-bit name of each set, 0 for an empty one."""
    size = np.diff(bound)
    ids = np.zeros(len(size), np.uint64)
    full = size > 0
    if full.any():
        at = bound[:-1][full]
        ids[full] = C.mix(np.add.reduceat(C.mix(h + np.uint64(0x51ED270B)), at) ^ (np.add.reduceat(h, at) * np.uint64(0x9E3779B97F4A7C15)) + size[full].astype(np.uint64))
    return ids.view(np.int64)


def parity_bits(h: np.ndarray, bound: np.ndarray) -> list[bytes]:
    """For each set a power of two of bits, two for each shingle at least: bit k tells whether an odd number of its hashes end in k."""
    size = np.diff(bound)
    width = np.int64(1) << np.ceil(np.log2(np.maximum(2 * size, 64))).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(width)])
    at = np.repeat(begin[:-1], size) + (h & (np.repeat(width, size) - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits(np.bincount(at, minlength=begin[-1]) & 1, bitorder="little").tobytes()
    return [packed[a:b] for a, b in zip((begin[:-1] // 8).tolist(), (begin[1:] // 8).tolist())]


def least_difference(x: bytes, y: bytes) -> int:
    """Lower bound of the shingles that only one of two sets holds: bits that differ, the wider ones folded to the width of the others."""
    x, y = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


class Seen:
    """Sorted numbers met before, at most ``most``; beyond that it starts anew, so a number may count as new again."""

    def __init__(self, most: int = 1 << 18):
        self.known, self.most = np.zeros(0, np.int64), most

    def fresh(self, ids: np.ndarray) -> np.ndarray:
        """Marks the first of each id that was not met, and keeps all."""
        names, first = np.unique(ids, return_index=True)
        at = np.searchsorted(self.known, names)
        new = np.append(self.known, 0)[at] != names if len(self.known) else np.ones(len(names), bool)
        new |= at == len(self.known)
        out = np.zeros(len(ids), bool)
        out[first[new]] = True
        self.known = np.insert(self.known, at[new], names[new]) if len(self.known) + int(new.sum()) <= self.most else names
        return out


class Repeats:
    """Shingles that several sets of a stream hold, with bounded memory: a bit table tells those met before, as a rule; counts are handed out as they gather."""

    def __init__(self, bits: int = 25, gather: int = 1 << 17):
        self.mask, self.table, self.found, self.gather, self.size = np.uint64((1 << bits) - 1), np.zeros(1 << (bits - 3), np.uint8), [], gather, 0

    def add(self, h: np.ndarray) -> None:
        shingle, sets = np.unique(h, return_counts=True)
        at = (shingle & self.mask).astype(np.int64)
        bit = np.uint8(1) << (at & 7).astype(np.uint8)
        again = (self.table[at >> 3] & bit > 0) | (sets > 1)
        np.bitwise_or.at(self.table, at >> 3, bit)
        self.found.append((shingle[again], sets[again]))
        self.size += int(again.sum())

    def take(self, last: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Shingles and numbers of sets, once there are enough or at the end; a first set that was alone when it came isn't counted."""
        if not last and self.size < self.gather:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        names, at = np.unique(np.concatenate([x for x, _ in self.found] or [np.zeros(0, np.uint64)]), return_inverse=True)
        sets = np.bincount(at, np.concatenate([n for _, n in self.found] or [np.zeros(0)]), len(names)).astype(np.int64)
        self.found, self.size = [], 0
        return names.view(np.int64), sets


def prefix_length(size: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Shingles of a set to index: a link shares at least ``ceil(t n)``, so one of the others."""
    return np.where(size > 0, size - (percent * size + 99) // 100 + 1, 0)


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """For each row of ``docs``: key, ``n_shingles`` and ``component_id``, the smallest key that links reach.

    Null and empty texts have an empty set, are linked with nothing and are their own component. Equal sets are linked whatever their size.
    A row without key takes part; its component is the smallest key there is, null where all keys of it are null. Repeated rows return as often.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("row_id", F.xxhash64("doc_id", "text"))  # names rows without key too

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, with parity bits for each new set, and counts of shingles that several sets of a task hold."""
        names = ["doc_id", "row_id", "n", "set_id", "bits", "shingle", "sets"]
        seen, repeats = Seen(), Repeats()

        def counts(last: bool) -> Iterator[pa.RecordBatch]:
            shingle, sets = repeats.take(last)
            if len(shingle):
                none = pa.nulls(len(shingle), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(shingle), pa.binary()), pa.array(shingle), pa.array(sets)], names)

        for b in batches:
            for i, j, texts in C.text_slices(b.column(1), SLICE):
                h, bound = shingle_sets(texts)
                ids, size = _set_ids(h, bound), np.diff(bound)
                none = pa.nulls(j - i, pa.int64())
                fresh = seen.fresh(ids)
                bits = pa.array([x if new else None for x, new in zip(parity_bits(h, bound), (fresh & (size > 0)).tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(size, pa.int64()), pa.array(ids), bits, none, none], names)
                repeats.add(h[np.repeat(fresh, size)])
                yield from counts(False)
        yield from counts(True)

    both = C.written(rows.mapInArrow(members, "doc_id bigint, row_id bigint, n bigint, set_id bigint, bits binary, shingle bigint, sets bigint"), "jaccard-members", BATCH)
    member = both.filter("set_id IS NOT NULL").select("doc_id", "row_id", "n", "set_id")
    bits = both.filter("bits IS NOT NULL").select("set_id", "n", "bits")
    frequent = (both.filter("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("sets").alias("sets")).filter("sets >= 4")
                .orderBy(F.desc("sets"), "shingle").limit(FREQUENT).orderBy("shingle").toArrow())
    often = frequent["shingle"].to_numpy().astype(np.int64).view(np.uint64)
    by_hash = np.argsort(often)
    often, rank = often[by_hash], frequent["sets"].to_numpy().astype(np.int64)[by_hash]
    n_docs = member.count()
    buckets = int(min(max(32, n_docs // 2000), 1 << 17))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Indexed shingles of each batch's distinct sets, as one row of packed entries for each bucket."""
        seen = Seen()  # copies that slip through meet in the index
        for b in batches:
            for _, _, texts in C.text_slices(b.column(0), SLICE):
                h, bound = shingle_sets(texts)
                size, ids = np.diff(bound), _set_ids(h, bound)
                use = seen.fresh(ids) & (size > 0)
                owner = np.repeat(np.arange(len(ids)), size)
                keep = use[owner]
                h, owner = h[keep], owner[keep]
                weight = np.zeros(len(h), np.int64)
                if len(often):
                    at = np.minimum(np.searchsorted(often, h), len(often) - 1)
                    weight = np.where(often[at] == h, rank[at], 0)
                order = np.lexsort((h, weight, owner))
                h, owner = h[order], owner[order]
                begin = np.searchsorted(owner, np.arange(len(ids)))
                place = np.arange(len(h)) - begin[owner]
                keep = place < prefix_length(size, percent)[owner]
                h, owner, place = h[keep], owner[keep], place[keep]
                frequency = weight[order][keep]
                bucket = (h % np.uint64(buckets)).astype(np.int64)
                salts = frequency // LIST_PART + 1
                bucket = np.where(salts > 1, -1 - (C.mix(h) % np.uint64(buckets)).astype(np.int64) * 4096 - ids[owner] % np.minimum(salts, 4096), bucket)
                order = np.argsort(bucket, kind="stable")
                entry = np.zeros(len(h), ENTRY)
                entry["h"], entry["s"], entry["n"], entry["p"] = h[order], ids[owner][order], size[owner][order], place[order]
                bucket = bucket[order]
                cut = np.flatnonzero(np.diff(bucket, prepend=1 << 60))
                ends = np.append(cut[1:], len(bucket))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cut]), pa.array([entry[a:z].tobytes() for a, z in zip(cut, ends)], pa.binary())], ["bucket", "entries"])

    def lists(group: pa.Table) -> pa.Table:
        """Pairs of a set with its list's leader or its neighbour by size, and entries that later rounds need again (``again``).

        A list of two sets has no other pair; in others an entry goes when all other sets of the list skip it by size and position.
        Negative buckets hold parts of lists that are too long for one group; those keep all entries.
        """
        e = np.concatenate([np.frombuffer(x, ENTRY) for x in group["entries"].to_pylist()])
        e = e[np.lexsort((e["s"], e["n"], e["h"]))]
        new = np.ones(len(e), bool)
        new[1:] = (e["h"][1:] != e["h"][:-1]) | (e["s"][1:] != e["s"][:-1])
        e = e[new]
        h, n = e["h"], e["n"].astype(np.int64)
        fits = (h[1:] == h[:-1]) & (100 * n[:-1] >= percent * n[1:])
        # the partner is the list's leader, the same in most lists of like sets, or else the neighbour by size
        cut = np.flatnonzero(np.diff(h, prepend=h[0] ^ np.uint64(1)))
        size = np.diff(np.append(cut, len(h)))
        size = np.repeat(size, size)
        token = C.mix(e["s"].view(np.uint64))
        # few rarer shingles before the shared one: few of its own, so near to what the list has in common
        leader = np.lexsort((token, e["p"], h))[cut]  # lists stay where they are, each with its leader first
        leader = np.repeat(leader, size[cut])
        led = 100 * np.minimum(n, n[leader]) >= percent * np.maximum(n, n[leader])
        before = np.arange(len(e)) - 1
        partner = np.where(led, leader, before)
        paired = (partner != np.arange(len(e))) & (led | np.append(False, fits))
        again = (size > 2) & _meets(h, n, e["p"].astype(np.int64), size, percent) if group["bucket"][0].as_py() >= 0 else np.ones(len(e), bool)
        keep = again | paired
        columns = {"shingle": h.view(np.int64), "n": e["n"], "set_id": e["s"], "place": e["p"]}
        out = {k: pa.array(v[keep]) for k, v in columns.items()} | {"again": pa.array(again[keep])}
        for k in ("n", "set_id", "place"):
            out[f"{k}_2"] = pa.array(columns[k][partner][keep], mask=~paired[keep])
        return pa.table(out)

    entries = C.written(rows.select("text").mapInArrow(index, "bucket bigint, entries binary").groupBy("bucket")
                        .applyInArrow(lists, "shingle bigint, n int, set_id bigint, place int, again boolean, n_2 int, set_id_2 bigint, place_2 int"), "jaccard-lists", BATCH)
    first = C.written(_possible(entries.filter("set_id_2 IS NOT NULL"), percent).select(
        F.least("set_id", "set_id_2").alias("a"), F.greatest("set_id", "set_id_2").alias("b")).distinct(), "jaccard-pairs")
    classes = components(_verified(rows, member, _near(bits, first, percent), percent))

    meets = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    tried = first
    for leaders in (True, False):
        labelled = (entries.filter("again").select("shingle", "n", "set_id", "place").join(classes.withColumnRenamed("node", "set_id"), "set_id", "left")
                    .withColumn("class", F.coalesce("component", "set_id")).drop("component"))
        open_lists = (labelled.groupBy("shingle").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count("*").alias("n_sets"))
                      .filter("lo < hi").select("shingle", F.ceil(F.col("n_sets") / LIST_PART).cast("int").alias("parts")))
        dealt = (labelled.join(open_lists, "shingle").withColumn("own", F.pmod("set_id", "parts").cast("int")).withColumn("other", meets)
                 .withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
                 .withColumn("bucket", F.when(F.col("parts") == 1, F.pmod("shingle", F.lit(buckets))).otherwise(F.col("shingle"))))
        pairs = C.written(dealt.groupBy("bucket", "lo", "hi").applyInArrow(_crossing(percent, leaders), "a bigint, b bigint").distinct()
                          .join(tried, ["a", "b"], "left_anti"), "jaccard-pairs")
        more = _verified(rows, member, _near(bits, pairs, percent), percent)
        tried = tried.unionByName(pairs)
        # what is known of classes is a star for each, so their links needn't be kept
        classes = components(classes.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more))

    # one row for each set with its smallest key; then the smallest key of each class
    sets = member.filter("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    sets = sets.join(classes.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("class", F.coalesce("component", "set_id"))
    best = sets.groupBy("class").agg(F.min("least").alias("component_id"))
    named = sets.join(best, "class").select("set_id", "component_id")
    return (member.filter("n > 0").join(named, "set_id").select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), "component_id")
            .unionByName(member.filter("n = 0").select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))))


def _meets(h: np.ndarray, n: np.ndarray, p: np.ndarray, size: np.ndarray, percent: int) -> np.ndarray:
    """Marks entries, ordered by list and set size, that can be linked with another of their list, and all entries of lists longer than ``SHORT``."""
    out = size > SHORT
    i, step = np.flatnonzero(~out), 0
    while len(i):
        step += 1
        i = i[i + step < len(h)]
        i = i[(h[i + step] == h[i]) & (100 * n[i] >= percent * n[i + step])]  # sizes ascend: too small for this one, too small for the rest
        ok = i[_may_link(n, p, i, i + step, percent)]
        out[ok] = out[ok + step] = True
    return out


def _crossing(percent: int, leaders: bool):
    """Kernel for pairs of a list, or of two of its parts, whose sets are in different classes, as far as sizes and positions allow a link.

    With ``leaders`` only pairs with one set of the list's largest class, and with the neighbour by size.
    """
    def kernel(group: pa.Table) -> pa.Table:
        h, n, s, p, c, part = (group[x].to_numpy() for x in ("shingle", "n", "set_id", "place", "class", "own"))
        order = np.lexsort((s, n, h))
        h, n, s, p, c, part = h[order], n[order].astype(np.int64), s[order], p[order].astype(np.int64), c[order], part[order]
        two = group["lo"][0].as_py() != group["hi"][0].as_py()
        cut = np.append(np.flatnonzero(np.diff(h, prepend=h[0] - 1)), len(h)).tolist()
        token = C.mix(s.view(np.uint64))
        out_a, out_b = [], []
        for begin, end in zip(cut, cut[1:]):
            if c[begin:end].min() == c[begin:end].max():
                continue
            if leaders:
                names, number = np.unique(c[begin:end], return_counts=True)
                inside = np.flatnonzero(c[begin:end] == names[number.argmax()]) + begin
                lead = inside[np.lexsort((token[inside], p[inside]))[0]]
                i = np.concatenate([np.arange(begin, end), np.arange(begin + 1, end)])
                j = np.concatenate([np.full(end - begin, lead), np.arange(begin, end - 1)])
                keep = (c[i] != c[j]) & _may_link(n, p, i, j, percent)
                out_a.append(s[i[keep]])
                out_b.append(s[j[keep]])
                continue
            limit = begin + np.searchsorted(100 * n[begin:end], percent * n[begin:end], side="left")  # skips the blocks of too small sizes
            for i, first_fit in zip(range(begin + 1, end), limit[1:].tolist()):
                j = slice(first_fit, i)
                other = np.flatnonzero((c[j] != c[i]) & ((part[j] != part[i]) | (not two))) + first_fit
                if len(other):
                    other = other[_may_link(n, p, other, i, percent)]
                    out_a.append(s[other])
                    out_b.append(np.full(len(other), s[i]))
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b))
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        return pa.table({"a": pa.array(pairs[0], pa.int64()), "b": pa.array(pairs[1], pa.int64())})

    return kernel


def _may_link(n: np.ndarray, p: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes, and the shingles left from the shared one on, allow the entries to be linked."""
    left, sizes = np.minimum(n[i] - p[i], n[j] - p[j]), n[i] + n[j]
    return ((100 + percent) * left >= percent * sizes) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))


def _possible(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs that sizes and positions of a shared shingle allow to be linked."""
    small, large = F.least("n", "n_2"), F.greatest("n", "n_2")
    left = F.least(F.col("n") - F.col("place"), F.col("n_2") - F.col("place_2"))
    return pairs.filter((small * 100 >= large * percent) & (left * (100 + percent) >= (small + large) * percent))


def _near(bits: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the parity bits of their sets allow to be linked."""
    wanted = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
    some = bits.join(wanted, "set_id", "left_semi").dropDuplicates(["set_id"])

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = np.add(b.column(2).to_numpy(), b.column(3).to_numpy())
            differ = np.fromiter((least_difference(x.as_buffer(), y.as_buffer()) for x, y in zip(b.column(4), b.column(5))), np.int64, b.num_rows)
            # at most (both - differ) / 2 shingles are shared
            yield b.filter(pa.array((100 + percent) * (both - differ) >= 2 * percent * both)).select(["a", "b"])

    ends = [some.select(F.col("set_id").alias(k), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}")) for k in ("a", "b")]
    joined = pairs.join(ends[0], "a").join(ends[1], "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
    return C.written(joined.mapInArrow(possible, "a bigint, b bigint"), "jaccard-near")


def _verified(rows: DataFrame, member: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are linked. Only texts of one document for each set of a pair are read into sets again."""
    wanted = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
    # a row with key where there is one: rows without key and of one text have one name
    row = F.coalesce(F.min(F.when(F.col("doc_id").isNotNull(), F.col("row_id"))), F.min("row_id"))
    one = member.groupBy("set_id").agg(row.alias("row_id")).join(wanted, "set_id", "left_semi")

    bit = F.pmod("row_id", F.lit(FILTER)).cast("int")
    bits = np.zeros(FILTER // 8, np.uint8)
    set_bits = one.select(bit.alias("bit")).distinct().toArrow()["bit"].to_numpy()
    np.bitwise_or.at(bits, set_bits >> 3, (1 << (set_bits & 7)).astype(np.uint8))

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(2).to_numpy()
            yield b.filter(pa.array((bits[at >> 3] >> (at & 7)) & 1 == 1)).select(["row_id", "text"])

    some = rows.select("row_id", "text", bit.alias("bit")).mapInArrow(passing, "row_id bigint, text string")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for i, j, texts in C.text_slices(b.column(1), SLICE):
                h, bound = shingle_sets(texts)
                same = _set_ids(h, bound) == ids[i:j]  # two rows may agree in their hash
                packed = [h[x:y].tobytes() for x, y in zip(bound[:-1][same], bound[1:][same])]
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][same]), pa.array(packed, pa.binary())], ["set_id", "shingles"])

    sets = C.written(some.join(one, "row_id").select("set_id", "text").mapInArrow(full, "set_id bigint, shingles binary"), "jaccard-sets", BATCH).dropDuplicates(["set_id"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):  # views of the batch, no copies
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], ["a", "b"])

    paired = (pairs.join(sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("x")), "a")
              .join(sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("y")), "b"))
    return C.written(paired.select("a", "b", "x", "y").mapInArrow(linked, "a bigint, b bigint"), "jaccard-links", BATCH)
