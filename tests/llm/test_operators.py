"""The dealt operators against brute force, exact round trips and held-out accuracy, with nulls, empty and long texts, ties and clashing columns."""

from __future__ import annotations

import gzip
import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from kbspark.llm import common, decontaminate, fingerprint, jaccard, language, mixing, shards, templates, tokens, toxicity, warc
from kbspark.llm.components import components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [(1, None, "en", None, 0), (2, "", None, "a", 0), (3, "   \n\t", "en", "a", 5), (4, "word " * 30_000, "en", "a", 0), (4, "word " * 30_000, "en", "a", 0),
       (5, "12 34 !!", "de", "b", 0), (None, "no id here at all but words", "en", "b", 0), (6, "日本語 text mixed", "fr", "c", 0), (7, "x", "en", "c", 1)]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_viterbi_equals_plain_recursion():
    rng = np.random.default_rng(1)
    for chunk in (3, 16, 64):
        first = np.concatenate([[0], np.cumsum(rng.integers(0, 200, 9))])
        s = rng.normal(size=(first[-1], 4)).astype(np.float32) * 3
        got = language.viterbi(s, first, 5.0, chunk)
        for a, b in zip(first, first[1:]):
            v, back = np.zeros(4), []
            for t in range(a, b):
                best = v[v.argmax()] - 5
                back.append(np.where(v >= best, np.arange(4), v.argmax()))
                v = np.maximum(v, best) + s[t]
            state, want = int(v.argmax()), []
            for way in reversed(back):
                want.append(state)
                state = int(way[state])
            assert list(got[a:b]) == want[::-1]


def test_language_held_out_and_spans(spark, docs, odd, none):
    m = language.fit(docs.filter(~common.held_out()))
    rows = language.identify(docs, m).filter(common.held_out()).select("lang", "lang_pred").collect()
    assert sum(r[0] == r[1] for r in rows) >= 0.95 * len(rows)
    mixed = {r.doc_id: r for r in language.identify(odd.withColumn("score", F.lit("clash")), m).collect()}
    assert [mixed[k].lang_pred for k in (1, 2, 3, 5)] == ["und"] * 4 and mixed[1].score == 0 and mixed[1].lang_spans == []
    assert language.identify(none, m).count() == 0 and language.fit(none).languages == ()
    assert {r.lang_pred for r in language.identify(odd, language.fit(none)).collect()} == {"und"}
    two = " ".join(["the and of that with"] * 20) + " " + " ".join(["der und die nicht eine"] * 20)
    got = language.identify(spark.createDataFrame([(two,)], "text string"), m).first()
    assert [s.lang for s in got.lang_spans] == ["en", "de"] and two[got.lang_spans[1].begin:].startswith("der")


def test_fingerprints_of_neighbours(spark, docs, odd, none):
    for frame, rows in ((docs, 37), (odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), 2)):
        src = sorted(frame.select("doc_id", "text").collect())
        got = {r.doc_id: r for r in fingerprint.with_next(frame, rows_per_bucket=rows).collect()}
        assert len(got) == len(src)
        for i, r in enumerate(src):
            t, nxt = r.text or "", src[(i + 1) % len(src)].text or ""
            k = len(t) // 4
            want = t[:len(t) - k] + nxt[:k]
            assert got[r.doc_id].edited_sha256 == hashlib.sha256(want.encode()).hexdigest() and got[r.doc_id].n_chars == len(t)
    near = [(r.near_edited, r.near_next) for r in fingerprint.with_next(docs).collect()]
    assert np.mean([a > b for a, b in near]) > 0.97
    assert fingerprint.with_next(odd).count() == len(ODD) and fingerprint.with_next(none).count() == 0
    a, b = "some text that is long enough " * 40, "other words stand in this one " * 3
    one = fingerprint.encode(*fingerprint.sketches([a, b, a + "\n" + b]))
    both = set(fingerprint.decode(fingerprint.merge(one[0], one[1]))[1].tolist())
    assert len(both) > 0 and fingerprint.fingerprints(odd).count() == len(ODD)


def test_toxicity_held_out(spark, sf_dir, docs, odd, none):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").drop("quality")
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").join(labels, "doc_id")
    m = toxicity.fit(big.filter(~common.held_out()))
    assert 0 < len(m.at) < 5000
    rows = toxicity.score(big, m).filter(common.held_out()).select("toxic", "score").collect()
    bad, good = ([r[1] for r in rows if r[0] == k] for k in (1, 0))
    assert np.mean(np.array(bad)[:, None] > np.array(good)[None]) > 0.75
    got = toxicity.score(odd.withColumn("predicted", F.lit(9)), m).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.score(none, toxicity.fit(none.withColumn("toxic", F.lit(1)))).count() == 0


def test_token_counts_equal_the_library(spark, docs, odd, none):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    extra = spark.createDataFrame([(-3, "  a  b "), (-4, "\n\n x\ny"), (-5, " "), (-7, "\n"), (-8, "<s> </s>\t\r\n日本語😀 ▁x▁"), (-10, " \n \n")], "doc_id bigint, text string")
    every = docs.select("doc_id", "text").union(odd.select("doc_id", "text")).union(extra)
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    want = Counter((r.doc_id, len((r.text or "").encode()), len(m.encode(r.text or ""))) for r in every.collect())
    assert Counter(tuple(r) for r in tokens.count_tokens(every, path).collect()) == want
    assert tokens.count_tokens(none, path).count() == 0


def _sets(rows):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    for r in rows:
        w = word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or ""))
        yield r.doc_id, {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_jaccard_join_equals_all_pairs(spark, docs, odd, none, monkeypatch):
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(60)]
    group = []
    for i in range(60):  # a group of near copies, each with words of its own
        w = list(base)
        for k in rng.integers(0, 60, rng.integers(0, 3)):
            w[k] = f"own{i}-{k}"
        group.append((10_000 + i, " ".join(w), "en", "g", 0))
    monkeypatch.setattr(jaccard, "LIST_PART", 16)  # long lists are cut
    every = docs.union(odd.filter("doc_id IS NOT NULL")).union(spark.createDataFrame(group, DOCS))
    src = list(_sets(every.select("doc_id", "text").collect()))
    parent = {k: k for k, _ in src}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(src):
        for b, y in src[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                ra, rb = sorted((find(a), find(b)))
                parent[rb] = ra
    want = sorted((k, len(s), find(k) if s else k) for k, s in src)
    assert sorted(tuple(r) for r in jaccard.near_copies(every).collect()) == want
    assert jaccard.near_copies(none).count() == 0 and jaccard.near_copies(odd).count() == len(ODD)


def test_written_bounds_the_rows_that_travel_at_once(spark):
    before = spark.conf.get(common.BATCH_ROWS)
    sizes = spark.range(5000, numPartitions=1).mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in bs), "n bigint")
    assert common.written(sizes, "sizes", 700).agg(F.max("n"), F.sum("n")).first() == (700, 5000)
    assert spark.conf.get(common.BATCH_ROWS) == before
    assert common.written(sizes, "sizes").agg(F.max("n")).first()[0] == min(5000, int(before))


def test_full_sets_travel_in_small_batches(spark, monkeypatch):
    held, plain = {}, common.written

    def noted(df, name, batch=None):
        held[name] = batch
        return plain(df, name, batch)

    monkeypatch.setattr(common, "written", noted)
    rows = [(i, f"{'same words here all over ' * 3}{i // 2} one two three four", "en", "a", 0) for i in range(20)]
    assert jaccard.near_copies(spark.createDataFrame(rows, DOCS)).count() == 20
    assert all(held[f"jaccard-{k}"] == jaccard.BATCH for k in ("members", "lists", "sets", "links"))


def test_jaccard_join_through_a_row_without_key(spark):
    base = [f"w{k}" for k in range(60)]
    ends = [" ".join(base[:k] + ["other"] + base[k + 1:]) for k in (10, 40)]  # linked with the base, not with each other
    rows = [(5, ends[0], "en", "a", 0), (9, ends[1], "en", "a", 0), (None, " ".join(base), "en", "a", 0), (None, " ".join(base), "en", "a", 0), (20, "far off " * 9, "en", "a", 0)]
    got = jaccard.near_copies(spark.createDataFrame(rows, DOCS)).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == {(5, 5): 1, (9, 5): 1, (None, 5): 2, (20, 20): 1}


def test_shingles_of_batches_with_fewer_words_than_a_shingle():
    for texts in ([], [""], ["a b c"], ["", "a", "b c"], ["a b c", "a b c d"]):
        h, bound = jaccard.shingle_sets(texts)
        assert np.diff(bound).tolist() == [int(bool(t.split())) for t in texts]
        for t, k in zip(texts, bound):
            if t:  # the same whatever stands beside it
                assert h[k] == jaccard.shingle_sets([t, "q r s t u v w"])[0][0]


def test_parity_bits_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    pool = common.mix(np.arange(5000, dtype=np.uint64))
    for n in (1, 5, 31, 32, 33, 400, 1500):
        x = pool[:n]
        for shared in {0, n // 2, n - 1, n}:
            y = np.concatenate([x[:shared], pool[2000:2000 + int(rng.integers(1, n + 2))]])
            two = jaccard.parity_bits(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
            assert jaccard.least_difference(*two) <= len(np.setxor1d(x, y))
        assert jaccard.least_difference(two[0], two[0]) == 0
    assert [len(b) for b in jaccard.parity_bits(np.zeros(0, np.uint64), np.array([0, 0, 0]))] == [8, 8]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7)], "a bigint, b bigint")
    assert dict(map(tuple, components(edges).collect())) == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}


def test_warc_round_trip_and_salvage(spark, sf_dir, tmp_path):
    rows = [(1, "http://a/ü x", "p" * 200), (2, None, "p" * 200), (None, "u", "p" * 200), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u\r\nX: y", "ß" * 500)]
    path = common.scratch_path(spark, "test")
    warc.write_archive(spark.createDataFrame(rows, "page_id bigint, url string, html string"), path)
    got = warc.read_archive(spark, path).withColumn("p", warc.page_number("record_id")).withColumn("r", warc.page_number("refers_to")).collect()
    assert all(g.problem is None for g in got) and len(got) == len(rows)
    by = {g.p: g for g in got}
    for k, _, html in rows:
        payload = (html or "").encode()
        assert by[k].payload_digest == hashlib.sha256(payload).hexdigest() and by[k].payload_bytes == len(payload)
        assert (by[k].record_type, by[k].r) == (("revisit", 1) if k in (2, None) else ("response", None))
    record = [warc._record("response", i, "u", b"x" * 300 + bytes([i]), hashlib.sha256(b"x" * 300 + bytes([i])).hexdigest(), None) for i in range(4)]
    packed = [warc.member(r) for r in record]
    broken = packed[1][:40] + b"\xff\x00" + packed[1][42:]
    data = packed[0] + broken + packed[2] + b"garbage" + packed[3] + packed[0][:30]
    found = list(warc.salvage(data))
    assert [f.get("record_id") for f in found] == ["<urn:page:0>", None, "<urn:page:2>", None, "<urn:page:3>", None]
    assert found[1]["offset"] == len(packed[0]) and found[1]["length"] == len(broken)
    assert sum(f["length"] for f in found) == len(data)
    plain = record[0] + record[1].replace(b"xxx", b"yyy", 1) + record[2]
    assert [f.get("record_id") for f in warc.salvage(plain)] == ["<urn:page:0>", None, "<urn:page:2>"]
    assert list(warc.salvage(b"")) == [] and gzip.decompress(packed[0]) == record[0] and packed[0][-1] == 0


def test_warc_members_of_many_records(spark, tmp_path):
    record = [warc._record("response", i, "u", b"x" * 300 + bytes([i]), hashlib.sha256(b"x" * 300 + bytes([i])).hexdigest(), None) for i in range(4)]
    bad = record[0].replace(b"xxx", b"yyy", 1)
    two, whole = gzip.compress(bad + record[1]), gzip.compress(b"".join(record))
    found = list(warc.salvage(two))
    assert [(f.get("record_id"), f.get("problem")) for f in found] == [(None, "block digest differs"), ("<urn:page:1>", None)]
    assert [(f["inner_offset"], f["inner_length"]) for f in found] == [(0, len(bad)), (len(bad), len(record[1]))]
    assert all((f["offset"], f["length"]) == (0, len(two)) for f in found)
    assert [f.get("record_id") for f in warc.salvage(whole)] == [f"<urn:page:{i}>" for i in range(4)]
    middle = list(warc.salvage(gzip.compress(record[0] + bad + b"noise" + record[2]) + gzip.compress(bad) + warc.member(record[3])))
    assert [f.get("record_id") for f in middle] == ["<urn:page:0>", None, "<urn:page:2>", None, "<urn:page:3>"]
    (tmp_path / "two.warc.gz").write_bytes(two + whole)
    got = warc.read_archive(spark, str(tmp_path)).collect()
    assert [r.record_id for r in got if r.problem is None] == [f"<urn:page:{i}>" for i in (1, 0, 1, 2, 3)] and len(got) == 6


def test_recurring_templates(spark, docs, odd, none):
    rows = [(i, f"page {i} of 120 printed on {i % 7}\nown line number x{i} y{i} z{i} here {i}\nshort", "en", "a", 0) for i in range(40)]
    got = templates.drop_recurring_lines(spark.createDataFrame(rows + ODD, DOCS)).collect()
    assert len(got) == len(rows) + len(ODD)
    kept = {r.doc_id: r for r in got if r.source == "a" and r.doc_id is not None and r.n_lines == 3}
    assert all("printed" not in r.text and "short" in r.text for r in kept.values()) and len(kept) == 40
    assert {r.text for r in got if r.doc_id == 1 and r.source is None} == {None}
    assert templates.drop_recurring_lines(none).count() == 0
    unique = spark.createDataFrame([(i, f"alpha{i}a beta{i}b gamma{i}c delta{i}d", "en", "a", 0) for i in range(5)], DOCS)
    assert templates.drop_recurring_lines(unique).agg(F.sum("n_dropped")).first()[0] == 0


def test_constant_lines_short_and_long(spark):
    letters = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    long = {n: " ".join(f"n{n}word{k}" for k in range(n)) for n in (12, 25, 45)}
    rows = []
    for i in range(12):
        lines = [f"own{letters(i)} text{letters(i)}", "", "Les.", "Les."] + ["in nine."] * (i < 9) + ["7"] * (i > 0)
        lines += [long[45]] * (i < 2) + [long[25]] * (i < 4) + [long[12].replace(" ", "  ", i)] * (i < 6)
        rows.append((i, "\n".join(lines), "en", "a", 0))
    copies = [(100 + i, " ".join(f"copied{k}" for k in range(60)) + "\nLes.", "en", "b", 0) for i in range(2)]
    rows += copies + [(200, long[45].upper(), "en", "c", 0)]
    frame = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in templates.drop_recurring_lines(frame, short_lines=True).collect()}
    for i, text, *_ in rows:
        keep = [x for x in text.split("\n") if x not in ("Les.", "7", long[45], long[25])]
        assert got[i].text == "\n".join(keep) and got[i].n_dropped == text.count("\n") + 1 - len(keep)
    more = spark.createDataFrame(rows + [(300, "other\n" + long[12], "en", "d", 0)], DOCS)  # a seventh text: 7 * 12 >= 80
    got = {r.doc_id: r.text for r in templates.drop_recurring_lines(more).collect()}
    assert got[300] == "other" and "n12word" not in "".join(got.values()) and "Les." in got[0] and got[100] == copies[0][1]


def test_templates_count_documents_not_lines(spark):
    letters = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    lead = "alpha beta gamma delta"
    # the leaf is common, but the tokens behind it are each document's own, except in one log and in what eleven documents share
    rows = [(i, "\n".join(f"{lead} " + " ".join(f"{x}{letters(i)}" for x in "pqrstu") for _ in range(2)), "en", "a", 0) for i in range(12)]
    log = "\n".join(f"{lead} took long to end with{letters(k)} then{letters(k)}" for k in range(30))
    shared = [(100 + i, "\n".join(f"{lead} took care of all in{letters(i)}x{k} here" for k in "ab"[:1 + i % 2]) + f"\n{lead} one{letters(i)} more{letters(i)} line that is{letters(i)} mine{letters(i)}", "en", "a", 0)
              for i in range(11)]
    got = {r.doc_id: r for r in templates.drop_recurring_lines(spark.createDataFrame(rows + [(50, log, "en", "a", 0)], DOCS)).collect()}
    assert got[50].text == log and all(r.n_dropped == 0 for r in got.values())
    got = {r.doc_id: r for r in templates.drop_recurring_lines(spark.createDataFrame(rows + shared, DOCS)).collect()}
    assert all("took care" not in got[100 + i].text and got[100 + i].n_dropped >= 1 + i % 2 for i in range(11))


def test_shards(spark, docs, odd, none):
    every = docs.union(odd).withColumn("slot", F.lit("clash"))
    got = shards.shard(every).select("doc_id", "shard", "slot").collect()
    n = Counter(r.shard for r in got)
    assert len(got) == every.count() and max(n.values()) - min(n.values()) <= 1 and set(n) == set(range(24))
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n[s]))
    assert Counter(got) == Counter(shards.shard(every.repartition(3)).select("doc_id", "shard", "slot").collect())
    assert shards.shard(none).count() == 0
    matrix = shards.communication_matrix([50, 0, 73], 4, 1)
    assert [sum(r) for r in matrix] == [50, 0, 73] and sorted(map(sum, zip(*matrix))) == [30, 31, 31, 31]
    import random
    draws = [shards.hypergeometric(random.Random(i), 500, 9500, 700) for i in range(1500)]
    assert abs(np.mean(draws) - 35) < 0.6 and abs(np.var(draws) - 30.9) < 4


def test_benchmark_passages(spark, sf_dir, docs, odd, none):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = bench.collect()
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    frame = docs.union(odd).union(spark.createDataFrame([(9000, "lead " * 500 + items[3].text.upper() + " tail" * 300, "en", "a", 0)], DOCS))
    want = {(r.doc_id, i.item_id) for r in frame.collect() for i in items if plain(i.text) in plain(r.text or "")}
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(frame, bench).collect()}
    assert want <= got and (9000, items[3].item_id) in got and len(got - want) <= 1
    kept = decontaminate.without_benchmark(frame, bench)
    assert kept.columns == frame.columns and kept.count() == frame.count() - len({d for d, _ in got})
    assert decontaminate.matches(none, bench).count() == 0 and decontaminate.matches(docs, bench.limit(0)).count() == 0
    index = decontaminate.Index([i.item_id for i in items], [i.text for i in items], 8)
    vocabulary, exact, most, often, slack, _ = index.blocks[0]
    assert (most >= 1000 * exact.max(axis=2) - 1e-3).all()


def test_small_and_repeated_benchmarks_equal_every_window_scored():
    rng = np.random.default_rng(4)
    text = lambda n, m=4000: " ".join(f"w{k}" for k in rng.integers(0, m, n))
    copy, others = text(60), [text(int(rng.integers(20, 90)), 600) for _ in range(40)]
    docs = [text(300) + " " + x + " " + text(200) for x in (copy, others[0], others[1])] + [copy, text(400), text(500, 600), "w1", ""]
    docs += [" ".join(w if rng.random() > 0.15 else "lost" for w in x.split()) for x in (copy, *others[:10])]
    for texts in ([copy], [copy, others[0]], [copy] * 5, [copy] * 20 + others, [copy] * 300 + others * 15):
        index = decontaminate.Index(list(range(len(texts))), texts, 8)
        want = {}
        for t, doc in enumerate(docs):
            w = decontaminate.words([doc])[0]
            for at in range(0, len(w), decontaminate.SEGMENT):
                for vocabulary, exact, _, _, _, items in index.blocks:
                    scores = exact[:-1].reshape(len(vocabulary), -1)[np.isin(vocabulary, w[at:at + 2 * decontaminate.SEGMENT])].sum(axis=0)
                    for e in np.flatnonzero(scores >= 0.7).tolist():
                        item = items[e]
                        size = index.items[item][1]
                        if min(index._overlaps(item, w[max(0, at - size):at + 2 * decontaminate.SEGMENT + size])) >= 0.6:
                            want[t, item] = max(want.get((t, item), 0), float(scores[e]))
        got = {(t, i): s for t, i, s, *_ in index.search(docs, 0.7, 0.6)}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want)
        assert {(0, 0), (3, 0)} <= got.keys()


def test_mixing(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).collect()
    by = {}
    for r in rows:
        s = by.setdefault(r.source, [0, 0, r.target, r.source_size, 0])
        s[0] += r.size * r.copies
        s[1] += r.size
        s[4] = max(s[4], r.size)
    total = sum(s[1] for s in by.values())
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(sorted(by))}
    want, capped = {}, {}
    while True:  # share what is left by weight until no target is above its cap
        left = 1.5 * total - sum(capped.values())
        w = sum(weight[k] for k in by if k not in capped)
        want = {**{k: left * weight[k] / w for k in by if k not in capped}, **capped}
        over = {k: 2.0 * by[k][1] for k in by if k not in capped and want[k] > 2 * by[k][1]}
        if not over:
            break
        capped |= over
    for k, (taken, size, target, source_size, largest) in by.items():
        assert source_size == size and abs(target - want[k]) < 1e-6 * target and abs(taken - target) <= max(largest, 0.02 * target)
    assert {r.copies for r in rows} <= {0, 1, 2} and sorted(rows) == sorted(mixing.mix(docs.repartition(5)).collect())
    strange = mixing.mix(odd).collect()
    assert len(strange) == len(ODD) and {r.size for r in strange if r.doc_id in (1, 2, 3)} == {0}
    assert mixing.mix(none).count() == 0


def test_pipeline(spark, sf_dir, odd):
    got = corpus_pipeline.run(spark, sf_dir)
    src = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got.columns == [*src.columns, "shard", "slot"] and 0 < got.count() <= 2 * src.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, sf_dir)
        assert out.count() <= 2 * len(ODD) and (name == "sharding" or out.columns == odd.columns)
    assert {f"op{n}_" for n in range(1, 11)} <= {re.match(r"op\d+_|", k)[0] for k in entry.queries()} and "pipeline" in entry.queries()
