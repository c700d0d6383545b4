"""Token counts of a sentencepiece BPE model without encoding whole texts.

The model puts one space before a text and writes spaces as U+2581. No piece of it holds that sign
behind another character, so no merge crosses the place before a run of spaces; and no piece holds a
line feed. So a text falls into pre-tokens: line feeds, and runs of spaces with the characters up to the next. Pieces are counted once for each distinct pre-token of the corpus.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm import common as C

#: Pre-tokens whose counts are sent to every task: at most so many, of at most so many characters.
COMMON, COMMON_CHARS = 1 << 18, 32


def _model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


#: A pre-token: a line feed, or a run of spaces and what follows up to the next space or line feed.
PRE_TOKEN = r"\n| *[^ \n]+| +"


def check_model(model: bytes) -> None:
    """Raises where a piece of the vocabulary would cross two pre-tokens, or texts are normalised before they are cut."""
    import sentencepiece as sp

    p = sp.SentencePieceProcessor(model_proto=model)
    pieces = [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i))]
    if any("▁" in x.lstrip("▁") or "\n" in x for x in pieces) or p.encode("a") == p.encode(" a") or p.decode(p.encode("ﬁ Å\t\n  x ")) != "ﬁ Å\t\n  x ":
        raise ValueError("this model joins characters across spaces or changes texts; pre-tokens can't be counted on their own")


def pre_tokens(pattern: re.Pattern[str], text: str) -> list[str]:
    """Pre-tokens with the model's leading space; an empty text has none."""
    return pattern.findall(" " + text.replace("▁", " ")) if text else []


def counter(model: bytes):
    """Function from pre-tokens to their numbers of pieces; they are encoded behind a line feed, where no space is added."""
    import sentencepiece as sp

    p = sp.SentencePieceProcessor(model_proto=model)
    before = len(p.encode("\n"))
    return lambda words: [len(ids) - before for ids in p.encode(["\n" + w for w in words], num_threads=1)]


def count_tokens(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: key, ``n_bytes`` (UTF-8) and ``n_tokens`` of the text; null counts as empty, with 0 of both.

    Frequencies of pre-tokens are summed over the corpus, each distinct one is encoded once, and the table of counts is written.
    Counts of at most ``COMMON`` very frequent ones go to every task. The others of each document are joined by pre-token.
    Rows are told apart by a 64-bit hash of key and text, and equal rows are counted together and repeated at the end.
    """
    spark = docs.sparkSession
    model = _model_bytes(model_path)
    check_model(model)
    rows = docs.select(F.col(key).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("doc", F.xxhash64("doc", "text").alias("h"), F.octet_length("text").cast("bigint").alias("n_bytes"), "text")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, seen = re.compile(PRE_TOKEN), Counter()
        for b in batches:
            for t in C.strings(b.column(0)):
                seen.update(pre_tokens(p, t))
                if len(seen) > 1_000_000:
                    yield pa.RecordBatch.from_pydict({"w": list(seen), "n": pa.array(seen.values(), pa.int64())})
                    seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(seen.values(), pa.int64())], ["w", "n"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(count(b.column(0).to_pylist()), pa.int64())], ["w", "n", "pieces"])

    distinct = rows.select("text").mapInArrow(frequencies, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    table = C.written(distinct.mapInArrow(pieces, "w string, n bigint, pieces bigint"), "pieces")
    top = table.filter(F.length("w") <= COMMON_CHARS).orderBy(F.desc("n"), "w").limit(COMMON).select("w", "pieces").toArrow()
    common = dict(zip(top["w"].to_pylist(), top["pieces"].to_pylist()))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row with what the frequent pre-tokens give, and one for each other pre-token of the text."""
        p, get = re.compile(PRE_TOKEN), common.get
        names = ["doc", "h", "n_bytes", "w", "n", "rows"]
        for b in batches:
            texts = C.strings(b.column(3))
            for lo, hi in C.slices(texts, 1 << 22):
                at, w, n, one = [], [], [], []
                for i in range(lo, hi):
                    sure, rest = 0, Counter()
                    for x in pre_tokens(p, texts[i]):
                        k = get(x)
                        if k is None:
                            rest[x] += 1
                        else:
                            sure += k
                    at += [i] * (len(rest) + 1)
                    w += [None, *rest]
                    n += [sure, *rest.values()]
                    one += [1] + [0] * len(rest)
                # key and size stand in the first row of a text only, so that the others are short
                back, head = pa.array(at), pa.array([i if x else None for i, x in zip(at, one)], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(head), b.column(1).take(back), b.column(2).take(head), pa.array(w, pa.string()), pa.array(n, pa.int64()), pa.array(one, pa.int64())], names)

    cells = rows.mapInArrow(documents, rows.drop("text").schema.simpleString()[7:-1].replace(":", " ") + ", w string, n bigint, rows bigint")
    found = (cells.filter("w IS NOT NULL").join(table.select("w", "pieces"), "w").select("doc", "h", "n_bytes", (F.col("n") * F.col("pieces")).alias("n"), "rows")
             .unionByName(cells.filter("w IS NULL").drop("w")))
    total = found.groupBy("h").agg(F.max("doc").alias("doc"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n"), F.sum("rows").alias("rows"))
    return total.select(F.col("doc").alias(key), "n_bytes", (F.col("n") / F.col("rows")).cast("bigint").alias("n_tokens"), F.explode(F.sequence(F.lit(1).cast("bigint"), "rows")).alias("__copy")).drop("__copy")
