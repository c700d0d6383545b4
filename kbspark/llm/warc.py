"""WARC archives: writing one gzip member for each record, and a reader that salvages what damage leaves.

The reader walks the members of a file and the records of each member. A member that fails to unpack, or a record that fails its checks, starts a search for
the next valid member (or version line, where an archive isn't compressed); the bytes in between are quarantined and logged, and the records behind them are read.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
LEAST = 100
RECORDS = ("file string, offset bigint, length bigint, problem string, record_type string, record_id string, refers_to string, uri string, "
           "payload_digest string, payload_bytes bigint, payload binary, inner_offset bigint, inner_length bigint")
NAMES = [x.split()[0] for x in RECORDS.split(", ")]


def _record(kind: str, page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}"]
    if page is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page}>")
    head += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
             f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=-._~%"))
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """Gzip member that ends in a zero byte: the last byte of its length field, or an empty member's where the record has 16 MiB or more."""
    out = gzip.compress(record, 4, mtime=0)
    return out if out[-1] == 0 else out + gzip.compress(b"", 4, mtime=0)


def write_archive(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", records_per_file: int = 2000) -> None:
    """Writes a record for each row of ``pages`` to ``path``, in files of ``records_per_file``.

    Of rows with equal payloads of ``LEAST`` bytes or more those of the smallest key are responses, the others revisits of it; rows without key
    revisit too, unless no row of the payload has one. Smaller payloads are all responses. Null html is an empty payload, a null key or url leaves its header out.

    Spark's text writer puts down the bytes of each row and its separator as they are. Every member ends in a zero byte, so that byte is the separator.
    """
    rows = pages.select(F.col(key).cast("bigint").alias("page"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    shared = (rows.filter(F.octet_length("payload") >= LEAST).groupBy("digest").agg(F.min("page").alias("least"), F.count("*").alias("n"))
              .filter("n > 1").select("digest", "least"))
    flagged = rows.join(shared, "digest", "left").withColumn("refers", F.when(F.col("least").isNotNull() & ~F.col("least").eqNullSafe(F.col("page")), F.col("least")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            out, size = [], 0
            for page, link, payload, digest, refers in zip(*cols):
                out.append(member(_record("response" if refers is None else "revisit", page, link, payload, digest, refers))[:-1])
                size += len(out[-1])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    members = flagged.select("page", "url", "payload", "digest", "refers").mapInArrow(pack, "value binary")
    members.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", records_per_file).text(path)


def _parse(data: bytes, at: int) -> tuple[dict | None, str]:
    """Record that begins at a place of unpacked bytes, or why there is none."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0 or not data.startswith(VERSION, at):
        return None, "no version line"
    head, begin = data[at:end], end + 4
    lines = head.split(b"\r\n")[1:]
    fields = {k.strip().lower().decode("ascii", "replace"): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines)}
    length = fields.get("content-length", "")
    if not length.isascii() or not length.isdigit() or len(data) - begin < int(length):
        return None, "bad content length"
    block = data[begin:begin + int(length)]
    kind, sha = fields.get("warc-type", ""), fields.get("warc-block-digest", "")
    if sha.startswith("sha256:") and hashlib.sha256(block).hexdigest() != sha[7:]:
        return None, "block digest differs"
    payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    own = hashlib.sha256(payload).hexdigest()
    if kind != "revisit" and digest and digest != own:
        return None, "payload digest differs"
    size = fields.get("x-payload-length", "")
    return {"record_type": kind, "record_id": fields.get("warc-record-id"), "refers_to": fields.get("warc-refers-to"), "uri": fields.get("warc-target-uri"),
            "payload_digest": digest or own, "payload_bytes": int(size) if kind == "revisit" and size.isdigit() else len(payload),
            "payload": None if kind == "revisit" else payload, "length": len(head) + 4 + int(length)}, ""


def _plain(data: bytes) -> Iterator[tuple[int, int, dict | None, str]]:
    """(offset, length, record, problem) of the records and gaps in bytes that aren't compressed, in order and without holes."""
    at, gap, why = 0, None, ""
    while at < len(data):
        record, problem = _parse(data, at) if data.startswith(VERSION, at) else (None, "no version line")
        if record:
            if gap is not None:
                yield gap, at - gap, None, why
                gap = None
            step = record["length"]
            while data.startswith(b"\r\n", at + step):
                step += 2
            yield at, step, record, ""
            at += step
            continue
        if gap is None:
            gap, why = at, problem
        at = data.find(VERSION, at + 1)
        at = len(data) if at < 0 else at
    if gap is not None:
        yield gap, len(data) - gap, None, why


def _unpacked(data: bytes, at: int, piece: int = 1 << 16) -> tuple[bytes | None, int]:
    """Content and length of the member that begins at ``at``, none where it is cut off. Bytes go in by pieces, so no more than one piece behind the member is touched."""
    unpack, out, pos = zlib.decompressobj(31), [], at
    while not unpack.eof and pos < len(data):
        out.append(unpack.decompress(data[pos:pos + piece]))
        pos += piece
    return (b"".join(out), min(pos, len(data)) - len(unpack.unused_data) - at) if unpack.eof else (None, 0)


def salvage(data: bytes) -> Iterator[dict]:
    """Records of an archive in order, and a row with ``problem`` for each gap that was passed over.

    A member may hold any number of records. Offset and length are those in the file, so all records of a member, and the gaps between them, have the member's;
    ``inner_offset`` and ``inner_length`` tell the place in its content. A member without any record is a gap of the file.
    """
    at, gap, why = 0, None, ""
    while at < len(data):
        step, rows, problem = 0, [], "no member or version line"
        if data.startswith(MAGIC, at):
            try:
                content, step = _unpacked(data, at)
                if content is not None:
                    inner = list(_plain(content))
                    rows = [(r or {"problem": p}) | {"inner_offset": a, "inner_length": n} for a, n, r, p in inner]
                    # an empty member says nothing
                    problem = "" if not content or any(r for _, _, r, _ in inner) else inner[0][3]
                else:
                    problem = "member is cut off"
            except zlib.error:
                problem = "member does not unpack"
        elif data.startswith(VERSION, at):
            record, problem = _parse(data, at)
            step = record["length"] if record else 0
            step += 4 if record and data.startswith(b"\r\n\r\n", at + step) else 0
            rows = [record] if record else []
        if not problem:
            if gap is not None:
                yield {"offset": gap, "length": at - gap, "problem": why}
                gap = None
            for row in rows:
                yield row | {"offset": at, "length": step}
            at += step
            continue
        if gap is None:
            gap, why = at, problem
        found = [x for x in (data.find(MAGIC, at + 1), data.find(VERSION, at + 1)) if x >= 0]
        at = min(found, default=len(data))
    if gap is not None:
        yield {"offset": gap, "length": len(data) - gap, "problem": why}


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives below ``path``, and one with ``problem`` for each quarantined gap (its place and length in the file, no record).
    A compressed member may hold many records; the ``inner`` columns tell the place of each, and of the gaps between them, in its content.

    Digests and lengths are checked; a record's ``payload_digest`` and ``payload_bytes`` are of the full payload, for revisits as the record states them.
    Empty files have no row. A file is read as a whole by one task, so archives should be of moderate size, as ``write_archive`` makes them.
    """
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in RECORDS.split(", "))])
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows, size = [], 0
                for r in salvage(content.as_py()):
                    rows.append({n: r.get(n) for n in NAMES} | {"file": name})
                    size += len(r.get("payload") or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(kernel, RECORDS)


def page_number(urn: str) -> Column:
    return F.expr(f"try_cast(regexp_extract({urn}, '^<urn:page:(-?[0-9]+)>$', 1) AS bigint)")
