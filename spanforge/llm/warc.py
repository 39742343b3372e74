"""Operator 10, WARC: archives written with an index first, read back by coalesced byte ranges.

``write`` makes a gzip member per record and, in the same task, an index row (file, offset, length, URL, digest, ...) for it;
the index is a Parquet table that Spark commits, and each attempt of a task writes a file of its own name, so the index only
names whole files.  ``read`` takes any selection of index rows, sorts it by file and offset, joins ranges that lie less than
``GAP`` apart to one read of at most ``READ_BYTES`` (or one longer record) and parses the records.

Of records with equal payloads (by their SHA-1) of at least ``min_bytes``, those with the largest ``page_id`` are responses
and the others revisits without payload.  Only (digest, largest id) pairs are aggregated, and the join that brings them to the
pages can be split where one payload is frequent.

Null html is an empty payload; null URLs leave their header out; null ids count as smaller than all others; rows that repeat
the largest ``page_id`` are all responses; an empty table gives an empty index; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import store
from spanforge.llm.memory import lean

GAP, READ_BYTES = 64 << 10, 8 << 20
#: Rows of a batch that are Python objects at once.
STEP = 256
LEVEL = 3
INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def record(page_id: int | None, url: str | None, payload: bytes, keep: int | None) -> bytes:
    """A record; with ``keep`` a revisit of that page's."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if keep is not None else head + payload
    fields = [("WARC-Type", "revisit" if keep is not None else "response"), ("WARC-Record-ID", _name(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if keep is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(keep))]
    fields += [("WARC-Payload-Digest", f"sha1:{base32(hashlib.sha1(payload).digest())}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """What ``record`` wrote."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError("no WARC record here")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    number = lambda name: int(m[1]) if (m := re.fullmatch(r"<urn:x-page:(-?\d+)>", name or "")) else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or base32(hashlib.sha1(payload).digest()) != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} doesn't match its digest")
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To")), "payload": payload if fields["WARC-Type"] == "response" else None}


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = store.filesystem(folder)
        name, at, stream = f"{uuid.uuid4().hex}.warc.gz", 0, None
        try:
            for batch in batches:
                rows: list[tuple] = []
                for page_id, url, html, keep in (row for k in range(0, batch.num_rows, STEP) for row in zip(*(c.to_pylist() for c in batch.slice(k, STEP).columns))):
                    if stream is None:
                        system.create_dir(path, recursive=True)
                        stream = system.open_output_stream(f"{path}/{name}", compression=None)
                    payload = (html or "").encode()
                    own = keep is not None and keep != page_id
                    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    data = packer.compress(record(page_id, url, payload, keep if own else None)) + packer.flush()
                    stream.write(data)
                    rows.append((name, at, len(data), url, base32(hashlib.sha1(payload).digest()), page_id, "revisit" if own else "response"))
                    at += len(data)
                if rows:
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["file", "offset", "length", "url", "digest", "page_id", "record_type"])
        finally:
            if stream is not None:
                stream.close()

    return run


def write(pages: DataFrame, folder: str, *, min_bytes: int = 0) -> DataFrame:
    """Writes the archives to ``folder`` and gives their index, itself a table there."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("digest", F.sha1("html"))
    sizes = F.octet_length("html")
    many = rows.where(sizes >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1").drop("n")
    # The digests are few and short, so the pages stream past a table of them instead of being sorted with their contents.
    marked = rows.join(many.hint("shuffle_hash"), "digest", "left").select("page_id", "url", "html", F.when(sizes >= min_bytes, F.col("keep")).alias("keep"))
    index = f"{folder}/index"
    # Snappy: a zstd stream takes a megabyte outside the heap for each column of each file, whatever few rows it has.
    marked.mapInArrow(lean(_writer(f"{folder}/archive")), INDEX).write.option("compression", "snappy").parquet(index)
    return pages.sparkSession.read.schema(INDEX).parquet(index)


def ranges(rows: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(start, end, its records) of each read, for records sorted by offset."""
    group: list[tuple[int, int]] = []
    for offset, length in rows:
        if group and (offset - sum(group[-1]) > GAP or offset + length - group[0][0] > READ_BYTES):
            yield group[0][0], sum(group[-1]), group
            group = []
        group.append((offset, length))
    if group:
        yield group[0][0], sum(group[-1]), group


KINDS = {"page_id": "long", "url": "string", "payload_bytes": "long", "payload_digest": "string", "record_type": "string", "refers_to": "long", "payload": "binary"}


def _reader(folder: str, outputs: list[str]):
    arrow = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def given(found: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, arrow[KINDS[k]]) for k, c in zip(outputs, zip(*found))], outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = store.filesystem(folder)
        name, source = None, None
        for batch in batches:
            files, offsets, lengths = (batch.column(k).to_pylist() for k in range(3))
            k = 0
            while k < len(files):
                end = k
                while end < len(files) and files[end] == files[k]:
                    end += 1
                if files[k] != name:
                    name, source = files[k], system.open_input_file(f"{path}/{files[k]}")
                for start, stop, group in ranges(list(zip(offsets[k:end], lengths[k:end]))):
                    source.seek(start)
                    data = source.read(stop - start)
                    # Records may unpack to many times what was read: only what is asked for is kept, up to READ_BYTES of it.
                    found, size = [], 0
                    for o, n in group:
                        one = parse(zlib.decompress(data[o - start : o - start + n], 31))
                        found.append([one[c] for c in outputs])
                        size += len(one["payload"] or b"") if "payload" in outputs else 0
                        if size >= READ_BYTES:
                            yield given(found)
                            found, size = [], 0
                    if found:
                        yield given(found)
                k = end

    return run


def read(selected: DataFrame, folder: str, outputs: list[str]) -> DataFrame:
    """The records of the selected index rows; ``outputs`` are of ``KINDS``.

    The rows are few bytes but stand for much to read, so they are dealt to as many tasks as there are archives."""
    files = max(1, selected.select("file").distinct().count())
    placed = selected.select("file", "offset", "length").repartition(files, "file").sortWithinPartitions("file", "offset")
    return placed.mapInArrow(lean(_reader(f"{folder}/archive", outputs)), ", ".join(f"{c} {KINDS[c]}" for c in outputs))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = store.fresh_path(spark, "warc")
    index = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read(index, folder, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), g AS (SELECT html, max(page_id) AS keep FROM p GROUP BY html),
d AS (SELECT p.page_id, p.html, keep, sha1(p.html) AS hex FROM p JOIN g USING (html)),
b AS (SELECT *, list_reduce(list_transform(range(0, 160), lambda i: substr(lpad(bin(('0x' || substr(hex, (i // 4 + 1)::INT, 1))::INT), 4, '0'), (i % 4 + 1)::INT, 1)), lambda x, y: x || y) AS bits FROM d)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  list_reduce(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (list_reduce(list_transform(range(0, 5), lambda j: substr(bits, (5 * k + j + 1)::INT, 1)::INT), lambda x, y: 2 * x + y) + 1)::INT, 1)), lambda x, y: x || y) AS payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM b
"""
