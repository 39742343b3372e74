"""ZIP archives that tasks write and read in parallel.

Each task deflates its members into a part of its own and tells their sizes; places in the archive are prefix sums over the parts,
a row each.  The directory is written by parts too, then all parts are copied to their places in one file at once.  The driver
writes the 98 bytes of the end.  Places and counts are 64-bit (ZIP64), so any number of members and any size will do.

A task that runs twice leaves a part that no index row names; copying is the same however often it is done.  The target is a file
in a folder that all executors mount, as copies are written in place.

Null contents count as empty; names are taken as they are (see ``history.zip_names`` for names that repeat); no rows give an empty archive.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.sources import shared

# Fixed values of the format: signatures, version 4.5, UTF-8 names, deflate, the first day of its calendar.
LOCAL, CENTRAL, END, END64, AT64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
VERSION, UTF8, DEFLATE, DAY = 45, 0x800, 8, 0x21
LOCAL_SIZE, CENTRAL_SIZE, END_SIZE = 30, 46, 98
COPY = 1 << 20
MEMBERS = "part long, file string, name string, crc long, packed long, size long, at long"


def local_header(name: bytes, crc: int, packed: int, size: int) -> bytes:
    return LOCAL + struct.pack("<HHHHHIIIHH", VERSION, UTF8, DEFLATE, 0, DAY, crc, packed, size, len(name), 0) + name


def central_header(name: bytes, crc: int, packed: int, size: int, at: int) -> bytes:
    """With the place in a field of 64 bits."""
    return CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", VERSION, VERSION, UTF8, DEFLATE, 0, DAY, crc, packed, size, len(name), 12, 0, 0, 0, 0, 0xFFFFFFFF) + name + struct.pack("<HHQ", 1, 8, at)


def end_record(count: int, size: int, at: int) -> bytes:
    whole = END64 + struct.pack("<QHHIIQQQQ", 44, VERSION, VERSION, 0, 0, count, count, size, at)
    return whole + AT64 + struct.pack("<IQI", 0, at + size, 1) + END + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)


def _write_parts(folder: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, stream = TaskContext.get().partitionId(), 0, None
        file = f"part-{part:06d}-{uuid.uuid4().hex}"
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0), batch.column(1)):
                name, content = (name.as_py() or "").encode(), content.as_py() or b""
                stream = stream or open(f"{folder}/{file}", "wb")
                deflate = zlib.compressobj(level, zlib.DEFLATED, -zlib.MAX_WBITS)
                packed, crc = deflate.compress(content) + deflate.flush(), zlib.crc32(content)
                stream.write(local_header(name, crc, len(packed), len(content)))
                stream.write(packed)
                rows.append((part, file, name.decode(), crc, len(packed), len(content), at))
                at += LOCAL_SIZE + len(name) + len(packed)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["part", "file", "name", "crc", "packed", "size", "at"])
        if stream:
            # The last rows are read once this is done, so a part is whole when its rows are kept.
            stream.flush()
            os.fsync(stream.fileno())
            stream.close()

    return run


def _write_directory(folder: str):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        file, size = f"dir-{key[0].as_py():06d}-{uuid.uuid4().hex}", 0
        with open(f"{folder}/{file}", "wb") as stream:
            for row in table.sort_by("at").to_pylist():
                size += stream.write(central_header(row["name"].encode(), row["crc"], row["packed"], row["size"], row["base"] + row["at"]))
            stream.flush()
            os.fsync(stream.fileno())
        return pa.table([[key[0].as_py()], [file], [size]], ["part", "file", "bytes"])

    return run


def _copy(folder: str, target: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open(f"{folder}/{file}", "rb") as part, open(target, "r+b") as whole:
                    whole.seek(at)
                    while data := part.read(COPY):
                        whole.write(data)
                    whole.flush()
                    os.fsync(whole.fileno())
            yield batch

    return run


def _placed(parts: DataFrame, first: int) -> DataFrame:
    """``base``: where each part begins.  One task sees a row per part, not per member."""
    before = F.sum("bytes").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return parts.withColumn("base", F.coalesce(before, F.lit(0)) + first)


def write_archive(df: DataFrame, path: str, *, name_col: str = "zip_name", content_col: str = "content", level: int = 6) -> int:
    """Writes the rows as members of the archive at ``path``; returns how many there are."""
    spark = df.sparkSession
    target, scratch = shared.local(path), shared.fresh_path(spark, "archive")
    folder = f"{shared.local(scratch)}/parts"
    os.makedirs(folder, exist_ok=True)
    rows = df.select(F.col(name_col).cast("string"), F.col(content_col).cast("binary"))
    members = shared.written(rows.mapInArrow(_write_parts(folder, level), MEMBERS), f"{scratch}/members")
    parts = members.groupBy("part", "file").agg(F.sum(F.col("packed") + F.octet_length("name") + LOCAL_SIZE).alias("bytes"), F.count("*").alias("n"))
    parts = shared.written(_placed(parts, 0), f"{scratch}/placed")
    total = parts.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    listed = members.join(parts.select("part", "base"), "part").groupBy("part").applyInArrow(_write_directory(folder), "part long, file string, bytes long")
    directory = shared.written(_placed(shared.written(listed, f"{scratch}/listed"), total["bytes"]), f"{scratch}/directory")
    size = directory.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    with open(target, "wb") as whole:
        whole.truncate(total["bytes"] + size)
        whole.seek(total["bytes"] + size)
        whole.write(end_record(total["n"], size, total["bytes"]))
    copies = parts.select("file", "base").unionByName(directory.select("file", "base"))
    copies.repartition("file").mapInArrow(_copy(folder, target), "file string, base long").write.format("noop").mode("overwrite").save()
    shared.drop(spark, scratch)
    return total["n"]


def _list(target: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            with open(target, "rb") as stream:
                stream.seek(-END_SIZE, os.SEEK_END)
                end = stream.read(END_SIZE)
                if end[:4] != END64:
                    raise ValueError(f"{target} is no archive of this writer")
                count, _, size, at = struct.unpack("<QQQQ", end[24:56])
                stream.seek(at)
                rows = []
                for k in range(count):
                    head = struct.unpack("<HHHHHHIIIHHHHHII", stream.read(CENTRAL_SIZE)[4:])
                    name = stream.read(head[9]).decode()
                    rows.append((name, head[6], head[7], head[8], struct.unpack("<HHQ", stream.read(12))[2]))
                    if len(rows) == 10_000 or k + 1 == count:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["name", "crc", "packed", "size", "at"])
                        rows = []

    return run


def _read(target: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(target, "rb") as stream:
            for batch in batches:
                for row in batch.to_pylist():
                    stream.seek(row["at"] + LOCAL_SIZE + len(row["name"].encode()))
                    content = zlib.decompress(stream.read(row["packed"]), -zlib.MAX_WBITS, max(1, row["size"]))
                    if zlib.crc32(content) != row["crc"]:
                        raise ValueError(f"{row['name']} is damaged")
                    yield pa.RecordBatch.from_arrays([pa.array([row["name"]]), pa.array([content], pa.binary())], ["zip_name", "content"])

    return run


def read_archive(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """zip_name, content of an archive of ``write_archive``: one task reads the directory, members are read by all."""
    target = shared.local(path)
    members = spark.range(1, numPartitions=1).mapInArrow(_list(target), "name string, crc long, packed long, size long, at long")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return members.repartition(n).mapInArrow(_read(target), "zip_name string, content binary")
