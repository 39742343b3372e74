"""Writing results: texts, Word files, catalogs, audit lines, archives and encrypted columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.functions import pixels
from spanforge.operators.plug import call_with
from spanforge.sources import docx


def write_texts(df: DataFrame, path: str, *, text_col: str = "redacted_text", mode: str = "error") -> None:
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def docx_outputs(df: DataFrame, *, content_col: str = "content", map_col: str = "entity_map", out_col: str = "output") -> DataFrame:
    """Adds the rewritten Word file and ``redacted_count``; what is no Word file gives null."""
    schema = T.StructType.fromJson(df.schema.jsonValue()).add(out_col, "binary").add("redacted_count", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, counts = [], []
            for data, mapping in zip(batch.column(content_col).to_pylist(), batch.column(map_col).to_pylist()):
                try:
                    new, n = docx.rewrite(data, dict(mapping or {}))
                except Exception:  # noqa: BLE001
                    new, n = None, None
                out.append(new)
                counts.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary()), pa.array(counts, pa.int64())], [*batch.schema.names, out_col, "redacted_count"])

    return df.mapInArrow(run, schema)


def painted(df: DataFrame, *, method: str = "fill", strength: int = 25, color: str = "#000000", content_col: str = "content", boxes_col: str = "boxes", out_col: str = "output") -> DataFrame:
    """Adds the PNG file with its boxes (fractions) covered; null for files that are no such PNG."""

    def make():
        return lambda data, boxes: pixels.write_png(pixels.cover(pixels.read_png(data), boxes or [], method, strength, color))

    return call_with(df, make, inputs=[content_col, boxes_col], out_col=out_col, kind="binary")


def previews(df: DataFrame, *, most: int = 256, content_col: str = "content", boxes_col: str = "boxes", out_col: str = "preview") -> DataFrame:
    """Adds a small PNG with frames around the boxes; null for files that are no PNG."""

    def make():
        return lambda data, boxes: pixels.write_png(pixels.preview(pixels.outlined(pixels.read_png(data), boxes or []), most))

    return call_with(df, make, inputs=[content_col, boxes_col], out_col=out_col, kind="binary")


def images_with(df: DataFrame, make, *, content_col: str = "content", boxes_col: str = "boxes", out_col: str = "output") -> DataFrame:
    """Adds the file that a writer of (bytes, boxes) gives, such as one that paints over a PDF's pages; null where it failed."""
    return call_with(df, make, inputs=[content_col, boxes_col], out_col=out_col, kind="binary")


def save_catalog(catalog: DataFrame, path: str) -> None:
    """Overwrites by the commit protocol: readers see the old table or the new one."""
    catalog.write.mode("overwrite").json(path)


def load_catalog(spark, path: str, schema: str, default: DataFrame) -> DataFrame:
    """The saved catalog, or ``default`` if there is none or nothing in it can be read."""
    try:
        found = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return default
    return found if found.head(1) else default


def audit_rows(df: DataFrame, action: Column, resource_type: Column, resource_id: Column, user: Column, detail: Column) -> DataFrame:
    """A JSON line per row; append with ``write_audit``."""
    return df.select(F.to_json(F.struct(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("timestamp"), action.alias("action"), resource_type.alias("resource_type"), resource_id.alias("resource_id"), user.alias("user"), detail.alias("detail"))).alias("value"))


def write_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").text(path)


def encrypted(content: Column, key: Column) -> Column:
    """AES-GCM; the nonce stands in front."""
    return F.aes_encrypt(content, key, F.lit("GCM"))


def decrypted(content: Column, key: Column) -> Column:
    """Null if it was tampered with or the key is wrong."""
    return F.try_aes_decrypt(content, key, F.lit("GCM"))


def write_zip(rows, stream) -> int:
    """Writes (zip_name, content) rows to an archive as they come; a stream of rows from ``toLocalIterator`` needs no memory."""
    import zipfile

    n = 0
    with zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in rows:
            z.writestr(name, content)
            n += 1
    return n
