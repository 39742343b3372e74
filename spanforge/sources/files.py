"""Files as rows: kinds, checks, decoding, plain text of HTML and RTF, pages, and the file table's upkeep."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.functions import text as X
from spanforge.functions import values as V
from spanforge.operators import history as H
from spanforge.operators.plug import call_with

MAX_BYTES = 50 * 1024 * 1024
SCANNED_CHARS = 100


def read(spark: SparkSession, path: str, *, most: int = MAX_BYTES) -> DataFrame:
    """path, modificationTime, length, content of files of an allowed kind and size; larger ones are not read."""
    listing = spark.read.format("binaryFile").load(path)
    return listing.where((F.col("length") <= most) & file_type(F.col("path")).isNotNull())


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(F.substring_index(name, "/", -1), r"(?<=[^.])(\.[^./]+)$", 1))


def file_type(name: Column) -> Column:
    """doc, docx, txt, pdf or image by the last extension; null for other kinds."""
    own, out = extension(name), F.lit(None).cast("string")
    for kind, extensions in V.FILE_TYPES.items():
        out = F.when(own.isin(extensions), kind).otherwise(out)
    return out


def allowed(name: Column, length: Column, most: int = MAX_BYTES) -> Column:
    return file_type(name).isNotNull() & (length <= most)


def signature_fits(content: Column, ext: Column) -> Column:
    """Whether the first bytes are a known signature that stands for the extension; without a known one only texts fit."""
    head = F.substring(content, 1, 8)
    out = ext.isin([".txt", ".md", ".rtf", ".html", ".htm"])
    for signature, extensions in reversed(V.SIGNATURES):
        out = F.when(F.startswith(head, F.lit(signature)), ext.isin(extensions)).otherwise(out)
    return out


def decoded(df: DataFrame, *, content_col: str = "content", out_col: str = "text") -> DataFrame:
    """Text of bytes: UTF-8, else GBK, else Latin 1.  Clean UTF-8 stays in the JVM; only the rest goes through Python."""
    clean = F.try_validate_utf8(F.col(content_col).cast("string"))

    @F.pandas_udf("string")
    def other(contents):
        def text(data):
            for name in ("utf-8", "gbk"):
                try:
                    return data.decode(name)
                except UnicodeDecodeError:
                    continue
            return data.decode("latin-1")

        return contents.map(lambda data: None if data is None else text(data))

    good = df.where(clean.isNotNull() | F.col(content_col).isNull()).withColumn(out_col, clean)
    return good.unionByName(df.where(clean.isNull() & F.col(content_col).isNotNull()).withColumn(out_col, other(F.col(content_col))))


def plain_text(text: Column, ext: Column) -> Column:
    return F.when(ext.isin(".html", ".htm"), X.html_text(text)).when(ext == ".rtf", X.rtf_text(text)).otherwise(text)


def classified_pdf(df: DataFrame, *, pages_col: str = "pages") -> DataFrame:
    """Adds file_type, is_scanned, page_count and content of PDFs by their pages' texts; fewer than 100 characters a page on
    average is a scan, whose text is dropped."""
    total = F.aggregate(pages_col, F.lit(0), lambda a, p: a + F.length(X.strip(F.coalesce(p, F.lit("")))))
    scanned = F.coalesce(total / F.size(pages_col), F.lit(0.0)) < SCANNED_CHARS
    empty = F.array().cast("array<string>")
    return df.withColumns({
        "is_scanned": scanned, "page_count": F.size(pages_col), "file_type": F.when(scanned, "pdf_scanned").otherwise("pdf"),
        "content": F.when(scanned, "").otherwise(F.array_join(pages_col, "\n\n")), pages_col: F.when(scanned, empty).otherwise(F.col(pages_col)),
    })


def _number(content: Column, at: int, size: int, little: bool = False) -> Column:
    """An unsigned number in bytes ``at`` (from 1) and on."""
    places = range(at, at + size)
    digits = F.concat(*[F.hex(F.substring(content, k, 1)) for k in (reversed(places) if little else places)])
    return F.conv(digits, 16, 10).try_cast("int")


def image_size(content: Column) -> Column:
    """(width, height) from the header of a PNG, GIF or BMP file; null for others."""
    size = lambda w, h: F.struct(w.alias("width"), h.alias("height"))
    is_ = lambda head: F.startswith(content, F.lit(head))
    png = F.when(is_(b"\x89PNG"), size(_number(content, 17, 4), _number(content, 21, 4)))
    gif = png.when(is_(b"GIF8"), size(_number(content, 7, 2, True), _number(content, 9, 2, True)))
    return gif.when(is_(b"BM"), size(_number(content, 19, 4, True), _number(content, 23, 4, True)))


def converted_with(df: DataFrame, make: Callable[[], Callable[[bytes], bytes]], *, content_col: str = "content") -> DataFrame:
    """``content`` through a converter of bytes, such as one of old Word files; ``converted`` is false where it failed, and the
    content is then null."""
    return call_with(df, make, inputs=[content_col], out_col="_new", kind="binary", failed_col="_failed").withColumns({content_col: F.col("_new"), "converted": ~F.col("_failed")}).drop("_new", "_failed")


def page_images(df: DataFrame, make: Callable[[], Callable[[bytes], list[bytes]]], *, content_col: str = "content") -> DataFrame:
    """Adds ``images``, the pages of a file as a renderer of bytes gives them."""
    return call_with(df, make, inputs=[content_col], out_col="images", kind="array<binary>")


def page_image(images: Column, number: Column) -> Column:
    """The image of a page, from 1; a page that is not there is null."""
    return F.when(number.between(1, F.size(images)), F.get(images, number - 1))


def parsed_image(df: DataFrame) -> DataFrame:
    return df.withColumns({"file_type": F.lit("image"), "is_scanned": F.lit(True), "page_count": F.lit(1), "content": F.lit(""), "pages": F.array().cast("array<string>")})


Parser = Callable[[bytes], list[str]]


def parse_with(df: DataFrame, make: Callable[[], Parser], *, content_col: str = "content") -> DataFrame:
    """Adds ``pages`` from a parser of bytes (PDF, old Word files, readers of page images); a file it fails on has none."""
    schema = T.StructType.fromJson(df.schema.jsonValue()).add("pages", T.ArrayType(T.StringType()))
    place = df.columns.index(content_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse = make()

        def pages(data):
            try:
                return parse(data) if data is not None else None
            except Exception:  # noqa: BLE001  one broken file must not end the job
                return None

        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([pages(x) for x in batch.column(place).to_pylist()], pa.list_(pa.string()))], [*batch.schema.names, "pages"])

    return df.mapInArrow(run, schema)


def registered(uploads: DataFrame, *, is_clean: Callable[[Column], Column] | None = None) -> DataFrame:
    """Uploads (filename, content, upload_source, batch_group_id, job_id) as rows of the file table; ``error`` says why one is
    refused.  ``is_clean`` is a virus check of the content; without one everything passes."""
    ext = extension(F.col("filename"))
    job = H.clean_job_id(F.col("job_id"))
    group = F.coalesce(job, H.clean_group(F.col("batch_group_id")))
    asked = H.clean_source(F.col("upload_source"))
    size = F.length("content")
    error = F.when(file_type(F.col("filename")).isNull(), "unsupported type").when(size > MAX_BYTES, "too large").when(~signature_fits(F.col("content"), ext), "content doesn't fit the extension")
    if is_clean is not None:
        error = error.when(~F.coalesce(is_clean(F.col("content")), F.lit(True)), "infected")
    error = error.when(group.isNull() & (asked == "batch"), "batch needs a group or job")
    return uploads.withColumns({
        "error": error, "file_type": file_type(F.col("filename")), "file_size": size.cast("long"), "original_filename": H.clean_filename(F.col("filename"), ext),
        "upload_source": F.when(group.isNotNull(), "batch").otherwise(F.coalesce(asked, F.lit("playground"))), "batch_group_id": group, "job_id": job,
    })


def upserted(table: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key of both."""
    rows = table.unionByName(new, allowMissingColumns=True)
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(F.col(order).isNotNull(), F.col(order))).alias("_r")).select("_r.*")


def patched(table: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Rows with the fields of their patch that are not null."""
    named = patches.select(key, *[F.col(c).alias(f"_{c}") for c in patches.columns if c != key])
    new = {c: F.coalesce(f"_{c}", c) for c in patches.columns if c != key and c in table.columns}
    return table.join(named, key, "left").withColumns(new).drop(*[f"_{c}" for c in patches.columns if c != key])


def point(table: DataFrame, key: str, value) -> DataFrame:
    return table.where(F.col(key) == value)


def without(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def orphans(disk: DataFrame, known: DataFrame, *, path_col: str = "path", age_col: str = "age_seconds", least_age: int = 3600) -> DataFrame:
    """Files that no row knows and that are an hour old; none if the table knows suspiciously few of many files."""
    one = lambda df, there, named: df.select(F.lit(there).alias("there"), F.lit(named).alias("named"))
    counts = one(disk, 1, 0).unionByName(one(known, 0, 1)).agg(F.sum("there").alias("there"), F.sum("named").alias("named"))
    sound = counts.where("there <= 5 OR named >= floor(there / 2)").select(F.lit(1).alias("_one"))
    lost = disk.where(F.col(age_col) > least_age).join(known.select(path_col), path_col, "left_anti")
    return lost.withColumn("_one", F.lit(1)).join(F.broadcast(sound), "_one", "left_semi").drop("_one")  # a row or none


def newest(files: DataFrame, name_col: str, keep: int = 24) -> DataFrame:
    """The last ``keep`` files by name; sorted in parts, not in one task."""
    return files.orderBy(F.desc(name_col)).limit(keep)
