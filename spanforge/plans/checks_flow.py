"""Queries over sources, sinks, images, catalogs, jobs and keyed calls that the other modules leave out.  SQL beside each."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import functions as F

from spanforge.functions import boxes as B
from spanforge.functions import pixels as PX
from spanforge.functions import text as X
from spanforge.functions import values as V
from spanforge.operators import boxes as O
from spanforge.operators import catalog as C
from spanforge.operators import history as H
from spanforge.operators import paging as G
from spanforge.operators import jobs as J
from spanforge.operators import plug
from spanforge.operators import reports as R
from spanforge.plans.checks_boxes import BOXES_SQL, boxes
from spanforge.plans.checks_jobs import FILES_SQL, HISTORY_SQL, ITEMS_SQL, JOBS_SQL, events, files, history, items, jobs
from spanforge.plans.checks_text import docs
from spanforge.sources import docx, sinks
from spanforge.sources import files as S

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def pages(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet")


def turns(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet")


def pick(key, *values):
    return F.get(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int"))


# Sources.

NAMES = ["a.PDF", "b.exe", "c.tiff", "d", ".docx", "e.tar.gz", "f.htm"]


@query("SELECT page_id, list_contains(['a.PDF', 'c.tiff', 'f.htm'], ['a.PDF', 'b.exe', 'c.tiff', 'd', '.docx', 'e.tar.gz', 'f.htm'][page_id % 7 + 1]) AND length(html) <= 20000 AS ok FROM pages")
def allowed_uploads(spark, d):
    return pages(spark, d).select("page_id", S.allowed(pick(F.col("page_id"), *NAMES), F.length("html"), 20_000).alias("ok"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace('{\\rtf1 \\b0 ' || text || '\\par }', '\\\\[a-z]+\\d*\\s?', '', 'g'), '[{}]', '', 'g'), '\\s+', ' ', 'g')) AS text FROM documents")
def rtf_to_text(spark, d):
    return docs(spark, d).select("doc_id", X.rtf_text(F.concat(F.lit(r"{\rtf1 \b0 "), "text", F.lit(r"\par }"))).alias("text"))


EXTENSIONS = [".pdf", ".docx", ".doc", ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".rtf", ".tif", ".tiff", ".txt", ".html"]
HEADS = [h for h, _ in V.SIGNATURES] + [b"hello", b""]
FITS = [[(e in exts) if k < len(V.SIGNATURES) else e in (".txt", ".md", ".rtf", ".html", ".htm") for e in EXTENSIONS] for k, exts in enumerate([x for _, x in V.SIGNATURES] + [[], []])]


@query("SELECT page_id, fits FROM pages JOIN (VALUES " + ", ".join(f"({k}, {j}, {str(FITS[k][j]).lower()})" for k in range(len(HEADS)) for j, e in enumerate(EXTENSIONS)) + f") AS t(head, ext, fits) ON head = page_id % {len(HEADS)} AND ext = page_id // {len(HEADS)} % {len(EXTENSIONS)}")
def every_signature(spark, d):
    """Pages behind each known signature, and none, under each extension in turn."""
    turn = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (n + 1).cast("int"))
    rows = spark.read.parquet(f"{d}/pages.parquet")
    head = turn([bytearray(h) for h in HEADS], F.col("page_id") % len(HEADS))
    ext = turn(EXTENSIONS, F.floor(F.col("page_id") / len(HEADS)) % len(EXTENSIONS))
    content = F.concat(head, F.encode(F.lit("rest"), "utf-8"), F.encode(F.coalesce("html", F.lit("")), "utf-8"))
    return rows.select("page_id", S.signature_fits(content, ext).alias("fits"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN '中文' || doc_id ELSE 'é' || doc_id || 'ÿ' END AS text FROM documents")
def decode_each_way(spark, d):
    """Bytes in UTF-8, GBK and Latin 1."""
    k, own = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    content = F.when(k == 0, F.encode("text", "UTF-8")).when(k == 1, F.concat(F.unhex(F.lit("D6D0CEC4")), F.encode(own, "UTF-8"))).otherwise(F.concat(F.unhex(F.lit("E9")), F.encode(own, "UTF-8"), F.unhex(F.lit("FF"))))
    return S.decoded(docs(spark, d).select("doc_id", content.alias("content"))).select("doc_id", "text")


def _word_file():
    def made(text: str) -> bytes:
        xml = "".join(f"<w:p><w:r><w:t>{escape(line)}</w:t></w:r></w:p>" for line in text.split("\n"))
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{xml}</w:body></w:document>')
        return out.getvalue()

    return made


def word_files(spark, d):
    return plug.call_with(docs(spark, d), _word_file, inputs=["text"], out_col="content", kind="binary")


LINES_SQL = "array_to_string(list_filter(list_transform(string_split({0}, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> ''), chr(10))"


@query(f"SELECT doc_id, {LINES_SQL.format('text')} AS text FROM documents")
def word_text(spark, d):
    return S.parse_with(word_files(spark, d), docx.parser).select("doc_id", F.get("pages", F.lit(0)).alias("text"))


@query(f"SELECT doc_id, {LINES_SQL.format(chr(34) + 't' + chr(34))} AS text, n FROM (SELECT doc_id, replace(text, 'the', '<1>') AS t, (len(string_split(text, 'the')) - 1)::BIGINT AS n FROM documents)")
def word_files_rewritten(spark, d):
    made = sinks.docx_outputs(word_files(spark, d).withColumn("entity_map", F.create_map(F.lit("the"), F.lit("<1>"))))
    back = S.parse_with(made.drop("content").withColumnRenamed("output", "content"), docx.parser)
    return back.select("doc_id", F.get("pages", F.lit(0)).alias("text"), F.col("redacted_count").alias("n"))


@query("SELECT page_id, 'image' AS file_type, true AS is_scanned, '' AS content FROM pages")
def image_files(spark, d):
    return S.parsed_image(pages(spark, d).select("page_id")).select("page_id", "file_type", "is_scanned", "content")


@query("SELECT page_id, CASE WHEN page_id % 4 < 3 THEN page_id % 256 + 1 END AS width, CASE WHEN page_id % 4 < 3 THEN page_id % 100 + 7 END AS height FROM pages")
def image_sizes(spark, d):
    w, h, k = F.col("page_id") % 256 + 1, F.col("page_id") % 100 + 7, F.col("page_id") % 4
    big = lambda v, n: F.unhex(F.lpad(F.hex(v), 2 * n, "0"))
    little = lambda v, n: F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright(v, 8 * k).bitwiseAND(F.lit(255))), 2, "0")) for k in range(n)])
    pad = lambda n: F.unhex(F.lit("00" * n))
    content = F.when(k == 0, F.concat(F.lit(b"\x89PNG\r\n\x1a\n"), pad(8), big(w, 4), big(h, 4))).when(k == 1, F.concat(F.lit(b"GIF89a"), little(w, 2), little(h, 2))).when(k == 2, F.concat(F.lit(b"BM"), pad(16), little(w, 4), little(h, 4))).otherwise(F.lit(b"\xff\xd8\xff"))
    size = S.image_size(content)
    return pages(spark, d).select("page_id", size["width"].cast("long").alias("width"), size["height"].cast("long").alias("height"))


@query("""SELECT page_id, CASE WHEN page_id % 5 = 4 THEN 'unsupported type' WHEN page_id % 5 = 1 THEN 'content doesn''t fit the extension' WHEN contains(html, 'script') THEN 'infected' WHEN page_id % 3 = 1 AND page_id % 2 <> 0 THEN 'batch needs a group or job' END AS error,
CASE WHEN page_id % 2 = 0 THEN 'batch' WHEN page_id % 3 = 1 THEN 'batch' ELSE 'playground' END AS upload_source, CASE WHEN page_id % 2 = 0 THEN 'g' || page_id END AS batch_group_id FROM pages""")
def uploads_registered(spark, d):
    n = F.col("page_id")
    rows = pages(spark, d).select("page_id", pick(n, "a.txt", "b.png", "c.html", "d/e.md", "f.exe").alias("filename"), F.encode("html", "UTF-8").alias("content"), F.when(n % 3 == 1, " Batch ").alias("upload_source"), F.when(n % 2 == 0, F.concat(F.lit(" g"), n.cast("string"))).alias("batch_group_id"), F.lit("no uuid").alias("job_id"))
    made = S.registered(rows, is_clean=lambda c: ~F.contains(F.decode(c, "UTF-8"), F.lit("script")))
    return made.select("page_id", "error", "upload_source", "batch_group_id")


@query("SELECT doc_id FROM documents WHERE n_chars > 1000 AND doc_id % 4 = 0")
def orphans_found(spark, d):
    """Files that no row knows: the table knows three of four."""
    disk = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("age_seconds"))
    return S.orphans(disk, disk.where("path % 4 <> 0"), least_age=1000).select(F.col("path").alias("doc_id"))


@query("SELECT user_id, max_by(event_type, event_id) FILTER (event_id % 2 = 1) AS event_type, max(event_id) FILTER (event_id % 2 = 0) AS event_id FROM events GROUP BY user_id HAVING count(*) FILTER (event_id % 2 = 0) > 0")
def rows_patched(spark, d):
    half = lambda k: events(spark, d).where(F.col("event_id") % 2 == k).groupBy("user_id")
    table = half(0).agg(F.max("event_id").alias("event_id"), F.lit(None).cast("string").alias("event_type"))
    return S.patched(table, half(1).agg(F.max_by("event_type", "event_id").alias("event_type")), "user_id").select("user_id", "event_type", "event_id")


@query("SELECT doc_id, text AS opened, true AS tampered FROM documents")
def encryption_roundtrip(spark, d):
    key = F.lit(b"0123456789abcdef")
    sealed = docs(spark, d).withColumn("sealed", sinks.encrypted(F.col("text"), key))
    return sealed.select("doc_id", sinks.decrypted(F.col("sealed"), key).cast("string").alias("opened"), sinks.decrypted(F.concat("sealed", F.lit(b"x")), key).isNull().alias("tampered"))


@query("SELECT doc_id, 'delete' AS action, 'file' AS resource_type, doc_id::VARCHAR AS resource_id FROM documents")
def audit_lines(spark, d):
    lines = sinks.audit_rows(docs(spark, d), F.lit("delete"), F.lit("file"), F.col("doc_id").cast("string"), F.lit("me"), F.lit(None).cast("string"))
    get = lambda k: F.get_json_object("value", f"$.{k}").alias(k)
    return lines.select(get("resource_id").cast("long").alias("doc_id"), get("action"), get("resource_type"), get("resource_id"))


@query("SELECT count(*) FILTER (l_quantity <= 10) AS le_10, count(*) FILTER (l_quantity <= 25) AS le_25, count(*) AS count, sum(l_quantity) AS sum FROM lineitem")
def metric_histogram(spark, d):
    return R.histogram(spark.read.parquet(f"{d}/lineitem.parquet"), F.col("l_quantity"), [10, 25])


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE 'old' END AS name FROM part")
def presets_imported(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"))
    return C.imported(rows.withColumn("name", F.lit("old")), rows.where("id % 3 = 0").withColumn("name", F.lit("new")))


@query("SELECT DISTINCT o_orderdate::DATE::VARCHAR AS name FROM orders ORDER BY name DESC LIMIT 24")
def backups_kept(spark, d):
    names = spark.read.parquet(f"{d}/orders.parquet").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("name")).distinct()
    return S.newest(names, "name", 24)


# Images.


def _png():
    import numpy as np

    return lambda k: PX.write_png(np.full((10 + k % 5, 20, 3), 200, np.uint8))


def images(spark, d):
    box = F.struct(F.lit(0.1).alias("x"), F.lit(0.2).alias("y"), F.lit(0.5).alias("width"), F.lit(0.3).alias("height"))
    rows = pages(spark, d).select("page_id", F.when(F.col("page_id") % 4 > 0, F.array(box)).otherwise(F.array().cast("array<struct<x:double,y:double,width:double,height:double>>")).alias("boxes"))
    return plug.call_with(rows, _png, inputs=["page_id"], out_col="content", kind="binary")


def _counted():
    def count(data: bytes) -> list[int]:
        px = PX.read_png(data)
        return [int((px != 200).any(2).sum()), px.shape[1], px.shape[0]]

    return count


def counted(df, column):
    return plug.call_with(df, _counted, inputs=[column], out_col="c", kind="array<bigint>").select("page_id", *[F.get("c", F.lit(k)).alias(n) for k, n in enumerate(("changed", "width", "height"))])


SIZE = "(10 + page_id % 5)"


@query(f"SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 0 ELSE (trunc(0.6 * 20) - trunc(0.1 * 20) + 1) * (trunc((0.2::DOUBLE + 0.3::DOUBLE) * {SIZE}) - trunc(0.2::DOUBLE * {SIZE}) + 1) END::BIGINT AS changed, 20::BIGINT AS width, {SIZE} AS height FROM pages")
def images_filled(spark, d):
    return counted(sinks.painted(images(spark, d)), "output")


@query(f"SELECT page_id, 0::BIGINT AS changed, 20::BIGINT AS width, {SIZE} AS height FROM pages")
def images_blurred(spark, d):
    """An even grey stays itself under blur and mosaic."""
    done = sinks.painted(images(spark, d), method="blur", strength=40).drop("content").withColumnRenamed("output", "content")
    return counted(sinks.painted(done, method="mosaic", strength=80), "output")


@query("SELECT page_id, 10::BIGINT AS width, trunc((10 + page_id % 5) / 2.0)::BIGINT AS height, page_id % 4 > 0 AS framed FROM pages")
def image_previews(spark, d):
    return counted(sinks.previews(images(spark, d), most=10), "preview").select("page_id", "width", "height", (F.col("changed") > 0).alias("framed"))


@query("SELECT page_id, 'p' || page_id AS first_page, 2::BIGINT AS n, true AS none FROM pages")
def rendered_pages(spark, d):
    """A plugged-in renderer's pages, counted from 1; page 3 of two is not there."""
    rows = pages(spark, d).select("page_id", F.encode(F.concat(F.lit("p"), F.col("page_id").cast("string")), "UTF-8").alias("content"))
    made = S.page_images(rows, lambda: lambda data: [data, data + b"-2"])
    image = lambda k: S.page_image(F.col("images"), F.lit(k))
    return made.select("page_id", image(1).cast("string").alias("first_page"), F.size("images").cast("long").alias("n"), image(3).isNull().alias("none"))


def _upper():
    def call(data: bytes) -> bytes:
        if data.endswith(b"0"):
            raise ValueError("cannot be converted")
        return data + b"!"

    return call


@query("SELECT page_id, CASE WHEN page_id % 10 <> 0 THEN page_id || '!' END AS text, page_id % 10 <> 0 AS converted FROM pages")
def files_converted(spark, d):
    rows = pages(spark, d).select("page_id", F.encode(F.col("page_id").cast("string"), "UTF-8").alias("content"))
    return S.converted_with(rows, _upper).select("page_id", F.col("content").cast("string").alias("text"), "converted")


# Boxes.


@query(f"WITH {BOXES_SQL} SELECT doc, page, part, supp, cents, round(trunc(x * 1000) / 1000, 9) AS x, round(trunc(width * 1000) / 1000, 9) AS width FROM boxes")
def fraction_boxes(spark, d):
    own = boxes(spark, d)
    made = B.to_fractions(*[(F.col(s) * 1000).cast("int") for s in B.SIDES], F.lit(1000), F.lit(1000))
    return own.select("doc", "page", "part", "supp", "cents", F.round(made["x"], 9).alias("x"), F.round(made["width"], 9).alias("width"))


@query("SELECT doc_id, doc_id % 3 = 0 OR doc_id % 5 = 0 AS seal FROM documents")
def seals(spark, d):
    label = F.when(F.col("doc_id") % 3 == 0, "SEAL").when(F.col("doc_id") % 2 == 0, "text")
    text = F.when(F.col("doc_id") % 5 == 0, "a [公章]")
    return docs(spark, d).select("doc_id", O.is_seal(label, text).alias("seal"))


IOU = """CASE WHEN least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x) <= 0 OR least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y) <= 0 THEN 0.0::DOUBLE
ELSE ((least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x)) * (least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y))) / (a.width * a.height + b.width * b.height - ((least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x)) * (least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y)))) END"""


@query(f"""WITH {BOXES_SQL}, n AS (SELECT *, doc || '-' || page || '-' || part || '-' || supp || '-' || cents AS box_id FROM boxes), p AS (SELECT a.box_id, b.x, b.y, {IOU} AS iou FROM n a JOIN n b ON a.doc = b.doc AND b.source = 'has_image'), t AS (SELECT box_id, first(x ORDER BY iou DESC, x, y) AS x FROM p WHERE iou >= 0.3 GROUP BY box_id)
SELECT n.box_id, round(coalesce(t.x, n.x), 9) AS x FROM n LEFT JOIN t USING (box_id)""")
def boxes_refined(spark, d):
    own = boxes(spark, d).withColumn("box_id", F.concat_ws("-", "doc", "page", "part", "supp", "cents"))
    made = O.refine(own.select("doc", "box_id", *B.SIDES), own.where("source = 'has_image'").select("doc", *B.SIDES), page=["doc"])
    return made.select("box_id", F.round("x", 9).alias("x"))


@query("""WITH a AS (SELECT doc_id, CASE WHEN lang = 'en' THEN NULL WHEN lang = 'de' THEN [] ELSE [source, lang] END AS asked, CASE WHEN n_chars % 3 = 0 THEN NULL WHEN n_chars % 3 = 1 THEN [] ELSE ['a'] END AS other FROM documents),
v AS (SELECT *, list_filter(asked, lambda t: t IN ('src1', 'src2', 'fr')) AS valid FROM a)
SELECT doc_id, CASE WHEN asked IS NULL THEN 'd' WHEN len(asked) = 0 THEN CASE WHEN other IS NOT NULL AND len(other) = 0 THEN 'd' ELSE '' END WHEN len(valid) = 0 THEN 'src1,src2,fr' ELSE array_to_string(valid, ',') END AS types FROM v""")
def pipeline_choice(spark, d):
    """What each document's language, source and length ask of two pipelines."""
    none = F.array().cast("array<string>")
    asked = F.when(F.col("lang") == "de", none).when(F.col("lang") != "en", F.array("source", "lang"))
    other = F.when(F.col("n_chars") % 3 == 1, none).when(F.col("n_chars") % 3 == 2, F.array(F.lit("a")))
    rows = spark.read.parquet(f"{d}/documents.parquet")
    return rows.select("doc_id", F.array_join(O.chosen_types_of(asked, other, ["src1", "src2", "fr"], ["d"]), ",").alias("types"))


def _text_boxes():
    return lambda data: [{"x": 0.1, "y": 0.1, "width": 0.4, "height": 0.4, "type": "PERSON", "text": "t", "confidence": 0.9}]


def _image_boxes():
    def call(data: bytes):
        if data.endswith(b"3"):
            raise RuntimeError("no answer")
        one = {"width": 0.4, "height": 0.4, "type": "face", "text": None, "confidence": 0.5}
        return [one | {"x": 0.1, "y": 0.1}, one | {"x": 0.6, "y": 0.6}]

    return call


@query("SELECT page_id, 'ocr_has' AS source, 'PERSON' AS type FROM pages UNION ALL SELECT page_id, 'has_image', 'face' FROM pages WHERE page_id % 10 <> 3")
def dual_pipeline_boxes(spark, d):
    """Two detectors, of which one fails on some pages; what both see is kept once."""
    rows = pages(spark, d).select("page_id", F.encode(F.col("page_id").cast("string"), "UTF-8").alias("content"))
    return O.dual_pipeline(rows, _text_boxes, _image_boxes, page=["page_id"], attempts=1)[0].select("page_id", "source", "type")


@query("SELECT page_id, page_id % 10 = 3 AS image_failed, false AS text_failed FROM pages")
def dual_pipeline_failures(spark, d):
    rows = pages(spark, d).select("page_id", F.encode(F.col("page_id").cast("string"), "UTF-8").alias("content"))
    return O.dual_pipeline(rows, _text_boxes, _image_boxes, page=["page_id"], attempts=2, base=0.0)[1].select("page_id", F.col("has_image_failed").alias("image_failed"), F.col("ocr_has_failed").alias("text_failed"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'spotting' WHEN page_id % 3 = 1 THEN 'seal' ELSE 'text' END AS label, CASE WHEN page_id % 3 = 0 THEN 's' WHEN page_id % 3 = 1 THEN '[公章]' ELSE 'c' END AS text, CASE WHEN page_id % 3 = 0 THEN 0.05 ELSE 0.2 END::DOUBLE AS x, CASE WHEN page_id % 3 = 0 THEN 0.1 ELSE 0.3 END::DOUBLE AS width FROM pages")
def reader_answers(spark, d):
    """Layout boxes in pixels or fractions; without usable ones the spotted texts."""
    k = F.col("page_id") % 3
    box = F.when(k == 1, F.array(F.lit(100.0), F.lit(50.0), F.lit(40.0), F.lit(90.0))).otherwise(F.array(F.lit(0.2), F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    layout = F.array(F.struct(F.when(k == 1, "seal").otherwise("text").alias("label"), F.when(k == 2, "c").alias("content"), box.alias("box")))
    poly = F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((10.0, 20.0), (30.0, 20.0), (30.0, 60.0), (10.0, 60.0))])
    spotting = F.array(F.struct(F.lit(" s ").alias("text"), poly.alias("polygon")), F.struct(F.lit("flat").alias("text"), F.slice(poly, 1, 1).alias("polygon")))
    rows = pages(spark, d).select("page_id", F.inline(O.page_boxes(layout, spotting, F.lit(200), F.lit(100))))
    return rows.select("page_id", "label", "text", F.round("x", 9).alias("x"), F.round("width", 9).alias("width"))


# Reports and lists.


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 > 0 THEN 7 WHEN doc_id % 5 > 0 THEN doc_id % 5 + 1 ELSE 3 END::BIGINT AS n FROM documents")
def entity_counts(spark, d):
    k = F.col("doc_id")
    spans = F.when(k % 5 > 0, k % 5)
    made = R.entity_count(k % 2 == 0, F.when(k % 3 > 0, F.lit(7)), spans, F.when(k % 5 > 0, F.lit(1)), F.lit(3))
    return docs(spark, d).select("doc_id", made.cast("long").alias("n"))


@query("SELECT count(*) AS files, sum(n_chars)::BIGINT AS bytes FROM documents")
def folder_totals(spark, d):
    return R.folder_size(spark.read.parquet(f"{d}/documents.parquet").select(F.col("n_chars").alias("length")))


BUCKETS_SQL = ", ".join(f"{{'name': '{name}', 'n': count(*) FILTER (status IN ({', '.join(repr(s) for s in states)}))}}" for name, states in R.BUCKETS)


@query(f"WITH {ITEMS_SQL}, b AS (SELECT job_id, [{BUCKETS_SQL}] AS b FROM items GROUP BY job_id) SELECT job_id, array_to_string(list_transform(list_filter(b, lambda x: x.n > 0)[:3], lambda x: x.name || ' ' || x.n), ', ') AS headline FROM b")
def progress_headlines(spark, d):
    return R.progress_line(R.job_progress(items(spark, d))).select("job_id", "headline")


@query("""WITH s AS (SELECT doc_id, n_chars * n_chars * 3 AS size FROM documents), t AS (SELECT *, (size * 20 + 1024) // 2048 AS kb, (size * 20 + 1048576) // 2097152 AS mb FROM s)
SELECT doc_id, size, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN kb // 10 || '.' || kb % 10 || ' KB' ELSE mb // 10 || '.' || mb % 10 || ' MB' END AS label FROM t""")
def size_labels(spark, d):
    size = (F.col("n_chars") * F.col("n_chars") * 3).alias("size")
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", size).withColumn("label", R.size_label(F.col("size")))


def typed_jobs(spark, d):
    return jobs(spark, d).withColumns({"job_type": F.when(F.col("id") % 2 == 0, "text_batch").otherwise("image_batch"), "created_at": F.col("updated_at")})


@query(f"WITH {JOBS_SQL} SELECT id, (SELECT count(*) FROM jobs WHERE id % 2 = 0) AS total FROM jobs WHERE id % 2 = 0 ORDER BY updated_at DESC, id LIMIT 20 OFFSET 40")
def job_pages(spark, d):
    rows, total = H.job_list(typed_jobs(spark, d), "text_batch", 3, 20)
    return rows.select("id", F.lit(total).cast("long").alias("total"))


@query(f"WITH {ITEMS_SQL} SELECT id FROM items ORDER BY sort_order, updated_at, id LIMIT 50 OFFSET 100")
def item_pages(spark, d):
    return H.page(H.items_in_order(items(spark, d).withColumnRenamed("updated_at", "created_at")), 3, 50).select("id")


@query("WITH s AS (SELECT source, count(*) AS total, min(doc_id) % 90 - 10 AS asked, 1 + count(*) % 9 AS size FROM documents GROUP BY source) SELECT source, asked, greatest(1, least(asked, ceil(total / size)))::BIGINT AS page FROM s")
def page_clamps(spark, d):
    """Pages asked for of each source's list, before its first, in it and behind its last."""
    lists = spark.read.parquet(f"{d}/documents.parquet").groupBy("source").agg(F.count("*").alias("total"), (F.min("doc_id") % 90 - 10).alias("asked"))
    return lists.select("source", "asked", G.clamped_page(F.col("asked"), F.col("total"), 1 + F.col("total") % 9).alias("page"))


@query(f"WITH {HISTORY_SQL} SELECT file_id FROM h WHERE batch_group_id IS NOT NULL AND file_id % 5 < 2")
def history_filters(spark, d):
    rows = history(spark, d).withColumns({"upload_source": F.lit(None).cast("string"), "job_id": F.when(F.col("file_id") % 5 < 2, F.lit(1)).otherwise(F.lit(2))})
    listed = H.of_jobs(rows, spark.range(1, 2)).withColumn("job_id", F.lit(None).cast("int"))
    return H.of_source(listed, "batch").select("file_id")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-25 00:00:00' - INTERVAL 7 DAY")
def recent_rows(spark, d):
    return H.recent(events(spark, d), F.col("ts"), F.expr("TIMESTAMP_NTZ '2024-01-25 00:00:00'"), 7).select("event_id")


@query(f"WITH {ITEMS_SQL} SELECT id, CASE WHEN status = 'failed' THEN 'failed' WHEN status IN ('processing', 'redacting') THEN 'analyzing' WHEN status = 'awaiting_review' THEN 'awaiting_review' WHEN status = 'completed' THEN 'completed' ELSE 'pending' END AS shown FROM items")
def wizard_states(spark, d):
    return items(spark, d).select("id", H.wizard_status(F.col("status")).alias("shown"))


# Catalogs.


@query("SELECT doc_id, id, name, has_pattern FROM documents JOIN (VALUES " + ", ".join(f"({k}, '{r['id']}', '{r['name']}', {str(r['regex_pattern'] is not None).lower()})" for k, r in enumerate(V.catalog())) + f") AS t(i, id, name, has_pattern) ON i = n_chars % {len(V.catalog())}")
def catalog_names(spark, d):
    """A type for each document, by its length, with its name in the catalog."""
    ids = F.array(*[F.lit(r["id"]) for r in V.catalog()])
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.element_at(ids, (F.col("n_chars") % len(V.catalog()) + 1).cast("int")).alias("id"))
    return rows.join(C.preset(spark).select("id", "name", F.col("regex_pattern").isNotNull().alias("has_pattern")), "id")


@query("SELECT doc_id, len(regexp_extract_all(text, '(?i)(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}', 0))::BIGINT AS n FROM (SELECT doc_id, text || ' 00:1A:2b:3c:4d:5e' AS text FROM documents)")
def catalog_patterns(spark, d):
    """The catalog's own pattern of a type that no built-in rule finds."""
    from spanforge.operators import detect as D

    rules = [r for r in C.rules_of(C.preset(spark)) if r.type == "MAC_ADDRESS"]
    rows = docs(spark, d).withColumn("text", F.concat("text", F.lit(" 00:1A:2b:3c:4d:5e")))
    return D.find_patterns(rows, rules).select("doc_id", F.size("spans").cast("long").alias("n"))


@query("""WITH s AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), on_ AS (SELECT lang, source AS id, n AS ord FROM s WHERE ((n % 2 = 0) <> (lang = 'fr' AND source = 'src2')) AND NOT (lang = 'es' AND source = 'src1') AND lang <> 'de' UNION ALL SELECT 'en', 'new', 5 UNION ALL SELECT 'old', 'x', 1)
SELECT lang AS mode, row_number() OVER (PARTITION BY lang ORDER BY ord, id = 'new', id) AS rank, id FROM on_""")
def pipeline_catalog(spark, d):
    """Languages as pipelines, their sources as types: stored types in place of a preset's, one added, one removed, one toggled; a
    pipeline that is no more dropped."""
    sources = spark.read.parquet(f"{d}/documents.parquet").groupBy("lang", "source").agg(F.count("*").cast("int").alias("n"))
    type_ = F.struct(F.col("source").alias("id"), F.col("source").alias("name"), F.col("n").alias("order"), (F.col("n") % 2 == 0).alias("enabled"))
    stored = sources.groupBy(F.col("lang").alias("mode")).agg(F.lit(True).alias("enabled"), F.array_sort(F.collect_list(type_)).alias("types"))
    preset = spark.createDataFrame([(m, True, [("x", "x", 1, True)]) for m in ("en", "fr", "old")], C.PIPELINES)
    merged = C.merged_pipelines(preset, stored, dropped="de")
    more = C.with_type(merged, "en", {"id": "new", "name": "n", "order": 5, "enabled": True})
    fewer = C.without_type(C.with_type_toggled(more, "fr", "src2"), "es", "src1", [])
    return C.pipeline_types(fewer).select("mode", F.col("rank").cast("long").alias("rank"), "id")


@query("SELECT mode, id, count(*) AS n FROM lineitem JOIN (VALUES " + ", ".join(f"({k}, '{s}')" for k, s in enumerate(V.IMAGE_CLASSES)) + f") AS c(k, slug) ON k = l_partkey % {len(V.IMAGE_CLASSES)} JOIN (VALUES " + ", ".join(f"('{m}', '{i}')" for m, ts in (("ocr_has", V.OCR_TYPES), ("has_image", V.IMAGE_TYPES)) for i, *_ in ts) + ") AS t(mode, id) ON id = slug GROUP BY mode, id")
def pipeline_types_counted(spark, d):
    """Boxes of each class that a pipeline reads."""
    classes = spark.read.parquet(f"{d}/lineitem.parquet").select(O.class_slug((F.col("l_partkey") % len(V.IMAGE_CLASSES)).cast("int")).alias("id"))
    return classes.groupBy("id").agg(F.count("*").alias("n")).join(C.pipeline_types(C.preset_pipelines(spark)).select("mode", "id"), "id")


@query("SELECT doc_id, array_to_string(list_filter(['PHONE', 'x' || doc_id % 3, 'EMAIL', 'x1'], lambda t: t IN ('EMAIL', 'PHONE', 'x1')), ',') AS ids FROM documents WHERE doc_id % 3 <> 1 UNION ALL SELECT doc_id, 'PHONE,x1,EMAIL' FROM documents WHERE doc_id % 3 = 1")
def presets_applied(spark, d):
    ids = F.array(F.lit("PHONE"), F.concat(F.lit("x"), (F.col("doc_id") % 3).cast("string")), F.lit("EMAIL"), F.lit("x1"))
    enabled = F.array(F.lit("EMAIL"), F.lit("PHONE"), F.lit("x1"))
    return docs(spark, d).select("doc_id", F.array_join(C.applied_preset(ids, enabled), ",").alias("ids"))


@query("""WITH s AS (SELECT source AS id, count(*) AS n FROM documents GROUP BY source), m AS (SELECT id, n % 2 = 0 AS enabled FROM s WHERE n % 7 <> 0 OR id = 'src0')
SELECT 'src3' AS asked, (SELECT id FROM m ORDER BY id <> 'src3', NOT enabled, id LIMIT 1) AS id UNION ALL SELECT 'gone', (SELECT id FROM m ORDER BY NOT enabled, id LIMIT 1)""")
def models_active(spark, d):
    """Sources as models: the one pointed to, else the first enabled; stored ones without a name go, the built-in one stays."""
    counts = spark.read.parquet(f"{d}/documents.parquet").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n"))
    every = counts.select("id", F.when(F.col("n") % 7 == 0, " ").otherwise(F.upper("id")).alias("name"), (F.col("n") % 2 == 0).alias("enabled"))
    models = C.merged_models(every.where("id = 'src0'"), every)
    own = lambda asked: C.active_model(models, asked).select(F.lit(asked).alias("asked"), "id")
    return own("src3").unionByName(own("gone"))


# Workflow.


@query(f"WITH {ITEMS_SQL} SELECT id, CASE WHEN file_id % 2 = 0 AND status = 'awaiting_review' THEN 'review_approved' ELSE status END AS status, file_id % 2 = 0 AND status NOT IN ('awaiting_review', 'review_approved', 'completed') AS refused FROM items")
def reviews_approved(spark, d):
    own = items(spark, d)
    return J.approved(own, own.where("file_id % 2 = 0")).select("id", "status", "refused")


@query(f"WITH {ITEMS_SQL} SELECT id, CASE WHEN file_id % 2 = 0 AND status = 'awaiting_review' THEN 'queued' ELSE status END AS status, file_id % 2 = 0 AND status <> 'awaiting_review' AS refused FROM items")
def reviews_rejected(spark, d):
    own = items(spark, d)
    return J.rejected(own, own.where("file_id % 2 = 0")).select("id", "status", "refused")


@query(f"WITH {ITEMS_SQL} SELECT id, CASE WHEN file_id % 3 = 0 AND status IN ('awaiting_review', 'processing') THEN CASE WHEN file_id % 2 = 0 THEN 'completed' ELSE 'awaiting_review' END ELSE status END AS status, CASE WHEN status = 'failed' THEN 'refused' WHEN status = 'completed' THEN 'done' ELSE 'redact' END AS way FROM items")
def reviews_committed(spark, d):
    own = items(spark, d)
    results = own.where("file_id % 3 = 0").select("id", (F.col("file_id") % 2 == 0).alias("ok"))
    return J.committed(own, results).join(own.select("id", J.committable(F.col("status")).alias("way")), "id").select("id", "status", "way")


@query("SELECT user_id AS item_id, max_by(props, event_id) AS draft_json FROM events GROUP BY user_id HAVING max_by(event_type, event_id) <> 'error'")
def drafts_latest(spark, d):
    rows = events(spark, d).select(F.col("user_id").alias("item_id"), F.when(F.col("event_type") == "error", "").otherwise(F.col("props")).alias("draft_json"), F.col("event_id").alias("updated_at"))
    return J.latest_drafts(rows)


@query(f"WITH {ITEMS_SQL} SELECT DISTINCT id AS item_id FROM items")
def tasks_once(spark, d):
    own = items(spark, d).select(F.col("id").alias("item_id"))
    return J.unique_tasks(own.unionByName(own))


@query(f"WITH {ITEMS_SQL}, {FILES_SQL} SELECT id, CASE WHEN has_output THEN 'vision' WHEN file_id % 3 = 1 THEN 'vision' ELSE 'text' END AS route FROM items JOIN files USING (file_id) WHERE status NOT IN ('completed', 'failed', 'cancelled')")
def recognition_routes(spark, d):
    known = files(spark, d).select("file_id", F.when(F.col("has_output"), "image").otherwise("txt").alias("file_type"), (F.col("file_id") % 3 == 1).alias("is_scanned"))
    return J.recognition_plan(items(spark, d), known).select("id", "route")


@query(f"WITH {ITEMS_SQL}, {FILES_SQL} SELECT id FROM items WHERE file_id NOT IN (SELECT file_id FROM files WHERE has_output)")
def tasks_left(spark, d):
    return J.without_output(items(spark, d), files(spark, d).where("has_output")).select("id")


@query("""WITH a AS (SELECT user_id AS item_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt, event_type = 'purchase' AS ok, props AS error FROM events), m AS (SELECT * FROM a WHERE attempt <= 3)
SELECT item_id, CASE WHEN bool_or(ok) THEN 'done' WHEN max(attempt) = 3 THEN 'failed' ELSE 'open' END AS outcome, coalesce(min(attempt) FILTER (ok), max(attempt))::BIGINT AS attempts, (2 ** (coalesce(min(attempt) FILTER (ok), max(attempt)) - 1) - 1)::BIGINT AS waited,
CASE WHEN NOT bool_or(ok) AND max(attempt) = 3 THEN left(max_by(error, attempt), 500) END AS error FROM m GROUP BY item_id""")
def attempts_ended(spark, d):
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return J.after_attempts(events(spark, d).select(F.col("user_id").alias("item_id"), number.alias("attempt"), (F.col("event_type") == "purchase").alias("ok"), F.col("props").alias("error")))


@query("SELECT event_id, least(0.5 * 2 ** (event_id % 8), 10)::DOUBLE AS wait FROM events")
def retry_waits(spark, d):
    return events(spark, d).select("event_id", X.capped_backoff(0.5, F.col("event_id") % 8).alias("wait"))
