"""Queries over boxes derived from ``lineitem``, and tables in text blocks.  SQL beside each."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.functions import boxes as B
from spanforge.functions import text as X
from spanforge.functions import values as V
from spanforge.operators import boxes as O
from spanforge.operators import detect as D
from spanforge.operators import spatial

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


BOXES_SQL = """boxes AS (SELECT l_orderkey AS doc, l_linenumber::BIGINT AS page, l_partkey AS part, l_suppkey AS supp, (l_extendedprice * 100)::BIGINT AS cents,
(l_partkey % 80) / 100.0::DOUBLE AS x, (l_suppkey % 80) / 100.0::DOUBLE AS y, 0.05::DOUBLE + (l_quantity % 10) / 100.0::DOUBLE AS width, 0.05::DOUBLE + (l_quantity % 10) / 100.0::DOUBLE AS height,
CASE WHEN l_partkey % 2 = 0 THEN 'ocr_has' ELSE 'has_image' END AS source FROM lineitem)"""
IOU_SQL = """CASE WHEN least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x) <= 0 OR least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y) <= 0 THEN 0.0::DOUBLE
ELSE ((least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x)) * (least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y))) / (a.width * a.height + b.width * b.height - ((least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x)) * (least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y)))) END"""


def boxes(spark, d):
    size = (F.lit(0.05) + (F.col("l_quantity") % 10) / 100.0).alias
    return spark.read.parquet(f"{d}/lineitem.parquet").select(
        F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("long").alias("page"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
        ((F.col("l_partkey") % 80) / 100.0).alias("x"), ((F.col("l_suppkey") % 80) / 100.0).alias("y"), size("width"), size("height"), F.when(F.col("l_partkey") % 2 == 0, "ocr_has").otherwise("has_image").alias("source"),
    )


@query(f"WITH {BOXES_SQL} SELECT a.doc, a.page, a.part AS part_a, b.part AS part_b, round({IOU_SQL}, 6) AS iou FROM boxes a JOIN boxes b ON a.doc = b.doc AND a.page = b.page AND a.part < b.part WHERE {IOU_SQL} > 0.1")
def iou_pairs(spark, d):
    own = boxes(spark, d).select("doc", "page", "part", *B.SIDES)
    pairs = spatial.meeting(own, own, page=["doc", "page"], least=0.1).where("a.part < b.part")
    return pairs.select("a.doc", "a.page", F.col("a.part").alias("part_a"), F.col("b.part").alias("part_b"), F.round("iou", 6).alias("iou"))


@query(f"WITH {BOXES_SQL} SELECT doc, page, part, supp, cents, source FROM boxes a WHERE source = 'ocr_has' OR NOT EXISTS (SELECT 1 FROM boxes b WHERE b.source = 'ocr_has' AND a.doc = b.doc AND a.page = b.page AND {IOU_SQL} > 0.3)")
def dual_dedup_image_vs_ocr(spark, d):
    return O.dual_dedup(boxes(spark, d), page=["doc", "page"]).select("doc", "page", "part", "supp", "cents", "source")


#: A walk over a page's boxes: ``seen`` are those kept so far, ``one`` is the next in a list of its own.
WALK_SQL = f"list_reduce(boxes_, lambda seen, one: CASE WHEN len(list_filter(seen, lambda a: list_max(list_transform(one, lambda b: {IOU_SQL})) >= 0.5)) > 0 THEN seen ELSE list_concat(seen, one) END)"


@query(f"""WITH {BOXES_SQL}, pages AS (SELECT doc, page, list([{{'x': x, 'y': y, 'width': width, 'height': height}}] ORDER BY part NULLS FIRST, supp NULLS FIRST, cents NULLS FIRST, x NULLS FIRST, y NULLS FIRST, width NULLS FIRST, height NULLS FIRST) AS boxes_ FROM boxes GROUP BY doc, page)
SELECT doc, page, len({WALK_SQL})::BIGINT AS kept FROM pages""")
def merge_sequential(spark, d):
    """A page's boxes in the order of their names and sides: each that overlaps none *kept* before by half or more stays."""
    row = F.struct("part", "supp", "cents", "x", "y", "width", "height")
    pages = boxes(spark, d).groupBy("doc", "page").agg(F.array_sort(F.collect_list(row)).alias("all"))
    merged = O.merge_in_order(F.slice("all", 1, 1), F.slice("all", F.lit(2), F.size("all")))
    return pages.select("doc", "page", F.size(merged).cast("long").alias("kept"))


@query(f"""WITH {BOXES_SQL}, p AS (SELECT *, greatest(0, least(trunc(x * 1000)::INT, 999)) AS left_, greatest(0, least(trunc(y * 800)::INT, 799)) AS top_ FROM boxes)
SELECT doc, page, part, supp, cents, left_::BIGINT AS left_px, top_::BIGINT AS top_px, greatest(1, least(trunc(width * 1000)::INT, 1000 - left_))::BIGINT AS width_px, greatest(1, least(trunc(height * 800)::INT, 800 - top_))::BIGINT AS height_px FROM p""")
def pixel_boxes(spark, d):
    out = boxes(spark, d)
    made = B.to_pixels({s: F.col(s) for s in B.SIDES}, F.lit(1000), F.lit(800))
    return out.select("doc", "page", "part", "supp", "cents", *[made[k].cast("long").alias(f"{k}_px") for k in ("left", "top", "width", "height")])


@query(f"WITH {BOXES_SQL} SELECT doc, part, supp, cents, page, round(least(greatest(x - 0.02, 0), 1 - width), 9) AS x, round(greatest(width - 0.3, 0.01), 9) AS width FROM boxes")
def clamp_box(spark, d):
    made = B.clamped({"x": F.col("x") - 0.02, "y": F.col("y"), "width": F.col("width"), "height": F.col("height")})
    thin = B.clamped({"x": F.col("x"), "y": F.col("y"), "width": F.col("width") - 0.3, "height": F.col("height")})
    ref = {"x": made["x"], "width": thin["width"]}
    return boxes(spark, d).select("doc", "part", "supp", "cents", "page", *[F.round(v, 9).alias(k) for k, v in ref.items()])


@query(f"WITH {BOXES_SQL} SELECT doc, page, part, supp, cents, round(greatest(0, least(x + 0.5, x + width - 0.01)), 9) AS x, round(x + width - greatest(0, least(x + 0.5, x + width - 0.01)), 9) AS width, round(least(1, greatest(y + height - 0.5, y + 0.01)) - y, 9) AS height FROM boxes")
def resize_box(spark, d):
    made = B.resized({s: F.col(s) for s in B.SIDES}, "sw", F.lit(0.5), F.lit(-0.5))
    return boxes(spark, d).select("doc", "page", "part", "supp", "cents", *[F.round(made[k], 9).alias(k) for k in ("x", "width", "height")])


@query(f"WITH {BOXES_SQL} SELECT doc, count(DISTINCT page) AS pages, count(*) AS boxes FROM boxes GROUP BY doc")
def boxes_by_page(spark, d):
    grouped = O.by_page(boxes(spark, d), "doc")
    back = O.from_pages(grouped, "doc").groupBy("doc").agg(F.count("*").alias("boxes"))
    return grouped.select("doc", F.size("boxes").cast("long").alias("pages")).join(back, "doc")


@query("SELECT doc_id, CASE WHEN length(text) > 0 AND 5.0 / length(text) <= 0.8 THEN trunc(100 + 2.0 / length(text) * 900)::BIGINT ELSE 100 END AS left_px, CASE WHEN length(text) > 0 AND 5.0 / length(text) <= 0.8 THEN greatest(trunc(5.0 / length(text) * 900), 20)::BIGINT ELSE 900 END AS width_px FROM documents")
def sub_box(spark, d):
    made = B.sub_box(F.lit(100), F.lit(900), F.col("text"), F.lit(2.0), F.lit(5.0))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", made["left"].cast("long").alias("left_px"), made["width"].cast("long").alias("width_px"))


@query(f"SELECT slug, count(*) AS n FROM lineitem JOIN (VALUES {', '.join(f"({k}, '{s}')" for k, s in enumerate([*V.IMAGE_CLASSES, 'class_21', 'class_22']))}) AS t(k, slug) ON k = l_partkey % {len(V.IMAGE_CLASSES) + 2} GROUP BY slug")
def class_slugs(spark, d):
    slug = O.class_slug((F.col("l_partkey") % (len(V.IMAGE_CLASSES) + 2)).cast("int")).alias("slug")
    return spark.read.parquet(f"{d}/lineitem.parquet").select(slug).groupBy("slug").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS doc, count(*) AS n FROM lineitem WHERE l_partkey % 21 IN (0, 12) GROUP BY l_orderkey")
def class_filter(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("doc"), (F.col("l_partkey") % 21).cast("int").alias("class_id"))
    return O.of_classes(rows, ["face", "official_seal", "no such"]).groupBy("doc").agg(F.count("*").alias("n"))


@query("SELECT l_quantity::BIGINT AS strength, count(*) AS n, max(greatest(2, trunc(2 + l_quantity / 100 * 25)))::BIGINT AS block, max(greatest(1, trunc(1 + l_quantity / 100 * 24)))::BIGINT AS radius FROM lineitem GROUP BY l_quantity")
def effect_sizes(spark, d):
    made = B.effect_size(F.col("l_quantity"), F.lit(300), F.lit(200))
    return spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_quantity").agg(F.count("*").alias("n"), F.max(made["block"]).cast("long").alias("block"), F.max(made["radius"]).cast("long").alias("radius")).select(F.col("l_quantity").cast("long").alias("strength"), "n", "block", "radius")


@query("SELECT doc_id, text, x AS left_px, y AS top_px, w AS width_px FROM (SELECT doc_id, unnest([{'text': 'n', 'x': 0, 'y': 0, 'w': 100}, {'text': 'v & w', 'x': 100, 'y': 0, 'w': 200}, {'text': doc_id::VARCHAR, 'x': 0, 'y': 50, 'w': 100}, {'text': 'b', 'x': 200, 'y': 50, 'w': 100}], recursive := true) FROM documents)")
def table_cells(spark, d):
    html = F.concat(F.lit("<table><tr><th>n</th><th colspan=2>v &amp; w</th></tr><tr><td>"), F.col("doc_id").cast("string"), F.lit("</td><td> </td><td>b</td></tr></table>"))
    blocks = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", html.alias("text"), F.lit(0).alias("left"), F.lit(0).alias("top"), F.lit(300).alias("width"), F.lit(100).alias("height"), F.lit(1.0).alias("confidence"))
    return O.expand_tables(blocks).select("doc_id", "text", *[F.col(k).cast("long").alias(f"{k}_px") for k in ("left", "top", "width")])


ORACLE_SQL["table_cells"] = "SELECT doc_id, unnest(['n', 'v & w', doc_id::VARCHAR, 'b']) AS text, unnest([0, 100, 0, 200])::BIGINT AS left_px, unnest([0, 0, 50, 50])::BIGINT AS top_px, unnest([100, 200, 100, 100])::BIGINT AS width_px FROM documents"


@query("SELECT doc_id, text AS block_text FROM documents WHERE contains(text, 'the')")
def match_blocks(spark, d):
    """Each document's whole text is a block."""
    blocks = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").withColumns({"pos": F.lit(0)} | {c: F.lit(100) for c in ("left", "top", "width", "height")})
    found_in = O.match_blocks(blocks.select("doc_id", F.lit(1).alias("entity_id"), F.lit("the").alias("text")), blocks, page=["doc_id"])
    return found_in.join(blocks.select("doc_id", F.col("text").alias("block_text")), "doc_id").select("doc_id", "block_text")


QUERIES["match_blocks_whole"], ORACLE_SQL["match_blocks_whole"] = QUERIES["match_blocks"], ORACLE_SQL["match_blocks"]


@query("SELECT doc_id, m AS card FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[3-6]\\d{15,18}', 0)) AS m FROM documents)")
def ocr_rule_boxes(spark, d):
    blocks = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", F.lit(0).alias("left"), F.lit(0).alias("top"), F.lit(1000).alias("width"), F.lit(20).alias("height"))
    return O.rule_boxes(blocks, ["BANK_CARD"]).select("doc_id", F.col("match").alias("card"))


@query("SELECT l_orderkey AS doc, l_linenumber::BIGINT AS page, l_partkey AS part, l_suppkey AS supp, CASE WHEN l_quantity > 25 THEN false ELSE true END AS fractions FROM lineitem")
def raw_boxes(spark, d):
    """Boxes of a reader that gives pixels for some blocks and fractions for others, all in the unit square."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    scale = F.when(F.col("l_quantity") > 25, 1000.0).otherwise(1.0)
    made = B.from_raw(0.9 * scale, 0.8 * scale, 0.1 * scale, 0.2 * scale, F.lit(1000), F.lit(1000))
    inside = (F.round(made["x"], 6) == 0.1) & (F.round(made["width"], 6) == 0.8) & (F.round(made["height"], 6) == 0.6)
    return rows.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("long").alias("page"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), ((scale == 1.0) & inside).alias("fractions"))


@query("SELECT conv_id, count(*) AS n FROM conversations WHERE text LIKE '%the%' GROUP BY conv_id")
def overlap_probe(spark, d):
    """Turns in which a selection of the first ``the`` meets a span."""
    turns = D.find_terms(spark.read.parquet(f"{d}/conversations.parquet"), {"X": ["the"]})
    start = F.instr("text", "the") - 1
    return turns.where(D.overlapping(F.col("spans"), start, start + 2)).groupBy("conv_id").agg(F.count("*").alias("n"))


@query("SELECT doc_id, conv AS red, green, blue FROM (SELECT doc_id, 255::BIGINT AS conv, 128::BIGINT AS green, (doc_id % 16)::BIGINT AS blue FROM documents)")
def hex_colors(spark, d):
    color = F.concat(F.lit("#ff800"), F.lower(F.hex(F.col("doc_id") % 16)))
    rgb = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", X.hex_rgb(color).alias("c"))
    return rgb.select("doc_id", *[F.get("c", F.lit(k)).cast("long").alias(n) for k, n in enumerate(("red", "green", "blue"))])
