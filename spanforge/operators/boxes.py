"""Boxes on page images: merging detectors' results, tables in text blocks, matching texts to blocks."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.functions import boxes as B
from spanforge.functions import text as X
from spanforge.functions import values as V
from spanforge.operators import paging, spatial
from spanforge.operators.detect import OCR_RULES
from spanforge.operators.plug import call_with
from spanforge.sources import shared

MERGE_IOU, DUAL_IOU = 0.5, 0.3


def merge_in_order(first: Column, second: Column, threshold: float = MERGE_IOU) -> Column:
    """Boxes of ``first``, then those of ``second`` that overlap none kept before by ``threshold`` or more."""
    return F.aggregate(second, first, lambda kept, b: F.when(F.exists(kept, lambda k: B.iou(k, b) >= threshold), kept).otherwise(F.concat(kept, F.array(b))))


def dual_dedup(df: DataFrame, *, page: list[str], source_col: str = "source", text_source: str = "ocr_has", image_source: str = "has_image", threshold: float = DUAL_IOU) -> DataFrame:
    """Drops boxes of the image detector that overlap one of the text detector on their page by more than ``threshold``; boxes
    of other sources are kept unless they overlap a kept one or an earlier one of theirs.

    The image side is held against the text side by the tiles or cells of a page (``spatial``), so a crowded page is no one task's.
    Boxes of other sources are folded in order on pages with few boxes, and walked by tiles (``spatial.first_kept``) on crowded ones;
    there a box with a missing side meets nothing.
    """
    text = df.where(F.col(source_col) == text_source)
    image = df.where(F.col(source_col) == image_source)
    kept = text.unionByName(spatial.without_meeting(image, text, page=page, least=threshold))
    other = df.where(~F.col(source_col).isin(text_source, image_source) | F.col(source_col).isNull())
    if not spatial.few_on_a_page(df, page):
        if other.isEmpty():
            return kept
        kept = shared.written(kept, shared.fresh_path(df.sparkSession, "kept"))
        free = spatial.without_meeting(other, kept, page=page, least=threshold)
        placed = paging.ranked(free, "x", F.struct(*[c for c in df.columns if c not in page])).numbered("_rank")
        return kept.unionByName(spatial.first_kept(placed, page=page, order=["_rank"], least=threshold, inclusive=False).drop("_rank"))
    columns = [c for c in df.columns if c not in page]
    row = F.struct(*columns)
    base = kept.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("x", "y", "width", "height"))).alias("_kept"))
    more = other.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct(F.col("x").alias("_x"), row.alias("_row")))).alias("_more"))
    shape = more.schema["_more"].dataType.elementType["_row"].dataType
    joined = more.join(base, page, "left")
    zero = F.struct(F.coalesce("_kept", F.array().cast("array<struct<x:double,y:double,width:double,height:double>>")).alias("seen"), F.array().cast(T.ArrayType(shape)).alias("out"))

    def step(s: Column, m: Column) -> Column:
        b = m["_row"]
        side = F.struct(*[b[c].cast("double").alias(c) for c in B.SIDES])
        return F.when(F.exists(s["seen"], lambda k: B.iou(k, b) > threshold), s).otherwise(F.struct(F.concat(s["seen"], F.array(side)).alias("seen"), F.concat(s["out"], F.array(b)).alias("out")))

    added = joined.select(*page, F.inline(F.aggregate("_more", zero, step, lambda s: s["out"])))
    return kept.unionByName(added)


def pixel_boxes(df: DataFrame, image_width: Column, image_height: Column) -> DataFrame:
    return df.withColumns(B.to_pixels({s: F.col(s) for s in B.SIDES}, image_width, image_height))


def is_seal(label: Column, text: Column) -> Column:
    return F.coalesce(F.lower(label) == "seal", F.lit(False)) | F.coalesce(F.contains(text, F.lit("[公章]")), F.lit(False))


def class_indices(slugs: list[str] | None) -> list[int] | None:
    """Numbers of the named classes; None asks for all, and an empty list for none."""
    return None if slugs is None else [V.IMAGE_CLASSES.index(s) for s in slugs if s in V.IMAGE_CLASSES]


def class_slug(index: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(s) for s in V.IMAGE_CLASSES]), index), F.concat(F.lit("class_"), index.cast("string")))


def of_classes(df: DataFrame, slugs: list[str] | None, class_col: str = "class_id") -> DataFrame:
    wanted = class_indices(slugs)
    return df if wanted is None else df.where(F.col(class_col).isin(wanted) if wanted else F.lit(False))


def by_page(df: DataFrame, *doc: str, page_col: str = "page") -> DataFrame:
    """A row per document: ``boxes`` as map of page (1 if missing) to its boxes in order."""
    row = F.struct(*[c for c in df.columns if c not in doc])
    pages = df.withColumn("_p", F.coalesce(page_col, F.lit(1))).groupBy(*doc, "_p").agg(F.array_sort(F.collect_list(row)).alias("_b"))
    return pages.groupBy(*doc).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_p", "_b")))).alias("boxes"))


def from_pages(df: DataFrame, *doc: str, boxes_col: str = "boxes") -> DataFrame:
    """Rows of boxes again; a box's own page wins over the map's key."""
    rows = df.select(*doc, F.explode(boxes_col).alias("_p", "_b")).select(*doc, "_p", F.inline("_b"))
    return rows.withColumn("page", F.coalesce("page", "_p")).drop("_p")


class _Table(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[tuple[str, int]]] = []
        self.text: list[str] | None = None
        self.span = 1

    def close_cell(self):
        if self.text is not None and self.rows:
            self.rows[-1].append(("".join(self.text).strip(), self.span))
        self.text = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.close_cell()
            self.rows.append([])
        elif tag in ("td", "th"):
            self.close_cell()
            if not self.rows:
                self.rows.append([])
            try:
                span = int(dict(attrs).get("colspan") or 1)
            except ValueError:
                span = 1
            self.text, self.span = [], max(1, span)

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self.close_cell()

    def handle_data(self, data):
        if self.text is not None:
            self.text.append(data)


def cells_of(html: str, left: int, top: int, width: int, height: int) -> list[tuple[str, int, int, int, int]]:
    """(text, left, top, width, height) of a table's filled cells on an even grid of steps of one pixel at least; no table gives
    nothing.  Sides are cut to whole pixels on their own, so neighbours touch."""
    parser = _Table()
    parser.feed(html or "")
    parser.close_cell()
    rows = [r for r in parser.rows if r]
    if not rows:
        return []
    wide, high = max(width / max(sum(n for _, n in r) for r in rows), 1.0), max(height / len(rows), 1.0)
    out = []
    for k, row in enumerate(rows):
        at = 0
        for text, n in row:
            if text:
                x, y = int(left + at * wide), int(top + k * high)
                out.append((text, x, y, int(left + at * wide + n * wide) - x, int(top + k * high + high) - y))
            at += n
    return out


def expand_tables(df: DataFrame, *, text_col: str = "text", confidence_col: str = "confidence") -> DataFrame:
    """Blocks of HTML tables as their cells (at 0.9 of the confidence); a table without cells as its text without tags."""
    is_table = F.coalesce(F.contains(F.lower(text_col), F.lit("<table")), F.lit(False))
    schema = T.StructType.fromJson(df.schema.jsonValue())
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                cells = cells_of(row[text_col], row["left"], row["top"], row["width"], row["height"])
                own = None if row[confidence_col] is None else row[confidence_col] * 0.9
                if cells:
                    out += [row | dict(zip((text_col, "left", "top", "width", "height"), c)) | {confidence_col: own} for c in cells]
                elif plain := " ".join(re.sub(r"<[^>]+>", " ", row[text_col]).split()):
                    out.append(row | {text_col: plain})
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], batch.schema.field(n).type) for n in names], names)

    return df.where(~is_table).unionByName(df.where(is_table).mapInArrow(run, schema))


def match_blocks(entities: DataFrame, blocks: DataFrame, *, page: list[str]) -> DataFrame:
    """The box of each entity (entity_id, text) in the first block (pos) of its page that contains its text."""
    block = blocks.select(*page, "pos", F.col("text").alias("_block"), "left", "top", "width", "height")
    pairs = entities.join(block, page).where(F.contains("_block", F.col("text")) & (F.length("text") > 0))
    first = pairs.groupBy(*page, "entity_id").agg(F.min_by(F.struct("text", "_block", "left", "top", "width", "height"), "pos").alias("b")).select(*page, "entity_id", "b.*")
    start, size, n = F.instr("_block", F.col("text")) - 1, F.length("text"), F.length("_block")
    parts = F.size(F.regexp_extract_all("_block", F.lit(r"[,;，；、|]"), F.lit(0)))
    whole = (n > 100) | (size / n < 0.1) | (parts >= 2) | F.col("_block").rlike(r"  |\t")
    part = B.sub_box(F.col("left"), F.col("width"), F.col("_block"), start, size)
    return first.withColumns({"left": F.when(whole, F.col("left")).otherwise(part["left"]), "width": F.when(whole, F.col("width")).otherwise(part["width"])}).drop("_block")


def similarity(a: Column, b: Column) -> Column:
    """Ratio of matching blocks of characters, by Arrow batches."""
    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, p or "", q or "").ratio() for p, q in zip(x, y)])

    return ratio(a, b)


def fuzzy_blocks(entities: DataFrame, blocks: DataFrame, *, page: list[str], least: float = 0.85) -> DataFrame:
    """The block of its page most like the entity's text, over ``least``; the first of equals, at confidence 0.9."""
    block = blocks.select(*page, "pos", F.col("text").alias("_block"), "left", "top", "width", "height")
    squeezed = lambda c: F.regexp_replace(c, r"(?U)\W+", "")
    pairs = entities.join(block, page).withColumn("_ratio", similarity(squeezed(F.col("text")), squeezed(F.col("_block")))).where(F.col("_ratio") > least)
    best = F.max_by(F.struct("text", "left", "top", "width", "height"), F.struct("_ratio", -F.col("pos")))
    return pairs.groupBy(*page, "entity_id").agg(best.alias("b")).select(*page, "entity_id", "b.*", F.lit(0.9).alias("confidence"))


def refine(boxes: DataFrame, refined: DataFrame, *, page: list[str], least_iou: float = 0.3) -> DataFrame:
    """Boxes moved to the refined box that overlaps them most, by ``least_iou`` or more."""
    near = spatial.meeting(boxes.select(*page, "box_id", *B.SIDES), refined.select(*page, *B.SIDES), page=page, least=least_iou, inclusive=True)
    named = near.select(*[F.col(f"a.{c}").alias(c) for c in (*page, "box_id")], "iou", *[F.col(f"b.{s}").alias(f"_{s}") for s in B.SIDES])
    best = named.groupBy(*page, "box_id").agg(F.max_by(F.struct(*[f"_{s}" for s in B.SIDES]), F.struct("iou", *[-F.col(f"_{s}") for s in B.SIDES])).alias("_b"))
    return boxes.join(best, [*page, "box_id"], "left").withColumns({s: F.coalesce(F.col(f"_b._{s}"), F.col(s)) for s in B.SIDES}).drop("_b")


def rule_boxes(blocks: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Boxes of pattern matches in text blocks."""
    rules = [r for r in OCR_RULES if types is None or r.type in types]
    of = lambda kind: lambda m: F.struct(F.lit(kind).alias("entity_type"), m["text"].alias("match"), m["start"].alias("start"))
    found = F.concat(*[F.transform(X.located(F.col("text"), r.java), of(r.type)) for r in rules])
    rows = blocks.withColumn("_m", F.explode(found))
    part = B.sub_box(F.col("left"), F.col("width"), F.col("text"), F.col("_m.start"), F.length("_m.match"))
    return rows.withColumns(part | {"entity_type": F.col("_m.entity_type"), "match": F.col("_m.match"), "source": F.lit("regex"), "confidence": F.lit(1.0)}).drop("_m")


def page_boxes(layout: Column, spotting: Column, image_width: Column, image_height: Column) -> Column:
    """Boxes of a page from a reader's two answers: ``layout`` (label, content, box of four numbers), else, if none of these is
    usable, ``spotting`` (text, polygon).  If no side exceeds 1.5 the page's numbers are fractions.  Seals read ``[公章]``."""
    raw = "array<struct<text:string,label:string,x1:double,y1:double,x2:double,y2:double>>"
    seal = lambda b: F.coalesce(b["label"] == "seal", F.lit(False))
    usable = F.filter(layout, lambda b: (F.size(b["box"]) == 4) & (seal(b) | F.coalesce(F.length(b["content"]) > 0, F.lit(False))))
    first = F.transform(usable, lambda b: F.struct(F.when(seal(b), "[公章]").otherwise(b["content"]).alias("text"), F.coalesce(b["label"], F.lit("")).alias("label"), *[b["box"][k].alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])).cast(raw)
    side = lambda b, k, f: f(F.transform(b["polygon"], lambda p: p[k]))
    spots = F.transform(F.filter(spotting, lambda b: F.size(b["polygon"]) > 0), lambda b: F.struct(X.strip(F.coalesce(b["text"], F.lit(""))).alias("text"), F.lit("spotting").alias("label"), side(b, 0, F.array_min).alias("x1"), side(b, 1, F.array_min).alias("y1"), side(b, 0, F.array_max).alias("x2"), side(b, 1, F.array_max).alias("y2"))).cast(raw)
    second = F.filter(spots, lambda b: (b["x2"] > b["x1"]) & (b["y2"] > b["y1"]))
    chosen = F.when(F.coalesce(F.size(first), F.lit(0)) > 0, first).otherwise(F.coalesce(second, F.array().cast(raw)))

    def placed(all_: Column) -> Column:
        fractions = F.array_max(F.transform(all_, lambda b: F.greatest(b["x2"], b["y2"]))) <= 1.5

        def one(b: Column) -> Column:
            inside = lambda v, n: F.least(F.greatest(F.when(fractions, v * n).otherwise(v), F.lit(0.0)), n.cast("double"))
            x1, x2 = inside(F.least(b["x1"], b["x2"]), image_width), inside(F.greatest(b["x1"], b["x2"]), image_width)
            y1, y2 = inside(F.least(b["y1"], b["y2"]), image_height), inside(F.greatest(b["y1"], b["y2"]), image_height)
            sizes = {"x": x1 / image_width, "y": y1 / image_height, "width": F.greatest(F.lit(1.0), x2 - x1) / image_width, "height": F.greatest(F.lit(1.0), y2 - y1) / image_height}
            return F.struct(b["text"].alias("text"), b["label"].alias("label"), *[v.alias(k) for k, v in sizes.items()], F.lit(0.9).alias("confidence"))

        return F.transform(all_, one)

    return X.let(chosen, placed)


BOX = "array<struct<x:double,y:double,width:double,height:double,type:string,text:string,confidence:double>>"


def detect_with(df: DataFrame, make, *, source: str, content_col: str = "content", attempts: int = 3, base: float = 0.5) -> DataFrame:
    """Adds ``{source}_boxes``, what a detector of image bytes says, and ``{source}_failed`` where all attempts failed."""
    return call_with(df, make, inputs=[content_col], out_col=f"{source}_boxes", kind=BOX, failed_col=f"{source}_failed", attempts=attempts, base=base)


def dual_pipeline(pages: DataFrame, text_detector=None, image_detector=None, *, page: list[str], content_col: str = "content", attempts: int = 3, base: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(boxes of both detectors with ``source``, deduplicated by page; pages with a flag for each detector that failed there).
    A detector that fails, or is none, leaves the other's boxes."""
    done = pages
    sources = {s: m for s, m in (("ocr_has", text_detector), ("has_image", image_detector)) if m is not None}
    for source, make in sources.items():
        done = detect_with(done, make, source=source, content_col=content_col, attempts=attempts, base=base)
    parts = [done.select(*page, F.inline(F.coalesce(f"{s}_boxes", F.array().cast(BOX))), F.lit(s).alias("source")) for s in sources]
    if not parts:
        return pages.select(*page, F.inline(F.array().cast(BOX)), F.lit("").alias("source")), pages
    boxes = parts[0] if len(parts) == 1 else dual_dedup(parts[0].unionByName(parts[1]), page=page)
    return boxes, done.drop(*[f"{s}_boxes" for s in sources])


def chosen_types(asked: list[str] | None, other: list[str] | None, enabled: list[str], defaults: list[str]) -> list[str]:
    """The types of one pipeline: as asked; all that are enabled if none of those asked is valid; the defaults if both
    pipelines were asked for nothing; none if only this one was."""
    if asked is None:
        return defaults
    if not asked:
        return defaults if other is not None and not other else []
    valid = [t for t in asked if t in enabled]
    return valid or enabled


def chosen_types_of(asked: Column, other: Column, enabled: list[str], defaults: list[str]) -> Column:
    """As ``chosen_types`` for each row's lists."""
    some = lambda names: F.array(*[F.lit(t) for t in names]).cast("array<string>")
    valid = F.filter(asked, lambda t: t.isin(enabled))
    both = F.coalesce(F.size(other) == 0, F.lit(False)) & other.isNotNull()
    return F.when(asked.isNull(), some(defaults)).when(F.size(asked) == 0, F.when(both, some(defaults)).otherwise(some([]))).when(F.size(valid) == 0, some(enabled)).otherwise(valid)
