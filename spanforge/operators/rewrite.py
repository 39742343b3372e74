"""Rewriting texts by a map, taking it back, and telling what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions import text as X


def rewrite(df: DataFrame, *, text_col: str = "text", map_col: str = "entity_map", out_col: str = "redacted_text", count_col: str = "redacted_count") -> DataFrame:
    """Replaces every occurrence of the map's keys, longest first, in one pass."""
    return df.withColumn("_r", X.rewritten(F.col(text_col), F.col(map_col))).withColumns({out_col: F.col("_r.text"), count_col: F.col("_r.count")}).drop("_r")


def rewrite_spans(df: DataFrame, *, text_col: str = "text", spans_col: str = "spans", out_col: str = "redacted_text") -> DataFrame:
    """Replaces the spans themselves (sorted, not overlapping, with ``replacement``) and leaves other occurrences alone."""
    return df.withColumn(out_col, X.put(F.col(text_col), F.col(spans_col), lambda s: s["replacement"]))


def restore(df: DataFrame, *, text_col: str = "redacted_text", map_col: str = "entity_map", out_col: str = "restored_text") -> DataFrame:
    """Takes a rewrite back; null where two keys share a value, as that can't be undone."""
    values = F.map_values(map_col)
    unique = F.size(F.array_distinct(values)) == F.size(values)
    back = F.map_from_arrays(F.array_distinct(values), F.slice(F.map_keys(map_col), F.lit(1), F.size(F.array_distinct(values))))
    return df.withColumn(out_col, F.when(unique, X.rewritten(F.col(text_col), back)["text"]))


def changes(df: DataFrame, *id_cols: str, text_col: str = "text", map_col: str = "entity_map") -> DataFrame:
    """A row per key of the map that occurs: original, replacement, count, in the map's order (``pos``)."""
    each = df.select(*id_cols, F.col(text_col).alias("_t"), F.posexplode(F.map_entries(map_col)).alias("pos", "e"))
    counted = each.select(*id_cols, "pos", F.col("e.key").alias("original"), F.col("e.value").alias("replacement"), X.occurrences(F.col("_t"), F.col("e.key")).alias("count"))
    return counted.where("count > 0")


def comparison(df: DataFrame, *, text_col: str = "text", out_col: str = "redacted_text", type_col: str = "file_type") -> DataFrame:
    """What a person compares: texts, or a note for files that have none."""
    note = F.concat(F.lit("["), F.col(type_col), F.lit("]"))
    return df.withColumns({"original": F.when(F.col(type_col) == "image", note).otherwise(F.coalesce(text_col, note)), "redacted": F.when(F.col(type_col) == "image", note).otherwise(F.coalesce(out_col, note))})


def segments(df: DataFrame, *id_cols: str, text_col: str = "text", map_col: str = "entity_map") -> DataFrame:
    """The text in order as pieces between and at keys; a key's pieces are numbered."""
    keys = F.map_keys(map_col)
    pattern = X.any_of(keys)
    some = F.exists(keys, lambda k: F.length(k) > 0)
    gaps = F.when(some, F.split(text_col, pattern, -1)).otherwise(F.array(text_col))
    found = F.when(some, F.regexp_extract_all(text_col, pattern, F.lit(0))).otherwise(F.array().cast("array<string>"))
    pair = lambda g, m: F.array(F.struct(g.alias("text"), F.lit(False).alias("is_match")), F.struct(m.alias("text"), F.lit(True).alias("is_match")))
    pieces = F.filter(F.flatten(F.zip_with(gaps, found, pair)), lambda p: F.coalesce(F.length(p["text"]) > 0, F.lit(False)))
    told = df.select(*id_cols, F.col(map_col).alias("_map"), F.posexplode(pieces).alias("pos", "p"))
    name = F.regexp_replace("p.text", r"[^0-9A-Za-z_一-鿿-]", "_")
    ordinal = F.when(F.col("p.is_match"), F.row_number().over(Window.partitionBy(*id_cols, "p").orderBy("pos")) - 1)
    return told.select(*id_cols, "pos", F.col("p.text").alias("text"), F.col("p.is_match").alias("is_match"), F.when(F.col("p.is_match"), F.element_at("_map", F.col("p.text"))).alias("replacement"), ordinal.alias("ordinal"), F.when(F.col("p.is_match"), name).alias("safe_key"))


def page_spans(df: DataFrame, page: int, *, spans_col: str = "spans", pages_col: str = "pages") -> DataFrame:
    """The spans of a page with offsets from its start."""
    before = F.aggregate(F.slice(pages_col, F.lit(1), F.lit(page - 1)), F.lit(0), lambda a, p: a + F.length(p) + 2)
    own = F.filter(spans_col, lambda s: s["page"] == page)
    return df.withColumn(spans_col, F.transform(own, lambda s: s.withField("start", s["start"] - before).withField("end", s["end"] - before)))


def majority_run(paragraph_runs: Column, start: Column, end: Column) -> Column:
    """The run (from 0) that holds most characters of [start, end); the first of equals."""
    ends = F.aggregate(paragraph_runs, F.array().cast("array<int>"), lambda out, r: F.concat(out, F.array(F.when(F.size(out) > 0, F.element_at(out, -1)).otherwise(0) + F.length(r))))
    shares = F.transform(F.zip_with(paragraph_runs, ends, lambda r, e: F.struct((e - F.length(r)).alias("a"), e.alias("b"))), lambda p: F.greatest(F.lit(0), F.least(p["b"], end) - F.greatest(p["a"], start)))
    return F.array_position(shares, F.array_max(shares)).cast("int") - 1


def route(file_type: Column, has_boxes: Column) -> Column:
    """Which writer a document goes to."""
    return F.when(file_type.isin("image", "pdf_scanned") | ((file_type == "pdf") & has_boxes), "raster").when(file_type == "docx", "docx").when(file_type == "pdf", "pdf").otherwise("text")
