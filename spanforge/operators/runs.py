"""Replacement in texts that are cut into runs, such as the formatted pieces of a Word paragraph.

A paragraph is matched as one text; a match's value goes to the run that holds most of it (of equals the first), and the other
runs lose their part.  Runs are rows with their place in the paragraph, and matches meet them by blocks of ``BLOCK`` characters, so
a paragraph of many runs and many matches isn't compared in pairs.  Only the numbering of a paragraph's runs and its text are
one task's, as they are one row of the dictionary's input.

Null texts of runs count as empty; runs without a match stay as they are; runs of one paragraph have different numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions import text as X
from spanforge.operators import dictionary as L

BLOCK = 64


def _blocks(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(F.floor(start / BLOCK), F.floor((F.greatest(end, start + 1) - 1) / BLOCK))).alias("_b")


def rewrite_runs(runs: DataFrame, mapping: DataFrame, *, paragraph: list[str], run_col: str = "run", text_col: str = "text", out_col: str = "redacted_text", count_col: str = "redacted_count") -> DataFrame:
    """``runs`` with their new text, and how many matches each one took."""
    order = Window.partitionBy(*paragraph).orderBy(run_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    before = F.coalesce(F.sum(F.length(text)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = runs.withColumn("_start", before.cast("int")).withColumn("_end", (F.col("_start") + F.length(text)).cast("int"))
    whole = runs.groupBy(*paragraph).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(run_col).alias("n"), text.alias("t")))), lambda r: r["t"]), "").alias("_text"))
    whole = whole.withColumn("_id", F.struct(*paragraph))
    found = L.hits(whole, mapping.withColumn("_type", F.lit("")), id_col="_id", type_col="_type", value_col="value", text_col="_text", out_col="_hits", mode=L.APART)
    # A term goes on behind each of its own matches before terms are held against each other.
    hits = found.select(*paragraph, F.explode(L.taken(F.col("_hits"))).alias("_h")).select(*paragraph, F.col("_h.start").alias("_from"), F.col("_h.end").alias("_to"), F.coalesce("_h.value", F.lit("")).alias("_value"))
    sides = placed.where(F.col("_end") > F.col("_start")).select(*paragraph, F.col(run_col).alias("_run"), "_start", "_end", _blocks(F.col("_start"), F.col("_end")))
    pairs = sides.join(hits.select(*paragraph, "_from", "_to", "_value", _blocks(F.col("_from"), F.col("_to"))), [*paragraph, "_b"])
    a, b = F.greatest("_start", "_from"), F.least("_end", "_to")
    pairs = pairs.where((b > a) & (F.floor(a / BLOCK) == F.col("_b"))).select(*paragraph, "_run", "_from", "_value", (a - F.col("_start")).alias("start"), (b - F.col("_start")).alias("end"))
    most = Window.partitionBy(*paragraph, "_from").orderBy(F.desc(F.col("end") - F.col("start")), "_run")
    owned = pairs.withColumn("_own", F.row_number().over(most) == 1)
    edits = owned.groupBy(*paragraph, F.col("_run").alias(run_col)).agg(F.array_sort(F.collect_list(F.struct("start", "end", F.when(F.col("_own"), F.col("_value")).otherwise("").alias("value"), "_own"))).alias("_edits"))
    named = edits.withColumnsRenamed({c: f"_of_{c}" for c in (*paragraph, run_col)})
    rows = runs.join(named, [runs[c].eqNullSafe(named[f"_of_{c}"]) for c in (*paragraph, run_col)], "left")
    new = F.when(F.col("_edits").isNull(), F.col(text_col)).otherwise(X.put(text, F.col("_edits"), lambda e: e["value"]))
    taken = F.coalesce(F.size(F.filter("_edits", lambda e: e["_own"])), F.lit(0))
    return rows.withColumns({out_col: new, count_col: F.when(F.col("_edits").isNull(), 0).otherwise(taken).cast("long")}).select(*runs.columns, out_col, count_col)
