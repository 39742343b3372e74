"""Counts and roll-ups of spans, boxes, jobs and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions import text as X
from spanforge.functions import values as V


def band(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.5, "medium").otherwise("low")


def distribution(rows: DataFrame, *doc: str, by: Column | str) -> DataFrame:
    return rows.groupBy(*doc, (F.col(by) if isinstance(by, str) else by).alias("value")).agg(F.count("*").alias("n"))


def quality_report(spans: DataFrame, files: DataFrame, *, doc: str, boxes: DataFrame | None = None) -> DataFrame:
    """A row per file (``doc``, redacted_count): distributions by type, source and confidence, totals and coverage in percent.

    Spans and boxes are counted in one pass each; coverage divides what was replaced by what was found and may exceed 100.
    """
    fields = [F.col(doc), F.col("type"), F.col("source"), band(F.col("confidence")).alias("band"), F.coalesce(F.col("selected"), F.lit(True)).alias("selected") if "selected" in spans.columns else F.lit(True).alias("selected")]
    rows = spans.select(*fields)
    if boxes is not None:
        rows = rows.unionByName(boxes.select(F.col(doc), F.col("type"), F.col("source"), F.lit("high").alias("band"), F.coalesce(F.col("selected"), F.lit(True)).alias("selected")))
    # Pre-aggregated to the few distinct values of a document before maps are built.
    counts = rows.groupBy(doc, "type", "source", "band", "selected").agg(F.count("*").alias("n"))
    merged = lambda c: F.aggregate(F.collect_list(F.struct(F.col(c).alias("k"), "n")), F.create_map().cast("map<string,bigint>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["k"]), F.map_from_entries(F.array(F.struct(e["k"].alias("key"), (e["n"] + F.coalesce(F.element_at(m, e["k"]), F.lit(0).cast("long"))).alias("value"))))))
    per = counts.groupBy(doc).agg(merged("type").alias("by_type"), merged("source").alias("by_source"), merged("band").alias("by_confidence"), F.sum("n").alias("total"), F.sum(F.when(F.col("selected"), F.col("n")).otherwise(0)).alias("selected_total"))
    joined = files.join(per, doc, "left").withColumns({"total": F.coalesce("total", F.lit(0)), "selected_total": F.coalesce("selected_total", F.lit(0))})
    coverage = F.when(F.col("total") > 0, F.col("redacted_count") / F.col("total") * 100).otherwise(0.0)
    return joined.withColumns({"coverage": coverage, "coverage_rate": X.round1(coverage)})


def quality_of_rows(df: DataFrame, *, redacted_col: str = "redacted_count", spans_col: str = "spans") -> DataFrame:
    """As ``quality_report`` where spans lie on their file's row: one projection, nothing is shuffled.  There are few types, sources
    and bands, so each is counted by a filter."""

    def shares(values: Column) -> Column:
        return X.let(values, lambda all_: F.map_from_entries(F.transform(F.array_distinct(all_), lambda v: F.struct(v.alias("key"), F.size(F.filter(all_, lambda x: x.eqNullSafe(v))).cast("long").alias("value")))))

    own = F.coalesce(F.col(spans_col), F.array().cast(df.schema[spans_col].dataType))
    of = lambda f: F.transform(own, f)
    selected = F.size(F.filter(own, lambda s: F.coalesce(s["selected"], F.lit(True)))) if "selected" in df.schema[spans_col].dataType.elementType.names else F.size(own)
    told = df.withColumns({"by_type": shares(of(lambda s: F.coalesce(s["type"], F.lit("")))), "by_source": shares(of(lambda s: F.coalesce(s["source"], F.lit("")))), "by_confidence": shares(of(lambda s: band(s["confidence"]))), "total": F.size(own).cast("long"), "selected_total": selected.cast("long")})
    coverage = F.when(F.col("total") > 0, F.col(redacted_col) / F.col("total") * 100).otherwise(0.0)
    return told.withColumns({"coverage": coverage, "coverage_rate": X.round1(coverage)})


def entity_count(has_output: Column, redacted: Column, spans: Column, boxes: Column, mapped: Column) -> Column:
    """What the history shows: replaced if there is an output, else found, else the size of the map."""
    found = F.coalesce(spans, F.lit(0)) + F.coalesce(boxes, F.lit(0))
    return F.when(has_output & redacted.isNotNull(), redacted).when(found > 0, found).otherwise(F.coalesce(mapped, F.lit(0)))


def type_totals(spans: DataFrame, *doc: str) -> DataFrame:
    return spans.groupBy(*doc, "type").agg(F.count("*").alias("total"), F.count_if(F.coalesce(F.col("selected"), F.lit(True))).alias("selected"))


def job_progress(items: DataFrame) -> DataFrame:
    """Per job the items of each state (states that are none are not counted) and of all."""
    return items.groupBy("job_id").agg(F.count("*").alias("total_items"), *[F.count_if(F.col("status") == s).alias(s) for s in V.ITEM_STATES])


def _job_status(items: DataFrame, rules) -> DataFrame:
    every = lambda *s: F.bool_and(F.col("status").isin(*s))
    some = lambda *s: F.bool_or(F.col("status").isin(*s))
    return items.groupBy("job_id").agg(rules(every, some).alias("status"))


def job_status(items: DataFrame) -> DataFrame:
    """By the states of a job's items; null leaves the job as it is."""
    return _job_status(items, lambda every, some: F.when(every("completed"), "completed").when(some("processing"), "processing").when(some("awaiting_review"), "awaiting_review").when(some("failed"), "failed"))


def live_job_status(items: DataFrame) -> DataFrame:
    """As a running worker sees it: what is active first, then mixed ends."""
    return _job_status(
        items,
        lambda every, some: F.when(some("processing"), "processing").when(some("pending"), "queued").when(every("completed"), "completed").when(every("failed"), "failed")
        .when(every("awaiting_review", "completed", "failed") & some("awaiting_review"), "awaiting_review").when(every("awaiting_review", "completed", "failed"), "completed"),
    )


def legacy_job_status(items: DataFrame) -> DataFrame:
    """By the older, finer states."""
    active = ("pending", "processing", "queued", "parsing", "ner", "vision", "redacting")
    return _job_status(
        items,
        lambda every, some: F.when(every("completed"), "completed").when(every("cancelled"), "cancelled").when(some(*active), "running").when(some("awaiting_review"), "awaiting_review")
        .when(some("review_approved"), "redacting").when(every("failed"), "failed").when(some("failed"), "awaiting_review"),
    )


def job_summary(items: DataFrame, files: DataFrame) -> DataFrame:
    """Per job: items, those with an output, those that wait for review and the first of these (id, sort_order)."""
    joined = items.join(files.select("file_id", "has_output"), "file_id", "left").withColumn("has_output", F.coalesce("has_output", F.lit(False)))
    waits = ~F.col("has_output") & F.col("status").isin("awaiting_review", "review_approved", "completed")
    return joined.groupBy("job_id").agg(F.count("*").alias("item_count"), F.count_if("has_output").alias("redacted_count"), F.count_if(waits).alias("awaiting_review_count"), F.min_by(F.when(waits, F.col("id")), F.when(waits, F.struct("sort_order", "id"))).alias("first_awaiting_review_item_id"))


def latest_status(items: DataFrame) -> DataFrame:
    """Each file's state in its last updated item (of equal times the largest id)."""
    return items.groupBy("file_id").agg(F.max_by("status", F.struct("updated_at", "id")).alias("status"))


def group_sizes(files: DataFrame, group_col: str = "batch_group_id") -> DataFrame:
    """Files with the size of their group, 1 where they have none; sizes are counted first, so a large group is no bottleneck."""
    named = F.trim(F.coalesce(F.col(group_col), F.lit(""))) != ""
    sizes = files.where(named).groupBy(group_col).agg(F.count("*").alias("batch_group_count"))
    return files.join(sizes, group_col, "left").withColumn("batch_group_count", F.coalesce("batch_group_count", F.lit(1).cast("long")))


def size_label(size: Column) -> Column:
    mb = size / (1024 * 1024)
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(mb < 1, F.format_string("%.1f KB", size / 1024)).otherwise(F.format_string("%.1f MB", mb))


def history_stats(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.count_if("has_output").alias("redacted_files"), F.coalesce(F.sum("entity_count"), F.lit(0)).alias("entities"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes")).withColumn("size_label", size_label(F.col("bytes")))


def folder_size(listing: DataFrame) -> DataFrame:
    return listing.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


# What a progress line names, in order.
BUCKETS = [("waiting", ["pending", "queued"]), ("recognizing", ["parsing", "ner", "vision", "processing"]), ("review", ["awaiting_review"]), ("redacting", ["review_approved", "redacting"]), ("completed", ["completed"]), ("failed", ["failed"])]


def progress_line(progress: DataFrame, most: int = 3) -> DataFrame:
    """The first buckets of ``job_progress`` that are not empty, as text."""
    told = F.array(*[F.struct(F.lit(name).alias("name"), sum((F.col(s) for s in states), F.lit(0)).alias("n")) for name, states in BUCKETS])
    shown = F.slice(F.filter(told, lambda b: b["n"] > 0), 1, most)
    return progress.withColumn("headline", F.array_join(F.transform(shown, lambda b: F.concat_ws(" ", b["name"], b["n"].cast("string"))), ", "))


def histogram(df: DataFrame, value: Column, edges: list[float]) -> DataFrame:
    """Observations up to each edge (cumulative), and over all."""
    return df.agg(*[F.count_if(value <= e).alias(f"le_{e:g}") for e in edges], F.count(value).alias("count"), F.sum(value).alias("sum"))


def versions(history: DataFrame, doc: str, order: list[str]) -> DataFrame:
    """Numbers a document's redactions from 1."""
    return history.withColumn("version", F.row_number().over(Window.partitionBy(doc).orderBy(*order)))
