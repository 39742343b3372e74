"""Lists of files and jobs: filters, grouping, order, pages, and what ids are missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions import text as X

#: Positions that one task numbers.
BLOCK_ROWS = 1 << 16
SCHEDULABLE = ["queued", "processing", "running", "redacting", "awaiting_review"]


def _named(group: Column) -> Column:
    return F.trim(F.coalesce(group, F.lit(""))) != ""


def group_and_sort(files: DataFrame, *, id_col: str = "file_id", group_col: str = "batch_group_id", time_col: str = "created_at", pos_col: str = "pos") -> DataFrame:
    """``group_key`` and ``rank`` from 1: groups by their newest file, newest first, equal ones by their first place; inside a
    group oldest first.  Newest times and first places are aggregated and joined, so a large group is not one task's window."""
    key = F.when(_named(F.col(group_col)), F.col(group_col).cast("string")).otherwise(F.concat(F.lit("single:"), F.col(id_col).cast("string")))
    rows = files.withColumns({"group_key": key, "_t": F.coalesce(F.col(time_col), F.lit(""))})
    groups = rows.groupBy("group_key").agg(F.max("_t").alias("_newest"), F.min(pos_col).alias("_first"))
    # Dealt on its own, as only a join of two shuffles can be split where a group is large.
    return rows.join(groups.repartition("group_key"), "group_key")


def ordered(grouped: DataFrame, *, pos_col: str = "pos") -> DataFrame:
    return grouped.orderBy(F.desc("_newest"), "_first", "_t", pos_col)


def page(df: DataFrame, number: int, size: int, *, most: int = 100) -> DataFrame:
    """The rows of a page (from 1) of an ordered table; size 0 is all."""
    if size == 0:
        return df
    size = min(max(size, 1), most)
    return df.offset((max(number, 1) - 1) * size).limit(size)


def last_page(number: int, total: int, size: int) -> int:
    """The page asked for, or the last there is."""
    return max(1, min(number, -(-total // max(size, 1))))


def schedulable(jobs: DataFrame, limit: int = 1000) -> DataFrame:
    return jobs.where(F.col("status").isin(SCHEDULABLE)).orderBy("updated_at", "id").limit(min(max(limit, 1), 50_000))


def job_list(jobs: DataFrame, job_type: str | None, number: int, size: int) -> tuple[DataFrame, int]:
    """(a page of jobs, newest first; how many there are)."""
    own = jobs if job_type is None else jobs.where(F.col("job_type") == job_type)
    return page(own.orderBy(F.desc("created_at"), "id"), number, size), own.count()


def items_in_order(items: DataFrame) -> DataFrame:
    return items.orderBy("sort_order", "created_at", "id")


def _block(pos_col: str, rows: int) -> Column:
    """Numbers of blocks that keep the order of positions, null ones in a block before all others."""
    return F.coalesce(F.floor(F.col(pos_col) / rows), F.lit(-(1 << 62))).cast("long")


def _with(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with what was found for their keys, of which nulls are equal too.  Blocks are never null; a plain comparison keeps
    the partitioning that numbered them."""
    named = found.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = [rows[k] == named[f"_of_{k}"] if k == "_b" else rows[k].eqNullSafe(named[f"_of_{k}"]) for k in keys]
    return rows.join(named, same).drop(*[f"_of_{k}" for k in keys])


def runs(df: DataFrame, *, group: Column, pos_col: str = "pos", within: tuple[str, ...] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``run``: number of the stretch of neighbouring rows with one group, inside ``within``.  Rows are numbered in blocks of
    positions, whose ends are then joined up, so a long list is not one task's; positions are unique."""
    keys = [*within, "_b"]
    rows = df.withColumns({"_g": group, "_b": _block(pos_col, block_rows)})
    w = Window.partitionBy(*keys).orderBy(pos_col)
    changed = F.when(F.lag("_g").over(w).eqNullSafe(F.col("_g")) & (F.row_number().over(w) > 1), 0).otherwise(1)
    rows = rows.withColumn("_c", changed).withColumn("_n", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.struct(F.col(pos_col))
    ends = rows.groupBy(*keys).agg(F.min_by("_g", place).alias("_first"), F.max_by("_g", place).alias("_last"), F.max("_n").alias("_runs"))
    order = Window.partitionBy(*within).orderBy("_b")
    goes_on = F.when(F.lag("_last").over(order).eqNullSafe(F.col("_first")) & (F.row_number().over(order) > 1), 1).otherwise(0)
    ends = ends.withColumn("_on", goes_on)
    before = F.coalesce(F.sum("_runs").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select(*keys, (before - F.sum("_on").over(order.rowsBetween(Window.unboundedPreceding, 0))).alias("_before"))
    return _with(rows, ends, keys).withColumn("run", F.col("_n") + F.col("_before")).drop("_g", "_b", "_c", "_n", "_before")


def of_source(files: DataFrame, source: str | None) -> DataFrame:
    return files if source is None else files.where(upload_source(F.col("upload_source"), F.col("job_id"), F.col("batch_group_id")) == source)


def of_jobs(files: DataFrame, jobs: DataFrame) -> DataFrame:
    return files.join(jobs.select(F.col("id").alias("job_id")), "job_id", "left_semi")


def recent(df: DataFrame, time: Column, now: Column, days: int) -> DataFrame:
    return df.where(time >= now - F.make_interval(days=F.lit(days)))


def redaction_state(has_output: Column, status: Column) -> Column:
    return F.when(has_output, "redacted").when(status.isin("awaiting_review", "review_approved", "completed", "processing"), "awaiting_review").otherwise("unredacted")


def upload_source(source: Column, job_id: Column, group: Column) -> Column:
    """As stored; else batch if the file belongs to a job or group."""
    some = lambda c: F.coalesce(F.length(c.cast("string")) > 0, F.lit(False))
    return F.when(source.isin("playground", "batch"), source).when(some(job_id) | some(group), "batch").otherwise("playground")


def clean_source(raw: Column) -> Column:
    own = F.lower(X.strip(raw))
    return F.when(own.isin("playground", "batch"), own)


def clean_group(raw: Column) -> Column:
    """A group's id: stripped, cut to 80 characters, of letters, digits and ``_.-``; else null."""
    own = F.left(X.strip(raw), F.lit(80))
    return F.when(own.rlike(r"^[a-zA-Z0-9_.\-]{1,80}$"), own)


def clean_job_id(raw: Column) -> Column:
    """A UUID in one of its spellings, else null."""
    own = X.strip(raw)
    bare = F.regexp_replace(F.regexp_replace(own, "(?i)^urn:uuid:|^uuid:", ""), r"^\{+|\}+$|-", "")
    return F.when(bare.rlike("^[0-9a-fA-F]{32}$"), own)


def clean_filename(name: Column, extension: Column) -> Column:
    """The last part of a path without control characters; ``upload`` and the extension if nothing usable is left."""
    own = F.regexp_replace(F.substring_index(F.coalesce(F.nullif(name, F.lit("")), F.lit("unnamed")), "/", -1), r"[\x00-\x1f\x7f]", "")
    return F.when((own == "") | own.startswith("."), F.concat(F.lit("upload"), extension)).otherwise(own)


def wizard_status(status: Column) -> Column:
    """What a batch screen shows for an item's state."""
    return F.when(status == "failed", "failed").when(status.isin("processing", "parsing", "ner", "vision", "redacting"), "analyzing").when(status.isin("awaiting_review", "review_approved"), "awaiting_review").when(status == "completed", "completed").otherwise("pending")


def first_seen(df: DataFrame, id_col: str, pos_col: str) -> DataFrame:
    """Each id once, at its first place."""
    return df.groupBy(id_col).agg(F.min(pos_col).alias(pos_col))


def missing(asked: DataFrame, there: DataFrame, id_col: str) -> DataFrame:
    return asked.join(there.select(id_col), id_col, "left_anti")


def lookup(asked: DataFrame, rows: DataFrame, id_col: str, pos_col: str) -> DataFrame:
    """The rows of the asked ids, each once; unknown ids are left out."""
    return first_seen(asked, id_col, pos_col).join(rows, id_col)


def with_jobs(files: DataFrame, summary: DataFrame) -> DataFrame:
    """Files with their job's summary, which is aggregated once for all files of a job."""
    return files.join(summary, "job_id", "left")


def zip_names(files: DataFrame, *, name_col: str = "name", pos_col: str = "pos", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Names in an archive: a name that was there before gets the number of times it was, in front.  A name is counted in blocks of
    positions, so one that many files have is not one task's."""
    keys = [name_col, "_b"]
    rows = files.withColumn("_b", _block(pos_col, block_rows))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(name_col).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    rows = _with(rows, counts.select(*keys, F.coalesce(before, F.lit(0)).alias("_before")), keys)
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(pos_col)) - 1 + F.col("_before")
    return rows.withColumn("zip_name", F.when(n > 0, F.concat_ws("_", n.cast("string"), F.col(name_col))).otherwise(F.col(name_col))).drop("_b", "_before")
