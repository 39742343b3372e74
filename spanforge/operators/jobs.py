"""Job and item tables: which changes of state are allowed, and set-based changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.functions import values as V

TERMINAL = ["completed", "failed", "cancelled"]


def edges(spark: SparkSession) -> DataFrame:
    """(entity, current, target) of every allowed change; a state may stay itself."""
    rows = []
    for entity, table, states in (("job", V.JOB_EDGES, V.JOB_STATES), ("item", V.ITEM_EDGES, V.ITEM_STATES)):
        for current, targets in table.items():
            rows += [(entity, current, t) for t in dict.fromkeys([*(states if targets == ["*"] else targets), current])]
    return spark.createDataFrame(rows, "entity string, current string, target string")


def transition(entity: str, current: Column, target: Column) -> Column:
    """ok, idempotent or illegal, without a join: the tables are small and fixed."""
    table, states = (V.JOB_EDGES, V.JOB_STATES) if entity == "job" else (V.ITEM_EDGES, V.ITEM_STATES)
    allowed = F.create_map(*[x for k, t in table.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in (states if t == ["*"] else t)]).cast("array<string>"))])
    return F.when(current == target, "idempotent").when(F.coalesce(F.array_contains(F.element_at(allowed, current), target), F.lit(False)), "ok").otherwise("illegal")


def invalid_transitions(log: DataFrame, entity: str, *, key: str, order: list[str], status_col: str = "status") -> DataFrame:
    """Changes in a log of states that are not allowed."""
    w = Window.partitionBy(key).orderBy(*order)
    return log.withColumn("previous", F.lag(status_col).over(w)).where(F.col("previous").isNotNull()).where(transition(entity, F.col("previous"), F.col(status_col)) == "illegal")


def _set(df: DataFrame, when: Column, status: str, **more: Column) -> DataFrame:
    new = {"status": F.when(when, status).otherwise(F.col("status"))} | {k: F.when(when, v).otherwise(F.col(k)) for k, v in more.items()}
    return df.withColumns(new)


def submitted(jobs: DataFrame, items: DataFrame, job_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs, items) after the jobs (``job_id``) were submitted: they are queued and their unfinished items pending; completed
    and cancelled jobs refuse and stay as they are."""
    takes = job_ids.join(jobs.where(~F.col("status").isin("completed", "cancelled")).select(F.col("id").alias("job_id")), "job_id", "left_semi").distinct().withColumn("_t", F.lit(True))
    new_jobs = _set(jobs.join(takes, jobs["id"] == takes["job_id"], "left").drop("job_id"), F.col("_t"), "queued").drop("_t")
    new_items = _set(items.join(takes, "job_id", "left"), F.col("_t") & ~F.col("status").isin(TERMINAL), "pending").drop("_t")
    return new_jobs, new_items


def cancelled(items: DataFrame, job_ids: DataFrame) -> DataFrame:
    own = job_ids.select("job_id").distinct().withColumn("_t", F.lit(True))
    return _set(items.join(own, "job_id", "left"), F.col("_t") & ~F.col("status").isin(TERMINAL), "cancelled").drop("_t")


def without_jobs(rows: DataFrame, job_ids: DataFrame) -> DataFrame:
    return rows.join(job_ids.select("job_id"), "job_id", "left_anti")


def detached(files: DataFrame, job_ids: DataFrame) -> DataFrame:
    """Files of deleted jobs, without their job."""
    own = job_ids.select("job_id").distinct().withColumn("_t", F.lit(True))
    return files.join(own, "job_id", "left").withColumn("job_id", F.when(F.col("_t"), None).otherwise(F.col("job_id"))).drop("_t")


def requeued(jobs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs, items) with failed items pending again and their failed or completed jobs queued."""
    hit = items.where("status = 'failed'").select(F.col("job_id").alias("_j")).distinct()
    new_jobs = _set(jobs.join(hit, jobs["id"] == hit["_j"], "left"), F.col("_j").isNotNull() & F.col("status").isin("failed", "completed"), "queued").drop("_j")
    return new_jobs, _set(items, F.col("status") == "failed", "pending")


def committed(items: DataFrame, results: DataFrame) -> DataFrame:
    """Items under review after their redaction (``id``, ``ok``): completed, or back to review if it failed."""
    joined = items.join(results.select("id", "ok"), "id", "left")
    moves = F.col("ok").isNotNull() & F.col("status").isin("awaiting_review", "processing", "review_approved")
    return joined.withColumn("status", F.when(moves & F.col("ok"), "completed").when(moves, "awaiting_review").otherwise(F.col("status"))).drop("ok")


def approved(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Items whose review is approved (``id``): those that wait are approved, what is approved or completed stays, and others
    get ``refused``."""
    joined = items.join(ids.select("id").distinct().withColumn("_t", F.lit(True)), "id", "left")
    waits = F.coalesce(F.col("_t"), F.lit(False)) & (F.col("status") == "awaiting_review")
    refused = F.coalesce(F.col("_t"), F.lit(False)) & ~F.col("status").isin("awaiting_review", "review_approved", "completed")
    return _set(joined.withColumn("refused", refused), waits, "review_approved").drop("_t")


def rejected(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Items whose review is rejected (``id``): those that wait are queued again, others get ``refused``."""
    joined = items.join(ids.select("id").distinct().withColumn("_t", F.lit(True)), "id", "left")
    asked, waits = F.coalesce(F.col("_t"), F.lit(False)), F.col("status") == "awaiting_review"
    return _set(joined.withColumn("refused", asked & ~waits), asked & waits, "queued").drop("_t")


def committable(status: Column) -> Column:
    """Whether a review can be committed; what is completed already stays."""
    return F.when(status.isin("cancelled", "failed"), "refused").when(status == "completed", "done").otherwise("redact")


def recognition_plan(items: DataFrame, files: DataFrame) -> DataFrame:
    """What each item that is not at its end is to be read by: ``route`` text or vision, by its file's kind; without its file
    ``missing``."""
    active = items.where(~F.col("status").isin(TERMINAL))
    joined = active.join(files.select("file_id", "file_type", "is_scanned"), "file_id", "left")
    return joined.withColumn("route", F.when(F.col("file_type").isNull(), "missing").otherwise(task_route(F.col("file_type"), F.col("is_scanned"))))


def after_attempts(attempts: DataFrame, *, most: int = 3) -> DataFrame:
    """Of attempts (item_id, attempt, ok, error) each item's end: done by its first success of the first ``most``, else failed
    with its last error (500 characters) once all were made, else still open; ``waited`` is the seconds of its back-off."""
    counted = attempts.where(F.col("attempt") <= most)
    won = F.min(F.when(F.col("ok"), F.col("attempt")))
    last = F.max("attempt")
    tried = F.coalesce(won, last)
    end = F.when(won.isNotNull(), "done").when(last == most, "failed").otherwise("open")
    error = F.when(won.isNull() & (last == most), F.left(F.max_by("error", "attempt"), F.lit(500)))
    return counted.groupBy("item_id").agg(end.alias("outcome"), tried.cast("long").alias("attempts"), (F.pow(F.lit(2.0), tried - 1) - 1).cast("long").alias("waited"), error.alias("error"))


def latest_drafts(drafts: DataFrame, key: str = "item_id", order: str = "updated_at") -> DataFrame:
    """The last saved draft of each item; an empty one clears it."""
    return drafts.groupBy(key).agg(F.max_by("draft_json", order).alias("draft_json")).where(F.coalesce(F.length("draft_json"), F.lit(0)) > 0)


def repaired_outputs(items: DataFrame, files: DataFrame) -> DataFrame:
    """Completed items whose file has no output wait for review again."""
    joined = items.join(files.select("file_id", "has_output"), "file_id", "left")
    return _set(joined, (F.col("status") == "completed") & ~F.coalesce(F.col("has_output"), F.lit(False)), "awaiting_review").drop("has_output")


def repaired_files(items: DataFrame, there: DataFrame) -> DataFrame:
    """Items that failed for want of a file that is there are queued again."""
    joined = items.join(there.select("file_id").distinct().withColumn("_t", F.lit(True)), "file_id", "left")
    lost = F.contains(F.col("error_message"), F.lit("文件不存在")) | F.contains(F.lower("error_message"), F.lit("file not found"))
    return _set(joined, (F.col("status") == "failed") & lost & F.col("_t"), "queued", error_message=F.lit(None).cast("string")).drop("_t")


def unstuck(items: DataFrame) -> DataFrame:
    return items.withColumn("status", F.when(F.col("status").isin("parsing", "ner", "vision"), "queued").when(F.col("status") == "redacting", "awaiting_review").otherwise(F.col("status")))


def without_output(tasks: DataFrame, outputs: DataFrame, id_col: str = "file_id") -> DataFrame:
    """Redaction tasks that still have something to do."""
    return tasks.join(outputs.select(id_col), id_col, "left_anti")


def unique_tasks(tasks: DataFrame) -> DataFrame:
    return tasks.dropDuplicates(["item_id"])


def redispatch(status: Column) -> Column:
    """Which queue an item goes to after a restart."""
    return F.when(status.isin("pending", "queued", "processing", "parsing", "ner", "vision"), "recognition").when(status.isin("review_approved", "redacting"), "redaction")


def task_route(file_type: Column, is_scanned: Column) -> Column:
    return F.when((file_type == "image") | (file_type == "pdf_scanned") | F.coalesce(is_scanned, F.lit(False)), "vision").otherwise("text")
