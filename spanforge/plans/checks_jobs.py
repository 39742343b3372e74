"""Queries over jobs, files and keyed calls, derived from ``orders``, ``lineitem``, ``documents`` and ``events``.  SQL beside each."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanforge.functions import values as V
from spanforge.operators import catalog as C
from spanforge.operators import history as H
from spanforge.operators import jobs as J
from spanforge.operators import paging as P
from spanforge.operators import reports as R
from spanforge.operators import state as S
from spanforge.plans.checks_text import TYPES, found, spans_sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


STATUS = """CASE WHEN l_returnflag = 'R' THEN 'completed' WHEN l_returnflag = 'A' AND l_quantity < 20 THEN 'awaiting_review' WHEN l_linenumber % 5 = 0 THEN 'failed' WHEN l_linenumber % 4 = 0 THEN 'processing' WHEN l_linenumber % 7 = 3 THEN 'pending' WHEN l_linenumber = 6 THEN 'redacting' ELSE 'completed' END"""
ID = "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || round(l_extendedprice * 100)::BIGINT"
ITEMS_SQL = f"items AS (SELECT {ID} AS id, l_orderkey AS job_id, l_partkey AS file_id, l_linenumber::BIGINT AS sort_order, strftime(l_shipdate, '%Y-%m-%d') AS updated_at, {STATUS} AS status FROM lineitem)"
FILES_SQL = "files AS (SELECT p_partkey AS file_id, p_partkey % 3 = 0 AS has_output FROM part)"
JOBS_SQL = "jobs AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'failed' ELSE 'completed' END AS status, strftime(o_orderdate, '%Y-%m-%d') AS updated_at FROM orders)"


def items(spark, d):
    cents = F.round(F.col("l_extendedprice") * 100).cast("long").cast("string")
    return spark.read.parquet(f"{d}/lineitem.parquet").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents).alias("id"), F.col("l_orderkey").alias("job_id"), F.col("l_partkey").alias("file_id"), F.col("l_linenumber").cast("long").alias("sort_order"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("updated_at"), F.expr(STATUS).alias("status"),
    )


def files(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("file_id"), (F.col("p_partkey") % 3 == 0).alias("has_output"))


def jobs(spark, d):
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "failed").otherwise("completed")
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), status.alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated_at"))


def events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").withColumn("seconds", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


@query(f"WITH {spans_sql(TYPES)}, c AS (SELECT doc_id, count(*) AS total, count(*) FILTER (type = 'EMAIL') AS n_email FROM spans GROUP BY doc_id) SELECT d.doc_id, coalesce(total, 0)::BIGINT AS total, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(total, 0)::BIGINT AS n_high, CASE WHEN total > 0 THEN (d.doc_id % 4) / total * 100.0 ELSE 0.0 END::DOUBLE AS coverage FROM documents d LEFT JOIN c USING (doc_id)")
def quality_report(spark, d):
    report = R.quality_of_rows(found(spark, d).withColumn("redacted_count", F.col("doc_id") % 4))
    count = lambda c, k: F.coalesce(F.element_at(c, k), F.lit(0)).cast("long")
    return report.select("doc_id", "total", count("by_type", "EMAIL").alias("n_email"), count("by_confidence", "high").alias("n_high"), "coverage")


@query("SELECT CASE WHEN l_discount * 10 >= 0.8 THEN 'high' WHEN l_discount * 10 >= 0.5 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM lineitem GROUP BY 1")
def confidence_bands(spark, d):
    return R.distribution(spark.read.parquet(f"{d}/lineitem.parquet"), by=R.band(F.col("l_discount") * 10)).select(F.col("value").alias("band"), "n")


@query(f"WITH {spans_sql(TYPES)} SELECT type, count(*) AS total, count(*) FILTER (doc_id % 2 = 0) AS selected FROM spans GROUP BY type")
def type_totals(spark, d):
    return R.type_totals(found(spark, d).select("doc_id", F.inline("spans")).withColumn("selected", F.col("doc_id") % 2 == 0))


@query(f"WITH {ITEMS_SQL} SELECT job_id, count(*) AS total_items, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in V.ITEM_STATES) + " FROM items GROUP BY job_id")
def progress_pivot(spark, d):
    return R.job_progress(items(spark, d))


@query(f"WITH {ITEMS_SQL} SELECT job_id, CASE WHEN bool_and(status = 'completed') THEN 'completed' WHEN bool_or(status = 'processing') THEN 'processing' WHEN bool_or(status = 'awaiting_review') THEN 'awaiting_review' WHEN bool_or(status = 'failed') THEN 'failed' END AS status FROM items GROUP BY job_id")
def job_status_v1(spark, d):
    return R.job_status(items(spark, d))


@query(f"WITH {ITEMS_SQL} SELECT job_id, CASE WHEN bool_or(status = 'processing') THEN 'processing' WHEN bool_or(status = 'pending') THEN 'queued' WHEN bool_and(status = 'completed') THEN 'completed' WHEN bool_and(status = 'failed') THEN 'failed' WHEN bool_and(status IN ('awaiting_review', 'completed', 'failed')) THEN CASE WHEN bool_or(status = 'awaiting_review') THEN 'awaiting_review' ELSE 'completed' END END AS status FROM items GROUP BY job_id")
def job_status_v2(spark, d):
    return R.live_job_status(items(spark, d))


@query(f"WITH {ITEMS_SQL} SELECT job_id, CASE WHEN bool_and(status = 'completed') THEN 'completed' WHEN bool_or(status IN ('pending', 'processing', 'redacting')) THEN 'running' WHEN bool_or(status = 'awaiting_review') THEN 'awaiting_review' WHEN bool_and(status = 'failed') THEN 'failed' WHEN bool_or(status = 'failed') THEN 'awaiting_review' END AS status FROM items GROUP BY job_id")
def job_status_v3(spark, d):
    return R.legacy_job_status(items(spark, d))


@query(f"WITH {ITEMS_SQL}, {FILES_SQL}, j AS (SELECT i.*, coalesce(has_output, false) AS o, NOT coalesce(has_output, false) AND status IN ('awaiting_review', 'review_approved', 'completed') AS w FROM items i LEFT JOIN files USING (file_id)) SELECT job_id, count(*) AS item_count, count(*) FILTER (o) AS redacted_count, count(*) FILTER (w) AS awaiting_review_count, first(id ORDER BY sort_order, id) FILTER (w) AS first_awaiting_review_item_id FROM j GROUP BY job_id")
def job_summary(spark, d):
    return R.job_summary(items(spark, d), files(spark, d))


@query(f"WITH {ITEMS_SQL} SELECT file_id, first(status ORDER BY updated_at DESC, id DESC) AS status FROM items GROUP BY file_id")
def latest_item_status(spark, d):
    return R.latest_status(items(spark, d))


HISTORY_SQL = "h AS (SELECT doc_id AS file_id, CASE WHEN doc_id % 2 = 0 THEN source END AS batch_group_id, 't' || lpad((doc_id * 7919 % 1000)::VARCHAR, 4, '0') AS created_at, doc_id AS pos, n_chars AS file_size, coalesce(quality, 0) = 1 AS has_output FROM documents LEFT JOIN labels USING (doc_id))"


def history(spark, d):
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    joined = docs.join(labels, "doc_id", "left")
    return joined.select(F.col("doc_id").alias("file_id"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("batch_group_id"), F.concat(F.lit("t"), F.lpad((F.col("doc_id") * 7919 % 1000).cast("string"), 4, "0")).alias("created_at"), F.col("doc_id").alias("pos"), F.col("n_chars").alias("file_size"), (F.coalesce("quality", F.lit(0)) == 1).alias("has_output"))


@query(f"WITH {HISTORY_SQL} SELECT file_id, CASE WHEN batch_group_id IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY batch_group_id) END AS batch_group_count FROM h")
def batch_group_size(spark, d):
    return R.group_sizes(history(spark, d)).select("file_id", "batch_group_count")


GROUPED = f"{HISTORY_SQL}, k AS (SELECT *, coalesce(batch_group_id, 'single:' || file_id) AS group_key FROM h), g AS (SELECT group_key, max(created_at) AS newest, min(pos) AS first FROM k GROUP BY group_key), o AS (SELECT file_id, group_key, row_number() OVER (ORDER BY newest DESC, first, created_at, pos) AS n FROM k JOIN g USING (group_key))"


def in_groups(spark, d):
    return P.ranked(H.group_and_sort(history(spark, d)), F.desc("_newest"), "_first", "_t", "pos")


@query(f"WITH {GROUPED} SELECT file_id, group_key, n FROM o")
def batch_group_sort(spark, d):
    return in_groups(spark, d).numbered("n").select("file_id", "group_key", "n")


@query(f"WITH {GROUPED} SELECT file_id, group_key FROM o WHERE n BETWEEN 21 AND 40")
def history_page(spark, d):
    return in_groups(spark, d).page(2, 20).select("file_id", "group_key")


@query(f"WITH {GROUPED} SELECT (n - 1) // 20 + 1 AS page, count(*) AS n, first(file_id ORDER BY n) AS first_id, last(file_id ORDER BY n) AS last_id FROM o GROUP BY (n - 1) // 20")
def page_bounds(spark, d):
    """Where every page begins and ends, for reading on from there."""
    return in_groups(spark, d).pages(20, ["file_id"]).select("page", "n", F.col("first.file_id").alias("first_id"), F.col("last.file_id").alias("last_id"))


@query(f"WITH {HISTORY_SQL}, w AS (SELECT file_id, created_at, row_number() OVER (ORDER BY created_at DESC, file_id DESC) AS n FROM h) SELECT file_id, created_at FROM w WHERE n BETWEEN 101 AND 130")
def page_read_on(spark, d):
    """The 30 rows behind the hundredth, newest first, from its keys alone."""
    rows = history(spark, d).select("file_id", "created_at")
    last = P.after(rows, ["created_at", "file_id"], None, 100, descending=True).orderBy("created_at", "file_id").first()
    return P.after(rows, ["created_at", "file_id"], (last["created_at"], last["file_id"]), 30, descending=True)


@query(f"WITH {HISTORY_SQL}, c AS (SELECT *, CASE WHEN lag(batch_group_id) OVER (ORDER BY pos) IS NOT DISTINCT FROM batch_group_id AND row_number() OVER (ORDER BY pos) > 1 THEN 0 ELSE 1 END AS c FROM h) SELECT file_id, (sum(c) OVER (ORDER BY pos))::BIGINT AS run FROM c")
def run_grouping(spark, d):
    return H.runs(history(spark, d), group=F.col("batch_group_id")).select("file_id", "run")


@query(f"WITH {ITEMS_SQL}, {FILES_SQL}, l AS (SELECT file_id, first(status ORDER BY updated_at DESC, id DESC) AS status FROM items GROUP BY file_id) SELECT file_id, CASE WHEN has_output THEN 'redacted' WHEN status IN ('awaiting_review', 'review_approved', 'completed', 'processing') THEN 'awaiting_review' ELSE 'unredacted' END AS state FROM files LEFT JOIN l USING (file_id)")
def tri_state(spark, d):
    rows = files(spark, d).join(R.latest_status(items(spark, d)), "file_id", "left")
    return rows.select("file_id", H.redaction_state(F.col("has_output"), F.col("status")).alias("state"))


@query(f"WITH {HISTORY_SQL} SELECT count(*) AS files, count(*) FILTER (has_output) AS redacted_files, sum(pos)::BIGINT AS entities, sum(file_size)::BIGINT AS bytes FROM h")
def history_stats(spark, d):
    return R.history_stats(history(spark, d).withColumn("entity_count", F.col("pos"))).drop("size_label")


@query("SELECT l_partkey AS id, min(l_orderkey * 10 + l_linenumber)::BIGINT AS pos FROM lineitem GROUP BY l_partkey")
def dedup_order(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_partkey").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return H.first_seen(rows, "id", "pos")


@query("SELECT d.doc_id FROM documents d ANTI JOIN labels l USING (doc_id)")
def missing_ids(spark, d):
    return H.missing(spark.read.parquet(f"{d}/documents.parquet").select("doc_id"), spark.read.parquet(f"{d}/labels.parquet"), "doc_id")


@query("SELECT l.doc_id, l.quality::BIGINT AS quality FROM labels l SEMI JOIN documents d USING (doc_id)")
def batch_lookup(spark, d):
    asked = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("n_chars").alias("pos"))
    return H.lookup(asked, spark.read.parquet(f"{d}/labels.parquet"), "doc_id", "pos").select("doc_id", F.col("quality").cast("long").alias("quality"))


@query(f"WITH {ITEMS_SQL}, {FILES_SQL}, t AS (SELECT job_id, count(*) AS item_count FROM items GROUP BY job_id) SELECT f.file_id, t.item_count FROM files f LEFT JOIN t ON t.job_id = f.file_id")
def job_embed(spark, d):
    summary = R.job_summary(items(spark, d), files(spark, d)).select("job_id", "item_count")
    return H.with_jobs(files(spark, d).withColumn("job_id", F.col("file_id")), summary).select("file_id", "item_count")


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'batch' WHEN 1 THEN 'playground' WHEN 2 THEN 'batch' ELSE 'playground' END AS source FROM pages")
def upload_source(spark, d):
    k = F.col("page_id") % 4
    rows = spark.read.parquet(f"{d}/pages.parquet")
    return rows.select("page_id", H.upload_source(F.when(k == 0, "batch").when(k == 1, "playground"), F.when(k == 2, "job"), F.lit("")).alias("source"))


@query("SELECT page_id, CASE WHEN regexp_full_match(left(url, 80), '[a-zA-Z0-9_.-]{1,80}') THEN left(url, 80) END AS group_id, regexp_extract(url, '[^/]*$') AS name FROM pages")
def sanitize_input(spark, d):
    rows = spark.read.parquet(f"{d}/pages.parquet")
    raw = F.substring_index("url", "/", -1)
    return rows.select("page_id", H.clean_group(F.col("url")).alias("group_id"), F.when(raw == "", "").otherwise(H.clean_filename(F.col("url"), F.lit(".txt"))).alias("name"))


@query("SELECT event_id, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1)::BIGINT AS before, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY event_id) > 1 THEN (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) || '_' || event_type ELSE event_type END AS zip_name FROM events")
def zip_names(spark, d):
    named = H.zip_names(events(spark, d), name_col="event_type", pos_col="event_id")
    return named.select("event_id", F.coalesce(F.split("zip_name", "_")[0].try_cast("long"), F.lit(0)).cast("long").alias("before"), "zip_name")


@query("SELECT event_id, CASE WHEN k BETWEEN 1 AND 5 THEN k END::BIGINT AS step, event_id % 2 = 0 AS ready FROM (SELECT event_id, event_id % 7 AS k FROM events)")
def wizard_config(spark, d):
    ids = F.when(F.col("event_id") % 2 == 0, F.lit('["EMAIL"]')).otherwise(F.lit("[]"))
    config = F.concat(F.lit('{"wizard_furthest_step": "'), (F.col("event_id") % 7).cast("string"), F.lit('.0", "entity_type_ids": '), ids, F.lit("}"))
    return events(spark, d).select("event_id", C.wizard_step(config).cast("long").alias("step"), C.step_one_done(config, F.lit("text_batch")).alias("ready"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.mode'), 'structured') AS mode, coalesce(json_extract(props, '$.k')::BIGINT, -1) AS k FROM events")
def json_config(spark, d):
    own = C.redaction_config(F.col("props"))
    return events(spark, d).select("event_id", own["replacement_mode"].alias("mode"), F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(-1).cast("long")).alias("k"))


EDGES = [("job", c, t) for c, ts in V.JOB_EDGES.items() for t in dict.fromkeys([*(V.JOB_STATES if ts == ["*"] else ts), c])] + [("item", c, t) for c, ts in V.ITEM_EDGES.items() for t in dict.fromkeys([*(V.ITEM_STATES if ts == ["*"] else ts), c])]


@query(f"WITH {ITEMS_SQL}, l AS (SELECT lag(status) OVER (PARTITION BY file_id ORDER BY updated_at, id) AS current, status AS target FROM items), e AS (SELECT * FROM (VALUES " + ", ".join(f"('{b}', '{c}')" for a, b, c in EDGES if a == "item") + ") AS t(current, target)) SELECT l.current, l.target, count(*) AS n, CASE WHEN l.current = l.target THEN 'idempotent' WHEN any_value(e.target) IS NULL THEN 'illegal' ELSE 'ok' END AS said FROM l LEFT JOIN e USING (current, target) WHERE l.current IS NOT NULL GROUP BY l.current, l.target")
def transition_edges(spark, d):
    """Every change of an item's state that there is, how often, by the table of edges and as the expression judges it."""
    own = Window.partitionBy("file_id").orderBy("updated_at", "id")
    seen = items(spark, d).select(F.lag("status").over(own).alias("current"), F.col("status").alias("target")).where("current IS NOT NULL").groupBy("current", "target").agg(F.count("*").alias("n"))
    judged = seen.withColumn("said", J.transition("item", F.col("current"), F.col("target")))
    edges = J.edges(spark).where("entity = 'item'").drop("entity").withColumn("edge", F.lit(True))
    # Both must say the same.
    return judged.join(edges, ["current", "target"], "left").select("current", "target", "n", F.when(F.col("edge").isNotNull() == (F.col("said") != "illegal"), F.col("said")).alias("said"))


@query(f"WITH {ITEMS_SQL}, l AS (SELECT *, lag(status) OVER (PARTITION BY file_id ORDER BY updated_at, id) AS previous FROM items) SELECT id, previous, status FROM l WHERE previous IS NOT NULL AND ('item', previous, status) NOT IN (VALUES {', '.join(str(e) for e in EDGES)})")
def invalid_transitions(spark, d):
    return J.invalid_transitions(items(spark, d), "item", key="file_id", order=["updated_at", "id"]).select("id", "previous", "status")


def _some(spark, d):
    return jobs(spark, d).where("id % 3 = 0").select(F.col("id").alias("job_id"))


@query(f"WITH {ITEMS_SQL}, {JOBS_SQL} SELECT i.id, CASE WHEN j.id % 3 = 0 AND j.status NOT IN ('completed', 'cancelled') AND i.status NOT IN ('completed', 'failed', 'cancelled') THEN 'pending' ELSE i.status END AS status FROM items i LEFT JOIN jobs j ON j.id = i.job_id")
def submit_reset(spark, d):
    return J.submitted(jobs(spark, d), items(spark, d), _some(spark, d))[1].select("id", "status")


@query(f"WITH {ITEMS_SQL}, {JOBS_SQL} SELECT i.id, CASE WHEN j.id % 3 = 0 AND i.status NOT IN ('completed', 'failed', 'cancelled') THEN 'cancelled' ELSE i.status END AS status FROM items i LEFT JOIN jobs j ON j.id = i.job_id")
def cancel_cascade(spark, d):
    return J.cancelled(items(spark, d), _some(spark, d)).select("id", "status")


@query(f"WITH {ITEMS_SQL} SELECT id FROM items WHERE job_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)")
def delete_cascade(spark, d):
    return J.without_jobs(items(spark, d), _some(spark, d)).select("id")


@query(f"WITH {ITEMS_SQL}, {JOBS_SQL} SELECT id, CASE WHEN status IN ('failed', 'completed') AND id IN (SELECT job_id FROM items WHERE status = 'failed') THEN 'queued' ELSE status END AS status FROM jobs")
def requeue_failed(spark, d):
    return J.requeued(jobs(spark, d), items(spark, d))[0].select("id", "status")


@query(f"WITH {ITEMS_SQL}, {FILES_SQL} SELECT id, CASE WHEN status = 'completed' AND NOT coalesce(has_output, false) THEN 'awaiting_review' ELSE status END AS status FROM items LEFT JOIN files USING (file_id)")
def repair_outputs(spark, d):
    return J.repaired_outputs(items(spark, d), files(spark, d)).select("id", "status")


@query(f"WITH {ITEMS_SQL} SELECT id, CASE WHEN status = 'failed' AND file_id % 2 = 0 AND file_id IN (SELECT p_partkey FROM part) THEN 'queued' ELSE status END AS status FROM items")
def repair_files(spark, d):
    rows = items(spark, d).withColumn("error_message", F.when(F.col("file_id") % 2 == 0, "File not found: x"))
    return J.repaired_files(rows, files(spark, d)).select("id", "status")


@query(f"WITH {ITEMS_SQL} SELECT id, CASE WHEN status IN ('pending', 'queued', 'processing') THEN 'recognition' WHEN status = 'redacting' THEN 'redaction' END AS queue FROM items")
def redispatch_class(spark, d):
    return items(spark, d).select("id", J.redispatch(F.col("status")).alias("queue"))


@query(f"WITH {ITEMS_SQL} SELECT id, row_number() OVER (PARTITION BY file_id ORDER BY updated_at, id) AS version FROM items")
def version_history(spark, d):
    return R.versions(items(spark, d), "file_id", ["updated_at", "id"]).select("id", F.col("version").cast("long").alias("version"))


@query(f"WITH {JOBS_SQL} SELECT id, status FROM jobs WHERE status IN ('queued', 'processing') ORDER BY updated_at, id LIMIT 50")
def schedulable_scan(spark, d):
    return H.schedulable(jobs(spark, d), 50).select("id", "status")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS last FROM events) WHERE last IS DISTINCT FROM event_type")
def progress_changes(spark, d):
    return S.changed(events(spark, d), key="user_id", order=["event_id"], columns=["event_type"]).select("event_id", "user_id", "event_type")


CALLS_SQL = """calls AS (SELECT event_id, user_id, event_type, epoch_us(ts) / 1e6 AS t, event_type <> 'error' AS success, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"""


def _machine(first: str, next_: str, out: str) -> str:
    """A key's calls one after another: the state and the answer of the first call, and of the next ones from the state before."""
    return f"""WITH RECURSIVE {CALLS_SQL}, s AS (SELECT event_id, user_id, n, {first} FROM calls c WHERE n = 1 UNION ALL SELECT c.event_id, c.user_id, c.n, {next_} FROM s JOIN calls c ON c.user_id = s.user_id AND c.n = s.n + 1) SELECT event_id, user_id, {out} FROM s"""


SEEN = "list_filter(s.seen, lambda x: x > c.t - 3600)"
LOCKED, LIFTED = "s.until IS NOT NULL AND c.t < s.until", "s.until IS NOT NULL AND c.t >= s.until"
FAILURES = f"CASE WHEN {LIFTED} THEN 0 ELSE s.failures END"
FOUND = "CASE WHEN s.opened IS NULL THEN 'closed' WHEN c.t - s.opened > 3600 THEN 'half_open' ELSE 'open' END"
MACHINES_SQL = {
    "rate_limit": _machine("true AS allowed, [t] AS seen", f"len({SEEN}) < 2, CASE WHEN len({SEEN}) < 2 THEN list_append({SEEN}, c.t) ELSE {SEEN} END", "allowed"),
    "idempotency_first": _machine("event_type AS result, t AS at", "CASE WHEN c.t - s.at < 3600 THEN s.result ELSE c.event_type END, CASE WHEN c.t - s.at < 3600 THEN s.at ELSE c.t END", "result"),
    "login_lockout": _machine(
        "CASE WHEN success THEN 'ok' ELSE 'failed' END AS outcome, CASE WHEN success THEN 0 ELSE 1 END AS failures, NULL::DOUBLE AS until",
        f"CASE WHEN {LOCKED} THEN 'locked' WHEN c.success THEN 'ok' ELSE 'failed' END, CASE WHEN {LOCKED} THEN s.failures WHEN c.success THEN 0 ELSE {FAILURES} + 1 END, CASE WHEN {LOCKED} THEN s.until WHEN NOT c.success AND {FAILURES} + 1 >= 2 THEN c.t + 86400 END",
        "outcome",
    ),
    "circuit_breaker": _machine(
        "'closed' AS state, CASE WHEN success THEN 0 ELSE 1 END AS failures, NULL::DOUBLE AS opened",
        f"{FOUND}, CASE WHEN {FOUND} = 'open' THEN s.failures WHEN c.success THEN 0 ELSE s.failures + 1 END, CASE WHEN {FOUND} = 'open' THEN s.opened WHEN c.success THEN NULL WHEN {FOUND} = 'half_open' OR s.failures + 1 >= 2 THEN c.t END",
        "state",
    ),
}


@query(MACHINES_SQL["rate_limit"])
def rate_limit(spark, d):
    return S.fold(events(spark, d), S.sliding_limit(2, 3600.0), key="user_id", time="seconds", id_col="event_id", inputs=[], out="allowed boolean")


@query(MACHINES_SQL["idempotency_first"])
def idempotency_first(spark, d):
    return S.fold(events(spark, d), S.first_result(3600.0), key="user_id", time="seconds", id_col="event_id", inputs=["event_type"], out="result string")


@query(MACHINES_SQL["login_lockout"])
def login_lockout(spark, d):
    calls = events(spark, d).withColumn("success", F.col("event_type") != "error")
    return S.fold(calls, S.lockout(2, 86400.0), key="user_id", time="seconds", id_col="event_id", inputs=["success"], out="outcome string")


@query(MACHINES_SQL["circuit_breaker"])
def circuit_breaker(spark, d):
    calls = events(spark, d).withColumn("success", F.col("event_type") != "error")
    return S.fold(calls, S.breaker(2, 3600.0), key="user_id", time="seconds", id_col="event_id", inputs=["success"], out="state string")


@query("SELECT event_id AS jti FROM events WHERE event_id % 10 = 0 AND user_id >= 50")
def token_revocation(spark, d):
    tokens = events(spark, d).select(F.col("event_id").alias("jti"))
    listed = events(spark, d).where("event_id % 10 = 0").select(F.col("event_id").alias("jti"), F.col("user_id").alias("exp"))
    return S.revoked(tokens, listed.unionByName(listed), F.lit(50))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '203.0.113.' || (event_id % 250) ELSE '198.51.100.' || (event_id % 200) END AS client FROM events")
def client_address(spark, d):
    n = F.col("event_id")
    peer = F.when(n % 3 == 0, "10.1.2.3").otherwise(F.concat(F.lit("198.51.100."), (n % 200).cast("string")))
    forwarded = F.concat(F.lit("203.0.113."), (n % 250).cast("string"), F.lit(", 10.0.0.1"))
    return events(spark, d).select("event_id", S.client_ip(peer, forwarded, ["10.0.0.0/8", "192.168.0.0/16"]).alias("client"))
