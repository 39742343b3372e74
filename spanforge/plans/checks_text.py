"""Queries over texts: sources, detection, reconciliation, replacement, rewriting.  SQL beside each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import text as X
from spanforge.functions import values as V
from spanforge.operators import catalog as C
from spanforge.operators import detect as D
from spanforge.operators import reconcile as R
from spanforge.operators import replace as P
from spanforge.operators import rewrite as W
from spanforge.plans import anonymize as A
from spanforge.sources import files as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
PATTERN = {kind: next(p for k, p, _ in V.BUILTIN_PATTERNS if k == kind) for kind in V.LABELS if any(k == kind for k, *_ in V.BUILTIN_PATTERNS)} | {"URL": V.BUILTIN_PATTERNS[-1][1]}
TYPES = ["EMAIL", "IP_ADDRESS", "BANK_CARD"]
TERMS = {"ORG": ["the", "der"], "PERSON": ["ing", "eau"]}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")


def rules(*kinds: str) -> list[D.Rule]:
    return [r for r in D.BUILTIN if r.type in kinds]


def _q(s: str) -> str:
    return s.replace("'", "''")


def spans_sql(kinds: list[str], table: str = "documents", key: str = "doc_id", col: str = "text") -> str:
    """CTE ``spans``: the matches of the types' first patterns with offsets."""
    one = [
        f"""SELECT {key} AS doc_id, '{k}' AS type, i, list_sum(list_transform(g[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT AS start_pos, m[i] AS span_text
        FROM (SELECT {key}, g, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT {key}, string_split_regex({col}, '(?i){_q(PATTERN[k])}') AS g, regexp_extract_all({col}, '(?i){_q(PATTERN[k])}', 0) AS m FROM {table}))"""
        for k in kinds
    ]
    return "spans AS (" + " UNION ALL ".join(one) + ")"


def found(spark: SparkSession, d: str, kinds: list[str] | None = None) -> DataFrame:
    kinds = kinds or TYPES
    return D.find_patterns(docs(spark, d), rules(*kinds), kinds)


def flat(df: DataFrame) -> DataFrame:
    return D.explode_spans(df, "doc_id").select("doc_id", "type", F.col("start").cast("long").alias("start_pos"), F.col("text").alias("span_text"))


FLAT = "SELECT doc_id, type, start_pos, span_text FROM spans"


@query(f"WITH t AS (SELECT doc_id, string_split_regex(text, '(?i){_q(PATTERN['EMAIL'])}') AS g, regexp_extract_all(text, '(?i){_q(PATTERN['EMAIL'])}', 0) AS m FROM documents) SELECT doc_id, array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || CASE WHEN i <= len(m) THEN repeat('*', length(m[i])) ELSE '' END), '') AS redacted_text, len(m)::BIGINT AS n FROM t")
def mask_email_documents(spark, d):
    return A.mask_emails(docs(spark, d)).select("doc_id", "redacted_text", "n")


for _kind in TYPES:

    @query(f"WITH {spans_sql([_kind])} {FLAT}")
    def spans_of(spark, d, _kind=_kind):
        return flat(found(spark, d, [_kind]))

    QUERIES[f"spans_{_kind.lower()}"] = QUERIES.pop("spans_of")
    ORACLE_SQL[f"spans_{_kind.lower()}"] = ORACLE_SQL.pop("spans_of")


@query(f"WITH {spans_sql(TYPES)} {FLAT}")
def spans_all_resolved(spark, d):
    return flat(found(spark, d))


@query(f"WITH {spans_sql(['URL'], 'pages', 'page_id', 'url')} {FLAT}")
def spans_url_pages(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.col("url").alias("text"))
    return flat(D.find_patterns(pages, rules("URL"), ["URL"]))


@query(f"WITH {spans_sql(TYPES)} SELECT doc_id, type, count(*) AS n FROM spans GROUP BY doc_id, type")
def entity_summary(spark, d):
    return D.entity_summary(found(spark, d), "doc_id")


CUSTOM = r"\+\d \(\d{3}\) \d{3}-\d{4}"


@query(f"SELECT doc_id, len(m)::BIGINT AS n, array_to_string(m, '|') AS matches FROM (SELECT doc_id, regexp_extract_all(text, '{CUSTOM}') AS m FROM documents) WHERE len(m) > 0")
def custom_rule_phone(spark, d):
    made = D.checked_rule(spark, D.Rule("PHONE_INTL", CUSTOM))
    hits = D.find_patterns(docs(spark, d), [made])
    return hits.where(F.size("spans") > 0).select("doc_id", F.size("spans").cast("long").alias("n"), F.array_join(F.transform("spans", lambda s: s["text"]), "|").alias("matches"))


@query(rf"SELECT doc_id, (i - 1)::BIGINT AS n, regexp_extract(m[i], '(\d+)\.(\d+)\.\d+\.\d+', 1) AS first_part, regexp_extract(m[i], '(\d+)\.(\d+)\.\d+\.\d+', 2) AS second_part FROM (SELECT doc_id, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '(\d+)\.(\d+)\.\d+\.\d+', 0) AS m FROM documents))")
def regex_tester(spark, d):
    hits = D.test_pattern(docs(spark, d), r"(\d+)\.(\d+)\.\d+\.\d+", id_cols=["doc_id"])
    return hits.select("doc_id", F.col("n").cast("long").alias("n"), F.get("groups", F.lit(0)).alias("first_part"), F.get("groups", F.lit(1)).alias("second_part"))


@query("SELECT doc_id, substr(text, 1, 500) AS text, length(text) > 500 AS was_truncated FROM documents")
def truncate_text(spark, d):
    return D.truncated(docs(spark, d), most=500)


@query(f"WITH {spans_sql(['BANK_CARD'])}, c AS (SELECT doc_id, start_pos, span_text, list_reverse(string_split(span_text, '')) AS ds FROM spans) SELECT doc_id, start_pos, span_text, list_sum(list_transform(range(1, len(ds) + 1), lambda i: CASE WHEN i % 2 = 1 THEN ds[i]::INT WHEN ds[i]::INT > 4 THEN 2 * ds[i]::INT - 9 ELSE 2 * ds[i]::INT END))::BIGINT % 10 = 0 AS valid FROM c")
def luhn_check(spark, d):
    return flat(found(spark, d, ["BANK_CARD"])).select("doc_id", "start_pos", "span_text", D.luhn(F.col("span_text")).alias("valid"))


def _terms_sql() -> str:
    return " UNION ALL ".join(f"SELECT doc_id, '{k}' AS type, '{t}' AS span_text, (len(string_split(text, '{t}')) - 1)::BIGINT AS n FROM documents" for k, ts in TERMS.items() for t in ts)


@query(f"SELECT * FROM ({_terms_sql()}) WHERE n > 0")
def dictionary_spans(spark, d):
    return D.explode_spans(D.find_terms(docs(spark, d), TERMS), "doc_id").groupBy("doc_id", "type", F.col("text").alias("span_text")).agg(F.count("*").alias("n"))


def candidates(spark, d):
    """Spans with copies of other sources, shifted where the document's number is even."""
    one = found(spark, d)
    copy = F.transform("spans", lambda s: s.withField("source", F.lit("has")).withField("confidence", F.when(F.col("doc_id") % 3 == 0, 1.0).otherwise(0.5)).withField("type", F.lit("PERSON")))
    moved = F.transform(copy, lambda s: s.withField("start", F.when(F.col("doc_id") % 2 == 0, s["start"] + 1).otherwise(s["start"])))
    return one.withColumn("spans", F.concat("spans", moved))


@query(f"WITH {spans_sql(TYPES)} SELECT doc_id, start_pos, span_text, CASE WHEN doc_id % 2 <> 0 AND doc_id % 3 = 0 THEN 'PERSON' ELSE type END AS type, CASE WHEN doc_id % 2 <> 0 AND doc_id % 3 = 0 THEN 'has' ELSE 'regex' END AS source FROM spans")
def reconcile_candidates(spark, d):
    # A copy of the same text elsewhere in its document would be a place to move to; equal texts stand once here.
    df = R.reconcile(candidates(spark, d))
    return D.explode_spans(df, "doc_id").select("doc_id", F.col("start").cast("long").alias("start_pos"), F.col("text").alias("span_text"), "type", "source")


@query(f"""WITH {spans_sql(TYPES)}, f AS (SELECT doc_id, type, span_text, min(start_pos) AS first FROM spans GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS n FROM f)
SELECT doc_id, type, start_pos, printf('coref_%03d', n) AS coref_id FROM spans JOIN r USING (doc_id, type, span_text)""")
def coref_ids(spark, d):
    df = found(spark, d).withColumn("spans", R.with_corefs(F.col("spans")))
    return D.explode_spans(df, "doc_id").select("doc_id", "type", F.col("start").cast("long").alias("start_pos"), "coref_id")


@query("""WITH t AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, row_number() OVER w AS page, sum(length(text) + 2) OVER w - 2 AS upto FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT conv_id, content, unnest(range(0, length(content), 997)) AS start_pos FROM t)
SELECT conv_id, start_pos::BIGINT AS start_pos, (SELECT count(*) FROM p WHERE p.conv_id = g.conv_id AND p.upto <= g.start_pos)::BIGINT + 1 AS page FROM g""")
def page_assign(spark, d):
    turns = spark.read.parquet(f"{d}/conversations.parquet")
    pages = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]).alias("pages"))
    marks = pages.withColumn("content", F.array_join("pages", "\n\n")).where(F.length("content") > 0)
    spans = F.transform(F.sequence(F.lit(0), F.length("content") - 1, F.lit(997)), lambda i: F.struct(i.alias("start"), (i + 1).alias("end")))
    paged = D.assign_pages(marks.withColumn("spans", spans))
    return paged.select("conv_id", F.inline("spans")).select("conv_id", F.col("start").cast("long").alias("start_pos"), F.col("page").cast("long").alias("page"))


@query("""WITH s AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS page FROM conversations)
SELECT conv_id, count(*)::BIGINT AS pages, (max(CASE WHEN page = 2 THEN n END))::BIGINT AS second_end FROM s GROUP BY conv_id HAVING count(*) >= 2""")
def page_relative_spans(spark, d):
    turns = spark.read.parquet(f"{d}/conversations.parquet")
    pages = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]).alias("pages")).where(F.size("pages") >= 2)
    start = F.length(F.get("pages", F.lit(0))) + 2
    spans = F.array(F.struct(start.alias("start"), (start + F.length(F.get("pages", F.lit(1)))).alias("end"), F.lit(2).alias("page")))
    own = W.page_spans(pages.withColumn("spans", spans), 2)
    return own.select("conv_id", F.size("pages").cast("long").alias("pages"), (F.get("spans", F.lit(0))["end"] - F.get("spans", F.lit(0))["start"]).cast("long").alias("second_end"))


_NAMES = [(a, k) for k, names in V.ALIASES.items() for a in names] + [("other", "OTHER")]


@query(f"WITH a AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{a}', '{k}')" for i, (a, k) in enumerate(_NAMES))}) AS t(i, alias, id)) SELECT doc_id, alias, id FROM documents JOIN a ON i = n_chars % {len(_NAMES)}")
def type_mapping(spark, d):
    """A name of a type for each document, by its length."""
    rows = spark.read.parquet(f"{d}/documents.parquet")
    named = F.element_at(F.array(*[F.lit(a) for a, _ in _NAMES]), (F.col("n_chars") % len(_NAMES) + 1).cast("int"))
    return rows.select("doc_id", named.alias("alias")).withColumn("id", D.type_id(F.col("alias")))


@query("SELECT type || n AS tag, type, n AS index FROM (SELECT doc_id AS n, 'T' AS type FROM documents) WHERE false")
def parse_tags(spark, d):
    tags = docs(spark, d).select(D.made_tag(F.lit("T"), F.col("doc_id").cast("int"), F.lit("a"), F.lit("b")).alias("made"), F.col("doc_id"))
    parsed = tags.select("doc_id", D.parsed_tag(F.col("made")).alias("p")).select(F.concat(F.col("p.type"), F.col("p.index").cast("string")).alias("tag"), F.col("p.type").alias("type"), F.col("p.index").cast("long").alias("index"))
    return parsed


ORACLE_SQL["parse_tags"] = "SELECT 'T' || doc_id AS tag, 'T' AS type, doc_id AS index FROM documents"


def _replaced(mode: str, value: str) -> str:
    return f"""WITH {spans_sql(TYPES)}, f AS (SELECT doc_id, type, span_text, min(start_pos) AS first FROM spans GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, type ORDER BY first) AS n FROM f), l(type, label, template) AS (VALUES {', '.join(f"('{k}', '{V.LABELS[k]}', '{P.preset_templates()[k]}')" for k in TYPES)})
SELECT doc_id, span_text, {value} AS replacement FROM r JOIN l USING (type)"""


NUMERAL = "CASE WHEN n <= 10 THEN substr('一二三四五六七八九十', n::INT, 1) ELSE n::VARCHAR END"


def mapped(spark, d, mode: str, **more) -> DataFrame:
    df = P.allocate(found(spark, d), mode, **more)
    return df.select("doc_id", F.explode("entity_map").alias("span_text", "replacement"))


@query(_replaced("smart", f"'[' || label || {NUMERAL} || ']'"))
def replace_smart(spark, d):
    return mapped(spark, d, "smart")


@query(_replaced("mask", "CASE WHEN type = 'BANK_CARD' THEN repeat('*', length(span_text) - 4) || right(span_text, 4) ELSE repeat('*', length(span_text)) END"))
def replace_mask(spark, d):
    return mapped(spark, d, "mask")


@query(_replaced("structured", "replace(template, '{index}', printf('%03d', n))"))
def replace_structured(spark, d):
    return mapped(spark, d, "structured")


@query(f"""WITH {spans_sql(TYPES)}, f AS (SELECT doc_id, type, span_text, min(start_pos) AS first FROM spans GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, type ORDER BY first) AS n FROM f WHERE type <> 'EMAIL'), l(type, label) AS (VALUES {', '.join(f"('{k}', '{V.LABELS[k]}')" for k in TYPES)})
SELECT doc_id, span_text, '[' || label || {NUMERAL} || ']' AS replacement FROM r JOIN l USING (type) UNION ALL SELECT doc_id, span_text, 'mail' FROM f WHERE type = 'EMAIL'""")
def replace_custom(spark, d):
    own = found(spark, d).withColumn("custom", F.map_from_entries(F.transform(F.array_distinct(F.transform(F.filter("spans", lambda s: s["type"] == "EMAIL"), lambda s: s["text"])), lambda t: F.struct(t.alias("key"), F.lit("mail").alias("value")))))
    return P.allocate(own, "custom", custom_col="custom").select("doc_id", F.explode("entity_map").alias("span_text", "replacement"))


@query("SELECT doc_id, replace(replace(text, 'the', '<1>'), 'ing', '<2>') AS redacted_text, ((length(text) - length(replace(text, 'the', ''))) // 3 + (length(text) - length(replace(text, 'ing', ''))) // 3)::BIGINT AS n FROM documents")
def rewrite_documents(spark, d):
    df = docs(spark, d).withColumn("entity_map", F.create_map(F.lit("the"), F.lit("<1>"), F.lit("ing"), F.lit("<2>")))
    return W.rewrite(df).select("doc_id", "redacted_text", F.col("redacted_count").alias("n"))


@query("SELECT doc_id, original, replacement, count FROM (SELECT doc_id, 'the' AS original, '<1>' AS replacement, ((length(text) - length(replace(text, 'the', ''))) // 3)::BIGINT AS count FROM documents UNION ALL SELECT doc_id, 'ing', '<2>', ((length(text) - length(replace(text, 'ing', ''))) // 3)::BIGINT FROM documents) WHERE count > 0")
def change_list(spark, d):
    df = docs(spark, d).withColumn("entity_map", F.create_map(F.lit("the"), F.lit("<1>"), F.lit("ing"), F.lit("<2>")))
    return W.changes(df, "doc_id").drop("pos")


@query("SELECT doc_id, text AS restored_text FROM documents")
def restore_roundtrip(spark, d):
    df = A.anonymize(docs(spark, d), A.Options(mode="structured", types=TYPES))
    return W.restore(df).select("doc_id", "restored_text")


@query("SELECT doc_id, (2 * (len(string_split(text, 'the')) - 1) + 1 - len(list_filter(string_split(text, 'the'), lambda x: x = '')))::BIGINT AS pieces, length(text)::BIGINT AS chars FROM documents WHERE text <> ''")
def segments(spark, d):
    df = docs(spark, d).where("text <> ''").withColumn("entity_map", F.create_map(F.lit("the"), F.lit("x")))
    return W.segments(df, "doc_id").groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum(F.length("text")).alias("chars"))


@query(f"""WITH {spans_sql(TYPES)} SELECT d.doc_id, (SELECT count(*) FROM spans s WHERE s.doc_id = d.doc_id)::BIGINT AS n_spans FROM documents d""")
def anonymize_offsets(spark, d):
    df = A.anonymize(docs(spark, d), A.Options(mode="mask", types=TYPES, scope="offsets"))
    return df.select("doc_id", F.col("redacted_count").alias("n_spans"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?is)<script[^>]*>.*?</script>', '', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages")
def html_to_text(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", X.html_text(F.col("html")).alias("text"))


@query("SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'pdf' WHEN page_id % 5 = 1 THEN 'txt' WHEN page_id % 5 = 2 THEN 'image' WHEN page_id % 5 = 3 THEN 'docx' END AS file_type FROM pages")
def file_type_of_name(spark, d):
    names = F.get(F.array(*[F.lit(x) for x in ("a.b.PDF", "x/notes.md", "y.JPEG", "z.docx", "z.exe")]), (F.col("page_id") % 5).cast("int"))
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", S.file_type(names).alias("file_type"))


@query("SELECT page_id, page_id % 3 <> 2 AS fits FROM pages")
def signature_check(spark, d):
    data = F.unhex(F.get(F.array(F.lit("255044462D31"), F.lit("68656C6C6F"), F.lit("89504E470D0A")), (F.col("page_id") % 3).cast("int")))
    ext = F.get(F.array(F.lit(".pdf"), F.lit(".txt"), F.lit(".jpg")), (F.col("page_id") % 3).cast("int"))
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", S.signature_fits(data, ext).alias("fits"))


@query("SELECT conv_id, avg(length(trim(text, ' ' || chr(10) || chr(9) || chr(13)))) < 100 AS is_scanned, count(*)::BIGINT AS page_count FROM conversations GROUP BY conv_id")
def scan_classify(spark, d):
    turns = spark.read.parquet(f"{d}/conversations.parquet")
    pages = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]).alias("pages"))
    return S.classified_pdf(pages).select("conv_id", "is_scanned", F.col("page_count").cast("long").alias("page_count"))


@query("SELECT doc_id, text FROM documents")
def decode_ladder(spark, d):
    """Texts through bytes: UTF-8, and GBK where the number is odd and the text has no other characters."""
    rows = docs(spark, d).withColumn("content", F.encode("text", "UTF-8"))
    return S.decoded(rows.drop("text")).select("doc_id", "text")


@query("SELECT user_id, max_by(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def upsert_latest(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_type", "event_id")
    half = F.col("event_id") % 2 == 0
    return S.upserted(rows.where(half), rows.where(~half), "user_id", "event_id")


@query("SELECT d.doc_id FROM documents d WHERE d.n_chars > 1000 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def orphans(spark, d):
    disk = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("age_seconds"))
    known = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("path"))
    known = known.unionByName(disk.where("path < 0").select("path"))
    return S.orphans(disk, known, least_age=1000).select(F.col("path").alias("doc_id"))


ORACLE_SQL["orphans"] = "SELECT d.doc_id FROM documents d WHERE d.n_chars > 1000 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND NOT ((SELECT count(*) FROM documents) > 5 AND (SELECT count(*) FROM labels) < (SELECT count(*) FROM documents) // 2)"


@query(f"WITH {spans_sql(TYPES)}, c AS (SELECT * FROM (VALUES " + ", ".join(f"('{r['id']}', '{r['category']}', {r['risk_level']}::BIGINT, {r['order']}::BIGINT, '{r['tag_template']}')" for r in V.catalog() if r["enabled"]) + ") AS t(id, category, risk_level, position, tag_template)) SELECT doc_id, id, category, risk_level, position, tag_template, count(*) AS n FROM spans JOIN c ON c.id = spans.type GROUP BY ALL")
def enabled_catalog(spark, d):
    """What the catalog says of the types that each document has."""
    rows = C.listed(C.preset(spark), enabled_only=True).select("id", "category", F.col("risk_level").cast("long").alias("risk_level"), F.col("order").cast("long").alias("position"), "tag_template")
    counts = D.entity_summary(found(spark, d), "doc_id").withColumnRenamed("type", "id")
    return counts.join(rows, "id")


@query("""WITH e AS (SELECT source AS id, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY source), o AS (SELECT source AS id, count(*) AS n FROM documents WHERE lang <> 'en' AND n_chars > 3000 GROUP BY source)
SELECT id, n % 2 = 0 AS enabled, n AS position FROM o UNION ALL SELECT id, CASE WHEN id = 'src1' THEN false ELSE true END, n FROM e WHERE id NOT IN (SELECT id FROM o) UNION ALL SELECT 'CUSTOM_X', true, 200""")
def catalog_merge(spark, d):
    """Sources as types: those of English texts are the preset, those of long other ones are stored, one is changed, one new."""
    rows = spark.read.parquet(f"{d}/documents.parquet")
    kind = lambda df, enabled: df.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n")).select("id", F.col("id").alias("name"), F.lit("c").alias("category"), F.lit(1).alias("risk_level"), F.col("n").cast("int").alias("order"), enabled.alias("enabled"), F.lit(True).alias("use_llm"), F.lit(None).cast("string").alias("regex_pattern"), F.lit("t").alias("tag_template"))
    base = C.updated(kind(rows.where("lang = 'en'"), F.lit(True)), "src1", {"enabled": False})
    stored = C.created(kind(rows.where("lang <> 'en' AND n_chars > 3000"), F.col("n") % 2 == 0), {"id": "CUSTOM_X"})
    return C.merged(base, stored).select("id", "enabled", F.col("order").cast("long").alias("position"))


#: The queries above over all built-in rules.  Boundaries and classes are Unicode here and ASCII in DuckDB, so these have no SQL.
EVERY = D.supported_types()


@query()
def spans_every_type(spark, d):
    return flat(found(spark, d, EVERY))


@query()
def entity_summary_every_type(spark, d):
    return D.entity_summary(found(spark, d, EVERY), "doc_id")


for _mode in ("smart", "mask", "structured"):

    @query()
    def replace_every_type(spark, d, _mode=_mode):
        return P.allocate(found(spark, d, EVERY), _mode).select("doc_id", F.explode("entity_map").alias("span_text", "replacement"))

    QUERIES[f"replace_{_mode}_every_type"] = QUERIES.pop("replace_every_type")


@query()
def restore_every_type(spark, d):
    return W.restore(A.anonymize(docs(spark, d), A.Options(mode="structured", types=EVERY))).select("doc_id", "restored_text")


@query()
def anonymize_offsets_every_type(spark, d):
    df = A.anonymize(docs(spark, d), A.Options(mode="mask", types=EVERY, scope="offsets"))
    return df.select("doc_id", F.col("redacted_count").alias("n_spans"))
