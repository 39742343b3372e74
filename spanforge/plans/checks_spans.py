"""Queries over rules with overlaps, reconciliation, maps and rewriting in all their branches.  SQL beside each."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.functions import text as X
from spanforge.functions import values as V
from spanforge.operators import detect as D
from spanforge.operators import reconcile as R
from spanforge.operators import replace as P
from spanforge.operators import rewrite as W
from spanforge.plans import anonymize as A
from spanforge.plans.checks_text import _q, docs, found, spans_sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: What the tables' texts do not hold: one of each built-in type, with neighbours that overlap, after each whole text.
PLANTED = " | 11010119900101123X 110101900101123 13812345678 010-12345678 4000123412341234 a.b@c.org (2024)京01民初123号 (2021)abc12x34号 2024年1月2日 2023-11-05 ￥1,234.50元 5,000.00 万元 京A12345 10.20.30.40 https://x.yz/q?a=1 410101199001011234 010-1234567-11-05 https://10.20.30.41/a.b@c.org "
TYPES = [t for t in D.supported_types() if t != "MONEY"]


def planted(spark, d):
    return docs(spark, d).withColumn("text", F.concat("text", F.lit(PLANTED), F.col("doc_id").cast("string")))


PLANTED_SQL = f"planted AS (SELECT doc_id, text || '{_q(PLANTED)}' || doc_id AS text FROM documents)"


def _rules_sql(rules) -> str:
    """CTE ``hits``: matches of each rule with its rank, offsets by running sums."""
    one = [
        f"""SELECT doc_id, '{r.type}' AS type, {r.priority} AS priority, {k} AS rank, list_sum(list_transform(g[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT AS start_pos, m[i] AS span_text
        FROM (SELECT doc_id, g, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, string_split_regex(text, '(?i){_q(r.pattern)}') AS g, regexp_extract_all(text, '(?i){_q(r.pattern)}', 0) AS m FROM planted))"""
        for k, r in enumerate(rules)
    ]
    return PLANTED_SQL + ", hits AS (" + " UNION ALL ".join(one) + ")"


RULES = [r for t in TYPES for r in D.BUILTIN if r.type == t]
FIRST_SQL = _rules_sql(RULES) + ", firsts AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id, start_pos, start_pos + length(span_text) ORDER BY rank) = 1)"
RESOLVED_SQL = f"""WITH RECURSIVE {FIRST_SQL},
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_pos, priority DESC, rank) AS n FROM firsts),
kept AS (SELECT doc_id, n, true AS keep, start_pos + length(span_text) AS upto FROM placed WHERE n = 1
  UNION ALL SELECT p.doc_id, p.n, p.start_pos >= k.upto, CASE WHEN p.start_pos >= k.upto THEN p.start_pos + length(p.span_text) ELSE k.upto END FROM kept k JOIN placed p ON p.doc_id = k.doc_id AND p.n = k.n + 1)"""


@query(f"WITH {FIRST_SQL} SELECT doc_id, type, start_pos, span_text FROM firsts")
def spans_first_of_equal(spark, d):
    """Matches of every rule but those of money, the first type of equal places; overlapping ones stay."""
    return _flat(D.find_patterns(planted(spark, d), RULES, TYPES, resolve=False))


@query(f"{RESOLVED_SQL} SELECT p.doc_id, type, start_pos, span_text FROM placed p JOIN kept k ON p.doc_id = k.doc_id AND p.n = k.n AND k.keep")
def spans_leftmost(spark, d):
    return _flat(D.find_patterns(planted(spark, d), RULES, TYPES))


def _flat(df):
    return D.explode_spans(df, "doc_id").select("doc_id", "type", F.col("start").cast("long").alias("start_pos"), F.col("text").alias("span_text"))


for _k, _rule in enumerate(r for r in D.BUILTIN):
    _name = f"rule_{_rule.type.lower()}_{sum(r.type == _rule.type for r in D.BUILTIN[:_k]) + 1}"

    @query(f"WITH {_rules_sql([_rule])} SELECT doc_id, start_pos, span_text FROM hits")
    def one_rule(spark, d, _rule=_rule):
        return _flat(D.find_patterns(planted(spark, d), [_rule], resolve=False)).drop("type")

    QUERIES[_name], ORACLE_SQL[_name] = QUERIES.pop("one_rule"), ORACLE_SQL.pop("one_rule")


_ASKED = [*D.supported_types(), "NOT_A_TYPE"]


@query(f"SELECT type, count(*) AS n FROM documents JOIN (VALUES {', '.join(f"({i}, '{t}')" for i, t in enumerate(_ASKED))}) AS t(i, type) ON i = n_chars % {len(_ASKED)} WHERE type <> 'NOT_A_TYPE' GROUP BY type")
def supported_types(spark, d):
    """How many documents ask for each type that is supported; what they ask for follows from their length."""
    asked = F.element_at(F.array(*[F.lit(t) for t in _ASKED]), (F.col("n_chars") % len(_ASKED) + 1).cast("int")).alias("type")
    rows = spark.read.parquet(f"{d}/documents.parquet").select(asked)
    return rows.where(F.col("type").isin(D.supported_types())).groupBy("type").agg(F.count("*").alias("n"))


OCR_PLANTED = " 账号：12345678901234 开户 中国工商银行北京分行 北京某某科技有限公司 6222021234567890123 13912345678 x@y.cn 110101199001011234 2024年1月2日 2024/3/4 "


@query(f"WITH p AS (SELECT doc_id, text || '{OCR_PLANTED}' AS text FROM documents) " + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS entity_type, unnest(regexp_extract_all(text, '{_q(p)}', 0)) AS found FROM p" for k, p in V.OCR_PATTERNS))
def ocr_rules_every_type(spark, d):
    from spanforge.operators import boxes as O

    blocks = docs(spark, d).select("doc_id", F.concat("text", F.lit(OCR_PLANTED)).alias("text"), *[F.lit(n).alias(c) for c, n in (("left", 0), ("top", 0), ("width", 1000), ("height", 20))])
    return O.rule_boxes(blocks).select("doc_id", "entity_type", F.col("match").alias("found"))


@query("SELECT doc_id, (CASE WHEN n >= 1 THEN 0 END)::BIGINT AS first_at, (CASE WHEN n >= 2 THEN 8 END)::BIGINT AS second_at, least(n, 2)::BIGINT AS kept FROM (SELECT doc_id, doc_id % 4 AS n FROM documents)")
def spans_relocated(spark, d):
    """Spans with wrong offsets move to the first free occurrence of their text; the third of two occurrences goes."""
    one = F.struct(F.lit("bob").alias("text"), F.lit("PERSON").alias("type"), F.lit(90).alias("start"), F.lit(93).alias("end"), F.lit(0.9).alias("confidence"), F.lit("has").alias("source"), F.lit(0).alias("priority"), F.lit(None).cast("string").alias("coref_id"))
    rows = docs(spark, d).select("doc_id", F.lit("bob ann bob").alias("text"), F.array_repeat(one, (F.col("doc_id") % 4).cast("int")).alias("spans"))
    moved = rows.withColumn("spans", R.verified(F.col("text"), F.col("spans")))
    at = lambda k: F.get("spans", F.lit(k))["start"].cast("long")
    return moved.select("doc_id", at(0).alias("first_at"), at(1).alias("second_at"), F.size("spans").cast("long").alias("kept"))


CENTS = "round(l_extendedprice * 100)::BIGINT"
ITEMS_SQL = f"""items AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, {CENTS}) - 1 AS i, l_partkey % 5 AS start_pos, l_partkey % 5 + 1 + l_suppkey % 2 AS end_pos, 't' || l_partkey % 4 AS text,
CASE l_suppkey % 3 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'ADDRESS' ELSE 'PHONE' END AS type, CASE WHEN l_quantity > 25 THEN 0.9 ELSE 0.5 END AS confidence, CASE l_partkey % 3 WHEN 0 THEN 'regex' WHEN 1 THEN 'has' ELSE 'manual' END AS source, l_linenumber AS priority, l_quantity % 2 = 0 AS selected FROM lineitem)"""


def items(spark, d):
    """Orders as documents, their lines as spans."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    c = F.col
    pick = lambda key, *names: F.get(F.array(*[F.lit(n) for n in names]), (key % len(names)).cast("int"))
    start = (c("l_partkey") % 5).cast("int")
    span = F.struct(
        F.concat(F.lit("t"), (c("l_partkey") % 4).cast("string")).alias("text"), pick(c("l_suppkey"), "PERSON", "ADDRESS", "PHONE").alias("type"), start.alias("start"), (start + 1 + (c("l_suppkey") % 2).cast("int")).alias("end"),
        F.when(c("l_quantity") > 25, 0.9).otherwise(0.5).alias("confidence"), pick(c("l_partkey"), "regex", "has", "manual").alias("source"), c("l_linenumber").cast("int").alias("priority"), F.lit(None).cast("string").alias("coref_id"), (c("l_quantity") % 2 == 0).alias("selected"),
    )
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.round(c("l_extendedprice") * 100).cast("long"))
    rows = li.groupBy(c("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), span.alias("s")))).alias("all"))
    return rows.select("doc_id", F.transform("all", lambda x: x["s"]).alias("spans"))


def plain(df):
    """Spans without ``selected``, as detectors give them."""
    return df.withColumn("spans", F.transform("spans", lambda s: s.dropFields("selected")).cast(D.SPANS))


@query(f"WITH {ITEMS_SQL} SELECT doc_id, type, start_pos, end_pos FROM items QUALIFY row_number() OVER (PARTITION BY doc_id, start_pos, end_pos ORDER BY i) = 1")
def first_of_equal_spans(spark, d):
    df = plain(items(spark, d)).withColumn("spans", D.first_of_equal(F.col("spans")))
    return D.explode_spans(df, "doc_id").select("doc_id", "type", F.col("start").cast("long").alias("start_pos"), F.col("end").cast("long").alias("end_pos"))


@query(f"""WITH RECURSIVE {ITEMS_SQL}, placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_pos, priority DESC, i) AS n FROM items),
kept AS (SELECT doc_id, n, true AS keep, end_pos AS upto FROM placed WHERE n = 1 UNION ALL SELECT p.doc_id, p.n, p.start_pos >= k.upto, CASE WHEN p.start_pos >= k.upto THEN p.end_pos ELSE k.upto END FROM kept k JOIN placed p ON p.doc_id = k.doc_id AND p.n = k.n + 1)
SELECT p.doc_id, start_pos, end_pos, type FROM placed p JOIN kept k ON p.doc_id = k.doc_id AND p.n = k.n AND k.keep""")
def leftmost_spans(spark, d):
    df = plain(items(spark, d)).withColumn("spans", D.leftmost(F.col("spans")))
    return D.explode_spans(df, "doc_id").select("doc_id", F.col("start").cast("long").alias("start_pos"), F.col("end").cast("long").alias("end_pos"), "type")


BEST_SQL = """best AS (SELECT *, min(i) OVER (PARTITION BY doc_id, start_pos, end_pos) AS g FROM items QUALIFY row_number() OVER (PARTITION BY doc_id, start_pos, end_pos ORDER BY confidence DESC,
CASE source WHEN 'regex' THEN 3 WHEN 'has' THEN 2 WHEN 'manual' THEN 1 ELSE 0 END DESC, CASE type WHEN 'ADDRESS' THEN 3 WHEN 'PERSON' THEN 2 ELSE 1 END DESC, i) = 1)"""


@query(f"""WITH {ITEMS_SQL}, {BEST_SQL}, f AS (SELECT doc_id, text, type, min(g) AS first FROM best GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS n FROM f)
SELECT doc_id, text, type, source, confidence::DOUBLE AS confidence, start_pos, printf('coref_%03d', n) AS coref_id, 'entity_' || (row_number() OVER (PARTITION BY doc_id ORDER BY start_pos, g) - 1) AS id FROM best JOIN r USING (doc_id, text, type)""")
def reconcile_ranks(spark, d):
    """Equal spans by confidence, source and type; references numbered before the sort; ids after it."""
    df = plain(items(spark, d)).withColumn("spans", R.best_of_equal(F.col("spans")))
    df = df.withColumn("spans", R.with_corefs(F.col("spans"))).withColumn("spans", R.by_start(F.col("spans")))
    return D.explode_spans(df, "doc_id").select("doc_id", "text", "type", "source", "confidence", F.col("start").cast("long").alias("start_pos"), "coref_id", "id")


LABELS_SQL = "l(type, label) AS (VALUES ('PERSON', '当事人'), ('ADDRESS', '地址'), ('PHONE', '电话'))"
NUMERAL = "CASE WHEN n <= 10 THEN substr('一二三四五六七八九十', n::INT, 1) ELSE n::VARCHAR END"


@query(f"""WITH {ITEMS_SQL}, {LABELS_SQL}, f AS (SELECT doc_id, text, first(type ORDER BY i) AS type, min(i) AS first FROM items WHERE selected GROUP BY doc_id, text), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, type ORDER BY first) AS n FROM f)
SELECT doc_id, text AS span_text, '[' || label || {NUMERAL} || ']' AS replacement FROM r JOIN l USING (type)""")
def preview_map(spark, d):
    """The map of selected spans; a text has one value, of the type it is first seen with."""
    return P.allocate(items(spark, d), "smart").select("doc_id", F.explode("entity_map").alias("span_text", "replacement"))


@query(f"""WITH {ITEMS_SQL}, {LABELS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, type ORDER BY i) AS n FROM items WHERE selected), z AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, text ORDER BY i DESC) = 1)
SELECT doc_id, text AS span_text, '[' || label || {NUMERAL} || ']' AS replacement FROM z JOIN l USING (type)""")
def screen_map(spark, d):
    return items(spark, d).select("doc_id", F.explode(P.fallback_map(F.col("spans"))).alias("span_text", "replacement"))


@query(f"WITH {ITEMS_SQL} SELECT doc_id, text AS span_text, first(CASE WHEN type = 'PERSON' THEN 't*' ELSE '**' END ORDER BY i) AS replacement FROM items GROUP BY doc_id, text")
def mask_map(spark, d):
    return P.allocate(items(spark, d), "mask", selected_only=False).select("doc_id", F.explode("entity_map").alias("span_text", "replacement"))


MASKS = [("PERSON", "张三丰"), ("PERSON", "张"), ("PHONE", "13800138000"), ("PHONE", "1234567"), ("ID_CARD", "110101199001011234"), ("ID_CARD", "110101900101123"), ("BANK_CARD", "6222021234567890"), ("BANK_CARD", "62220212"), ("EMAIL", "a@b.cd"), ("ORG", "x")]


@query("SELECT doc_id, kind, text, CASE kind || length(text) WHEN 'PERSON3' THEN left(text, 1) || '**' WHEN 'PERSON1' THEN '*' WHEN 'PHONE11' THEN left(text, 3) || '****' || right(text, 4) WHEN 'ID_CARD18' THEN left(text, 6) || '********' || right(text, 4) WHEN 'BANK_CARD16' THEN repeat('*', 12) || right(text, 4) ELSE repeat('*', length(text)) END AS masked FROM (SELECT doc_id FROM documents), (VALUES " + ", ".join(f"('{k}', '{t}')" for k, t in MASKS) + ") AS m(kind, text)")
def mask_every_type(spark, d):
    cases = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(t).alias("text")) for k, t in MASKS])
    return docs(spark, d).select("doc_id", F.inline(cases)).withColumn("masked", X.masked(F.col("kind"), F.col("text")))


@query("SELECT doc_id, 'ab' AS key, 'P' AS value FROM documents UNION ALL SELECT doc_id, left(text, 2), 'P' FROM documents WHERE length(text) >= 2 AND left(text, 2) <> 'ab'")
def slice_keys(spark, d):
    """Keys for what stands at a span's offsets, where that is not its text."""
    span = F.array(F.struct(F.lit("ab").alias("text"), F.lit(0).alias("start"), F.lit(2).alias("end")))
    rows = docs(spark, d).withColumns({"spans": span, "m": F.create_map(F.lit("ab"), F.lit("P"))})
    return rows.select("doc_id", F.explode(P.with_slices(F.col("text"), F.col("spans"), F.col("m"))).alias("key", "value"))


@query(f"WITH {ITEMS_SQL} SELECT doc_id, count(*) FILTER (NOT selected) AS toggled, count(*) AS all_selected, count(*) FILTER (i > 0) AS without_first FROM items GROUP BY doc_id")
def span_edits(spark, d):
    df = items(spark, d)
    chosen = lambda x: F.size(F.filter("spans", lambda s: s["selected"])).cast("long").alias(x)
    one = P.select_spans(df).select("doc_id", chosen("toggled"))
    every = P.select_spans(df, F.lit(True)).select("doc_id", chosen("all_selected"))
    fewer = P.remove_spans(df, F.array(F.lit(0))).select("doc_id", F.size("spans").cast("long").alias("without_first"))
    return one.join(every, "doc_id").join(fewer, "doc_id")


@query(f"WITH {ITEMS_SQL} SELECT doc_id, greatest(0, start_pos)::BIGINT AS start_pos, least(4, end_pos)::BIGINT AS end_pos FROM items WHERE start_pos < least(4, end_pos)")
def spans_normalized(spark, d):
    rows = P.normalized(items(spark, d).withColumn("text", F.lit("four")))
    return D.explode_spans(rows, "doc_id").select("doc_id", F.col("start").cast("long").alias("start_pos"), F.col("end").cast("long").alias("end_pos"))


@query("SELECT user_id, max(event_id) FILTER (n = least(c, 4)) AS undone, max(event_id) FILTER (n = least(c, 2)) AS redone FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n, count(*) OVER (PARTITION BY user_id) AS c FROM events) GROUP BY user_id")
def undo_redo(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id")
    back = P.undone(rows, "user_id", "event_id", 3).withColumnRenamed("event_id", "undone")
    return back.join(P.undone(rows, "user_id", "event_id", 3, 2).withColumnRenamed("event_id", "redone"), "user_id")


@query("SELECT doc_id, text AS redacted_text, 0::BIGINT AS n FROM documents")
def rewrite_without_map(spark, d):
    empty = F.when(F.col("doc_id") % 2 == 0, F.create_map().cast("map<string,string>"))
    return W.rewrite(docs(spark, d).withColumn("entity_map", empty)).select("doc_id", "redacted_text", F.col("redacted_count").alias("n"))


_LONGEST = "(SELECT doc_id, string_split_regex(text, 'then|the|\\\\E|en') AS g, regexp_extract_all(text, 'then|the|\\\\E|en', 0) AS m FROM documents)"


@query(f"SELECT doc_id, array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || CASE m[i] WHEN 'the' THEN '<1>' WHEN 'then' THEN '<22>' WHEN 'en' THEN '<3>' WHEN '\\E' THEN '<4>' ELSE '' END), '') AS redacted_text, len(m)::BIGINT AS n FROM {_LONGEST}")
def rewrite_longest_first(spark, d):
    """A key within another: the longer one is taken."""
    keys = F.create_map(*[F.lit(x) for x in ("the", "<1>", "then", "<22>", "en", "<3>", "\\E", "<4>")])
    return W.rewrite(docs(spark, d).withColumn("entity_map", keys)).select("doc_id", "redacted_text", F.col("redacted_count").alias("n"))



@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'raster' WHEN doc_id % 5 = 1 AND doc_id % 2 = 0 THEN 'raster' WHEN doc_id % 5 = 1 THEN 'pdf' WHEN doc_id % 5 = 2 THEN 'docx' WHEN doc_id % 5 = 3 THEN 'raster' ELSE 'text' END AS writer FROM documents")
def writer_routes(spark, d):
    kind = F.get(F.array(*[F.lit(k) for k in ("image", "pdf", "docx", "pdf_scanned", "txt")]), (F.col("doc_id") % 5).cast("int"))
    return docs(spark, d).select("doc_id", W.route(kind, F.col("doc_id") % 2 == 0).alias("writer"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '[image]' WHEN doc_id % 3 = 1 THEN text ELSE '[pdf]' END AS original, CASE WHEN doc_id % 3 = 0 THEN '[image]' WHEN doc_id % 3 = 1 THEN reverse(text) ELSE '[pdf]' END AS redacted FROM documents")
def comparison_view(spark, d):
    k = F.col("doc_id") % 3
    rows = docs(spark, d).withColumns({"file_type": F.when(k == 0, "image").when(k == 1, "txt").otherwise("pdf"), "redacted_text": F.when(k == 1, F.reverse("text"))}).withColumn("text", F.when(k != 2, F.col("text")))
    return W.comparison(rows).select("doc_id", "original", "redacted")


@query("SELECT doc_id, i::BIGINT AS ordinal, 'the' AS text FROM (SELECT doc_id, unnest(range(0, len(string_split(text, 'the')) - 1)) AS i FROM documents)")
def segment_ordinals(spark, d):
    df = docs(spark, d).withColumn("entity_map", F.create_map(F.lit("the"), F.lit("x")))
    return W.segments(df, "doc_id").where("is_match").select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "text")


def _first_word():
    return lambda texts, types: [{"人名": [t.split(" ")[0]]} for t in texts]


def _failing():
    def call(texts, types):
        raise RuntimeError("no model here")

    return call


@query("SELECT doc_id, string_split(text, ' ')[1] AS word, (len(string_split(text, string_split(text, ' ')[1])) - 1)::BIGINT AS n FROM documents WHERE string_split(text, ' ')[1] <> ''")
def model_entities(spark, d):
    """A plugged-in model that names each text's first word; every place of it is found."""
    said = D.find_with(docs(spark, d), _first_word, ["PERSON"])
    return D.explode_spans(D.find_entities(said, "entities"), "doc_id").groupBy("doc_id", F.col("text").alias("word")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, 'PERSON' AS type, 0::BIGINT AS start_pos, 'has_0' AS ref FROM documents WHERE string_split(text, ' ')[1] <> '' UNION ALL SELECT doc_id, 'X' AS type, instr(text, 'the') - 1, CASE WHEN string_split(text, ' ')[1] = '' THEN 'has_0' ELSE 'has_1' END FROM documents WHERE contains(text, 'the')")
def first_occurrences(spark, d):
    word = F.split("text", " ")[0]
    own = docs(spark, d).withColumn("e", F.map_from_arrays(F.array(F.lit("人名"), F.lit("x")), F.array(F.when(word == "", F.array().cast("array<string>")).otherwise(F.array(word)), F.array(F.lit("the")))))
    return D.explode_spans(D.find_first(own, "e"), "doc_id").select("doc_id", "type", F.col("start").cast("long").alias("start_pos"), F.col("coref_id").alias("ref"))


@query(f"WITH {spans_sql(['EMAIL'])} SELECT doc_id, (SELECT count(*) FROM spans s WHERE s.doc_id = d.doc_id)::BIGINT AS n, true AS recognition_failed FROM documents d")
def failed_model_keeps_rules(spark, d):
    done = A.detect(docs(spark, d), A.Options(types=["EMAIL"], model=_failing))
    return done.select("doc_id", F.size("spans").cast("long").alias("n"), "recognition_failed")


@query("SELECT doc_id, 'ORG' AS type, (instr(text, 'the') - 1)::BIGINT AS start_pos FROM documents WHERE contains(text, 'the')")
def tags_found_again(spark, d):
    tag = "<org[001].a.b>"
    rows = docs(spark, d).withColumns({"masked": F.regexp_replace("text", "(?s)^(.*?)the.*$", f"$1{tag}"), "tags": F.create_map(F.lit(tag), F.array(F.lit("the")))})
    rows = rows.withColumn("masked", F.when(F.contains("text", F.lit("the")), F.lit(tag)).otherwise(""))
    return D.explode_spans(D.find_tagged(rows, text_col="text", masked_col="masked", tags_col="tags"), "doc_id").select("doc_id", "type", F.col("start").cast("long").alias("start_pos"))


@query("SELECT doc_id, 'a' AS tag, 'x,' || (doc_id % 3) || CASE WHEN doc_id % 3 = 2 THEN '' ELSE ',2' END AS terms FROM documents UNION ALL SELECT doc_id, 'b', 'y' FROM documents")
def tag_maps_merged(spark, d):
    own = (F.col("doc_id") % 3).cast("string")
    first = F.create_map(F.lit("a"), F.array(F.lit("x"), own))
    second = F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array(F.array(own, F.lit("2")), F.array(F.lit("y"))))
    merged = docs(spark, d).select("doc_id", F.explode(D.merged_tags(first, second)).alias("tag", "t"))
    return merged.select("doc_id", "tag", F.array_join("t", ",").alias("terms"))


@query("""WITH c AS (SELECT source AS id, count(*) AS n FROM documents GROUP BY source), a AS (SELECT * FROM (VALUES (1, 'src3'), (2, 'no such'), (3, 'src1'), (4, 'src12')) AS t(pos, id))
SELECT row_number() OVER (ORDER BY pos) AS n, id, c.n AS documents, c.n % 2 = 0 AS enabled FROM a JOIN c USING (id)""")
def selected_catalog_types(spark, d):
    """Sources as types: asked ones in their order, disabled ones too, unknown ones not."""
    from pyspark.sql import Window

    asked = ["src3", "no such", "src1", "src3", "src12"]
    catalog = spark.read.parquet(f"{d}/documents.parquet").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("documents")).select("id", "documents", (F.col("documents") % 2 == 0).alias("enabled"), F.lit(1).alias("order"))
    rows = D.selected_types(catalog, asked)
    place = F.array_position(F.array(*[F.lit(x) for x in asked]), F.col("id"))
    # At most as many rows as were asked for.
    return rows.select(F.row_number().over(Window.orderBy(place)).cast("long").alias("n"), "id", "documents", "enabled")


@query(f"WITH {spans_sql(['EMAIL', 'IP_ADDRESS', 'BANK_CARD'])} SELECT doc_id, count(*) AS n FROM spans WHERE type = 'EMAIL' OR length(span_text) >= 12 GROUP BY doc_id")
def long_enough_spans(spark, d):
    """Spans with the characters their type asks for."""
    kept = found(spark, d).withColumn("spans", D.long_enough(F.col("spans"), {"EMAIL": 2}, 12))
    return D.explode_spans(kept, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN instr(text, ' ') > 2 THEN 1 ELSE 0 END::BIGINT AS n FROM documents")
def manual_spans(spark, d):
    """The first word selected by hand, if it has two characters."""
    rows = docs(spark, d).withColumn("spans", F.array().cast(D.SPANS))
    made = D.add_manual(rows, F.lit(0), F.instr("text", " ") - 1, F.lit("X"))
    return made.select("doc_id", F.size("spans").cast("long").alias("n"))
