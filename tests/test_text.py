import random
import re

import pytest
from pyspark.sql import functions as F

from spanforge.functions import text as X
from spanforge.functions import values as V
from spanforge.operators import detect as D
from spanforge.operators import reconcile as R
from spanforge.operators import replace as P
from spanforge.operators import rewrite as W
from spanforge.plans import anonymize as A


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def spans_of(df, **more):
    return [[(s.start, s.end, s.type) for s in r.spans] for r in df.orderBy("doc_id").collect()]


def test_boundaries_are_unicode(spark):
    got = spans_of(D.find_patterns(texts(spark, "电话13812345678号", "tel 13812345678 x", "京a12345", "邮箱a@b.com好", None, ""), types=["PHONE", "LICENSE_PLATE", "EMAIL"]))
    assert got == [[], [(4, 15, "PHONE")], [(0, 7, "LICENSE_PLATE")], [], [], []]


def test_patterns_find_what_finditer_finds(spark):
    rnd = random.Random(0)
    parts = ["a@b.com", "1.2.3.4", "13812345678", "2024年1月2日", "2024-01-02", "(2024)京01民初123号", "京A12345", "4000123412341234", "￥1,234.50元", "https://x.y/z", " ", "，", "字", "x", "110101199001011234", "é😀"]
    rows = ["".join(rnd.choice(parts) + rnd.choice(["", " "]) for _ in range(12)) for _ in range(60)]
    for rule in D.BUILTIN:
        want = [[(m.start(), m.end(), rule.type) for m in re.finditer(rule.pattern, t, re.IGNORECASE)] for t in rows]
        assert spans_of(D.find_patterns(texts(spark, *rows), [rule], resolve=False)) == want, rule


def test_leftmost_then_priority(spark):
    made = [(0, 4, 9), (2, 6, 10), (4, 8, 5), (4, 9, 8)]
    rows = spark.createDataFrame([([("t", "T", a, b, 1.0, "regex", p, None) for a, b, p in made],)], f"spans {D.SPANS}")
    kept = rows.select(D.leftmost(F.col("spans")).alias("s")).first().s
    assert [(s.start, s.end) for s in kept] == [(0, 4), (4, 9)]


def test_rewrite_takes_the_longest(spark):
    df = texts(spark, "张三丰和张三见了a.b", "axb \\E a.b").withColumn("entity_map", F.create_map(*[F.lit(x) for x in ("张三", "P1", "张三丰", "P2", "a.b", "X", "\\E", "E!", "", "never")]))
    got = W.rewrite(df).orderBy("doc_id").collect()
    assert [(r.redacted_text, r.redacted_count) for r in got] == [("P2和P1见了X", 3), ("axb E! X", 2)]
    back = W.restore(W.rewrite(df.withColumn("entity_map", F.map_filter("entity_map", lambda k, _: F.length(k) > 0)))).orderBy("doc_id").first()
    assert back.restored_text == "张三丰和张三见了a.b"
    assert W.restore(W.rewrite(df.withColumn("entity_map", F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.lit("x"))))).first().restored_text is None
    assert W.rewrite(df.withColumn("entity_map", F.create_map().cast("map<string,string>"))).first().redacted_count == 0


@pytest.mark.parametrize("kind, text, want", [("PERSON", "张三", "张*"), ("PERSON", "张", "*"), ("PHONE", "13800138000", "138****8000"), ("ID_CARD", "110101199001011234", "110101********1234"), ("BANK_CARD", "4000123412341234", "************1234"), ("ORG", "abc", "***")])
def test_masks(spark, kind, text, want):
    assert spark.range(1).select(X.masked(F.lit(kind), F.lit(text)).alias("m")).first().m == want


def people(spark, *names, kind="PERSON"):
    spans = F.array(*[F.struct(F.lit(n).alias("text"), F.lit(kind).alias("type"), F.lit(k).alias("start"), F.lit(k + 2).alias("end"), F.lit(1.0).alias("confidence"), F.lit("has").alias("source"), F.lit(0).alias("priority"), F.lit(None).cast("string").alias("coref_id")) for k, n in enumerate(names)])
    return spark.range(1).withColumn("spans", spans)


def test_allocation(spark):
    assert P.allocate(people(spark, "张三", "李四", "张三"), "smart").first().entity_map == {"张三": "[当事人一]", "李四": "[当事人二]"}
    assert P.allocate(people(spark, "张三"), "structured", templates={}).first().entity_map == {"张三": "<人物[001].个人.姓名>"}
    assert P.allocate(people(spark, "张三"), "structured").first().entity_map == {"张三": "<姓名[001].自然人.全名>"}
    assert P.allocate(people(spark, "张三", kind="MY_TYPE"), "structured").first().entity_map == {"张三": "<MY_TYPE[001].完整名称>"}
    many = P.allocate(people(spark, *[f"n{k}" for k in range(12)]), "smart").first().entity_map
    assert many["n9"] == "[当事人十]" and many["n10"] == "[当事人11]"
    own = people(spark, "张三", "李四").withColumn("c", F.create_map(F.lit("张三"), F.lit("X")))
    assert P.allocate(own, "custom", custom_col="c").first().entity_map == {"张三": "X", "李四": "[当事人一]"}
    assert P.allocate(own, "custom", custom_col="c", compat=True).first().entity_map == {"张三": "X", "李四": "[当事人二]"}
    tagged = people(spark, "张三", "张先生").withColumn("spans", F.transform("spans", lambda s: s.withField("coref_id", F.lit("coref_001"))))
    assert P.allocate(tagged, "smart").first().entity_map == {"张三": "[当事人一]", "张先生": "[当事人一]"}
    off = people(spark, "张三", "李四").withColumn("spans", F.transform("spans", lambda s: s.withField("selected", s["text"] != "张三")))
    assert P.allocate(off, "smart").first().entity_map == {"李四": "[当事人一]"}
    with pytest.raises(ValueError):
        P.allocate(own, "other")


def test_fallback_map_counts_spans_and_keeps_the_last(spark):
    df = people(spark, "张三", "李四", "张三").withColumn("spans", F.transform("spans", lambda s: s.withField("selected", F.lit(True))))
    assert df.select(P.fallback_map(F.col("spans")).alias("m")).first().m == {"李四": "[当事人二]", "张三": "[当事人三]"}


def test_slices_join_the_map(spark):
    df = people(spark, "张三").withColumns({"text": F.lit("张叁丰"), "m": F.create_map(F.lit("张三"), F.lit("P"))})
    assert df.select(P.with_slices(F.col("text"), F.col("spans"), F.col("m")).alias("m")).first().m == {"张三": "P", "张叁": "P"}


def test_pages(spark):
    pages = ["a" * 10, "b" * 8, "c" * 12]
    starts = [0, 9, 10, 12, 19, 22, 33, 99]
    df = spark.createDataFrame([(pages, [(s, s + 1) for s in starts])], "pages array<string>, spans array<struct<start:int,end:int>>")
    assert [s.page for s in D.assign_pages(df).first().spans] == [1, 1, 2, 2, 2, 3, 3, 3]
    assert [(s.start, s.end) for s in W.page_spans(D.assign_pages(df), 2).first().spans] == [(-2, -1), (0, 1), (7, 8)]


def test_reconcile(spark):
    rows = [("bob", "PERSON", 0, 3, 0.5, "has", 0, None), ("bob", "ORG", 0, 3, 0.9, "regex", 0, None), ("ann", "PERSON", 0, 3, 0.9, "has", 0, None), ("zed", "PERSON", 4, 7, 0.9, "has", 0, None), ("bob", "ORG", 99, 102, 0.9, "llm", 0, None)]
    df = spark.createDataFrame([("bob ann bob", rows)], f"text string, spans {D.SPANS}")
    got = R.reconcile(df).first().spans
    assert [(s.text, s.type, s.start, s.coref_id, s.id) for s in got] == [("bob", "ORG", 0, "coref_001", "entity_0"), ("ann", "PERSON", 4, "coref_002", "entity_1"), ("bob", "ORG", 8, "coref_001", "entity_2")]


def test_tags_and_models(spark):
    tag = spark.range(1).select(D.parsed_tag(F.lit("<组织[003].企业.名称>")).alias("t"), D.made_tag(F.lit("组织"), F.lit(3), F.lit("企业"), F.lit("名称")).alias("m")).first()
    assert (tag.t["type"], tag.t["index"], tag.m) == ("组织", 3, "<组织[003].企业.名称>")
    reply = spark.createDataFrame([('noise {"人名":["张三"]} tail',), ("none",), ('{"x": 1',)], "r string").select(D.parsed_entities(F.col("r")).alias("m")).collect()
    assert [r.m for r in reply] == [{"人名": ["张三"]}, {}, {}]
    df = texts(spark, "张三说张三", "nobody").withColumn("e", D.parsed_entities(F.lit('{"人名":["张三"], "别的": ["说"]}')))
    assert spans_of(D.find_entities(df, "e")) == [[(0, 2, "PERSON"), (2, 3, "别的"), (3, 5, "PERSON")], []]
    tagged = texts(spark, "张三和张三").withColumns({"m": F.lit("<人名[001].a.b>和<人名[001].a.b>"), "g": F.create_map(F.lit("<人名[001].a.b>"), F.array(F.lit("张三")))})
    assert spans_of(D.find_tagged(tagged, text_col="text", masked_col="m", tags_col="g")) == [[(0, 2, "人名"), (3, 5, "人名")]]

    def make():
        def call(batch, types):
            if "bad" in batch:
                raise RuntimeError
            return [{"PERSON": [t.split(" ")[0]]} for t in batch]

        return call

    said = D.find_with(texts(spark, "ann x").unionByName(texts(spark, "bad")), make, ["PERSON"]).collect()
    assert {(r.text, r.recognition_failed) for r in said} == {("ann x", False), ("bad", True)}


def test_rules_are_checked(spark):
    with pytest.raises(ValueError):
        D.checked_rule(spark, D.Rule("X", "("))
    card = D.Rule("CARD", r"\d{16}", validator=D.luhn)
    assert spans_of(D.find_patterns(texts(spark, "4539578763621486 4539578763621487"), [card])) == [[(0, 16, "CARD")]]
    manual = D.add_manual(D.find_patterns(texts(spark, "a@b.com and more"), types=["EMAIL"]), F.lit(8), F.lit(11), F.lit("X"))
    assert spans_of(manual) == [[(0, 7, "EMAIL"), (8, 11, "X")]]
    assert spans_of(D.add_manual(manual, F.lit(3), F.lit(9), F.lit("Y"))) == [[(0, 7, "EMAIL"), (8, 11, "X")]]
    probe = manual.select(D.overlapping(F.col("spans"), F.lit(0), F.lit(12)).alias("a"), D.overlapping(F.slice("spans", 2, 1), F.lit(7), F.lit(12), compat=True).alias("b")).first()
    assert (probe.a, probe.b) == (True, False)


def test_segments(spark):
    df = texts(spark, "a张三b张三", "plain").withColumn("entity_map", F.create_map(F.lit("张三"), F.lit("P")))
    got = [(r.doc_id, r.text, r.is_match, r.ordinal) for r in W.segments(df, "doc_id").orderBy("doc_id", "pos").collect()]
    assert got == [(0, "a", False, None), (0, "张三", True, 0), (0, "b", False, None), (0, "张三", True, 1), (1, "plain", False, None)]


def test_runs(spark):
    rows = spark.createDataFrame([(["ab", "cde", "f"], 1, 5)], "runs array<string>, a int, b int")
    assert rows.select(W.majority_run(F.col("runs"), F.col("a"), F.col("b")).alias("k")).first().k == 1


def test_rounding_is_that_of_the_exact_value(spark):
    cases = [12.25, 0.15, 150.0, 33.333, 0.05, 99.95]
    got = [r.x for r in spark.createDataFrame([(c,) for c in cases], "x double").select(X.round1(F.col("x")).alias("x")).collect()]
    assert got == [round(c, 1) for c in cases]


def test_whole_way_needs_no_shuffle_and_no_python(spark):
    df = texts(spark, "write to a@b.com or 1.2.3.4, a@b.com", "x")
    done = A.anonymize(df, A.Options(mode="smart", types=["EMAIL", "IP_ADDRESS"], terms={"ORG": ["write"]}))
    row = done.orderBy("doc_id").first()
    assert row.redacted_text == "[公司一] to [邮箱一] or [IP地址一], [邮箱一]" and row.redacted_count == 4
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    assert A.anonymize(df.limit(0)).count() == 0


def test_names(spark):
    assert len(V.catalog()) == 52 and sum(not r["enabled"] for r in V.catalog()) == 3
    assert sum(len(v) for v in V.ALIASES.values()) == 89
    got = spark.range(1).select(D.type_id(F.lit("甲方")).alias("a"), D.type_id(F.lit("my type")).alias("b"), D.type_name(F.lit("PHONE")).alias("c")).first()
    assert tuple(got) == ("COMPANY", "MY TYPE", "电话号码")


def test_whole_texts_are_searched(spark):
    long = texts(spark, "x " * 250_000 + "a@b.com Acme")
    assert spans_of(D.find_patterns(long, types=["EMAIL"])) == [[(500_000, 500_007, "EMAIL")]]
    assert spans_of(D.find_terms(long, {"ORG": ["Acme"]})) == [[(500_008, 500_012, "ORG")]]
    own = long.withColumn("e", F.create_map(F.lit("ORG"), F.array(F.lit("Acme"))))
    assert spans_of(D.find_entities(own, "e")) == [[(500_008, 500_012, "ORG")]]


def test_queries_over_every_type(spark, tmp_path):
    from spanforge.plans import checks_text as T

    rnd = random.Random(2)
    parts = ["a@b.com", "1.2.3.4", "13812345678", "2024年1月2日", "2024-01-02", "(2024)京01民初123号", "京A12345", "4000123412341234", "￥1,234.50元", "https://x.y/z", "110101199001011234", " ", "，", "字", "x"]
    rows = ["".join(rnd.choice(parts) + rnd.choice(["", " "]) for _ in range(12)) for _ in range(60)]
    texts(spark, *rows).write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for n, t in enumerate(rows):
        first, upto = {}, 0
        for kind in D.supported_types():
            for r in D.BUILTIN:
                if r.type == kind:
                    for m in re.finditer(r.pattern, t, re.IGNORECASE):
                        first.setdefault(m.span(), (m.start(), -r.priority, len(first), m.end(), kind))
        for start, _, _, end, kind in sorted(first.values()):
            if start >= upto:
                want.append((n, kind, start, t[start:end]))
                upto = end
    got = sorted(map(tuple, T.spans_every_type(spark, str(tmp_path)).collect()))
    assert got == sorted(want) and {k for _, k, *_ in got} == set(D.supported_types())
    assert sum(r.n for r in T.entity_summary_every_type(spark, str(tmp_path)).collect()) == len(want)
    assert [r.restored_text for r in T.restore_every_type(spark, str(tmp_path)).orderBy("doc_id").collect()] == rows
    assert sum(r.n_spans for r in T.anonymize_offsets_every_type(spark, str(tmp_path)).collect()) == len(want)
    for mode in ("smart", "mask", "structured"):
        made = T.QUERIES[f"replace_{mode}_every_type"](spark, str(tmp_path)).collect()
        assert {(r.doc_id, r.span_text) for r in made} == {(n, x) for n, _, _, x in want}


def test_many_matches_are_gathered_in_linear_time(spark):
    import time

    for n in (0, 1, 255, 256, 257, 1000):
        found = texts(spark, "ab 12 " * n).select(X.located(F.col("text"), r"\d+").alias("m")).first().m
        assert [(m.start, m.end, m.text) for m in found] == [(6 * k + 3, 6 * k + 5, "12") for k in range(n)]
    began = time.perf_counter()
    last = texts(spark, "ab 12 " * 100_000).select(F.element_at(X.located(F.col("text"), r"\d+"), -1).alias("m")).first().m
    assert last.end == 599_999 and time.perf_counter() - began < 30


def test_spans_are_put_in_linear_time(spark):
    for n in (0, 1, 256, 700):
        text = "é😀 12 " * n + "end"
        df = texts(spark, text).withColumn("spans", F.transform(X.located(F.col("text"), r"\d+"), lambda m: m.withField("replacement", F.lit("<>"))))
        assert W.rewrite_spans(df).first().redacted_text == text.replace("12", "<>")
    long = texts(spark, "ab 12 " * 50_000).withColumn("spans", F.transform(X.located(F.col("text"), r"\d+"), lambda m: m.withField("replacement", F.lit("<>"))))
    assert W.rewrite_spans(long).first().redacted_text == "ab <> " * 50_000
