"""Places of matches: found in one pass, made once."""

import re

import pytest
from pyspark.sql import functions as F

from spanforge.functions import text as X
from spanforge.operators import detect as D
from spanforge.plans import checks_spans


@pytest.mark.parametrize("pattern", [r"\d+", "ab?", "日"])
def test_located_is_finditer(spark, pattern):
    texts = ["a1b22", "", "日本日", "😀1😀ab", f"ab{X.MARK}1{X.MARK}{X.MARK}22a", "none", "1" * 700 + "a" * 300, None, "$0\\1"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: [tuple(m) for m in r.m] for r in df.select("id", X.located(F.col("text"), pattern).alias("m")).collect()}
    assert got == {k: [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, t or "")] if t is not None else [] for k, t in enumerate(texts)}


def test_spans_are_made_once(spark):
    """The plan has each rule's pattern once: not for a test of hits, a second pass, and a filter on the number of spans."""
    df = checks_spans.spans_first_of_equal(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    ids = D.BUILTIN[0].java
    # Three of them are for texts that hold the mark.
    assert 0 < plan.count(ids) <= 4


def test_exploded_spans_keep_their_rows(spark):
    df = spark.createDataFrame([(1, [(1, "a"), None, (2, "b")]), (2, []), (3, None)], "id int, spans array<struct<start:int,text:string>>")
    assert sorted(D.explode_spans(df, "id").collect(), key=repr) == sorted(df.select("id", F.inline("spans")).collect(), key=repr)


def test_classes_without_case():
    assert D.Rule("X", r"[京津]\[ab[A-Z京]{2}[^京][日-月]").java == r"(?iU)(?-i:[京津])\[ab[A-Z京]{2}[^京][日-月]"
    assert D.Rule("X", "[京ß]", ignore_case=False).java == "(?U)[京ß]"
