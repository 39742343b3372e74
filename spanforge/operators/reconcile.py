"""Reconciliation of spans from several detectors: verify or move, drop equal ones, number what refers to the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import text as X
from spanforge.operators.detect import SPANS

# What wins at equal confidence.
SOURCE_RANK = {"regex": 3, "has": 2, "llm": 2, "manual": 1}
TYPE_RANK = {"ADDRESS": 3, "ORG": 2, "PERSON": 2, "LEGAL_PARTY": 2, "LAWYER": 2, "JUDGE": 2}


def _rank(value: Column, ranks: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for name, rank in ranks.items():
        out = F.when(value == name, rank).otherwise(out)
    return out


def verified(text: Column, spans: Column) -> Column:
    """Spans whose offsets hold their text; others move to its first occurrence that no span before them takes, or go."""

    def step(out: Column, s: Column) -> Column:
        places = F.filter(X.located(text, X.quoted(s["text"])), lambda p: ~F.exists(out, lambda o: (p["start"] < o["end"]) & (o["start"] < p["end"])))
        moved = F.transform(F.slice(places, 1, 1), lambda p: s.withField("start", p["start"]).withField("end", p["end"]))
        return F.concat(out, F.when(F.coalesce(X.slice_is(text, s["start"], s["end"], s["text"]), F.lit(False)), F.array(s)).when(F.length(s["text"]) > 0, moved).otherwise(F.array().cast(SPANS)).cast(SPANS))

    placed = F.forall(spans, lambda s: F.coalesce(X.slice_is(text, s["start"], s["end"], s["text"]), F.lit(False)))
    return F.when(placed, spans).otherwise(F.aggregate(spans, F.array().cast(SPANS), step))


def best_of_equal(spans: Column) -> Column:
    """Of spans with the same offsets the one of highest confidence, then source, then type; the first of full ties."""
    less = lambda s, i: [(-s["confidence"]).alias("a"), (-_rank(s["source"], SOURCE_RANK, 0)).alias("b"), (-_rank(s["type"], TYPE_RANK, 1)).alias("c"), i.alias("i")]

    def of(all_: Column, first: Column) -> Column:
        # By the place of the first of its equals, then the best one: that stands where the first stood.
        placed = F.array_sort(F.transform(all_, lambda s, i: F.struct(F.get(first, i).alias("g"), *less(s, i), s.alias("s"))))
        best = X.let(placed, lambda ps: F.filter(ps, lambda p, j: (j == 0) | (F.get(ps, j - 1)["g"] != p["g"])))
        return F.transform(best, lambda p: p["s"])

    places = lambda all_: X.first_places(F.transform(all_, lambda s: F.struct(s["start"], s["end"])))
    return X.let(spans, lambda all_: X.let(places(all_), lambda first: of(all_, first)))


def with_corefs(spans: Column) -> Column:
    """``coref_NNN`` from 1 for each (text, type) in the order they come."""
    places = lambda all_: X.first_places(F.transform(all_, lambda s: F.struct(s["text"], s["type"])))
    named = lambda all_, first, n: F.transform(all_, lambda s, i: s.withField("coref_id", F.format_string("coref_%03d", F.get(n, F.get(first, i)))))
    return X.let(spans, lambda all_: X.let(places(all_), lambda first: X.let(X.ranks(first), lambda n: named(all_, first, n))))


def by_start(spans: Column) -> Column:
    """Spans by start, their order otherwise kept, with ids ``entity_{i}``."""
    placed = F.array_sort(F.transform(spans, lambda s, i: F.struct(s["start"].alias("a"), i.alias("i"), s.alias("s"))))
    return F.transform(placed, lambda p, i: p["s"].withField("id", F.concat(F.lit("entity_"), i.cast("string"))))


def reconcile(df: DataFrame, *, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """Verifies, drops equals, numbers references and sorts; per document, without a shuffle."""
    df = df.withColumn(spans_col, verified(F.col(text_col), F.col(spans_col)))
    df = df.withColumn(spans_col, best_of_equal(F.col(spans_col)))
    df = df.withColumn(spans_col, with_corefs(F.col(spans_col)))
    return df.withColumn(spans_col, by_start(F.col(spans_col)))
