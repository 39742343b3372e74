"""The whole way of a text: detect, reconcile, allocate, rewrite; one plan without a shuffle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import text as X
from spanforge.operators import detect as D
from spanforge.operators import reconcile as R
from spanforge.operators import replace as P
from spanforge.operators import rewrite as W


@dataclass(frozen=True)
class Options:
    mode: str = "structured"
    types: list[str] | None = None
    rules: list[D.Rule] = field(default_factory=lambda: list(D.BUILTIN))
    terms: dict[str, list[str]] = field(default_factory=dict)
    model: Callable[[], D.Detector] | None = None  # finds entities by batches; where it fails, the rules' spans stay
    custom_col: str | None = None
    scope: str = "text"  # "text": every occurrence; "offsets": the spans alone
    compat: bool = False


def detect(df: DataFrame, options: Options = Options(), *, text_col: str = "text") -> DataFrame:
    """Adds ``spans`` of terms and of the model, then of patterns, reconciled; with a model also ``recognition_failed``."""
    df = D.find_patterns(df, options.rules, options.types, text_col=text_col, out_col="_rules")
    df = D.find_terms(df, options.terms, text_col=text_col, out_col="_terms")
    parts = ["_terms", "_rules"]
    if options.model is not None:
        df = D.find_entities(D.find_with(df, options.model, options.types or D.supported_types(options.rules), text_col=text_col, out_col="_said"), "_said", text_col=text_col, out_col="_model").drop("_said")
        parts = ["_model", *parts]
    df = df.withColumn("spans", F.concat(*parts)).drop(*parts)
    return R.reconcile(df, text_col=text_col)


def anonymize(df: DataFrame, options: Options = Options(), *, text_col: str = "text") -> DataFrame:
    """Adds ``spans``, ``entity_map``, ``redacted_text`` and ``redacted_count``."""
    df = P.allocate(detect(df, options, text_col=text_col), options.mode, custom_col=options.custom_col, compat=options.compat)
    if options.scope == "offsets":
        df = df.withColumn("spans", _apart(F.col("spans")))
        return W.rewrite_spans(df, text_col=text_col).withColumn("redacted_count", F.size("spans").cast("long"))
    return W.rewrite(df, text_col=text_col)


def _apart(spans: Column) -> Column:
    """Spans by start that don't begin inside one before."""
    emit = lambda upto, s: F.when(s["start"] >= upto, F.array(s)).otherwise(F.slice(F.array(s), 1, 0))
    step = lambda upto, s: F.greatest(upto, s["end"])
    return X.scan(spans, F.lit(0), step, emit, f"struct<{D.FIELDS},id:string,replacement:string>")


def mask_emails(df: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Adds ``redacted_text`` with every e-mail address as stars, and ``n``."""
    rules = [r for r in D.BUILTIN if r.type == "EMAIL"]
    found = D.find_patterns(df, rules, text_col=text_col, resolve=False)
    stars = F.transform("spans", lambda s: s.withField("replacement", F.repeat(F.lit("*"), s["end"] - s["start"])))
    return W.rewrite_spans(found.withColumn("spans", stars), text_col=text_col).withColumn("n", F.size("spans").cast("long"))
