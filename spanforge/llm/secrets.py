"""Operator 3, secret scans, in DataFrame functions only: fixed patterns and windows of high entropy.

Base spans are the leftmost matches of three patterns (``BASE``) that do not overlap within a kind; a match that fails its
length test is dropped after it has taken its text.  Entropy spans come from candidate strings (runs of ``CANDIDATE``): a
window of ``WINDOW`` characters moves along the string, the counts of its characters change by the one that enters and the one
that leaves, and the Shannon entropy follows from the changed counts alone.  Windows at or over the threshold of the string's
character class are merged to spans.  Strings on the allow list give no entropy span; base spans always stay.

Whole texts are read; offsets are code points, ends exclusive.  The work on a text is linear in its length and its matches.  No
row moves: the plan is one projection over the scan.  Null texts count as empty; null or repeated ``doc_id`` values keep their
rows; an empty table gives an empty result; ``scan`` replaces a column named like its own, ``masked`` leaves all others alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import text as X
from spanforge.llm.store import free_name

# Kind, pattern, group whose length counts, least length.
BASE = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
]
#: What a pattern may match at all: only then are the offsets worked out.
GUARDS = {"assign": r"(?i:password|passwd|secret|token|api_?key)", "access": "AKIA[A-Z0-9]{12}", "hex": "[0-9a-f]{32}"}
WINDOW = 24
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
CANDIDATE = r"[A-Za-z0-9+/=_-]{24,}"
#: Class, pattern of the whole string, least entropy in bits; the first that fits counts.
CLASSES = [("hex", "^[0-9a-fA-F]+$", 3.0), ("alnum", "^[A-Za-z0-9]+$", 3.8), ("base64", "^[A-Za-z0-9+/=_-]+$", 3.9)]
#: Strings that are no secrets: without digits or without letters, UUIDs, paths of words, samples of documentation.  Repeated
#: groups are possessive: the engine would go one call deeper for each round otherwise.
ALLOWED = [r"^[^0-9]+$", r"^[^A-Za-z]+$", r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$", r"^/?(?:[A-Za-z]*+[0-9]{0,4}+[-_/=+]++)++[A-Za-z]*+[0-9]{0,4}+$", r"EXAMPLE|example|0123456789|abcdefghij"]
PLACEHOLDER = "[SECRET]"


SPAN = "array<struct<start:int,kind:int,end:int>>"


def _base(text: Column, rank: int) -> Column:
    kind, pattern, group, least = BASE[rank]
    if group == 0 and pattern.endswith("+"):
        # A run that is too short cannot hold a longer one: ask for the length at once and leave short runs in the gaps.
        fixed = len(pattern) - len(pattern.lstrip("AKI"))
        found = X.located(text, f"{pattern[:-1]}{{{least - fixed},}}")
    else:
        found = F.filter(X.located(text, pattern), lambda m: F.length(F.regexp_extract(m["text"], pattern, group)) >= least)
    spans = F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("kind"), m["end"].alias("end")))
    return F.when(text.rlike(GUARDS[kind]), spans.cast(SPAN)).otherwise(F.array().cast(SPAN))


def _log(count: Column) -> Column:
    """count * log2(count), from a table."""
    table = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 1)])
    return F.get(table, count)


def windows(value: Column, least: Column) -> Column:
    """Merged (start, end) of the windows of ``value`` whose entropy is ``least`` bits or more."""
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    # One more alphabet entry than there are characters: what leaves before the window is full.
    steps = F.zip_with(codes, F.concat(F.array_repeat(F.lit(len(ALPHABET)), WINDOW), codes), lambda a, b: F.struct(a.alias("add"), b.alias("drop")))
    # Behind the last one stands what closes the window that is open.
    end = F.array(F.struct(F.lit(-1).alias("add"), F.lit(-1).alias("drop")))
    steps = F.concat(F.filter(steps, lambda s: s["add"].isNotNull()), end)
    zero = F.struct(F.lit(0).alias("at"), F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"), F.lit(0.0).alias("sum"), F.lit(-1).alias("open"), F.lit(0).alias("upto"))

    def total(s: Column, x: Column) -> Column:
        here, gone = F.get(s["counts"], x["add"]), F.get(s["counts"], x["drop"])
        left = F.when(s["at"] >= WINDOW, _log(gone - 1) - _log(gone)).otherwise(0.0)
        return s["sum"] + F.when(x["add"] == x["drop"], 0.0).otherwise(_log(here + 1) - _log(here) + left)

    def scanned(bits: Column) -> Column:
        high = lambda s, x: (s["at"] + 1 >= WINDOW) & (F.lit(math.log2(WINDOW)) - total(s, x) / WINDOW >= bits - 1e-9)
        apart = lambda s: (s["open"] >= 0) & (s["at"] + 1 - WINDOW > s["upto"])

        def step(s: Column, x: Column) -> Column:
            counts = F.transform(s["counts"], lambda c, i: c + F.when(i == x["add"], 1).otherwise(0) - F.when((s["at"] >= WINDOW) & (i == x["drop"]), 1).otherwise(0))
            now = lambda h: F.struct((s["at"] + 1).alias("at"), counts.alias("counts"), total(s, x).alias("sum"), F.when(h & (apart(s) | (s["open"] < 0)), s["at"] + 1 - WINDOW).otherwise(s["open"]).alias("open"), F.when(h, s["at"] + 1).otherwise(s["upto"]).alias("upto"))
            return F.when(x["add"] < 0, s).otherwise(X.let(high(s, x), now))

        def emit(s: Column, x: Column) -> Column:
            closes = F.when(x["add"] < 0, s["open"] >= 0).otherwise(apart(s) & high(s, x))
            return F.when(closes, F.array(F.struct(s["open"].alias("start"), s["upto"].alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))

        return X.scan(steps, zero, step, emit, "struct<start:int,end:int>")

    # Worked out once for a string, not for each of its characters.
    return X.let(least, scanned)


def _entropy(text: Column) -> Column:
    allowed = lambda v: v.rlike("|".join(f"(?:{p})" for p in ALLOWED))

    def least(value: Column) -> Column:
        found = F.lit(None).cast("double")
        for _, pattern, bits in reversed(CLASSES):
            found = F.when(value.rlike(pattern), bits).otherwise(found)
        return found

    kept = F.filter(X.located(text, CANDIDATE), lambda m: ~allowed(m["text"]))
    spans = F.transform(kept, lambda m: F.transform(windows(m["text"], least(m["text"])), lambda w: F.struct((m["start"] + w["start"]).alias("start"), F.lit(len(BASE)).alias("kind"), (m["start"] + w["end"]).alias("end"))))
    return F.when(text.rlike(CANDIDATE), F.flatten(spans).cast(SPAN)).otherwise(F.array().cast(SPAN))


KINDS = [*(k for k, *_ in BASE), "entropy"]


def scan(df: DataFrame, text_col: str = "text", out_col: str = "secret_spans") -> DataFrame:
    """Adds the spans (start, kind's rank in ``KINDS``, end), sorted by start, then kind."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.withColumn(out_col, F.array_sort(F.concat(*[_base(text, k) for k in range(len(BASE))], _entropy(text))))


def runs(spans: Column) -> Column:
    """Overlapping or touching spans (sorted by start) as one (start, end) each."""
    kind = "struct<start:int,end:int>"
    bounds = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    closed = F.concat(bounds, F.array(F.struct(F.lit(2**31 - 1).alias("start"), F.lit(2**31 - 1).alias("end"))))
    apart = lambda at, s: s["start"] > at["end"]
    step = lambda at, s: F.struct(F.when(apart(at, s), s["start"]).otherwise(at["start"]).alias("start"), F.greatest(at["end"], s["end"]).alias("end"))
    emit = lambda at, s: F.when(apart(at, s) & (at["start"] >= 0), F.array(at)).otherwise(F.array().cast(f"array<{kind}>"))
    return X.scan(closed, F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end")), step, emit, kind)


def mask(df: DataFrame, text_col: str = "text", spans_col: str = "secret_spans") -> DataFrame:
    """Replaces each run of overlapping spans in ``text_col`` by ``PLACEHOLDER``."""
    text = F.col(text_col)
    return df.withColumn(text_col, F.when(F.size(spans_col) > 0, X.put(text, runs(F.col(spans_col)), lambda _: F.lit(PLACEHOLDER))).otherwise(text))


def masked(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with its secrets replaced, and its columns otherwise as they are, whatever their names."""
    spans = free_name(df, "secret_spans")
    return mask(scan(df, text_col, spans), text_col, spans).drop(spans)


def digest(df: DataFrame, spans_col: str = "secret_spans") -> DataFrame:
    name = lambda k: F.get(F.array(*[F.lit(x) for x in KINDS]), k)
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    spans = F.col(spans_col)
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    return df.select("doc_id", *[count(k).alias(f"n_{x}") for k, x in enumerate(KINDS)], F.sha2(told(F.filter(spans, lambda s: s["kind"] < len(BASE))), 256).alias("base_sha256"), told(spans).alias("spans"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(scan(docs))
