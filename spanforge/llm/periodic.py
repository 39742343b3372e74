"""Operator 12, periodic runs: Lyndon arrays of both word orders, with comparisons that reuse what was matched before.

A run is a stretch of consecutive words with a smallest period q that no neighbour extends; it counts if it has ``LEAST_WORDS``
words and ``LEAST_TIMES`` periods or more.  Words are compared as numbers.  For each order of the words (and its reverse) the next
smaller suffix of each place is found from left to right: the places whose suffix is still the smallest so far stand on a stack,
and a new place takes away those that are larger.  The stretch up to the next smaller suffix is the longest Lyndon word there, and
each run repeats such a word in one of the two orders, so the common extension of a place and its next smaller suffix, with what
goes on to the left, is the run.  Extensions are found by comparing words, never twice: of all matches so far the one that reaches
furthest right is kept, and a comparison inside its stretch is that of the same pair one match earlier, which is known.  Only
words beyond it are looked at, so a text takes time linear in its words, whatever it repeats.  No suffix is sorted, nothing hashed.

Words that come fewer times than a run has periods part the text first.  Each text is one row's work and whole in memory; texts are read as they are dealt, without a shuffle.

Null and empty texts have no words and no runs.  Equal texts and ids give equal rows; other columns are not read.  A null id is
kept, and its text not made periodic by the query (a null has no decimal form).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import text as X
from spanforge.llm.memory import lean
from spanforge.llm.store import free_name

LEAST_WORDS, LEAST_TIMES = 6, 4
#: Of characters: what texts a batch of results holds at least before it is handed on.
STEP_CHARS = 4 << 20
WORD = r"[^\x20\x09-\x0D]+"
RUN = "struct<start:long,length:long,period:long>"


def lyndon_roots(t: list[int], least: int) -> list[tuple[int, int, int]]:
    """(place, period, extension) of the places whose longest Lyndon word is repeated from there for ``least`` periods more, only
    the first place of neighbouring ones.  Numbers are 0 or more; a suffix that is the beginning of another is the smaller one."""
    n = len(t)
    t = [*t, -1]
    after, match_after, match_before = [n] * n, [0] * n, [0] * n
    stack: list[int] = []
    # What stands in [.., upto) was matched with what stands ``back`` places before.
    upto = back = 0
    found = []
    for i in range(n):
        match = 0
        while stack:
            j = stack[-1]
            if i + match < upto:
                known = match_after[j - back] if after[j - back] == i - back else match_before[i - back]
                match = known if i + known < upto else upto - i
            if i + match >= upto and t[j + match] == t[i + match]:
                match += 1
                while t[j + match] == t[i + match]:
                    match += 1
            if match and i + match >= upto:
                upto, back = i + match, i - j
            if t[j + match] < t[i + match]:
                match_before[i] = match
                break
            # All above the first that shares less with its neighbour are larger for the same reason.
            while True:
                stack.pop()
                after[j], match_after[j] = i, match
                if match >= least * (i - j):
                    first = 2 * j - i
                    if first < 0 or after[first] != j or match_after[first] != match + i - j:
                        found.append((j, i - j, match))
                below = match_before[j]
                if not stack or below <= match:
                    break
                j = stack[-1]
            if stack and below < match:
                match_before[i] = below
                break
        stack.append(i)
    return found


def stretches(words: list[int], least_words: int, least_times: int) -> list[tuple[int, int]]:
    """(start, end) of what lies between words that come less than ``least_times`` times: no run holds such a word, nor is one
    beside a run that goes on there."""
    if len(words) < least_words:
        return []
    all_ = np.array(words)
    often = np.concatenate([[False], np.bincount(all_)[all_] >= least_times, [False]])
    edges = np.flatnonzero(often[1:] != often[:-1])
    return [(a, b) for a, b in edges.reshape(-1, 2).tolist() if b - a >= least_words]


def runs(words: list[int], least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a list of numbers, by start, then period; ``least_times`` is 3 or more."""
    found = set()
    for a, b in stretches(words, least_words, least_times):
        part = words[a:b]
        top = max(part)
        for t in (part, [top - w for w in part]):
            # A run of k periods repeats its first Lyndon word for more than k - 2 periods.
            for place, period, match in lyndon_roots(t, least_times - 2):
                start = place
                while start and t[start - 1] == t[start - 1 + period]:
                    start -= 1
                length = place + period + match - start
                if length >= max(least_words, least_times * period):
                    found.add((a + start, length, period))
    return sorted(found)


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words that are in no run after its first period, joined by one space."""
    kept, upto = [], 0
    for a, b in sorted((start + period, start + length) for start, length, period in found):
        kept += words[upto:a] if a > upto else []
        upto = max(upto, b)
    return b" ".join(kept + words[upto:])


def _of_texts(place: int, names: list[str], least_words: int, least_times: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, size, told, texts = 0, 0, [], []
            for k, text in enumerate(batch.column(place)):
                # Of bytes, split() knows the six white space characters of ``WORD``, and no other.
                words = text.cast(pa.binary()).as_py().split() if text.is_valid else []
                codes: dict[bytes, int] = {}
                found = runs([codes.setdefault(w, len(codes)) for w in words], least_words, least_times)
                told.append([{"start": a, "length": b, "period": c} for a, b, c in found])
                texts.append(collapsed(words, found).decode())
                size += len(texts[-1])
                if size >= STEP_CHARS or k + 1 == batch.num_rows:
                    kept = [batch.column(c).slice(first, len(told)) for c in range(batch.num_columns) if c != place]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(told, kind), pa.array(texts, pa.string())], names)
                    first, size, told, texts = k + 1, 0, [], []

    return run


def find_runs(df: DataFrame, *, keep: list[str], text_col: str = "text", runs_col: str = "runs", out_col: str = "collapsed", least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES) -> DataFrame:
    """The columns ``keep`` with a text's runs, by start, then period, and its words without repetitions."""
    if least_times < 3:
        raise ValueError("runs of three periods or more are found")
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), f"`{runs_col}` array<{RUN}>", f"`{out_col}` string"])
    rows = df.select(*keep, F.col(text_col).cast("string").alias(free_name(df.select(*keep), "_text")))
    return rows.mapInArrow(lean(_of_texts(len(keep), [*keep, runs_col, out_col], least_words, least_times)), schema)


def made_periodic(text: Column, doc_id: Column) -> Column:
    """The text of a tenth of the ids with a repetition in it: from its word a on, words follow in turns of p."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10).cast("long")

    def of(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("long")
        turned = X.let(F.struct(a.alias("a"), p.alias("p")), lambda s: F.transform(words, lambda w, i: F.when(i >= s["a"], F.get(words, (s["a"] + F.pmod(i - s["a"], s["p"])).cast("int"))).otherwise(w)))
        return F.when(n > 0, F.array_join(turned, " ")).otherwise("")

    return F.when(F.pmod(h, F.lit(10)) == 0, X.let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), of)).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = find_runs(docs.withColumn("text", made_periodic(F.col("text"), F.col("doc_id"))), keep=["doc_id"])
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines = F.array_join(F.concat(F.transform("runs", line), F.array(F.lit(""))), "\n")
    best = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(0))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = -F.col("b.n"), F.col("b.period")
    return rows.select("doc_id", "n_runs", F.col("b.start").alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
