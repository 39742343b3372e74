"""Span detectors: patterns, dictionaries, tags and pluggable models, as arrays of spans on the document's row.

A span is a struct (text, type, start, end, confidence, source, priority, coref_id); offsets are code points, ends exclusive.
Detectors add no rows and move none; ``explode_spans`` gives a row per span where that is wanted.
"""

from __future__ import annotations

import re
import subprocess
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.functions import text as X
from spanforge.functions import values as V
from spanforge.operators.plug import attempted

FIELDS = "text:string,type:string,start:int,end:int,confidence:double,source:string,priority:int,coref_id:string"
SPANS = f"array<struct<{FIELDS}>>"
MAX_CHARS = 500_000


@dataclass(frozen=True)
class Rule:
    """A pattern of a type; ``validator`` gets the matched text and says whether it counts.  ``needs`` is a text that every
    match contains and ``digits`` says that it contains a digit: texts without skip the pattern."""

    type: str
    pattern: str
    priority: int = 5
    ignore_case: bool = True
    validator: Callable[[Column], Column] | None = None
    needs: str | None = None
    digits: bool = False

    @property
    def java(self) -> str:
        # A class of characters without case needs no folding, which Java does for each of them at each place.
        plain = lambda m: f"(?-i:{m[0]})" if m[0].lower() == m[0].upper() else m[0]
        return "(?iU)" + re.sub(r"(?<!\\)\[[^\[\]\\^&-]+\]", plain, self.pattern) if self.ignore_case else "(?U)" + self.pattern


_NEEDS = {"EMAIL": "@", "CASE_NUMBER": "号", "URL": "://"}
_DIGITS = {"ID_CARD", "PHONE", "BANK_CARD", "CASE_NUMBER", "DATE", "IP_ADDRESS"}
BUILTIN = [Rule(*row, needs=_NEEDS.get(row[0]), digits=row[0] in _DIGITS) for row in V.BUILTIN_PATTERNS]
OCR_RULES = [Rule(kind, pattern, 0, False) for kind, pattern in V.OCR_PATTERNS]


def supported_types(rules: list[Rule] = BUILTIN) -> list[str]:
    return list(dict.fromkeys(r.type for r in rules))


def checked_rule(spark: SparkSession, rule: Rule) -> Rule:
    """The rule, if the engine takes its pattern; ValueError if not."""
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(rule.java)
    except Exception as e:
        raise ValueError(f"{rule.type}: {rule.pattern!r} is no pattern") from e
    return rule


def guarded_rule(spark: SparkSession, rule: Rule, seconds: float = 2.0, probe: str = "a" * 25 + "!") -> Rule:
    """As ``checked_rule``; also refuses a pattern that takes longer than ``seconds`` over a probe, in a process that is ended."""
    checked_rule(spark, rule)
    code = "import re, sys; re.search(sys.argv[1], sys.argv[2], re.IGNORECASE)"
    try:
        subprocess.run([sys.executable, "-c", code, rule.pattern, probe], timeout=seconds, capture_output=True, check=False)
    except subprocess.TimeoutExpired as e:
        raise ValueError(f"{rule.type}: {rule.pattern!r} takes more than {seconds} s over {len(probe)} characters") from e
    return rule


def luhn(text: Column) -> Column:
    """Whether the digits of a card number pass the check digit."""
    digits = F.transform(F.filter(F.split(text, ""), lambda c: c.rlike("[0-9]")), lambda c: c.cast("int"))
    doubled = F.transform(F.reverse(digits), lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _span(found: Column, kind: Column, confidence: float, source: str, priority: int = 0, coref: Column | None = None) -> Column:
    fields = {"text": found["text"], "type": kind, "start": found["start"], "end": found["end"], "confidence": F.lit(confidence), "source": F.lit(source), "priority": F.lit(priority), "coref_id": coref if coref is not None else F.lit(None).cast("string")}
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def _of_rule(text: Column, rule: Rule) -> Column:
    found = X.located(text, rule.java)
    if rule.validator:
        found = F.filter(found, lambda m: rule.validator(m["text"]))
    spans = F.transform(found, lambda m: _span(m, F.lit(rule.type), 0.99, "regex", rule.priority)).cast(SPANS)
    # Texts that cannot have a hit skip the pattern.
    there = F.lit(True)
    if rule.digits:
        there = text.rlike(r"\p{Nd}")
    if rule.needs:
        there = F.contains(text, F.lit(rule.needs)) & there
    return F.when(there, spans).otherwise(F.array().cast(SPANS))


def first_of_equal(spans: Column) -> Column:
    """Of spans with the same offsets the first; their order stays."""
    places = lambda all_: X.first_places(F.transform(all_, lambda s: F.struct(s["start"], s["end"])))
    return X.let(spans, lambda all_: X.let(places(all_), lambda first: F.filter(all_, lambda s, i: F.get(first, i) == i)))


def leftmost(spans: Column) -> Column:
    """Spans by start, of equal starts the higher priority first, leaving out what begins before the last kept one ends."""
    placed = F.array_sort(F.transform(spans, lambda s, i: F.struct(s["start"].alias("a"), (-s["priority"]).alias("b"), i.alias("i"), s.alias("s"))))
    free = lambda upto, p: p["s"]["start"] >= upto
    emit = lambda upto, p: F.when(free(upto, p), F.array(p["s"])).otherwise(F.array().cast(SPANS))
    return X.scan(placed, F.lit(0), lambda upto, p: F.when(free(upto, p), p["s"]["end"]).otherwise(upto), emit, SPANS[len("array<") : -1])


def find_patterns(df: DataFrame, rules: list[Rule] = BUILTIN, types: list[str] | None = None, *, text_col: str = "text", out_col: str = "spans", resolve: bool = True) -> DataFrame:
    """Adds the matches of the rules, in the order of ``types`` (all: of the rules), resolved to spans that don't overlap."""
    order = types if types is not None else supported_types(rules)
    text = F.col(text_col)
    parts = [_of_rule(text, r) for kind in order for r in rules if r.type == kind]
    found = first_of_equal(F.concat(*parts)) if len(parts) > 1 else parts[0] if parts else F.array().cast(SPANS)
    return df.withColumn(out_col, leftmost(found) if resolve and parts else found)


def find_terms(df: DataFrame, terms: dict[str, list[str]], *, text_col: str = "text", out_col: str = "spans") -> DataFrame:
    """Adds every occurrence of the terms of each type, sorted by start; a (type, term) that occurs numbers ``coref_{n}`` from 0."""
    text = F.col(text_col)
    listed = [(kind, term) for kind, own in terms.items() for term in dict.fromkeys(own) if term]
    spans = F.array().cast(SPANS)
    number = F.lit(0)
    for kind, term in listed:
        there = F.contains(text, F.lit(term))
        found = _as_spans(X.located(text, X.quoted(F.lit(term))), kind, F.concat(F.lit("coref_"), number.cast("string")))
        spans = F.concat(spans, F.when(there, found).otherwise(F.array().cast(SPANS)))
        number = number + F.when(there, 1).otherwise(0)
    placed = F.array_sort(F.transform(spans, lambda s, i: F.struct(s["start"].alias("a"), i.alias("i"), s.alias("s"))))
    return df.withColumn(out_col, F.transform(placed, lambda p: p["s"]))


def _as_spans(found: Column, kind: str, coref: Column) -> Column:
    return F.transform(found, lambda m: _span(m, F.lit(kind), 0.95, "has", 0, coref)).cast(SPANS)


def find_entities(df: DataFrame, entities_col: str, *, text_col: str = "text", out_col: str = "spans") -> DataFrame:
    """As ``find_terms`` for each row's own ``map<type, array<term>>``, such as a model gives."""
    text = F.col(text_col)
    pairs = F.flatten(F.transform(F.map_entries(entities_col), lambda e: F.transform(F.array_distinct(e["value"]), lambda t: F.struct(type_id(e["key"]).alias("kind"), t.alias("term")))))
    there = F.filter(pairs, lambda p: (F.length(p["term"]) > 0) & F.contains(text, p["term"]))
    spans = F.flatten(F.transform(there, lambda p, n: F.transform(X.located(text, X.quoted(p["term"])), lambda m: _span(m, p["kind"], 0.95, "has", 0, F.concat(F.lit("coref_"), n.cast("string")))))).cast(SPANS)
    placed = F.array_sort(F.transform(spans, lambda s, i: F.struct(s["start"].alias("a"), i.alias("i"), s.alias("s"))))
    return df.withColumn(out_col, F.transform(placed, lambda p: p["s"]))


def find_first(df: DataFrame, entities_col: str, *, text_col: str = "text", out_col: str = "spans") -> DataFrame:
    """As ``find_entities``, with the first occurrence of each term alone; ``coref_id`` is ``has_{n}`` in the order they come."""
    text = F.col(text_col)
    pairs = F.flatten(F.transform(F.map_entries(entities_col), lambda e: F.transform(e["value"], lambda t: F.struct(type_id(e["key"]).alias("kind"), t.alias("term")))))
    there = F.filter(pairs, lambda p: F.contains(text, p["term"]))
    spans = F.transform(there, lambda p, n: _span({"text": p["term"], "start": F.instr(text, p["term"]) - 1, "end": F.instr(text, p["term"]) - 1 + F.length(p["term"])}, p["kind"], 0.95, "has", 0, F.concat(F.lit("has_"), n.cast("string")))).cast(SPANS)
    placed = F.array_sort(F.transform(spans, lambda s, i: F.struct(s["start"].alias("a"), i.alias("i"), s.alias("s"))))
    return df.withColumn(out_col, F.transform(placed, lambda p: p["s"]))


def merged_tags(first: Column, second: Column) -> Column:
    """Two maps of tags to terms as one: a tag's terms in the order they come, each once."""
    none = F.array().cast("array<string>")
    return F.map_zip_with(first, second, lambda _, a, b: F.array_union(F.coalesce(a, none), F.coalesce(b, none)))


def parsed_entities(reply: Column) -> Column:
    """A model's reply as ``map<type, array<term>>``: the object, or the first block in braces, or empty."""
    found = F.from_json(X.json_block(reply), "map<string,array<string>>")
    return F.coalesce(found, F.create_map().cast("map<string,array<string>>"))


def type_id(name: Column) -> Column:
    """A type's id by one of its names, else the name in capitals."""
    pairs = [F.lit(x) for kind, names in V.ALIASES.items() for alias in names for x in (alias, kind)]
    return F.coalesce(F.element_at(F.create_map(*pairs), name), F.upper(name))


def type_name(kind: Column) -> Column:
    """The name a model is asked by, else the id."""
    pairs = [F.lit(x) for own, names in V.ALIASES.items() for x in (own, names[0])]
    return F.coalesce(F.element_at(F.create_map(*pairs), kind), kind)


Detector = Callable[[list[str], list[list[str]]], list[dict[str, list[str]]]]


def find_with(df: DataFrame, make: Callable[[], Detector], types: list[str], *, text_col: str = "text", out_col: str = "entities", attempts: int = 3, base: float = 0.1) -> DataFrame:
    """Adds what a model says, by batches: ``make`` builds it once in each worker; a batch that fails ``attempts`` times (with
    growing waits between) gives no entities and ``recognition_failed``."""
    schema = T.StructType.fromJson(df.schema.jsonValue()).add(out_col, T.MapType(T.StringType(), T.ArrayType(T.StringType()))).add("recognition_failed", T.BooleanType())
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        kind = pa.map_(pa.string(), pa.list_(pa.string()))
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            found, _ = attempted(lambda: model(texts, [types] * len(texts)), attempts, base)  # noqa: B023
            rows = [list(x.items()) for x in found] if found is not None else [[] for _ in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind), pa.array([found is None] * len(texts))], [*batch.schema.names, out_col, "recognition_failed"])

    return df.mapInArrow(run, schema)


TAG = r"<([^\[\]<>]+)\[(\d+)\]\.([^.<>]+)\.([^<>]+)>"


def parsed_tag(tag: Column) -> Column:
    """Parts of a structured tag ``<type[NNN].sub.attribute>``, or null."""
    part = lambda k: F.regexp_extract(tag, f"^{TAG}$", k)
    return F.when(tag.rlike(f"^{TAG}$"), F.struct(part(1).alias("type"), part(2).cast("int").alias("index"), part(3).alias("sub"), part(4).alias("attribute")))


def tags_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TAG), F.lit(0))


def made_tag(kind: Column, index: Column, sub: Column, attribute: Column) -> Column:
    return F.format_string("<%s[%03d].%s.%s>", kind, index, sub, attribute)


def find_tagged(df: DataFrame, *, text_col: str, masked_col: str, tags_col: str, out_col: str = "spans") -> DataFrame:
    """Spans of ``text`` for the tags found in its masked form, by ``tags`` (map<tag, array<term>>): of a tag's terms the first
    that occurs at a place not taken yet."""
    text = F.col(text_col)
    zero = F.array().cast(SPANS)

    def step(out: Column, tag: Column) -> Column:
        places = F.flatten(F.transform(F.coalesce(F.element_at(tags_col, tag), F.array().cast("array<string>")), lambda t: F.when(F.length(t) > 0, X.located(text, X.quoted(t))).otherwise(F.array().cast(X.PIECE))))
        free = F.filter(places, lambda p: ~F.exists(out, lambda s: (p["start"] < s["end"]) & (s["start"] < p["end"])))
        made = F.transform(F.slice(free, 1, 1), lambda m: _span(m, F.upper(F.regexp_extract(tag, TAG, 1)), 0.96, "has", 0, tag)).cast(SPANS)
        return F.concat(out, made)

    return df.withColumn(out_col, F.aggregate(tags_in(F.col(masked_col)), zero, step))


def test_pattern(df: DataFrame, pattern: str, *, text_col: str = "text", id_cols: list[str]) -> DataFrame:
    """A row per match of any pattern, with its groups as an array; a pattern the engine refuses is a ValueError."""
    rule = checked_rule(df.sparkSession, Rule("TEST", pattern, 0, False))
    one = df.select(*id_cols, F.posexplode(X.located(F.col(text_col), rule.java)).alias("n", "m"))
    count = int(df.sparkSession.sparkContext._jvm.java.util.regex.Pattern.compile(rule.java).matcher("").groupCount())
    groups = F.array(*[F.regexp_extract(F.col("m.text"), rule.java, k) for k in range(1, count + 1)]).cast("array<string>")
    return one.select(*id_cols, "n", F.col("m.text").alias("text"), F.col("m.start").alias("start"), F.col("m.end").alias("end"), groups.alias("groups"))


def truncated(df: DataFrame, *, text_col: str = "text", most: int = MAX_CHARS) -> DataFrame:
    """Cuts texts to ``most`` characters and says so."""
    return df.withColumns({text_col: F.substring(F.col(text_col), 1, most), "was_truncated": F.coalesce(F.length(text_col) > most, F.lit(False))})


def selected_types(catalog: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """Catalog rows for the asked ids, in that order and even if disabled; without ids all that are enabled."""
    if not ids:
        return catalog.where("enabled").orderBy("order", "id")
    asked = catalog.sparkSession.createDataFrame([(k, x) for k, x in enumerate(dict.fromkeys(ids))], "pos int, id string")
    return catalog.join(asked, "id").orderBy("pos").drop("pos")


def assign_pages(df: DataFrame, *, spans_col: str = "spans", pages_col: str = "pages") -> DataFrame:
    """Gives each span its page, from 1; pages are joined by two characters, and a span that starts there is on the next page."""
    cumulative = F.aggregate(pages_col, F.array().cast("array<int>"), lambda out, p: F.concat(out, F.array(F.when(F.size(out) > 0, F.element_at(out, -1) + 2).otherwise(0) + F.length(p))))
    page = lambda s, e: F.least(F.size(F.filter(e, lambda x: x <= s["start"])) + 1, F.greatest(F.size(e), F.lit(1)))
    return df.withColumn(spans_col, X.let(cumulative, lambda e: F.transform(spans_col, lambda s: s.withField("page", page(s, e)))))


def explode_spans(df: DataFrame, *id_cols: str, spans_col: str = "spans") -> DataFrame:
    # From a plain ``inline`` Spark infers a filter on the array's size, which makes all spans once more.
    return df.select(*id_cols, F.posexplode_outer(spans_col).alias("_pos", "_span")).where("_pos IS NOT NULL").select(*id_cols, "_span.*")


def entity_summary(df: DataFrame, *id_cols: str, spans_col: str = "spans") -> DataFrame:
    return explode_spans(df, *id_cols, spans_col=spans_col).groupBy(*id_cols, "type").agg(F.count("*").alias("n"))


def overlapping(spans: Column, start: Column, end: Column, *, compat: bool = False) -> Column:
    """Whether a selection meets a span; ``compat`` misses spans strictly inside it."""
    if compat:
        return F.exists(spans, lambda s: ((s["start"] <= start) & (start < s["end"])) | ((s["start"] < end) & (end <= s["end"])))
    return F.exists(spans, lambda s: (s["start"] < end) & (start < s["end"]))


def add_manual(df: DataFrame, start: Column, end: Column, kind: Column, *, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """Adds a span a person selected, if it has two characters and meets no other."""
    made = F.struct(F.lit(None).alias("_"), start.cast("int").alias("start"), end.cast("int").alias("end"), F.substr(F.col(text_col), start + 1, end - start).alias("text"))
    good = (end - start >= 2) & ~overlapping(F.col(spans_col), start, end)
    return df.withColumn(spans_col, F.when(good, F.concat(spans_col, F.array(_span(made, kind, 1.0, "manual")).cast(SPANS))).otherwise(F.col(spans_col)))


def long_enough(spans: Column, least: dict[str, int] | None = None, default: int = 2, skip: list[str] | None = None) -> Column:
    """Spans of texts from images: not of a type only seen in pictures, and with enough characters for their type."""
    least = {"ADDRESS": 4} if least is None else least
    asked = F.lit(default)
    kept = F.filter(spans, lambda s: ~s["type"].isin(skip or []))

    def enough(s: Column) -> Column:
        n = asked
        for kind, k in least.items():
            n = F.when(s["type"] == kind, k).otherwise(n)
        return F.length(X.strip(s["text"])) >= n

    return F.filter(kept, enough)
