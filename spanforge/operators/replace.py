"""Replacement allocation: one value for each thing in a document, numbered in the order things come."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import text as X
from spanforge.functions import values as V

MODES = ("smart", "mask", "structured", "custom")


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def smart(kind: Column, n: Column) -> Column:
    label = F.coalesce(_looked_up(V.LABELS, kind), F.lit(V.DEFAULT_LABEL))
    numeral = F.when(n <= len(V.NUMERALS), F.get(F.array(*[F.lit(x) for x in V.NUMERALS]), n - 1)).otherwise(n.cast("string"))
    return F.concat(F.lit("["), label, numeral, F.lit("]"))


def structured(kind: Column, n: Column, templates: dict[str, str]) -> Column:
    """By the catalog's template, else the fixed paths, else the type itself."""
    index = F.format_string("%03d", n)
    made = F.concat(F.lit("<"), F.coalesce(_looked_up({k: c for k, (c, _) in V.STRUCTURED.items()}, kind), kind), F.lit("["), index, F.lit("]."), F.coalesce(_looked_up({k: p for k, (_, p) in V.STRUCTURED.items()}, kind), F.lit(V.OTHER_PATH)), F.lit(">"))
    if not templates:
        return made
    return F.coalesce(F.replace(_looked_up(templates, kind), F.lit("{index}"), index), made)


def preset_templates() -> dict[str, str]:
    return {row["id"]: row["tag_template"] for row in V.catalog()}


def _key(s: Column) -> Column:
    return F.coalesce(s["coref_id"], s["text"])


def _firsts(spans: Column) -> Column:
    return X.first_places(F.transform(spans, _key))


def things(spans: Column, custom: Column | None = None, first: Column | None = None) -> Column:
    """(key, text, type, n) of each thing in the order they come; n counts the things of a type, with ``custom`` only those
    that neither it nor the span gives a value."""
    own = (lambda s: s["replacement"]) if custom is not None else (lambda s: F.lit(None).cast("string"))
    uses = (lambda t: F.lit(True)) if custom is None else (lambda t: ~F.coalesce(F.map_contains_key(custom, t["text"]), F.lit(False)) & t["own"].isNull())
    chosen = lambda f: F.filter(spans, lambda s, i: F.get(f, i) == i)
    told = lambda f: F.transform(chosen(f), lambda s: F.struct(_key(s).alias("key"), s["text"].alias("text"), s["type"].alias("type"), own(s).alias("own")))
    numbers = lambda all_: X.numbered(F.transform(all_, lambda t: F.struct(t["type"].alias("kind"), uses(t).alias("counts"))))
    with_n = lambda all_: X.let(numbers(all_), lambda n: F.transform(all_, lambda t, i: t.withField("n", F.get(n, i))))
    return X.let(_firsts(spans) if first is None else first, lambda f: X.let(told(f), with_n))


def allocate(df: DataFrame, mode: str = "smart", *, spans_col: str = "spans", custom_col: str | None = None, templates: dict[str, str] | None = None, selected_only: bool = True, compat: bool = False) -> DataFrame:
    """Sets each span's ``replacement`` and adds ``entity_map`` (text -> replacement, the first of a text wins).

    Custom mode takes the value of ``custom_col`` (map) for the text, else the span's own replacement, else a smart one; things
    with a value of their own take no number, except with ``compat``.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    spans = F.col(spans_col)
    fields = df.select(F.explode(spans_col).alias("s")).schema["s"].dataType.fieldNames()
    if "selected" in fields and selected_only:
        spans = F.filter(spans, lambda s: F.coalesce(s["selected"], F.lit(True)))
    if "replacement" not in fields:
        spans = F.transform(spans, lambda s: s.withField("replacement", F.lit(None).cast("string")))
    custom = F.col(custom_col) if custom_col else F.create_map().cast("map<string,string>")
    templates = preset_templates() if templates is None else templates

    def value(s: Column, t: Column) -> Column:
        if mode == "mask":
            return X.masked(t["type"], t["text"])
        if mode == "structured":
            return F.when(t["key"].rlike("^<.*>$"), t["key"]).otherwise(structured(t["type"], t["n"], templates))
        if mode == "custom":
            return F.coalesce(F.element_at(custom, t["text"]), s["replacement"], smart(t["type"], t["n"]))
        return smart(t["type"], t["n"])

    def filled(all_: Column, first: Column, known: Column) -> Column:
        thing = lambda n, i: F.get(known, F.get(n, F.get(first, i)) - 1)
        return X.let(X.ranks(first), lambda n: F.transform(all_, lambda s, i: s.withField("replacement", X.let(thing(n, i), lambda t: value(s, t)))))

    def mapped(done: Column) -> Column:
        own = lambda f: F.filter(done, lambda s, i: F.get(f, i) == i)
        texts = X.first_places(F.transform(done, lambda s: s["text"]))
        pairs = X.let(texts, lambda f: F.transform(own(f), lambda s: F.struct(s["text"].alias("key"), s["replacement"].alias("value"))))
        return F.struct(done.alias("spans"), F.map_from_entries(pairs).alias("entity_map"))

    counted = custom if mode == "custom" and not compat else None
    with_first = lambda all_, first: X.let(things(all_, counted, first), lambda known: X.let(filled(all_, first, known), mapped))
    both = X.let(spans, lambda all_: X.let(_firsts(all_), lambda first: with_first(all_, first)))
    return df.withColumn("_both", both).withColumns({spans_col: F.col("_both.spans"), "entity_map": F.col("_both.entity_map")}).drop("_both")


def fallback_map(spans: Column, mode: str = "smart") -> Column:
    """The map a screen shows before the server answers: numbers go up with each span, and the last value of a text stays."""
    made = {"smart": lambda s, n: smart(s["type"], n), "mask": lambda s, n: X.masked(s["type"], s["text"]), "structured": lambda s, n: structured(s["type"], n, {})}[mode]
    numbers = lambda all_: X.numbered(F.transform(all_, lambda s: F.struct(s["type"].alias("kind"), F.lit(True).alias("counts"))))
    pairs = lambda all_: X.let(numbers(all_), lambda n: F.transform(all_, lambda s, i: F.struct(s["text"].alias("key"), made(s, F.get(n, i)).alias("value"))))
    # The last of equal keys is the first from behind.
    back = lambda ps: X.first_places(F.transform(F.reverse(ps), lambda p: p["key"]))
    last = lambda ps: X.let(back(ps), lambda f: F.filter(ps, lambda p, i: F.get(f, F.size(ps) - 1 - i) == F.size(ps) - 1 - i))
    chosen = F.filter(spans, lambda s: F.coalesce(s["selected"], F.lit(True)) & (F.length(s["text"]) > 0))
    return F.map_from_entries(X.let(chosen, lambda all_: X.let(pairs(all_), last)))


def with_slices(text: Column, spans: Column, mapping: Column) -> Column:
    """The map with a key for what really stands at a span's offsets, where that differs from its text."""
    n = F.length(text)
    good = F.filter(spans, lambda s: (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= n) & F.map_contains_key(mapping, s["text"]))
    pairs = F.transform(good, lambda s: F.struct(F.substr(text, s["start"] + 1, s["end"] - s["start"]).alias("key"), F.element_at(mapping, s["text"]).alias("value")))
    new = lambda ps: F.filter(ps, lambda p, i: ~F.map_contains_key(mapping, p["key"]) & ~F.exists(F.slice(ps, F.lit(1), i), lambda o: o["key"] == p["key"]))
    return F.map_concat(mapping, F.map_from_entries(X.let(pairs, new)))


def select_spans(df: DataFrame, chosen: Column | None = None, *, spans_col: str = "spans") -> DataFrame:
    """Sets ``selected`` of all spans to ``chosen`` (null: the other of what it was)."""
    set_ = (lambda s: ~F.coalesce(s["selected"], F.lit(True))) if chosen is None else (lambda s: chosen)
    return df.withColumn(spans_col, F.transform(spans_col, lambda s: s.withField("selected", set_(s))))


def remove_spans(df: DataFrame, gone: Column, *, spans_col: str = "spans") -> DataFrame:
    """Without the spans whose place (from 0) is in the array ``gone``."""
    return df.withColumn(spans_col, F.filter(spans_col, lambda s, i: ~F.coalesce(F.array_contains(gone, i), F.lit(False))))


def normalized(df: DataFrame, *, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """Spans cut to their text, with defaults for what is missing; those that end before they start go."""
    n = F.length(text_col)
    bound = lambda x: F.greatest(F.lit(0), F.least(x, n))
    cut = F.transform(spans_col, lambda s: s.withField("start", bound(s["start"])).withField("end", bound(s["end"])).withField("confidence", F.coalesce(s["confidence"], F.lit(1.0))))
    return df.withColumn(spans_col, F.filter(cut, lambda s: s["start"] < s["end"]))


def undone(versions: DataFrame, key: str, order: str, steps: int = 0, redo: int = 0) -> DataFrame:
    """The state of each key ``steps`` versions before its last (at most 50 back, and not before its first), then ``redo`` ahead
    again."""
    from pyspark.sql import Window

    back = max(0, min(steps, 50) - redo) + 1
    recent = versions.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_n") <= back)
    return recent.groupBy(key).agg(F.max_by(F.struct(*versions.columns), "_n").alias("_v")).select("_v.*")
