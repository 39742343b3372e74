"""Expressions over texts and spans; all stay inside the JVM, none moves a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PIECE = "array<struct<start:int,end:int,text:string>>"
#: A code point that stands for no character.
MARK = "\ufdd0"
#: Items of a fold whose results are gathered together.
CHUNK = 256


def let(value: Column, body) -> Column:
    """``body`` of the value, worked out once: inside lambdas a column's expression would be worked out for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(items: Column, state: Column, step, emit, kind: str) -> Column:
    """What ``emit(state, item)`` (an array of ``kind``) gives for each item in turn, as one array; ``step`` is the next state.

    Results are gathered by ``CHUNK`` items: a fold that appends to one array would copy it whole for each item.
    """
    rows = f"array<{kind}>"

    def one(s: Column, x: Column) -> Column:
        return F.struct(step(s["state"], x).alias("state"), F.concat(s["out"], emit(s["state"], x)).alias("out"))

    def chunk(all_: Column, s: Column, k: Column) -> Column:
        zero = F.struct(s["state"].alias("state"), F.array().cast(rows).alias("out"))
        done = F.aggregate(F.slice(all_, k * CHUNK + 1, F.lit(CHUNK)), zero, one)
        return let(done, lambda d: F.struct(d["state"].alias("state"), F.concat(s["out"], F.array(d["out"])).alias("out")))

    def whole(all_: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor(F.greatest(F.size(all_) - 1, F.lit(0)) / CHUNK).cast("int"))
        zero = F.struct(state.alias("state"), F.array().cast(f"array<{rows}>").alias("out"))
        return F.flatten(F.aggregate(chunks, zero, lambda s, k: chunk(all_, s, k), lambda s: s["out"]))

    return let(items, whole)


def first_places(keys: Column) -> Column:
    """For each element the place (from 0) of the first one equal to it; by sorting, not by comparing all with all."""

    def of(placed: Column) -> Column:
        new = lambda p, j: (j == 0) | ~F.get(placed, j - 1)["k"].eqNullSafe(p["k"])
        marked = F.transform(placed, lambda p, j: F.struct(p["i"].alias("i"), new(p, j).alias("new")))
        first = lambda at, m: F.when(m["new"], m["i"]).otherwise(at)
        told = scan(marked, F.lit(0), first, lambda at, m: F.array(F.struct(m["i"].alias("i"), first(at, m).alias("first"))), "struct<i:int,first:int>")
        return F.transform(F.array_sort(told), lambda x: x["first"])

    return let(F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i")))), of)


def ranks(first: Column) -> Column:
    """Of ``first_places``: how many different elements there are up to each place."""
    count = lambda n, new: n + new.cast("int")
    return scan(F.transform(first, lambda f, i: f == i), F.lit(0), count, lambda n, new: F.array(count(n, new)), "int")


def numbered(kinds: Column) -> Column:
    """Of (kind, counts) structs: for each the number of those of its kind up to it that count."""

    def of(placed: Column) -> Column:
        zero = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(0).alias("n"))
        count = lambda s, p: F.when(s["kind"].eqNullSafe(p["kind"]), s["n"]).otherwise(0) + p["counts"].cast("int")
        step = lambda s, p: F.struct(p["kind"].alias("kind"), count(s, p).alias("n"))
        told = scan(placed, zero, step, lambda s, p: F.array(F.struct(p["i"].alias("i"), count(s, p).alias("n"))), "struct<i:int,n:int>")
        return F.transform(F.array_sort(told), lambda x: x["n"])

    return let(F.array_sort(F.transform(kinds, lambda k, i: F.struct(k["kind"].alias("kind"), i.alias("i"), k["counts"].alias("counts")))), of)


def located(text: Column, pattern: str | Column) -> Column:
    """Array of (start, end, text) of the matches that ``finditer`` gives; offsets are code points, ends exclusive.

    One pass of the pattern puts a mark around each match, and texts are parted there; texts that hold the mark take two passes.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    piece = lambda at, p: F.array(F.struct((at + p["gap"]).alias("start"), (at + p["gap"] + p["size"]).alias("end"), p["text"].alias("text")))
    placed = lambda pairs: scan(pairs, F.lit(0), lambda at, p: at + p["gap"] + p["size"], piece, "struct<start:int,end:int,text:string>")
    pair = lambda gap, value: F.struct(F.length(gap).alias("gap"), F.length(value).alias("size"), value.alias("text"))

    def of_parts(parts: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.floor(F.size(parts) / 2).cast("int")), lambda k: pair(F.get(parts, 2 * k - 2), F.get(parts, 2 * k - 1)))
        return F.when(F.size(parts) > 1, placed(pairs)).otherwise(F.array().cast(PIECE))

    gaps, values = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    twice = placed(F.zip_with(F.slice(gaps, F.lit(1), F.size(values)), values, pair))
    once = let(F.split(F.regexp_replace(text, pattern, F.lit(f"{MARK}$0{MARK}")), MARK, -1), of_parts)
    return F.when(text.isNull(), F.array().cast(PIECE)).when(F.contains(text, F.lit(MARK)), twice).otherwise(once)


def sliced(text: Column, ranges: Column) -> Column:
    """The parts of ``text`` at ``ranges`` (array of (a, b), ascending and apart); a part is cut from its chunk's stretch, as
    cutting it from the text would read that from its beginning each time."""

    def chunk(all_: Column, k: Column) -> Column:
        own = F.slice(all_, k * CHUNK + 1, F.lit(CHUNK))
        stretch = lambda r: F.struct(r.alias("r"), r[0]["a"].alias("at"), F.substr(text, r[0]["a"] + 1, F.element_at(r, -1)["b"] - r[0]["a"]).alias("text"))
        return let(let(own, stretch), lambda c: F.transform(c["r"], lambda x: F.substr(c["text"], x["a"] - c["at"] + 1, x["b"] - x["a"])))

    def whole(all_: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / CHUNK).cast("int")), lambda k: chunk(all_, k)))

    return let(ranges, lambda all_: F.when(F.size(all_) > 0, whole(all_)).otherwise(F.array().cast("array<string>")))


def put(text: Column, spans: Column, value) -> Column:
    """``text`` with ``value(span)`` in place of each span (start, end; ascending and apart)."""

    def whole(all_: Column) -> Column:
        ends = F.concat(F.array(F.lit(0)), F.transform(all_, lambda s: s["end"]))
        starts = F.concat(F.transform(all_, lambda s: s["start"]), F.array(F.length(text)))
        gaps = sliced(text, F.zip_with(ends, starts, lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
        values = F.concat(F.transform(all_, value), F.array(F.lit("")))
        return F.array_join(F.zip_with(gaps, values, lambda g, v: F.concat(g, v)), "")

    return let(spans, whole)


def quoted(text: Column) -> Column:
    """A pattern that matches the text itself."""
    return F.concat(F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def any_of(keys: Column) -> Column:
    """A pattern of all keys, the longest first and equal lengths in their order; empty keys are left out."""
    placed = F.transform(F.filter(keys, lambda k: F.length(k) > 0), lambda k, i: F.struct((-F.length(k)).alias("n"), i.alias("i"), k.alias("k")))
    return F.array_join(F.transform(F.array_sort(placed), lambda p: quoted(p["k"])), "|")


def rewritten(text: Column, mapping: Column) -> Column:
    """(text, count): every occurrence of a key replaced by its value in one pass."""
    plain = F.struct(text.alias("text"), F.lit(0).cast("long").alias("count"))

    def of(found: Column, pattern: Column, values: Column) -> Column:
        put = F.concat(F.transform(found, lambda m: F.element_at(values, m)), F.array(F.lit("")))
        joined = F.array_join(F.zip_with(F.split(text, pattern, -1), put, lambda g, v: F.concat(g, v)), "")
        return F.struct(joined.alias("text"), F.size(found).cast("long").alias("count"))

    def with_map(values: Column) -> Column:
        some = F.exists(F.map_keys(values), lambda k: F.length(k) > 0)
        full = let(any_of(F.map_keys(values)), lambda p: let(F.regexp_extract_all(text, p, F.lit(0)), lambda found: of(found, p, values)))
        return F.when(values.isNull() | text.isNull() | ~some, plain).otherwise(full)

    return let(mapping, with_map)


def occurrences(text: Column, part: Column) -> Column:
    """Occurrences of ``part`` that don't overlap."""
    return F.when(F.length(part) == 0, F.length(text) + 1).otherwise(F.floor((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part))).cast("long")


def masked(kind: Column, text: Column) -> Column:
    """The text with what identifies hidden by stars, as its type asks."""
    n = F.length(text)
    stars = lambda k: F.repeat(F.lit("*"), k)
    partial = F.when((kind == "PERSON") & (n >= 2), F.concat(F.left(text, F.lit(1)), stars(n - 1)))
    partial = partial.when(kind == "PERSON", "*")
    partial = partial.when((kind == "PHONE") & (n >= 11), F.concat(F.left(text, F.lit(3)), F.lit("****"), F.right(text, F.lit(4))))
    partial = partial.when((kind == "ID_CARD") & (n >= 18), F.concat(F.left(text, F.lit(6)), F.lit("********"), F.right(text, F.lit(4))))
    partial = partial.when((kind == "BANK_CARD") & (n >= 16), F.concat(stars(n - 4), F.right(text, F.lit(4))))
    return partial.otherwise(stars(n))


def round1(x: Column) -> Column:
    """One decimal, by the exact value of the double and halves to even."""
    whole = F.floor(x).cast("double")
    part = x - whole
    # 20 times the fraction in two exact terms, so its distance to the next odd number (a half) has the right sign.
    high = F.floor(part * (1 << 26)) / (1 << 26)
    high, low = high * 20, (part - high) * 20
    tenths = F.floor((high + low) / 2).cast("double")
    over = (high - (2 * tenths + 1)) + low
    up = F.when(over > 0, 1.0).when(over < 0, 0.0).otherwise((whole * 10 + tenths) % 2)
    return (whole * 10 + tenths + F.abs(up)) / 10


def slice_is(text: Column, start: Column, end: Column, part: Column) -> Column:
    return (start >= 0) & (start < end) & (end <= F.length(text)) & (F.substr(text, start + 1, end - start) == part)


def html_text(html: Column) -> Column:
    """Text of HTML: style and script dropped, tags as a space, white space runs as one, ends stripped."""
    for pattern in (r"(?isU)<style[^>]*>.*?</style>", r"(?isU)<script[^>]*>.*?</script>"):
        html = F.regexp_replace(html, pattern, "")
    return strip(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"(?U)\s+", " "))


def rtf_text(rtf: Column) -> Column:
    """Text of RTF: control words and braces dropped, white space runs as one, ends stripped."""
    plain = F.regexp_replace(F.regexp_replace(rtf, r"(?U)\\[a-z]+\d*\s?", ""), r"[{}]", "")
    return strip(F.regexp_replace(plain, r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def json_map(column: Column, schema: str) -> Column:
    """An object column from JSON text; what is no object gives null."""
    return F.from_json(F.when(strip(column).startswith("{"), column), schema)


def json_block(text: Column) -> Column:
    """The text if it is an object, else its first block from a brace to the last brace."""
    whole = strip(text)
    return F.when(whole.startswith("{") & whole.endswith("}"), whole).otherwise(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")))


def capped_backoff(base: float, attempt: Column, cap: float = 10.0) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(cap))


def hex_rgb(color: Column) -> Column:
    digits = F.regexp_replace(color, "^#", "")
    part = lambda k: F.conv(F.substring(digits, k, 2), 16, 10).cast("int")
    return F.when(digits.rlike("^[0-9a-fA-F]{6}$"), F.array(part(1), part(3), part(5)))
