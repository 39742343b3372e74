"""Dictionaries of any size: every occurrence of many terms in texts, and their replacement in one pass.

The terms are a table, and no plan grows with them.  Their bytes are measured first:

* Up to ``AUTOMATON_BYTES`` they become one Aho-Corasick automaton (a trie in arrays, with failure and output links), which is
  broadcast; texts are scanned in place, without a shuffle.  A batch is cut into pieces that overlap by the longest term and that
  advance together, a byte of each at a time, so a step is a few array operations over thousands of pieces.
* Beyond that it is a join.  Terms are hashed by their first bytes, as many as the length's class says (each length below
  ``EXACT`` bytes, then powers of two), and a bitmap of fixed size says which hashes there are.  Texts give the places whose hash
  is in the bitmap, for each class, by prefix sums; those few are shuffled to the terms of that hash, compared byte by byte, and
  gathered by row.  A frequent term is one row on the terms' side, and its places may be split.

Both give the same spans.  Null and empty texts have none; null and empty terms are left out; a term that is there twice with
one type counts once; an empty table of terms gives empty arrays.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.functions import text as X
from spanforge.functions.arrays import buffers, grouped, steps
from spanforge.operators.detect import SPANS, leftmost
from spanforge.sources import shared

#: Of all terms together.  A state takes 20 bytes, and terms that share beginnings have fewer states than bytes.
AUTOMATON_BYTES = 16 << 20
STEP_BYTES, PIECE = 4 << 20, 256
#: States whose every move is listed.
DENSE = 1 << 14
#: Bits of the bitmaps, the lengths that are classes of their own, and bytes of the first look.
MAP_BITS, EXACT, LOOK = 27, 64, 4
#: What spans of terms say of themselves.
CONFIDENCE, SOURCE = 0.95, "has"
ALL, APART, LONGEST = "all", "apart", "longest"
HIT = "array<struct<start:int,end:int,text:string,type:string,pos:long,value:string,number:int>>"


class Automaton:
    """Of sorted, different, non-empty byte strings.  State 0 is the root; states of one depth have neighbouring numbers, and so
    have the children of one state, in the order of their bytes."""

    def __init__(self, terms: pa.Array):
        body, offsets = buffers(terms)
        size = np.diff(offsets)
        self.longest = int(size.max(initial=0))
        node, alive, keys, self.starts = np.zeros(len(size), np.int64), np.arange(len(size)), [], [0, 1]
        ends = []
        for depth in range(self.longest):
            alive = alive[size[alive] > depth]
            key = node[alive] * 256 + body[offsets[alive] + depth]
            new = np.append(True, key[1:] != key[:-1])
            node[alive] = self.starts[-1] + np.cumsum(new) - 1
            keys.append(key[new])
            self.starts.append(self.starts[-1] + int(new.sum()))
            done = alive[size[alive] == depth + 1]
            ends.append((node[done], done))
        keys = np.concatenate([np.zeros(0, np.int64), *keys])
        n = len(keys) + 1
        # Child k of all is state k + 1; those of a state are first[state] to first[state + 1].
        self.first, self.label = np.searchsorted(keys, np.arange(n + 1) << 8).astype(np.int32), (keys & 255).astype(np.uint8)
        self.term, self.link, self.fail = np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
        for nodes, done in ends:
            self.term[nodes] = done
        self.dense = np.zeros((min(n, DENSE), 256), np.int32)
        for a, b in zip(self.starts[:-1], self.starts[1:]):
            own = np.arange(a, b)
            if a > 1:
                self.fail[own] = self.step(self.fail[keys[own - 1] >> 8], self.label[own - 1])
            back = self.fail[own]
            self.link[own] = np.where(self.term[back] >= 0, back, self.link[back])
            listed = own[own < len(self.dense)]
            if len(listed):
                self.dense[listed] = self.dense[self.fail[listed]] if a else 0
                child = np.arange(self.first[listed[0]], self.first[listed[-1] + 1])
                self.dense[keys[child] >> 8, self.label[child]] = child + 1
        self.ends = (self.term >= 0) | (self.link > 0)

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next state of each."""
        out = self.dense[np.minimum(state, len(self.dense) - 1), byte]
        todo = np.flatnonzero(state >= len(self.dense))
        at, byte = state[todo], byte[todo]
        while len(todo):
            child, end = self.first[at], self.first[at + 1]
            there, look = np.zeros(len(at), bool), np.flatnonzero(child < end)
            while len(look):
                label = self.label[child[look]]
                same = look[label == byte[look]]
                out[todo[same]], there[same] = child[same] + 1, True
                look = look[label < byte[look]]
                child[look] += 1
                look = look[child[look] < end[look]]
            todo, at, byte = todo[~there], self.fail[at[~there]], byte[~there]
            shallow = at < len(self.dense)
            out[todo[shallow]] = self.dense[at[shallow], byte[shallow]]
            todo, at, byte = todo[~shallow], at[~shallow], byte[~shallow]
        return out

    def scan(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, end, term) of all occurrences, in no order."""
        size, piece = np.diff(offsets), max(PIECE, 4 * self.longest)
        count = -(-size // piece)
        text = np.repeat(np.arange(len(size)), count)
        start = offsets[text] + (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * piece
        end = np.minimum(start + piece, offsets[text + 1])
        begin = np.maximum(start - self.longest + 1, offsets[text])
        order = np.argsort(begin - end, kind="stable")
        text, start, begin, length = text[order], start[order], begin[order], (end - begin)[order]
        state, found = np.zeros(len(order), np.int32), []
        for t in range(int(length.max(initial=0))):
            m = int(np.searchsorted(-length, -t, "left"))
            at = begin[:m] + t
            state[:m] = now = self.step(state[:m], body[at])
            hit = np.flatnonzero(self.ends[now] & (at >= start[:m]))
            if len(hit):
                found.append((text[hit], at[hit] + 1, now[hit]))
        texts, ends, at = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        parts = []
        while len(at):
            own = self.term[at] >= 0
            parts.append((texts[own], ends[own], self.term[at][own]))
            at = self.link[at]
            texts, ends, at = texts[at > 0], ends[at > 0], at[at > 0]
        return tuple(np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3


def apart(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of occurrences sorted by key, then start: which ones a search from the left would give, that goes on behind each match."""
    kept = np.ones(len(key), bool)
    near = np.flatnonzero((key[1:] == key[:-1]) & (start[1:] < end[:-1])) + 1
    for k in near:  # only where occurrences of one term overlap
        j = k - 1
        while not kept[j]:
            j -= 1
        kept[k] = start[k] >= end[j]
    return kept


def longest_first(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of occurrences: those that a walk from the left takes, the longest at each place, going on behind it; in order."""
    order = np.lexsort((-end, start, text))
    text, start, end = text[order], start[order], end[order]
    first = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (start[1:] != start[:-1]))) if len(text) else np.zeros(0, np.int64)
    width = int(end.max(initial=0)) + 1
    place, behind = text[first] * width + start[first], np.searchsorted(text[first] * width + start[first], text[first] * width + end[first])
    kept, k, behind = [], 0, behind.tolist()
    while k < len(place):
        kept.append(k)
        k = behind[k]
    return order[first[kept]]


def _entries(terms: DataFrame, type_col: str, term_col: str, pos_col: str | None, value_col: str | None) -> DataFrame:
    """type, text, pos, value: each (type, term) once, at its smallest position; without positions by type, then term."""
    pos = F.col(pos_col).cast("long") if pos_col else F.lit(None).cast("long")
    value = F.col(value_col).cast("string") if value_col else F.lit(None).cast("string")
    rows = terms.select(F.col(type_col).cast("string").alias("type"), F.col(term_col).cast("string").alias("text"), pos.alias("pos"), value.alias("value")).where(F.length("text") > 0)
    return rows.groupBy("type", "text").agg(F.min("pos").alias("pos"), F.min_by("value", F.struct("pos", "value")).alias("value"))


class Entries:
    """A table (text, type, pos, value) sorted by text, and what a worker builds of it once."""

    def __init__(self, table: pa.Table):
        self.table = table

    @functools.cached_property
    def built(self) -> tuple[Automaton, np.ndarray, np.ndarray, np.ndarray]:
        """(automaton, for each of its terms the first entry, its size in bytes, for each entry its place by position)."""
        body, offsets = buffers(self.table.column("text").combine_chunks())
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(body)]).dictionary_encode()
        first = np.searchsorted(coded.indices.to_numpy(), np.arange(len(coded.dictionary) + 1))
        order = pc.sort_indices(self.table, [("pos", "ascending"), ("type", "ascending"), ("text", "ascending")]).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return Automaton(coded.dictionary), first, np.diff(buffers(coded.dictionary)[1]), rank


def _scanned(df: DataFrame, rows: pa.Table, text_col: str, out_col: str, mode: str, as_spans: bool) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(Entries(rows))
    place, names, kind = df.columns.index(text_col), [*df.columns, out_col], T._parse_datatype_string(SPANS if as_spans else HIT)
    fields = kind.elementType.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, (automaton, first, sizes, rank) = sent.value.table, sent.value.built
        for batch in batches:
            body, offsets = buffers(batch.column(place))
            for a, b in steps(offsets, STEP_BYTES):
                part, at = body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                text, end, term = automaton.scan(part, at)
                start = end - sizes[term]
                if mode == LONGEST:
                    kept = longest_first(text, start, end)
                    text, start, end, term = (x[kept] for x in (text, start, end, term))
                count = first[term + 1] - first[term]
                entry = np.repeat(first[term], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                text, start, end = (np.repeat(x, count) for x in (text, start, end))
                if mode == APART:
                    order = np.lexsort((start, entry, text))
                    text, start, end, entry = (x[order] for x in (text, start, end, entry))
                    kept = apart(text * len(table) + entry, start, end)
                    text, start, end, entry = (x[kept] for x in (text, start, end, entry))
                order = np.lexsort((rank[entry], end, start, text))
                text, start, end, entry = (x[order] for x in (text, start, end, entry))
                # Numbers of the entries of a text, in the order of positions.
                there, number = np.unique(text * len(table) + rank[entry], return_inverse=True)
                number = number - np.searchsorted(there, text * len(table))
                lead = np.append(0, np.cumsum((part & 0xC0) != 0x80))
                points = lambda x: pa.array((lead[x] - lead[at[text]]).astype(np.int32))  # noqa: B023, E731
                own, n = table.take(pa.array(entry)), len(entry)
                made = {"start": points(start), "end": points(end), "number": pa.array(number.astype(np.int32))} | {c: own.column(c).combine_chunks() for c in ("text", "type", "pos", "value")}
                if as_spans:
                    named = pa.array([f"coref_{k}" for k in range(int(number.max(initial=-1)) + 1)], pa.string())
                    made |= {"confidence": pa.array(np.full(n, CONFIDENCE)), "source": pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), pa.array([SOURCE])).cast(pa.string()), "priority": pa.array(np.zeros(n, np.int32)), "coref_id": named.take(made["number"])}
                out = grouped([made[f] for f in fields], fields, text, b - a)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, out], names)

    return df.mapInArrow(run, T.StructType.fromJson(df.schema.jsonValue()).add(out_col, kind))


def put_in(body: np.ndarray, offsets: np.ndarray, text: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of texts with ``values[at : at + size]`` in place of each range (sorted by text, then start; apart)."""
    n = len(offsets) - 1
    # Before each range and behind a text's last one lies a gap; a text's pieces are gap, value, gap, and so on.
    count = np.bincount(text, minlength=n)
    first = np.cumsum(2 * count + 1) - (2 * count + 1)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    gap = first[text] + 2 * k
    begin, length = np.zeros(2 * len(text) + n, np.int64), np.zeros(2 * len(text) + n, np.int64)
    # A gap begins where the range before it ends, and goes on to the next range or the text's end.
    begin[first] = offsets[:-1]
    begin[gap + 2] = end
    length[gap] = start
    length[first + 2 * count] = offsets[1:]
    gaps = np.ones(len(begin), bool)
    gaps[gap + 1] = False
    length[gaps] -= begin[gaps]
    begin[gap + 1], length[gap + 1] = len(body) + at, size
    done = np.cumsum(length)
    out = np.concatenate([body, values])[np.repeat(begin - (done - length), length) + np.arange(done[-1] if len(done) else 0)]
    return out, np.append(0, done[first + 2 * count])


def _replaced(df: DataFrame, rows: pa.Table, text_col: str, out_col: str, count_col: str) -> DataFrame:
    """Texts with the longest term at each place replaced, and how many, made where they are scanned."""
    sent = df.sparkSession.sparkContext.broadcast(Entries(rows))
    place, names = df.columns.index(text_col), [*df.columns, out_col, count_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, first, sizes, _ = sent.value.built
        # Of a term that is there once, as here, the first entry is its own.
        values, ends = buffers(sent.value.table.column("value").combine_chunks())
        for batch in batches:
            body, offsets = buffers(batch.column(place))
            for a, b in steps(offsets, STEP_BYTES):
                part, at = body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                text, end, term = automaton.scan(part, at)
                kept = longest_first(text, end - sizes[term], end)
                text, end, term = text[kept], end[kept], term[kept]
                entry = first[term]
                out, to = put_in(part, at, text, end - sizes[term], end, values, ends[entry], ends[entry + 1] - ends[entry])
                own = batch.slice(a, b - a)
                made = pa.LargeStringArray.from_buffers(b - a, pa.py_buffer(to), pa.py_buffer(out)).cast(pa.string())
                made = pc.if_else(pc.is_null(own.column(place)), pa.scalar(None, pa.string()), made)
                yield pa.RecordBatch.from_arrays([*own.columns, made, pa.array(np.bincount(text, minlength=b - a).astype(np.int64))], names)

    return df.mapInArrow(run, T.StructType.fromJson(df.schema.jsonValue()).add(out_col, "string").add(count_col, "long"))


_CHANCE = np.random.default_rng(1)
_WEIGHT, _BASE = _CHANCE.integers(1, 1 << 62, 256, np.uint64), np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def prefix_sums(body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, what brings a place's sum back to the beginning): the hash of ``body[a:b]`` is ``(sums[b] - sums[a]) * back[a]``."""
    power = np.cumprod(np.append(np.uint64(1), np.full(len(body), _BASE)))
    back = np.cumprod(np.append(np.uint64(1), np.full(len(body), _BACK)))
    return np.append(np.uint64(0), np.cumsum(_WEIGHT[body] * power[:-1])), back


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ h >> np.uint64(29)).view(np.int64)


def length_class(size: np.ndarray) -> np.ndarray:
    """How many of a term's first bytes are hashed."""
    return np.where(size < EXACT, size, 1 << np.maximum(0, np.floor(np.log2(np.maximum(size, 1))).astype(np.int64)))


def _hashed_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        body, offsets = buffers(batch.column(1))
        sums, back = prefix_sums(body)
        size = np.diff(offsets)
        used, a = length_class(size), offsets[:-1]
        whole = _mixed((sums[a + used] - sums[a]) * back[a])
        look = _mixed((sums[a + np.minimum(used, LOOK)] - sums[a]) * back[a])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(whole), pa.array(used), pa.array(look)], [*batch.schema.names, "hash", "used", "look"])


def _bitmap(hashes: DataFrame, col: str) -> np.ndarray:
    """Bits by the lower part of a hash; of one size, however many there are."""
    # Buckets and positions are of numbers from 1.
    bit = F.col(col).bitwiseAND(F.lit((1 << MAP_BITS) - 1)) + 1
    rows = hashes.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("m")).collect()
    found = np.zeros(1 << MAP_BITS - 3, np.uint8)
    for row in rows:
        at = (row["b"] - 1) * 4096
        found[at : at + len(row["m"])] |= np.frombuffer(row["m"], np.uint8)
    return found


def _places(sent, place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, looks, wholes = sent.value
        has = lambda bits, h: (bits[(h & (1 << MAP_BITS) - 1) >> 3] >> (h & 7).astype(np.uint8) & 1).astype(bool)
        for batch in batches:
            body, offsets = buffers(batch.column(place))
            for a, b in steps(offsets, STEP_BYTES):
                part, at = body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                sums, back = prefix_sums(part)
                begins = np.flatnonzero((part & 0xC0) != 0x80)
                text = np.searchsorted(at, begins, "right") - 1
                left = at[text + 1] - begins
                good = np.zeros(len(begins), bool)
                for size in range(1, LOOK + 1):
                    # A class of up to LOOK bytes looks at all of them.
                    fits = np.flatnonzero(left >= size)
                    if size in classes or size == LOOK:
                        k = begins[fits]
                        good[fits] |= has(looks, _mixed((sums[k + size] - sums[k]) * back[k]))
                begins, text, left = begins[good], text[good], left[good]
                lead = np.append(0, np.cumsum((part & 0xC0) != 0x80))
                for size in classes:
                    k, of, room = (x[left >= size] for x in (begins, text, left))
                    h = _mixed((sums[k + size] - sums[k]) * back[k])
                    hit = has(wholes, h)
                    if not hit.any():
                        continue
                    k, of, h, room = k[hit], of[hit], h[hit], room[hit]
                    # A class from EXACT on holds terms of up to twice its length.
                    ends = k + (size if size < EXACT else np.minimum(2 * size, room))
                    lengths = ends - k
                    step = max(1, STEP_BYTES // (2 * size))
                    for i in range(0, len(k), step):
                        s = slice(i, i + step)
                        n = lengths[s]
                        flat = part[np.repeat(k[s] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())]
                        context = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.append(0, np.cumsum(n)).astype(np.int32)), pa.py_buffer(flat)])
                        start = lead[k[s]] - lead[at[of[s]]]
                        ids = batch.column(0).slice(a, b - a).take(pa.array(of[s]))
                        yield pa.RecordBatch.from_arrays([ids, pa.array(h[s]), pa.array(start.astype(np.int32)), context], ["id", "hash", "start", "context"])

    return run


def _joined(df: DataFrame, entries: DataFrame, id_col: str, text_col: str, out_col: str, mode: str) -> DataFrame:
    spark = df.sparkSession
    kinds = "type string, text string, pos long, value string"
    hashed = shared.written(entries.select("type", "text", "pos", "value").mapInArrow(_hashed_terms, f"{kinds}, hash long, used long, look long"), shared.fresh_path(spark, "hashed-terms"))
    classes = sorted(r["used"] for r in hashed.select("used").distinct().collect())
    sent = spark.sparkContext.broadcast((classes, _bitmap(hashed, "look"), _bitmap(hashed, "hash")))
    kind = df.schema[id_col].dataType.simpleString()
    places = df.select(id_col, text_col).mapInArrow(_places(sent, 1), f"id {kind}, hash long, start int, context binary")
    hits = places.join(hashed.drop("look", "used"), "hash").where(F.startswith("context", F.encode("text", "utf-8")))
    hits = hits.select("id", "type", "text", "pos", "value", "start", (F.col("start") + F.length("text")).cast("int").alias("end"))
    if mode == APART:
        own = hits.groupBy("id", "type", "text", "pos", "value").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("all"))
        free = lambda upto, s: s["start"] >= upto
        kept = X.scan(F.col("all"), F.lit(0), lambda upto, s: F.when(free(upto, s), s["end"]).otherwise(upto), lambda upto, s: F.when(free(upto, s), F.array(s)).otherwise(F.array().cast("array<struct<start:int,end:int>>")), "struct<start:int,end:int>")
        own = own.withColumn("number", F.row_number().over(Window.partitionBy("id").orderBy(F.asc_nulls_last("pos"), "type", "text")) - 1)
        hits = own.select("id", "type", "text", "pos", "value", "number", F.inline(kept))
    else:
        hits = hits.withColumn("number", F.lit(None).cast("int"))
    hit = F.struct("start", "end", "pos", "type", "text", "value", "number")
    rows = hits.groupBy("id").agg(F.array_sort(F.collect_list(hit)).alias("_hits"))
    order = F.transform("_hits", lambda h: F.struct(*[h[c].alias(c) for c in ("start", "end", "text", "type", "pos", "value", "number")])).cast(HIT)
    if mode == LONGEST:
        order = taken(order)
    named = rows.select(F.col("id").alias("_id"), order.alias("_hits"))
    return df.join(named, df[id_col] == named["_id"], "left").withColumn(out_col, F.coalesce("_hits", F.array().cast(HIT))).drop("_id", "_hits")


def _sorted_entries(entries: DataFrame, most: int) -> pa.Table | None:
    """The entries by text, if these have at most ``most`` bytes."""
    size = entries.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    if size > most:
        return None
    return entries.select("text", "type", "pos", "value").toArrow().sort_by([("text", "ascending"), ("pos", "ascending"), ("type", "ascending")])


def _found(df: DataFrame, terms: DataFrame, columns: dict, id_col: str, text_col: str, out_col: str, mode: str, most: int, as_spans: bool = False) -> DataFrame:
    # Read several times: once for the size, and by each step of a join.
    entries = shared.written(_entries(terms, **columns), shared.fresh_path(df.sparkSession, "terms"))
    rows = _sorted_entries(entries, most)
    if rows is not None:
        return _scanned(df, rows, text_col, out_col, mode, as_spans)
    found = _joined(df, entries, id_col, text_col, out_col, mode)
    span = lambda h: F.struct(h["text"].alias("text"), h["type"].alias("type"), h["start"].alias("start"), h["end"].alias("end"), F.lit(CONFIDENCE).alias("confidence"), F.lit(SOURCE).alias("source"), F.lit(0).alias("priority"), F.concat(F.lit("coref_"), h["number"].cast("string")).alias("coref_id"))
    return found.withColumn(out_col, F.transform(out_col, span).cast(SPANS)) if as_spans else found


def taken(found: Column) -> Column:
    """Of an array of ``HIT``: those that a walk from the left takes, the longest at each place."""
    # As spans of their lengths' priorities; the place in the array rides in the type.
    span = lambda h, i: F.struct(F.lit(""), i.cast("string"), h["start"], h["end"], F.lit(0.0), F.lit(""), h["end"] - h["start"], F.lit(""))
    return X.let(found, lambda all_: F.transform(leftmost(F.transform(all_, span).cast(SPANS)), lambda s: F.get(all_, s["type"].cast("int"))))


def hits(df: DataFrame, terms: DataFrame, *, id_col: str, type_col: str = "type", term_col: str = "term", pos_col: str | None = None, value_col: str | None = None, text_col: str = "text", out_col: str = "hits", mode: str = ALL, most: int = AUTOMATON_BYTES) -> DataFrame:
    """Adds the occurrences of the terms as (start, end, text, type, pos, value, number), by start, end, then position.
    ``APART`` gives those of one (type, term) that a search from the left gives, and its number among those of the text, from 0;
    ``LONGEST`` those that a walk over the text takes, the longest term at each place.  ``id_col`` tells rows apart where it is a join."""
    columns = {"type_col": type_col, "term_col": term_col, "pos_col": pos_col, "value_col": value_col}
    return _found(df, terms, columns, id_col, text_col, out_col, mode, most)


def find_dictionary(df: DataFrame, terms: DataFrame, *, id_col: str, type_col: str = "type", term_col: str = "term", pos_col: str | None = None, text_col: str = "text", out_col: str = "spans", most: int = AUTOMATON_BYTES) -> DataFrame:
    """As ``detect.find_terms`` for a table of terms: spans by start; a (type, term) that occurs numbers ``coref_{n}`` from 0 in the
    order of ``pos_col``, or of types and terms."""
    columns = {"type_col": type_col, "term_col": term_col, "pos_col": pos_col, "value_col": None}
    return _found(df, terms, columns, id_col, text_col, out_col, APART, most, as_spans=True)


def replace_dictionary(df: DataFrame, mapping: DataFrame, *, id_col: str, term_col: str = "term", value_col: str = "value", text_col: str = "text", out_col: str = "redacted_text", count_col: str = "redacted_count", most: int = AUTOMATON_BYTES) -> DataFrame:
    """As ``text.rewritten`` for a table of terms and their values: from the left, the longest term at each place."""
    entries = _entries(mapping.withColumn("_type", F.lit("")), "_type", term_col, None, value_col)
    entries = shared.written(entries, shared.fresh_path(df.sparkSession, "terms"))
    rows = _sorted_entries(entries, most)
    if rows is not None:
        return _replaced(df, rows, text_col, out_col, count_col)
    found = _joined(df, entries, id_col, text_col, "_found", LONGEST)
    text = F.when(F.size("_found") > 0, X.put(F.col(text_col), F.col("_found"), lambda h: F.coalesce(h["value"], F.lit("")))).otherwise(F.col(text_col))
    return found.withColumns({out_col: text, count_col: F.size("_found").cast("long")}).drop("_found")
