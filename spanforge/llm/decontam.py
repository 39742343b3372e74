"""Operator 2, benchmark decontamination: the q-gram lemma on overlapping diagonal bands, then banded alignment.

An item of m characters is found where a stretch of a text is within ``budget`` = ``RATE`` * m edits of it.  Such a stretch
shares at least m + 1 - q (budget + 1) of the item's q-grams, on diagonals (place in the text less place in the item) that
differ by at most the budget.  Diagonals are dealt to bands that overlap by the budget, so one band sees all of them; bands
with fewer hits than the lemma demands are dropped, and the rest is aligned by dynamic programming over the band's diagonals.
Characters are folded first: lower case, white space runs as one space.  q is the largest of ``QS`` that leaves the lemma a
count of two or more, else of one; an item so short that none does gets fewer edits until one does.

The benchmark goes to the executors in blocks of ``BLOCK_BYTES``, each measured before it is sent; a larger benchmark takes
more passes over the documents, one after another and each written down.  A task holds ``STEP_BYTES`` of text, or one longer
text, and aligns ``TILE_CELLS`` at once, or one band of a longer item (a fifth of its characters wide).

Null texts and items count as empty; an empty item matches nothing; repeated rows are judged each; an empty benchmark marks
nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.llm import store
from spanforge.llm import words as W
from spanforge.llm.memory import lean
from spanforge.llm.chars import folded, points

RATE = 0.1
QS = (8, 6, 5, 4, 3, 2, 1)
STEP_BYTES, BLOCK_BYTES = 2 << 20, 4 << 20
#: Cells (diagonals and characters of items) that are aligned at once.
TILE_CELLS = 1 << 18
#: Pairs of equal q-grams that are counted at once.
STEP_HITS = 1 << 20
FILTER_BITS = 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def fold(cp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(folded code points, where texts begin, for each its place in the unfolded ones)."""
    cp = folded()[cp]
    keep = np.ones(len(cp), bool)
    keep[1:] = (cp[1:] != 32) | (cp[:-1] != 32)
    keep[at[:-1][at[:-1] < len(cp)]] = True
    where = np.flatnonzero(keep)
    return cp[where], np.searchsorted(where, at), where


def qgrams(cp: np.ndarray, q: int) -> np.ndarray:
    """A hash of each q characters, built from hashes of powers of two."""
    power, code, out, done = 1, cp.astype(np.uint64) * _MIX + np.uint64(1), None, 0
    while True:
        if q & power:
            if out is None:
                out = code
            else:
                n = max(len(out) - power, 0)
                out = out[:n] * np.uint64(0x100000001B3 + 2 * power) + code[done : done + n]
            done += power
        power *= 2
        if power > q:
            break
        n = max(len(code) - power // 2, 0)
        code = code[:n] * np.uint64(0xC2B2AE3D27D4EB4F + 2 * power) + code[power // 2 : power // 2 + n]
    out = out[: max(len(cp) - q + 1, 0)]
    return (out ^ out >> np.uint64(31)) * _MIX


def demand(m: int, q: int, budget: int) -> int:
    return m + 1 - q * (budget + 1)


def plan(m: int, rate: float) -> tuple[int, int]:
    """(q, edits) for an item of m characters."""
    budget = int(rate * m)
    while True:
        for least in (2, 1):
            for q in QS:
                if demand(m, q, budget) >= least:
                    return q, budget
        budget -= 1


class Counts:
    """How often each (item, band) was added, as sorted keys; what is added is counted before it is kept."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, who: np.ndarray, band: np.ndarray) -> None:
        low = int(band.min())
        wide = int(band.max()) - low + 1
        if (int(who.max()) + 1) * wide <= STEP_HITS:
            flat = np.bincount(who * wide + band - low)
            there = np.flatnonzero(flat)
            self.parts.append((there // wide << 40 | there % wide + low, flat[there]))
        else:
            self.parts.append(np.unique(who << 40 | band, return_counts=True))
        self.held += len(self.parts[-1][0])
        if self.held > 4 * STEP_HITS:
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*self.parts)) if self.parts else (np.zeros(0, np.int64),) * 2
        keys, inverse = np.unique(keys, return_inverse=True)
        self.parts = [(keys, np.bincount(inverse, weights=counts, minlength=len(keys)).astype(np.int64))]
        # What cannot be merged further waits until as much again has come.
        self.held = 0
        return self.parts[0]

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Counts of keys that were added, after ``total``."""
        return self.parts[0][1][np.searchsorted(self.parts[0][0], keys)]


class Items:
    """A block of the benchmark, indexed by q-grams."""

    def __init__(self, ids: list[int], texts: list[str], rate: float):
        body, offsets = W.buffers(pa.array(texts, pa.string()))
        cp, at = points(body, offsets)
        cp, at, _ = fold(cp, at)
        self.texts, self.ids = [cp[a:b] for a, b in zip(at, at[1:])], np.array(ids, np.int64)
        planned = [plan(len(t), rate) if len(t) else (0, 0) for t in self.texts]
        self.budget = np.array([k for _, k in planned], np.int64)
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.demand = np.array([demand(len(t), q, k) for t, (q, k) in zip(self.texts, planned)], np.int64)
        self.index = {}
        for q in sorted({q for q, _ in planned if q}):
            own = [i for i, (x, _) in enumerate(planned) if x == q]
            grams = [qgrams(self.texts[i], q) for i in own]
            item, place = np.repeat(own, [len(g) for g in grams]), np.concatenate([np.arange(len(g)) for g in grams])
            gram = np.concatenate(grams)
            order = np.argsort(gram, kind="stable")
            values, first = np.unique(gram[order], return_index=True)
            some = np.zeros(1 << FILTER_BITS, bool)
            some[values >> np.uint64(64 - FILTER_BITS)] = True
            # Bands as wide as the largest budget of the group, twice: each overlaps the next by that budget.
            self.index[q] = some, values, np.append(first, len(gram)), item[order], place[order], int(self.budget[own].max()) + 1

    def regions(self, cp: np.ndarray):
        """(item, lowest diagonal, number of diagonals) of the bands that meet the demand."""
        found = [np.zeros((0, 3), np.int64)]
        for q, (some, values, first, item, place, wide) in self.index.items():
            code = qgrams(cp, q)
            hit = np.flatnonzero(some[code >> np.uint64(64 - FILTER_BITS)])
            spot = np.searchsorted(values, code[hit])
            good = values[np.minimum(spot, len(values) - 1)] == code[hit]
            hit, spot = hit[good], spot[good]
            # Parts of the hits at a time, counted by band before the next: a frequent q-gram stands at many places of the items.
            n = first[spot + 1] - first[spot]
            ends, counts, k = np.cumsum(n), Counts(), 0
            while k < len(hit):
                end = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + STEP_HITS, "right")))
                m = n[k:end]
                entry = np.repeat(first[spot[k:end]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                counts.add(item[entry], (np.repeat(hit[k:end], m) - place[entry] + int(self.size.max())) // wide)
                k = end
            key, count = counts.total()
            # A band reaches over the next one as well.
            after = np.searchsorted(key, key + 1)
            over = np.append(key, -1)[after] == key + 1
            count = count + np.where(over, np.append(count, 0)[after], 0)
            alone = key[np.append(True, key[1:] != key[:-1] + 1)] if len(key) else key
            alone = alone[(alone & (1 << 40) - 1) > 0]
            key, count = np.append(key, alone - 1), np.append(count, counts.of(alone))
            who = key >> 40
            full = count >= self.demand[who]
            low = (key & (1 << 40) - 1) * wide - int(self.size.max())
            found.append(np.stack([who[full], low[full], np.full(full.sum(), 2 * wide)], 1))
        return np.concatenate(found)

    def align(self, cp: np.ndarray, at: np.ndarray, regions: np.ndarray):
        """(item, text, edits, start, end) of regions whose best alignment inside one text keeps the budget."""
        item, low, wide = regions.T
        # Every text that a region overlaps, if it is long enough to hold the item.
        first = np.searchsorted(at, np.clip(low, 0, len(cp) - 1), "right") - 1
        last = np.searchsorted(at, np.clip(low + wide + self.size[item], 0, len(cp) - 1), "right") - 1
        chars = np.diff(at)
        out = []
        for a in range(0, len(regions), 256):
            n = (last - first + 1)[a : a + 256]
            pick = np.repeat(np.arange(a, a + len(n)), n)
            text = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[a : a + 256], n)
            able = chars[text] >= (self.size - self.budget)[item[pick]]
            pick, text = pick[able], text[able]
            # Narrow bands together; a tile holds so many cells, or one band.
            order = np.argsort(wide[pick], kind="stable")
            pick, text = pick[order], text[order]
            k = 0
            while k < len(pick):
                end = len(pick)
                while end - k > 1 and (end - k) * (wide[pick[end - 1]] + self.size[item[pick[k:end]]].max()) > TILE_CELLS:
                    end = k + (end - k) // 2
                out += self._align(cp, at, regions[pick[k:end]], text[k:end])
                k = end
        return out

    def _align(self, cp, at, regions, text):
        item, low, wide = regions.T
        size, width = self.size[item], int(wide.max())
        longest = int(size.max())
        pattern = np.full((len(item), longest), 0xFFFFFFFF, np.uint32)
        for r, i in enumerate(item):
            pattern[r, : self.size[i]] = self.texts[i]
        begin, stop = at[text], at[text + 1]
        column = np.arange(width)
        # A cell is its cost and, below it, the start of its stretch; the least cell is the best one.
        unit, base = np.int64(1) << 32, np.int64(1) << 31
        never = np.int64(1) << 60
        place = low[:, None] + column
        inside = (place >= begin[:, None]) & (place <= stop[:, None])
        cell = np.where(inside, place + base, never)
        best = np.full(len(item), never)
        end = np.zeros(len(item), np.int64)
        for i in range(longest):
            place = low[:, None] + column + i  # of the character that a match in this row takes
            inside = (place >= begin[:, None]) & (place < stop[:, None])
            other = cp[np.clip(place, 0, len(cp) - 1)] != pattern[:, i, None]
            take = np.where(inside, cell + other * unit, never)
            skip = np.append(cell[:, 1:], np.full((len(item), 1), never), 1) + unit
            cell = np.minimum(take, skip)
            run = np.minimum.accumulate(cell - column * unit, axis=1) + column * unit
            reach = (place + 1 >= begin[:, None]) & (place + 1 <= stop[:, None])
            cell = np.where(reach, np.minimum(cell, run), never)
            done = np.flatnonzero(size == i + 1)
            if len(done):
                k = cell[done].argmin(1)
                best[done] = cell[done, k]
                end[done] = low[done] + k + i + 1
        cost = best >> 32
        good = np.flatnonzero((best < never // 2) & (cost <= self.budget[item]))
        return [(int(item[g]), int(text[g]), int(cost[g]), int((best[g] & 0xFFFFFFFF) - base), int(end[g])) for g in good]


def find(items: Items, body: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(text, item's place, edits, start, end) of the best stretch of each text and item, in code points of the text."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for a, b in W.steps(offsets, STEP_BYTES):
        full, starts = points(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        cp, at, where = fold(full, starts)
        if not len(cp):
            continue
        for item, text, cost, start, end in items.align(cp, at, items.regions(cp)):
            first = int(where[start]) if start < len(where) else len(full)
            last = int(where[end - 1]) + 1 if end > start else first
            own = (cost, first - int(starts[text]), last - int(starts[text]))
            key = (a + text, item)
            if key not in best or own < best[key]:
                best[key] = own
    return [(text, item, *own) for (text, item), own in sorted(best.items())]


def blocks(benchmark: DataFrame, rate: float) -> tuple[int, Iterator[object]]:
    """(how many, broadcasts of ``Items``), none of more than about ``BLOCK_BYTES`` of text, or one longer item."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(total / BLOCK_BYTES))

    def sent() -> Iterator[object]:
        for part in range(parts):
            own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id").toArrow()
            if own.num_rows:
                yield benchmark.sparkSession.sparkContext.broadcast((own.column("item_id").to_pylist(), own.column("text").to_pylist(), rate))

    return parts, sent()


MATCHES = "doc_id long, item_id long, edits long, start long, end long"


def _matches(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(*sent.value)
        for batch in batches:
            found = find(items, *W.buffers(batch.column(1)))
            ids = batch.column(0).to_pylist()
            rows = [(ids[text], int(items.ids[item]), cost, start, end) for text, item, cost, start, end in found]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 5)], ["doc_id", "item_id", "edits", "start", "end"])

    return run


def matches(docs: DataFrame, benchmark: DataFrame, *, rate: float = RATE) -> DataFrame:
    """A row for each document and item found in it, with the best stretch."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts, sent = blocks(benchmark, rate)
    out = docs.sparkSession.createDataFrame([], MATCHES)
    for k, block in enumerate(sent):
        part = rows.mapInArrow(lean(_matches(block)), MATCHES)
        if parts > 1:  # one pass after another: executors hold one block, whatever the benchmark's size
            part = store.written(part, "matches")
            block.destroy()
        out = out.unionByName(part) if k else part
    return out


def _clean(sent, place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(*sent.value)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[text for text, *_ in find(items, *W.buffers(batch.column(place)))]] = False
            yield batch.filter(pa.array(keep))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, rate: float = RATE) -> DataFrame:
    """``docs`` without the documents in which an item is found; no row moves."""
    schema, place = T.StructType.fromJson(docs.schema.jsonValue()), docs.columns.index("text")
    parts, sent = blocks(benchmark, rate)
    for block in sent:
        docs = docs.mapInArrow(lean(_clean(block, place)), schema)
        if parts > 1:
            docs = store.written(docs, "clean")
            block.destroy()
    return docs


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
