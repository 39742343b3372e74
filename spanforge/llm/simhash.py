"""Operator 5, SimHash near-dedup by anchor-point covering.

A document's fingerprint has a bit set if more than half of its shingles' XXH64 values have it set.  Fingerprints link at
``max_bits`` or fewer differing bits.  The 64 bits are split into segments (``Layout``), so linked fingerprints differ in at
most ``max_bits // parts`` bits of some segment.  On each segment a covering code gives the anchors: a Hamming code of 15 or 31
bits with the other bits free, whose covering radius is 1 (every value has exactly one anchor within it, its home).  A fingerprint
goes to every anchor within the radius plus the segment's threshold, by a table of error patterns for each syndrome; of two
linked fingerprints one's home is then among the other's anchors, so comparing homes with all others per anchor loses no link.

Equal fingerprints are one node from the start, so copies cost nothing.  Where an anchor's links are many, its task gives as few
as connect the same fingerprints; components of these links are those of all links.

Null texts count as empty; texts without words have fingerprint zero and link like any other; rows with equal or null ids
are documents of their own; an empty table gives an empty result; other columns are not read by ``components``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import store
from spanforge.llm import words as W
from spanforge.llm.memory import lean
from spanforge.llm.components import connected_components

SEED = 42
STEP_BYTES = 2 << 20
#: Pairs that are compared at once, and links for each row beyond which they are thinned.
PAIRS, MANY = 1 << 21, 4
#: Distinct fingerprints up to which segments are short: beyond, groups at an anchor of the short code would grow too large.
FEW = 1 << 25
MIX = np.uint64(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def shingles(body: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the shingles in their order, how many each text has)."""
    import xxhash

    body = _LOWER[body]
    blank = _BLANK[body]
    first = np.zeros(len(body), bool)
    first[offsets[:-1][offsets[:-1] < len(body)]] = True
    begin = ~blank & (np.append(True, blank[:-1]) | first)
    end = ~blank & np.append(blank[1:] | first[1:], True)
    # One space after each word, none elsewhere: a shingle is then a slice.
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    shift = np.arange(len(starts)) + 1
    keep = np.cumsum(~blank)
    tidy = np.full(keep[-1] + len(starts), 32, np.uint8)
    tidy[keep[~blank] - 1 + np.repeat(shift - 1, ends - starts)] = body[~blank]
    starts, ends = keep[starts] - 1 + shift - 1, keep[ends - 1] + shift - 1
    words = np.diff(np.searchsorted(np.flatnonzero(begin), offsets))
    at = np.cumsum(words) - words
    # Shingle i of a text covers words i to i + size - 1; a shorter text is one shingle.
    counts = np.where(words == 0, 0, np.maximum(words - size + 1, 1))
    word = np.repeat(at, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    last = np.minimum(word + size, np.repeat(at + words, counts)) - 1
    data, digest = tidy.tobytes(), xxhash.xxh64_intdigest
    return np.fromiter((digest(data[a:b], SEED) for a, b in zip(starts[word].tolist(), ends[last].tolist())), np.uint64, len(word)), counts


def _prints(body: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """The fingerprint of each text."""
    hashes, counts = shingles(body, offsets, size)
    out = np.zeros(len(offsets) - 1, np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, (np.cumsum(counts) - counts)[full], axis=0, dtype=np.int32)
        out[full] = np.packbits(sums * 2 > counts[full, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _map_prints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = W.buffers(batch.column(1))
            found = [_prints(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size) for a, b in W.steps(offsets, STEP_BYTES)]
            prints = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(prints)], ["doc_id", "text_key", "print"])

    return run


def fingerprints(df: DataFrame, *, words: int = 4) -> DataFrame:
    """doc_id, text_key (a hash of the text that tells rows of one id apart) and print (the 64 bits as a long)."""
    text = F.col("text").cast("string")
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    return rows.mapInArrow(lean(_map_prints(words)), "doc_id long, text_key long, print long")


@dataclass(frozen=True)
class Layout:
    """Segments of a fingerprint and the length of the Hamming code whose words are each segment's anchors."""

    parts: int
    code: int

    def widths(self) -> list[int]:
        return [64 // self.parts + (k >= self.parts - 64 % self.parts) for k in range(self.parts)]


def layout_for(count: int) -> Layout:
    """Three segments with a code of 15 bits give a fingerprint some 43 anchors of 400,000; two with one of 31 bits some 340 of
    268 million, whose groups stay small where fingerprints are many.  Both find every link."""
    return Layout(3, 15) if count <= FEW else Layout(2, 31)


def patterns(width: int, radius: int, code: int) -> list[list[int]]:
    """For each syndrome of the code the error patterns of at most ``radius`` bits that lead to an anchor; first that to the home."""
    found: list[list[int]] = [[] for _ in range(code + 1)]
    for weight in range(radius + 1):
        for places in itertools.combinations(range(width), weight):
            syndrome = 0
            for p in places:
                syndrome ^= p + 1 if p < code else 0
            found[syndrome].append(sum(1 << p for p in places))
    return found


def _placed(errors: Column, value: Column, part: int) -> Column:
    return F.transform(errors, lambda e, i: F.struct(F.lit(part << 32).cast("long").bitwiseOR(value.bitwiseXOR(e)).alias("anchor"), (i == 0).alias("home")))


def anchors(prints: DataFrame, max_bits: int, layout: Layout) -> DataFrame:
    """print, anchor, home: a row for each anchor of each fingerprint."""
    rows, low = [], 0
    for part, width in enumerate(layout.widths()):
        table = F.array(*[F.array(*[F.lit(e).cast("long") for e in es]) for es in patterns(width, 1 + max_bits // layout.parts, layout.code)])
        value = F.shiftrightunsigned("print", low).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        checks = [sum(1 << p for p in range(layout.code) if (p + 1) >> c & 1) for c in range(layout.code.bit_length())]
        syndrome = sum((F.shiftleft(F.bit_count(value.bitwiseAND(F.lit(m).cast("long"))).bitwiseAND(F.lit(1)), c) for c, m in enumerate(checks)), F.lit(0))
        low += width
        rows.append(_placed(F.get(table, syndrome), value, part))
    return prints.select("print", F.inline(F.concat(*rows)))


def thinned(pairs: np.ndarray) -> np.ndarray:
    """Links that connect what ``pairs`` connect: each node with the least of its component."""
    nodes, ends = np.unique(pairs, return_inverse=True)
    a, b = ends.reshape(-1, 2).T
    root, before = np.arange(len(nodes)), None
    while before is None or (root != before).any():
        before = root.copy()
        np.minimum.at(root, a, before[b])
        np.minimum.at(root, b, before[a])
        root = np.minimum(root, root[root])
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return np.stack([nodes[root[moved]], nodes[moved]], 1)


def links_of(anchor: np.ndarray, ids: np.ndarray, prints: np.ndarray, home: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by anchor; every group is whole.  Each home is compared with all rows of its anchor, ``PAIRS`` at
    a time.  Where links are many they are thinned to as few as connect the same, which is all that is asked of them."""
    edge = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    sizes = np.diff(np.append(edge, len(anchor)))
    group = np.repeat(np.arange(len(edge)), sizes)
    own = np.flatnonzero(home)
    need = sizes[group[own]]
    at = np.cumsum(need)
    found, count = [np.zeros((0, 2), np.int64)], 0
    k = 0
    while k < len(own):
        end = max(k + 1, int(np.searchsorted(at, (at[k - 1] if k else 0) + PAIRS, "right")))
        one, n = own[k:end], need[k:end]
        left = np.repeat(one, n)
        right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(edge[group[one]], n)
        near = np.bitwise_count(prints[left] ^ prints[right]) <= max_bits
        x, y = ids[left[near]], ids[right[near]]
        found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1)[x != y])
        count += len(found[-1])
        if count > MANY * len(ids):
            found, count = [thinned(np.concatenate(found))], 0
        k = end
    pairs = np.unique(np.concatenate(found), axis=0)
    if len(pairs) > MANY * len(ids):
        pairs = thinned(pairs)
    return pairs[:, 0], pairs[:, 1]


def _map_links(max_bits: int):
    def give(parts):
        anchor, prints, home = (np.concatenate(x) for x in zip(*parts))
        a, b = links_of(anchor, prints, prints.view(np.uint64), home, max_bits)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "print", "home")]
            if not len(rows[0]):
                continue
            cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last group may go on
            if held and size + cut >= 1 << 18 and (cut or rows[0][0] != held[-1][0][-1]):
                yield give([*held, [r[:cut] for r in rows]])
                held, size, rows = [], 0, [r[cut:] for r in rows]
            held.append(rows)
            size += len(rows[0])
        if held:
            yield give(held)

    return run


def links(prints: DataFrame, *, max_bits: int = 4, layout: Layout | None = None) -> DataFrame:
    """(a, b): links between distinct fingerprints (``print``), enough to connect all that link."""
    placed = anchors(prints, max_bits, layout or layout_for(prints.count())).repartition("anchor").sortWithinPartitions("anchor")
    return placed.mapInArrow(lean(_map_links(max_bits)), "a long, b long").distinct()


def components(df: DataFrame, *, words: int = 4, max_bits: int = 4) -> DataFrame:
    """doc_id, print and component_id (the smallest doc_id reachable) of each document."""
    prints = store.written(fingerprints(df, words=words), "prints")
    nodes = store.written(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "nodes")
    roots = connected_components(links(nodes.select("print"), max_bits=max_bits))
    placed = nodes.join(roots, nodes["print"] == roots["node"], "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    # Written, so that the join back reads two shuffles as they are and a root with many fingerprints can be split.
    classes = store.written(placed.groupBy("root").agg(F.min("least").alias("component_id")), "classes")
    of_print = placed.join(classes, "root").select("print", "root", "component_id")
    return prints.join(of_print, "print").select("doc_id", "text_key", "print", "root", "component_id")


def dedup(df: DataFrame, *, words: int = 5) -> DataFrame:
    """One document of each group of near copies: that with the smallest id (a null id is the largest); rows that repeat it
    count as one."""
    from spanforge.llm import nearcopies

    text, id_ = store.free_name(df, "dedup_text"), store.free_name(df, "dedup_id")
    last = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    kept = nearcopies.groups(df, words=words).groupBy("root").agg(F.min(last).alias("kept")).select(F.col("kept.text_key").alias(f"{text}_"), F.col("kept.doc_id").alias(f"{id_}_"))
    marked = df.withColumns({text: nearcopies.text_key(F.col("text")), id_: F.col("doc_id").cast("long")})
    same = (F.col(text) == F.col(f"{text}_")) & F.col(id_).eqNullSafe(F.col(f"{id_}_"))
    return marked.join(kept, same, "left_semi").dropDuplicates([text, id_]).select(*df.columns)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
