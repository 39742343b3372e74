"""Near copies: texts whose sets of word shingles have a Jaccard similarity of ``SIMILAR`` or more.

Candidates meet by the anchors of SimHash fingerprints (``simhash``, operator 5): a text has ``PRINTS`` fingerprints of 64 bits of
its set of shingles, each cut to four segments, and every segment has one anchor, the word of the Hamming code of 15 bits within
one bit of it (covering radius 1).  A bit of two texts of similarity 0.8 differs with probability arccos(8/9) / pi = 0.151, so they
share the anchor of one segment with 0.149 (``share``) and of none of the 80 with two in a million, whatever their length; texts of
4 and 5 shingles, which round to other majorities, with 0.0004.  Texts at an anchor whose first two fingerprints differ in more than
``FAR`` of 128 bits are not looked at further (at 0.151 a pair in a million; of 4 and 5 shingles 0.0002).  Every link is then verified exactly on the sets of
distinct shingles (a repeated shingle counts once), so no pair below the limit links.

The task that holds a key's texts verifies them itself and gives a spanning forest of verified links, so a group of copies costs
one verification each and components are those of all links at every size of a group.  The sets are in flat files of the shared
folder and are read by range; a text without a near fingerprint at its anchor reads nothing.  Fingerprints at an anchor are all
compared, which takes nanoseconds a pair; their number grows with the square of the texts (an anchor has one of 2,048 of them).

A shorter text than a shingle is one shingle; texts without words are copies of each other.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm import simhash, store
from spanforge.llm import words as W
from spanforge.llm.components import connected_components
from spanforge.llm.memory import lean

#: Similarity from which texts are copies, as a fraction.
SIMILAR = (4, 5)
PRINTS, CODE, FAR = 20, 15, 40
SEGMENTS = 4 * PRINTS
#: A text's number is that of its file, then its place in it.
PLACE_BITS = 40
HELD_BYTES, OPEN_FILES = 48 << 20, 64
TABLE_BITS = 16


def sets(body: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles."""
    hashes, counts = simhash.shingles(body, offsets, size)
    ends = np.cumsum(counts)
    return [np.unique(hashes[end - n : end]) for end, n in zip(ends, counts)]


@functools.cache
def _lanes() -> np.ndarray:
    """Each byte's bits in bytes of their own, so one addition counts eight bits."""
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


@functools.cache
def _homes() -> np.ndarray:
    """The anchor of each value of a segment: the word of the Hamming code that differs in one bit at most."""
    value = np.arange(1 << CODE)
    syndrome = np.zeros(1 << CODE, np.int64)
    for bit in range(CODE):
        syndrome ^= (value >> bit & 1) * (bit + 1)
    return value ^ (1 << syndrome >> 1)


def prints(found: list[np.ndarray], count: int = PRINTS) -> np.ndarray:
    """Fingerprints (texts x ``count``) of sets: a bit is 1 if over half of the set's hashes, mixed anew for each, have it."""
    counts = np.array([len(s) for s in found], np.int64)
    out = np.zeros((len(found), count), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    hashes, sizes = np.concatenate(found), counts[full]
    # A byte counts to 255, so longer sets are added in pieces.
    pieces = -(-sizes // 255)
    first = np.cumsum(pieces) - pieces
    edge = np.repeat(np.cumsum(sizes) - sizes, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    for k in range(count):
        hashes = (hashes ^ hashes >> np.uint64(32)) * simhash.MIX
        hashes ^= hashes >> np.uint64(29)
        sums = np.add.reduceat(_lanes()[hashes.view(np.uint8)].reshape(-1, 8), edge, axis=0)
        bits = np.add.reduceat(sums.view(np.uint8).reshape(-1, 64), first, axis=0, dtype=np.int32)
        out[full, k] = np.packbits(bits * 2 > sizes[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def anchors(of: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Keys (texts x ``SEGMENTS``): the segment and its anchor; those of a set without members are its own."""
    segments = np.ascontiguousarray(of).view(np.uint16).reshape(len(of), -1) & ((1 << CODE) - 1)
    keys = np.arange(segments.shape[1]) << CODE | _homes()[segments]
    keys[sizes == 0] = 1 << 30 | np.arange(segments.shape[1])
    return keys.astype(np.int32)


def share(differ: float) -> float:
    """How likely a segment's anchor is shared by texts whose bits differ with this probability."""
    values = _homes()[np.flatnonzero(_homes() == 0)[:, None] ^ np.arange(1 << CODE)] == 0
    weight = np.bitwise_count(np.arange(1 << CODE))
    return float((values.mean(0) * differ**weight * (1 - differ) ** (CODE - weight)).sum())


def partners(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Places of those of an anchor's texts that have another's fingerprints near."""
    has = np.zeros(len(p), bool)
    step = max(1, simhash.PAIRS // len(p))
    for k in range(0, len(p), step):
        has[k : k + step] = np.count_nonzero(_near(p[k : k + step, None], q[k : k + step, None], p, q), axis=1) > 1
    return np.flatnonzero(has)


def _near(p, q, r, s):
    return np.bitwise_count(p ^ r) + np.bitwise_count(q ^ s) <= FAR


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the similarity of two sorted sets reaches the limit."""
    if not len(a) and not len(b):
        return True
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return _enough(int((both[1:] == both[:-1]).sum()), len(a), len(b))


def _enough(common, n, m):
    # common / (n + m - common) >= SIMILAR
    over, under = SIMILAR
    return common * (over + under) >= over * (n + m)


def forest(load: Callable[[int], np.ndarray], sizes: np.ndarray, of: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[int, int]]:
    """Verified links among members 0, 1, ... that connect the same members as all links do; with two fingerprints of each (``of``),
    links of which these are near."""
    rest, queue = np.arange(len(sizes)), []
    while len(rest):
        if not queue:
            queue, rest = [rest[0]], rest[1:]
        x = queue.pop()
        mine, least = load(x), np.minimum(sizes[rest], sizes[x])
        able = rest[_enough(least, sizes[rest], sizes[x])]
        if of is not None:
            able = able[_near(of[0][x], of[1][x], of[0][able], of[1][able])]
        if len(able) > 8:
            able = _possible(load, mine, able, sizes)
        near = [k for k in able if alike(mine, load(k))]
        if near:
            yield from ((x, k) for k in near)
            queue += near
            rest = np.setdiff1d(rest, near, assume_unique=True)


def _possible(load, mine: np.ndarray, able: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Members that may be alike: a table of low bits gives at least as many common hashes as there are."""
    low = np.uint64((1 << TABLE_BITS) - 1)
    table = np.zeros(1 << TABLE_BITS, bool)
    table[mine & low] = True
    common = np.array([np.count_nonzero(table[load(k) & low]) for k in able])
    return able[_enough(common, sizes[able], len(mine))]


class Reader:
    """Sets by (file, place, size), the last ones held."""

    def __init__(self, folder: str):
        self.fs, self.folder = store.filesystem(folder)
        self.files: dict[int, pa.NativeFile] = {}
        self.held: dict[tuple[int, int], np.ndarray] = {}
        self.size = 0

    def get(self, file: int, at: int, size: int) -> np.ndarray:
        key = file, at
        if key not in self.held:
            if self.size > HELD_BYTES:
                self.held, self.size = {}, 0
            if file not in self.files:
                if len(self.files) >= OPEN_FILES:
                    self.files.pop(next(iter(self.files))).close()
                self.files[file] = self.fs.open_input_file(f"{self.folder}/{file:016x}")
            # An empty set has no place of its own.
            if not size:
                return np.zeros(0, np.uint64)
            self.held[key] = np.frombuffer(self.files[file].read_at(8 * size, 8 * at), np.uint64)
            self.size += 8 * size + 200
        return self.held[key]


SETS = ["doc_id long", "text_key binary", "node long", "size long", "p long", "q long", "keys array<int>"]


def _map_sets(size: int, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = store.filesystem(folder)
        name, at, out = TaskContext.get().taskAttemptId(), 0, None
        if name >> 63 - PLACE_BITS:
            raise OverflowError("more tasks than a text's number can tell apart")
        try:
            for batch in batches:
                if out is None:
                    fs.create_dir(path, recursive=True)
                    out = fs.open_output_stream(f"{path}/{name:016x}")
                body, offsets = W.buffers(batch.column(1))
                made, sizes, places = [np.zeros((0, PRINTS), np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for a, b in W.steps(offsets, simhash.STEP_BYTES):
                    found = sets(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                    n = np.array([len(s) for s in found], np.int64)
                    begin = np.cumsum(n) - n
                    made.append(prints(found))
                    sizes.append(n)
                    # Each set stands behind its size, so sets without members have places of their own.
                    places.append(at + begin + np.arange(len(n)))
                    out.write(np.insert(np.concatenate(found), begin, n.astype(np.uint64)).tobytes())
                    at += int(n.sum()) + len(n)
                n, of = np.concatenate(sizes), np.concatenate(made)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * SEGMENTS, pa.int32()), pa.array(anchors(of, n).ravel()))
                p, q = (pa.array(of[:, k].copy().view(np.int64)) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(name << PLACE_BITS | np.concatenate(places)), pa.array(n), p, q, listed], [c.split()[0] for c in SETS])
        finally:
            if out is not None:
                out.close()

    return run


def _map_links(folder: str):
    names = ("key", "node", "size", "p", "q")

    def linked(rows: list[np.ndarray], reader: Reader) -> tuple[list[int], list[int]]:
        key, node, size, p, q = (*rows[:3], *(r.view(np.uint64) for r in rows[3:]))
        edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        ends = np.append(edge[1:], len(key))
        heads, tails = [], []
        for a, b in zip(edge, ends):
            near = a + partners(p[a:b], q[a:b]) if b - a > 1 else ()
            if len(near):
                file, at = node[near] >> PLACE_BITS, node[near] & ((1 << PLACE_BITS) - 1)
                load = lambda k: reader.get(int(file[k]), int(at[k]) + 1, int(size[near[k]]))  # noqa: B023, E731
                for x, y in forest(load, size[near], (p[near], q[near])):
                    heads.append(min(node[near[x]], node[near[y]]))
                    tails.append(max(node[near[x]], node[near[y]]))
        return heads, tails

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held = Reader(folder), []

        def give(parts):
            a, b = linked([np.concatenate(x) for x in zip(*parts)], reader)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            if not len(rows[0]):
                continue
            cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last group may go on
            if held and (cut or rows[0][0] != held[-1][0][-1]):
                yield give([*held, [r[:cut] for r in rows]])
                held, rows = [], [r[cut:] for r in rows]
            held.append(rows)
        if held:
            yield give(held)

    return run


def text_key(text: Column) -> Column:
    """128 bits that stand for a text: 64 would be shared by unequal ones among 10^10.  A null text has a key of its own."""
    return F.coalesce(F.unhex(F.md5(text.cast("string"))), F.lit(b""))


def groups(df: DataFrame, *, words: int = 5) -> DataFrame:
    """doc_id, text_key and root (of its group) of each document."""
    spark = df.sparkSession
    folder = store.fresh_path(spark, "sets")
    text = F.col("text").cast("string")
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), text_key(text).alias("text_key"))
    found = store.written(rows.mapInArrow(lean(_map_sets(words, folder)), ", ".join(SETS)), "sets")
    # Written once, so that of equal texts the same one stands for all.
    one = found.groupBy("text_key").agg(F.first(F.struct("node", "size", "p", "q", "keys")).alias("s")).select("text_key", "s.*")
    nodes = store.written(one, "nodes")
    placed = nodes.select(F.explode("keys").alias("key"), "node", "size", "p", "q").repartition("key").sortWithinPartitions("key", "node")
    links = placed.mapInArrow(lean(_map_links(folder)), "a long, b long").distinct()
    roots = connected_components(links)
    store.drop(spark, folder)
    of_text = nodes.select("text_key", "node").join(roots, "node", "left").select("text_key", F.coalesce("root", "node").alias("root"))
    return found.select("doc_id", "text_key").join(of_text, "text_key").select("doc_id", "text_key", "root")
