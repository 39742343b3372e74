"""Operator 4, removal of repeated substrings with suffixes sorted by hash comparison.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts elsewhere.  Every such window has an anchor: of its
``GRAM``-byte grams the one of least hash, the first if equal.  Equal windows have equal anchors, so windows are compared with
those of their anchor's hash only, and neighbouring windows of one anchor travel as one stretch (under twice ``LENGTH`` bytes).

1. Blocks of documents give their anchors' hashes; a block names a hash once.  A shuffle by hash drops those seen once.
2. The stretches of the rest, each distinct one of a block once, are shuffled by hash.  A hash with one distinct stretch that
   is there twice is repeated as a whole; otherwise the windows of its stretches are sorted as suffixes (``Suffixes``).
3. A hash of more than ``HOT`` stretches is not one task's: its stretches are spread by their own bytes.  Those that are there
   twice are repeated as a whole, and one of each gives a 128-bit digest for each window; a window whose digest is there twice is
   repeated.  A task names a digest once, with all its windows, so neither counting nor joining back moves a row a window, and
   what is repeated goes to a block as one row for many windows.
4. What is repeated goes back to the blocks, which cut their texts.

Texts travel in compressed blocks (``BLOCK_BYTES`` or one longer text); no task holds more than one, and copies of a passage
are one row a block.  A block's key contains a checksum of its bytes: an input that changes between reads fails the job.

Null texts count as empty; texts shorter than ``LENGTH`` stay whole; equal or null ids keep their own rows, and repeated rows
repeat each other's text; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import store
from spanforge.llm import words as W
from spanforge.llm.decontam import qgrams
from spanforge.llm.suffix import Suffixes

LENGTH, GRAM = 200, 40
BLOCK_BYTES, STEP_BYTES, SORT_BYTES = 8 << 20, 2 << 20, 2 << 20
#: Stretches of one anchor that are sorted in one task: about ``SORT_BYTES`` of them.
HOT = SORT_BYTES >> 9
COUNT_BITS, CHECK_BITS = 14, 27
#: Bits of a hash that give way to the place, the same for every text, and windows of a long text that are looked at together.
PLACE_BITS, PIECE = 24, 1 << 23
#: A stretch is packed as start, place of its anchor in it, length.
SHORT = 9


def _blocks(batches: Iterator[pa.RecordBatch]):
    """(key, ids, bytes, offsets) of blocks of documents."""
    part, count = TaskContext.get().partitionId(), 0
    for batch in batches:
        body, offsets = W.buffers(batch.column(1))
        for a, b in W.steps(offsets, BLOCK_BYTES):
            inner, at = body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            if count >> COUNT_BITS or part >> 63 - COUNT_BITS - CHECK_BITS:
                raise OverflowError("more partitions or blocks in a partition than a key can tell apart")
            check = zlib.crc32(at.tobytes(), zlib.crc32(inner)) >> 32 - CHECK_BITS
            yield (part << COUNT_BITS | count) << CHECK_BITS | check, batch.column(0).slice(a, b - a), inner, at
            count += 1


def _pieces(body: np.ndarray, offsets: np.ndarray, length: int):
    """(where it begins, bytes, offsets in it) of steps of texts; a long text comes in pieces that have all its windows."""
    for a, b in W.steps(offsets, STEP_BYTES):
        base, end = int(offsets[a]), int(offsets[b])
        if end - base < length:
            continue
        if b - a > 1 or end - base <= PIECE:
            yield base, body[base:end], offsets[a : b + 1] - base
            continue
        for k in range(base, end - length + 1, PIECE):
            stop = min(k + PIECE + length - 1, end)
            yield k, body[k:stop], np.array([0, stop - k])


def stretches(body: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the anchor, packed place) of each run of windows with one anchor."""
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for base, text, at in _pieces(body, offsets, length):
        code = qgrams(text, gram)
        # Least hash of each window; the low bits are the place, so equal hashes give the first.
        low = np.uint64((1 << PLACE_BITS) - 1)
        least = (code & ~low) | np.arange(len(code), dtype=np.uint64)
        span, wide = length - gram + 1, 1
        while wide * 2 <= span:
            least = np.minimum(least[:-wide], least[wide:])
            wide *= 2
        least = np.minimum(least[: len(least) - (span - wide)], least[span - wide :])
        anchor = (least & low).astype(np.int64)
        doc = np.searchsorted(at, np.arange(len(anchor)), "right")
        inside = np.arange(len(anchor)) + length <= at[np.minimum(doc, len(at) - 1)]
        first = inside & np.append(True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))
        last = inside & np.append(first[1:] | ~inside[1:], True)
        start, stop = np.flatnonzero(first), np.flatnonzero(last)
        hashes.append(code[anchor[start]])
        places.append((start + base) << 2 * SHORT | (anchor[start] - start) << SHORT | (stop - start + length))
    return np.concatenate(hashes), np.concatenate(places)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, _, body, offsets in _blocks(batches):
        code, place = stretches(body, offsets)
        order = np.argsort(code, kind="stable")
        code, place = code[order], place[order]
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
        ends = np.append(first[1:], len(code))
        more: list[bytes | None] = [None] * len(first)
        for k in np.flatnonzero(ends - first > 1):
            more[k] = place[first[k] + 1 : ends[k]].tobytes()
        columns = [pa.array(code[first].view(np.int64)), pa.array(np.full(len(first), key)), pa.array(place[first]), pa.array(more, pa.binary())]
        whole = pa.RecordBatch.from_arrays(columns, ["code", "block", "place", "more"])
        for k in range(0, len(first), 50_000):
            yield whole.slice(k, 50_000)


ANCHORS = "code long, block long, place long, more binary"


def _shared(most: int):
    """Of rows sorted by hash, those whose hash is there twice, and whether it is of more than ``most`` stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hot = None, None  # rows of the last hash, if they are few so far; the last hash, if they are not
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            code = table.column("code").to_numpy()
            weight = 1 + np.diff(W.buffers(table.column("more").combine_chunks())[1]) // 8
            edge = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            total = np.add.reduceat(weight, edge)
            if code[0] == hot:
                total[0] = most + 1
            last = int(edge[-1]) if total[-1] <= most else table.num_rows
            held = table.slice(last).to_batches()[0] if last < table.num_rows else None
            hot = code[-1] if held is None else None
            yield from given(table.slice(0, last), np.repeat(total, np.diff(np.append(edge, len(code))))[:last])
        if held is not None:
            weight = 1 + np.diff(W.buffers(held.column("more"))[1]) // 8
            yield from given(pa.Table.from_batches([held]), np.full(held.num_rows, weight.sum()))

    def given(table: pa.Table, total: np.ndarray) -> Iterator[pa.RecordBatch]:
        table = table.append_column("hot", pa.array(total > most))
        yield from table.filter(pa.array(total > 1)).combine_chunks().to_batches()

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, ids, body, offsets in _blocks(batches):
        row = [pa.array([key]), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([offsets]), pa.array([pa.compress(body.tobytes(), "zstd", asbytes=True)])]
        yield pa.RecordBatch.from_arrays(row, ["block", "ids", "offsets", "body"])


TEXTS = "block long, ids array<long>, offsets array<long>, body binary"


def _open(left: pa.Table):
    if left.num_rows != 1:
        raise ValueError("a block came without its texts: the input changed between two reads")
    offsets = left.column("offsets")[0].values.to_numpy()
    size = int(offsets[-1])
    return left.column("ids")[0].values, np.frombuffer(pa.decompress(left.column("body")[0].as_py(), size, "zstd", asbytes=True), np.uint8) if size else np.zeros(0, np.uint8), offsets


def _take(body: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.cumsum(sizes)
    index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(body[index])])


STRETCHES = "code long, body binary, block long, own long, many boolean, hot boolean"
_MASK = (1 << SHORT) - 1


def _cut_out(left: pa.Table, right: pa.Table) -> pa.Table:
    """The distinct stretches of a block with what stands for them (``own``), and one row (own < 0) that says where they are."""
    names = ["code", "body", "block", "own", "many", "hot"]
    if not right.num_rows:
        return pa.table([pa.array([], t) for t in (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())], names)
    _, body, _ = _open(left)
    key = right.column("block")[0].as_py()
    more = right.column("more").combine_chunks()
    extra = [np.frombuffer(m, np.int64) if m else np.zeros(0, np.int64) for m in more.to_pylist()]
    times = [len(e) for e in extra]
    code, hot = (np.concatenate([c, np.repeat(c, times)]) for c in (right.column(n).to_numpy() for n in ("code", "hot")))
    place = np.concatenate([right.column("place").to_numpy(), *extra])
    order = np.argsort(code, kind="stable")
    code, hot, place = code[order], hot[order], place[order]
    own, parts, count = [], [], 0
    for k in range(0, len(code), 1 << 15):
        p = place[k : k + (1 << 15)]
        coded = _take(body, p >> 2 * SHORT, p & _MASK).dictionary_encode()
        index = coded.indices.to_numpy()
        first = np.unique(index, return_index=True)[1]
        name = np.arange(count, count + len(first)) << SHORT | (p[first] >> SHORT & _MASK)
        parts.append(pa.table([pa.array(code[k : k + (1 << 15)][first]), coded.dictionary, pa.array(np.full(len(first), key)), pa.array(name), pa.array(np.bincount(index) > 1), pa.array(hot[k : k + (1 << 15)][first])], names))
        own.append(index.astype(np.int64) + count)
        count += len(first)
    where = np.stack([place >> 2 * SHORT, np.concatenate(own)]).astype(np.uint32)
    told = pa.table([pa.array([key]), pa.array([len(code).to_bytes(8, "little") + pa.compress(where.tobytes(), "zstd", asbytes=True)], pa.binary()), pa.array([key]), pa.array([WHERE]), pa.array([False]), pa.array([False])], names)
    return pa.concat_tables([*parts, told])


#: ``key`` is the digest of one window of a hot hash, which is an answer if it is there twice; without ``spans`` it only counts.
ANSWERS = "block long, own long, spans binary, key binary"
#: Values of ``own`` for rows that are no stretch's: where a block's stretches are, and windows of many of its stretches.
WHERE, WINDOWS = -1, -2
#: Windows of which a task gathers those with one digest, and windows in one row at most.
GATHERED, IN_ROW = 1 << 17, 1 << 12


def judge(code: np.ndarray, body: pa.Array, anchor: np.ndarray, many: np.ndarray, length: int = LENGTH) -> list[bytes]:
    """For each stretch its repeated parts, as pairs of 16-bit numbers; hashes' rows are all there."""
    coded = body.dictionary_encode()
    index = coded.indices.to_numpy()
    n = len(coded.dictionary)
    first = np.full(n, len(index))
    np.minimum.at(first, index, np.arange(len(index)))
    twice = (np.bincount(index, minlength=n) + np.bincount(index, many, minlength=n)) > 1
    data, at = W.buffers(coded.dictionary)
    group = np.unique(code[first], return_inverse=True)[1]
    size = np.diff(at)
    alone = np.bincount(group)[group] == 1
    mark = np.zeros(len(data) + 1, np.int32)
    whole = np.flatnonzero(twice)
    np.add.at(mark, at[whole], 1)
    np.add.at(mark, at[whole] + size[whole], -1)
    rest = np.flatnonzero(~alone)
    if len(rest):
        windows = size[rest] - length + 1
        stretch = np.repeat(rest, windows)
        offset = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        start = at[stretch] + offset
        # Equal windows have their anchor at the same place.
        family = group[stretch] << 2 * SHORT | anchor[first][stretch] - offset + length
        order = np.argsort(family, kind="stable")
        found = Suffixes(data, length).repeated(start[order], family[order])
        hit = start[order][found]
        np.add.at(mark, hit, 1)
        np.add.at(mark, hit + length, -1)
    gone = np.cumsum(mark[:-1]) > 0
    edge = np.zeros(len(data), bool)
    edge[at[:-1]] = True
    opens = np.flatnonzero(gone & (edge | ~np.append(False, gone[:-1])))
    closes = np.flatnonzero(gone & (np.append(edge[1:], True) | ~np.append(gone[1:], False))) + 1
    upto = np.searchsorted(opens, at)
    pairs = np.stack([opens, closes], 1) - np.repeat(at[:-1], np.diff(upto))[:, None]
    spans = [pairs[a:b].astype(np.uint16).tobytes() for a, b in zip(upto, upto[1:])]
    return [spans[k] for k in index]


def _answers(block: pa.Array, own: pa.Array, spans: pa.Array, key: pa.Array | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([block, own, spans, pa.nulls(len(block), pa.binary()) if key is None else key], ["block", "own", "spans", "key"])


def _windows(rows: list[tuple[bytes, int, int, bool]], length: int = LENGTH) -> Iterator[pa.RecordBatch]:
    """The digest of each window of distinct stretches (bytes, block, own, whether they are answered)."""
    for k in range(0, len(rows), 256):
        part = rows[k : k + 256]
        key = [hashlib.blake2b(body[i : i + length], digest_size=16).digest() for body, *_ in part for i in range(len(body) - length + 1)]
        times = np.array([len(body) - length + 1 for body, *_ in part])
        offset = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        spans = np.stack([offset, offset + length], 1).astype(np.uint16)
        block, own, done = (np.repeat(np.array(c), times) for c in list(zip(*part))[1:])
        yield _answers(pa.array(block), pa.array(own), pa.array([None if d else s.tobytes() for d, s in zip(done, spans)], pa.binary()), pa.array(key, pa.binary()))


def _spread(batch: pa.RecordBatch, last):
    """Answers for rows of hot hashes, equal stretches of which are together, and the last stretch, which may go on: those that
    are there twice are repeated as a whole, and one of each gives its windows."""
    body, many = batch.column("body").to_pylist(), batch.column("many").to_pylist()
    block, own = batch.column("block").to_pylist(), [x >> SHORT for x in batch.column("own").to_pylist()]
    whole: list[tuple[int, int, bytes]] = []
    ended = []

    def answered(of_block: int, of_own: int, text: bytes) -> None:
        whole.append((of_block, of_own, np.array([0, len(text)], np.uint16).tobytes()))

    for text, twice, of_block, of_own in zip(body, many, block, own):
        if last is not None and last[0] == text:
            if not last[3]:
                answered(last[1], last[2], text)
                last = (*last[:3], True)
            answered(of_block, of_own, text)
            continue
        if last is not None:
            ended.append(last)
        if twice:
            answered(of_block, of_own, text)
        last = (text, of_block, of_own, twice)
    made = [_answers(*(pa.array(c, t) for c, t in zip(zip(*whole), (pa.int64(), pa.int64(), pa.binary()))))] if whole else []
    return itertools.chain(made, _windows(ended)), last


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def answer(table: pa.Table) -> pa.RecordBatch:
        own = table.column("own").to_numpy()
        spans = judge(table.column("code").to_numpy(), table.column("body").combine_chunks(), own & _MASK, table.column("many").to_numpy(), LENGTH)
        made = _answers(table.column("block").combine_chunks(), pa.array(own >> SHORT), pa.array(spans, pa.binary()))
        return made.filter(pa.array([bool(s) for s in spans]))

    open_run = None  # the last stretch of a hot hash: its bytes, its row, and whether it has been answered
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        told = pa.array(batch.column("own").to_numpy() < 0)
        where = batch.filter(told)
        if where.num_rows:
            yield _answers(where.column("block"), where.column("own"), where.column("body"))
        hot = batch.filter(batch.column("hot"))
        if hot.num_rows:
            made, open_run = _spread(hot, open_run)
            yield from made
        batch = batch.filter(pa.array(~(told.to_numpy(zero_copy_only=False) | batch.column("hot").to_numpy(zero_copy_only=False))))
        k = 0
        while k < batch.num_rows:
            # Rows of the hash that was last held, then as many whole hashes as fit.
            code, ends = batch.column("code").to_numpy(), batch.column("body").slice(k)
            sizes = np.cumsum(np.diff(W.buffers(ends)[1]))
            fit = max(1, int(np.searchsorted(sizes, max(SORT_BYTES - size, 1), "right")))
            end = k + fit
            if size >= SORT_BYTES and held:
                last = held[-1].column("code")[held[-1].num_rows - 1].as_py()
                stop = k
                while stop < batch.num_rows and code[stop] == last:
                    stop += 1
                if stop > k:
                    held.append(batch.slice(k, stop - k))
                if stop < batch.num_rows:
                    yield answer(pa.Table.from_batches(held))
                    held, size = [], 0
                k = stop
                continue
            held.append(batch.slice(k, end - k))
            size += int(sizes[min(fit, len(sizes)) - 1])
            k = end
    if held:
        yield answer(pa.Table.from_batches(held))
    if open_run is not None:
        yield from _windows([open_run])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers, those with a digest by digest: ``n`` windows have it, ``spans`` lists (block, own and offset) of those to answer."""
    names = ["block", "own", "spans", "key", "n"]

    def given(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        key = np.frombuffer(W.buffers(table.column("key").combine_chunks())[0].tobytes(), np.uint64).reshape(-1, 2)
        order = np.lexsort(key.T)
        key, asked = key[order], table.column("spans").is_valid().to_numpy()[order]
        new = np.append(True, (key[1:] != key[:-1]).any(1))
        # A digest of very many windows is several rows.
        run = np.arange(len(key)) - np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        edge = np.flatnonzero(new | (run % IN_ROW == 0))
        offset = np.frombuffer(W.buffers(table.column("spans").combine_chunks().fill_null(bytes(4)))[0].tobytes(), np.uint16)[::2].astype(np.int64)
        told = np.stack([table.column("block").to_numpy()[order], (table.column("own").to_numpy() << SHORT | offset)[order]], 1)[asked]
        at = 16 * np.append(0, np.cumsum(asked))[np.append(edge, len(key))]
        spans = pa.Array.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(told.tobytes())])
        keys = pa.Array.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer(np.arange(len(edge) + 1, dtype=np.int32) * 16), pa.py_buffer(key[edge].tobytes())])
        nothing = pa.nulls(len(edge), pa.int64())
        return pa.RecordBatch.from_arrays([nothing, nothing, spans, keys, pa.array(np.diff(np.append(edge, len(key))))], names)

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        counts = batch.column("key").is_valid()
        plain, windows = batch.filter(pa.array(~counts.to_numpy(zero_copy_only=False))), batch.filter(counts)
        if plain.num_rows:
            yield pa.RecordBatch.from_arrays([*plain.columns, pa.nulls(plain.num_rows, pa.int64())], names)
        if windows.num_rows:
            held.append(windows)
            size += windows.num_rows
        if size >= GATHERED:
            yield given(held)
            held, size = [], 0
    if held:
        yield given(held)


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows that rows of ``_gathered`` list, as a row for each block."""
    for batch in batches:
        rows = np.frombuffer(W.buffers(batch.column(0))[0].tobytes(), np.int64).reshape(-1, 2)
        if len(rows):
            rows = rows[np.argsort(rows[:, 0], kind="stable")]
            edge = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0]))
            spans = [r[:, 1].tobytes() for r in np.split(rows, edge[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(rows[edge, 0]), pa.array(np.full(len(edge), WINDOWS)), pa.array(spans, pa.binary())], ["block", "own", "spans"])


KINDS = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string", "kept": "binary"}


def _finish(outputs: Sequence[str]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, body, offsets = _open(left)
        mark = np.zeros(len(body) + 1, np.int32)
        own = right.column("own").to_numpy()
        spans = right.column("spans").combine_chunks() if right.num_rows else pa.array([], pa.binary())
        told = np.flatnonzero(own == WHERE)
        if len(told) and len(own) > 1:
            data = spans[int(told[0])].as_py()
            n = int.from_bytes(data[:8], "little")
            start, name = np.frombuffer(pa.decompress(data[8:], 8 * n, "zstd", asbytes=True), np.uint32).reshape(2, n).astype(np.int64)
            real = np.flatnonzero(own >= 0)
            flat, at = W.buffers(spans.take(pa.array(real)))
            windows = np.frombuffer(W.buffers(spans.take(pa.array(np.flatnonzero(own == WINDOWS))))[0].tobytes(), np.int64)
            offset = windows & _MASK
            pairs = np.concatenate([np.frombuffer(flat.tobytes(), np.uint16).reshape(-1, 2).astype(np.int64), np.stack([offset, offset + LENGTH], 1)])
            of = np.concatenate([np.repeat(own[real], np.diff(at) // 4), windows >> SHORT])
            pairs = pairs[np.argsort(of, kind="stable")]
            count = np.bincount(of, minlength=int(name.max()) + 2)
            first = np.cumsum(count) - count
            n_pairs = count[name]
            entry = np.repeat(first[name], n_pairs) + np.arange(n_pairs.sum()) - np.repeat(np.cumsum(n_pairs) - n_pairs, n_pairs)
            begin = np.repeat(start, n_pairs)
            mark += np.bincount(begin + pairs[entry, 0], minlength=len(mark)).astype(np.int32)
            mark -= np.bincount(begin + pairs[entry, 1], minlength=len(mark)).astype(np.int32)
        gone = np.cumsum(mark[:-1]) > 0
        edge = np.zeros(len(body) + 1, bool)
        edge[offsets[:-1]] = True
        opens = np.flatnonzero(gone & (edge[:-1] | ~np.append(False, gone[:-1])))
        kept = memoryview(body[~gone].tobytes())
        left_at = np.append(0, np.cumsum(~gone))[offsets]
        found: dict[str, pa.Array] = {"n_bytes": pa.array(np.diff(offsets))}
        found["n_removed"] = pa.array(np.diff(offsets) - np.diff(left_at))
        found["n_spans"] = pa.array(np.diff(np.searchsorted(opens, offsets)))
        if "kept_sha256" in outputs:
            found["kept_sha256"] = pa.array([hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(left_at, left_at[1:])], pa.string())
        if "kept" in outputs:
            found["kept"] = pa.array([bytes(kept[a:b]) for a, b in zip(left_at, left_at[1:])], pa.binary())
        return pa.table([ids, *(found[c] for c in outputs)], ["doc_id", *outputs])

    return run


def remove_repeats(df: DataFrame, *, hot: int = HOT, outputs: Sequence[str] = ("n_bytes", "n_removed", "n_spans", "kept")) -> DataFrame:
    """One row per document: ``doc_id`` and the named outputs (see ``KINDS``); ``kept`` are the bytes that stay.  ``hot`` says
    how many stretches of one anchor a task sorts; the result is the same for any."""
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = rows.mapInArrow(_anchors, ANCHORS).repartition("code").sortWithinPartitions("code").mapInArrow(_shared(hot), f"{ANCHORS}, hot boolean")
    texts = rows.mapInArrow(_texts, TEXTS)
    cut = texts.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_cut_out, STRETCHES)
    route = F.when(F.col("hot"), F.xxhash64("code", "body")).otherwise(F.col("code"))
    placed = cut.withColumn("route", route).repartition("route").sortWithinPartitions("route", "body").drop("route")
    judged = store.written(placed.mapInArrow(lambda batches: _gathered(_judge(batches)), f"{ANSWERS}, n long"), "judged")
    windows = judged.where("key IS NOT NULL")
    twice = windows.groupBy("key").agg(F.sum("n").alias("count")).where("count > 1").select("key")
    again = windows.where("octet_length(spans) > 0").join(twice, "key", "left_semi").select("spans").mapInArrow(_by_block, "block long, own long, spans binary")
    found = judged.where("key IS NULL").select("block", "own", "spans").unionByName(again)
    return texts.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_finish(outputs), ", ".join(["doc_id long", *(f"{c} {KINDS[c]}" for c in outputs)]))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), outputs=("n_bytes", "n_removed", "n_spans", "kept_sha256"))
