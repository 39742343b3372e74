"""Pre-tokens of byte-level BPE, found for whole batches of texts at once.

The split is that of ``public_tokenizers.PATTERN`` (contractions, runs of letters, of numbers and of other signs, each with
one leading space, and white space).  Every rule looks at no more than a run of one class and its neighbours, so the cuts
are array operations on the UTF-8 bytes instead of a regex call for each match.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np
import pyarrow as pa

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Bytes that are cut at once: the arrays of a step take about ten times as much.
STEP_BYTES = 4 << 20
# The code points with the White_Space property.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)], np.uint8)
    table[WHITE_SPACE] = SPACE
    return table


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null texts count as empty."""
    column = column.cast(pa.large_binary() if column.type in (pa.large_string(), pa.large_binary()) else pa.binary())
    if column.null_count:
        column = column.fill_null(b"")
    kind = np.int64 if column.type == pa.large_binary() else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return body, at - at[0]


def steps(offsets: np.ndarray, most: int):
    """Ranges of texts of about ``most`` bytes each; a longer text is a range of its own."""
    k, n = 0, len(offsets) - 1
    while k < n:
        end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + most, "right")) - 1)
        yield k, end
        k = end


def cuts(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in ``body``, texts of which begin at ``offsets``."""
    found = [_cuts(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) + offsets[a] for a, b in steps(offsets, STEP_BYTES)]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _cuts(b: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(b)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[:256][b]
    lead = None
    high = np.flatnonzero(b >= 0x80)
    if len(high):
        lead = high[b[high] >= 0xC0]
        first = b[lead].astype(np.uint32)
        after = [b[np.minimum(lead + j, n - 1)].astype(np.uint32) & 0x3F for j in (1, 2, 3)]
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        point = np.where(size == 2, (first & 0x1F) << 6 | after[0], np.where(size == 3, (first & 0x0F) << 12 | after[0] << 6 | after[1], (first & 7) << 18 | after[0] << 12 | after[1] << 6 | after[2]))
        of = classes()[np.minimum(point, sys.maxunicode)]
        for j in range(4):
            inside = size > j
            kind[np.minimum(lead[inside] + j, n - 1)] = of[inside]
    begins = np.zeros(n + 1, bool)
    begins[offsets[offsets < n]] = True
    begins[n] = True
    start = begins[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # White space before something else in the same text: its last character stands apart, and a plain space joins what follows.
    ends = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~begins[1:n]) + 1
    plain = ends[b[ends - 1] == 32]
    start[plain - 1] = True
    start[plain] = False
    rest = ends[b[ends - 1] != 32] - 1
    while len(more := rest[(b[rest] & 0xC0) == 0x80]):
        rest = np.concatenate([rest[(b[rest] & 0xC0) != 0x80], more - 1])
    start[rest] = True
    # An apostrophe alone, at the start of a pre-token, with one of the endings.
    marks = np.flatnonzero(b[: n - 1] == 39)
    if len(marks):
        marks = marks[start[marks] & start[marks + 1] & ~begins[marks + 1] & (kind[marks + 1] == LETTER)]
        one = b[marks + 1]
        two = b[np.minimum(marks + 2, n - 1)]
        whole = (marks + 2 < n) & ~begins[np.minimum(marks + 2, n)]
        short = np.isin(one, list(b"stmd"))
        long = whole & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        for picked, size in ((marks[short], 2), (marks[long & ~short], 3)):
            start[picked + 1] = False
            after = picked + size
            start[after[after < n]] = True
    return np.flatnonzero(start)


def distinct(body: np.ndarray, starts: np.ndarray, kind: pa.DataType | None = None) -> tuple[pa.Array, np.ndarray]:
    """(the distinct pre-tokens, for each pre-token its place among them)."""
    if not len(starts):
        return pa.array([], kind or pa.binary()), np.zeros(0, np.int32)
    at = pa.py_buffer(np.append(starts, len(body)).astype(np.int32))
    coded = pa.Array.from_buffers(kind or pa.binary(), len(starts), [None, at, pa.py_buffer(np.ascontiguousarray(body))]).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()
