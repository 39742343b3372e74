"""Suffixes sorted by hash comparison: common extensions by prefix hashes and binary search."""

from __future__ import annotations

import functools

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _bytes() -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


@functools.lru_cache(4)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Suffixes:
    """The bytes of ``body`` with sums of c[i] * BASE^i before each place; a stretch's hash is a difference, moved to place 0."""

    def __init__(self, body: np.ndarray, limit: int):
        room = 1 << int(np.ceil(np.log2(len(body) + 2)))
        self.body, self.limit = body, limit
        self.sums = np.zeros(len(body) + 1, np.uint64)
        np.cumsum(_bytes()[body] * _powers(room, int(BASE))[: len(body)], out=self.sums[1:])
        self.back = _powers(room, pow(int(BASE), -1, 1 << 64))
        self.jumps = [1 << k for k in range(limit.bit_length() - 1, -1, -1)]

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How far the suffixes at ``x`` and ``y`` agree, up to the limit; both must have that many bytes."""
        far = np.zeros(len(x), np.int64)
        sums, back = self.sums, self.back
        bx, by = back[x], back[y]
        sx, sy = sums[x], sums[y]
        for jump in self.jumps:
            reach = far + jump
            reach = np.where(reach <= self.limit, reach, far)
            same = (sums[x + reach] - sx) * bx == (sums[y + reach] - sy) * by
            far = np.where(same, reach, far)
        return far

    def before(self, x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether suffix x comes before y; equal ones do where ``ties``."""
        far = self.extension(x, y)
        full = far >= self.limit
        at = np.where(full, 0, far)
        return np.where(full, ties, self.body[x + at] < self.body[y + at])

    def sort(self, starts: np.ndarray, group: np.ndarray) -> np.ndarray:
        """The order of the suffixes at ``starts`` within each group (groups are together): mergesort of all groups at once."""
        n = len(starts)
        edge = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else np.zeros(0, np.int64)
        size = np.diff(np.append(edge, n))
        first, size = np.repeat(edge, size), np.repeat(size, size)
        order = np.arange(n)
        width, most = 1, int(size.max(initial=0))
        while width < most:
            slot = np.flatnonzero(size > width)
            place = slot - first[slot]
            run = place // width
            low = first[slot] + (run ^ 1) * width
            end = first[slot] + size[slot]
            high = np.minimum(low + width, end)
            low = np.minimum(low, high)
            begin = low.copy()
            x, left = starts[order[slot]], (run & 1) == 0
            # Left elements go before equal ones of the right run.
            todo = np.flatnonzero(low < high)
            while len(todo):
                middle = (low[todo] + high[todo]) >> 1
                less = self.before(starts[order[middle]], x[todo], ~left[todo])
                low[todo] = np.where(less, middle + 1, low[todo])
                high[todo] = np.where(less, high[todo], middle)
                todo = todo[low[todo] < high[todo]]
            target = first[slot] + (run >> 1) * 2 * width + place % width + (low - begin)
            new = order.copy()
            new[target] = order[slot]
            order = new
            width *= 2
        return order

    def repeated(self, starts: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Whether the first ``limit`` bytes of a suffix also start another suffix of its group; verified byte by byte."""
        order = self.sort(starts, group)
        out = np.zeros(len(starts), bool)
        a, b = order[:-1], order[1:]
        pair = np.flatnonzero(group[:-1] == group[1:])
        pair = pair[self.extension(starts[a[pair]], starts[b[pair]]) >= self.limit]
        views = np.lib.stride_tricks.sliding_window_view(self.body, self.limit)
        for k in range(0, len(pair), 1 << 15):
            part = pair[k : k + (1 << 15)]
            if not (views[starts[a[part]]] == views[starts[b[part]]]).all():
                return self._exact(starts, group, views)
            out[a[part]] = out[b[part]] = True
        return out

    def _exact(self, starts, group, views) -> np.ndarray:
        """Without hashes, for a collision."""
        seen: dict[tuple[int, bytes], list[int]] = {}
        for k, (s, g) in enumerate(zip(starts.tolist(), group.tolist())):
            seen.setdefault((g, views[s].tobytes()), []).append(k)
        out = np.zeros(len(starts), bool)
        out[[k for v in seen.values() if len(v) > 1 for k in v]] = True
        return out
