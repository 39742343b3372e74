"""Code points of whole batches of texts, folded for comparison."""

from __future__ import annotations

import functools
import sys

import numpy as np

from spanforge.llm import words as W


@functools.cache
def folded() -> np.ndarray:
    """The lower-case form of each code point that has one of one character; white space gives a plain space."""
    table = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(0x1FFFF):
        low = chr(c).lower()
        if len(low) == 1:
            table[c] = ord(low)
    table[W.WHITE_SPACE] = 32
    return table


def points(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, where each text begins in them) of UTF-8 bytes."""
    found = np.frombuffer(body.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(found) == len(body):
        return found, offsets
    lead = np.append(0, np.cumsum((body & 0xC0) != 0x80))
    return found, lead[offsets]
