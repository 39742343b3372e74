"""Pixels of an image as an array (height, width, 3): PNG files read and written, regions covered, boxes drawn.

Other kinds of images are for a plugged-in reader (``sinks.images_with``).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

HEAD = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 6: 4}


def read_png(data: bytes) -> np.ndarray:
    """8-bit grey, RGB or RGBA without interlacing; transparency is dropped."""
    if not data.startswith(HEAD):
        raise ValueError("no PNG file")
    at, body = len(HEAD), []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            width, height, depth, color, _, _, interlace = struct.unpack(">IIBBBBB", data[at + 8 : at + 21])
            if depth != 8 or color not in CHANNELS or interlace:
                raise ValueError("this kind of PNG needs a reader of its own")
        elif kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + size])
        at += 12 + size
    n = CHANNELS[color]
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + width * n)
    out = np.zeros((height + 1, width + 1, n), np.uint8)  # with a border of zeros above and to the left
    for y in range(height):
        line, rule, above = rows[y, 1:].reshape(width, n), rows[y, 0], out[y, 1:]
        if rule == 0:
            out[y + 1, 1:] = line
        elif rule == 1:
            out[y + 1, 1:] = np.cumsum(line, axis=0, dtype=np.uint64).astype(np.uint8)
        elif rule == 2:
            out[y + 1, 1:] = line + above
        else:
            for x in range(width):
                a, b, c = (v.astype(int) for v in (out[y + 1, x], out[y, x + 1], out[y, x]))
                if rule == 3:
                    guess = (a + b) // 2
                else:
                    da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))
                out[y + 1, x + 1] = (line[x] + guess) % 256
    pixels = out[1:, 1:]
    return np.repeat(pixels, 3, axis=2) if n == 1 else pixels[:, :, :3].copy()


def write_png(pixels: np.ndarray) -> bytes:
    height, width, _ = pixels.shape
    rows = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], 1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return HEAD + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def rgb(color: str | None) -> tuple[int, int, int]:
    """Of ``#rrggbb``; black if it is none."""
    digits = (color or "").strip().lstrip("#")
    try:
        return tuple(bytes.fromhex(digits)) if len(digits) == 6 else (0, 0, 0)
    except ValueError:
        return 0, 0, 0


def _edges(box: dict, width: int, height: int) -> tuple[int, int, int, int]:
    return int(box["x"] * width), int(box["y"] * height), int((box["x"] + box["width"]) * width), int((box["y"] + box["height"]) * height)


def cover(pixels: np.ndarray, boxes: list[dict], method: str = "fill", strength: int = 25, color: str = "#000000") -> np.ndarray:
    """The image with the boxes (fractions) as blocks of one colour (mosaic), blurred, or filled."""
    out, (height, width, _) = pixels.copy(), pixels.shape
    share = max(1, min(100, strength)) / 100
    for box in boxes:
        x1, y1, x2, y2 = _edges(box, width, height)
        x1, x2 = sorted((max(0, min(width, x1)), max(0, min(width, x2))))
        y1, y2 = sorted((max(0, min(height, y1)), max(0, min(height, y2))))
        if x1 == x2 or y1 == y2:
            continue
        part = out[y1:y2, x1:x2]
        if method == "mosaic":
            block = max(2, int(2 + share * (min(part.shape[:2]) // 8)))
            rows, columns = max(1, (y2 - y1) // block), max(1, (x2 - x1) // block)
            pick = lambda n, k: ((np.arange(n) * k // n + 0.5) * n / k).astype(int)
            out[y1:y2, x1:x2] = part[pick(y2 - y1, rows)][:, pick(x2 - x1, columns)]
        elif method == "blur":
            out[y1:y2, x1:x2] = blurred(part, max(1, int(1 + share * 24)))
        else:
            out[y1 : y2 + 1, x1 : x2 + 1] = rgb(color)
    return out


def blurred(part: np.ndarray, radius: int) -> np.ndarray:
    """Three running means each way, which come close to a Gaussian; edges are carried on."""
    out = part.astype(np.float64)
    for axis in (0, 1) * 3:
        padded = np.concatenate([np.repeat(np.take(out, [0], axis), radius + 1, axis), out, np.repeat(np.take(out, [-1], axis), radius, axis)], axis)
        sums, n = np.cumsum(padded, axis), out.shape[axis]
        out = (np.take(sums, range(2 * radius + 1, 2 * radius + 1 + n), axis) - np.take(sums, range(n), axis)) / (2 * radius + 1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def outlined(pixels: np.ndarray, boxes: list[dict], color: str = "#6B7280", line: int = 2) -> np.ndarray:
    """The image with a frame around each box (fractions)."""
    out, (height, width, _) = pixels.copy(), pixels.shape
    for box in boxes:
        x1, y1, x2, y2 = _edges(box, width, height)
        inner = np.zeros((height, width), bool)
        inner[max(0, y1) : y2 + 1, max(0, x1) : x2 + 1] = True
        inner[max(0, y1 + line) : max(0, y2 + 1 - line), max(0, x1 + line) : max(0, x2 + 1 - line)] = False
        out[inner] = rgb(color)
    return out


def preview(pixels: np.ndarray, most: int = 256) -> np.ndarray:
    """The image by its nearest pixels, its longer side ``most`` at most."""
    height, width, _ = pixels.shape
    scale = max(1.0, max(height, width) / most)
    pick = lambda n: (np.arange(max(1, int(n / scale))) * scale).astype(int)
    return pixels[pick(height)][:, pick(width)]
