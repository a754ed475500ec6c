"""A reader of 8-bit PNG files without palette or interlace."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def decode_png(body: bytes | None) -> np.ndarray | None:
    """Height x width (x channels); None if it is not such a file."""
    if not body or body[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    try:
        at, data, head = 8, b"", None
        while at + 8 <= len(body):
            size, name = struct.unpack_from(">I4s", body, at)
            if name == b"IHDR":
                head = struct.unpack_from(">IIBBBBB", body, at + 8)
            elif name == b"IDAT":
                data += body[at + 8 : at + 8 + size]
            at += 12 + size
        if head is None or head[2] != 8 or head[3] not in _CHANNELS or head[6]:
            return None
        w, h, n = head[0], head[1], _CHANNELS[head[3]]
        rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, 1 + w * n)
    except (zlib.error, ValueError, struct.error):
        return None
    out = np.zeros((h, w * n), np.uint8)
    above = np.zeros(w * n, np.uint8)
    for y in range(h):
        kind, line = rows[y, 0], rows[y, 1:].copy()
        if kind == 1:
            line = np.cumsum(line.reshape(w, n), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            line += above
        elif kind in (3, 4):
            for k in range(w * n):
                a = int(line[k - n]) if k >= n else 0
                b, c = int(above[k]), int(above[k - n]) if k >= n else 0
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[k] = (int(line[k]) + guess) & 255
        elif kind:
            return None
        out[y], above = line, line
    return out.reshape(h, w, n) if n > 1 else out
