"""Grey images as PNG bytes, without an image library."""

from __future__ import annotations

import struct
import zlib

import numpy as np


def encode(a: np.ndarray) -> bytes:
    """An 8- or 16-bit grey array (rows, columns)."""
    bits = 8 * a.dtype.itemsize
    body = b"".join(b"\0" + row.astype(f">u{a.dtype.itemsize}").tobytes() for row in a)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], bits, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body, 6)) + chunk(b"IEND", b"")
