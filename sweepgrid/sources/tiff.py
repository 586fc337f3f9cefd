"""Grey images as TIFF bytes, without an image library."""

from __future__ import annotations

import struct

import numpy as np


def encode(a: np.ndarray) -> bytes:
    """An 8- or 16-bit grey array (rows, columns): baseline TIFF, little-endian, one uncompressed strip."""
    bits = 8 * a.dtype.itemsize
    body = a.astype(f"<u{a.dtype.itemsize}").tobytes()
    h, w = a.shape
    # Tags in order: width, height, bits, no compression, black is 0, strip offset, samples, rows in the strip, bytes in the strip.
    tags = [(256, 4, w), (257, 4, h), (258, 3, bits), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, h), (279, 4, len(body))]
    pad = b"\0" * (len(body) % 2)
    directory = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII" if kind == 4 else "<HHIHxx", tag, kind, 1, value) for tag, kind, value in tags) + struct.pack("<I", 0)
    return b"II*\0" + struct.pack("<I", 8 + len(body) + len(pad)) + body + pad + directory
