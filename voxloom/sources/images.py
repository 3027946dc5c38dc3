"""Decoders and encoders of raw, TIFF and npy images, for tasks: bytes in, arrays out."""

from __future__ import annotations

import io
import struct

import numpy as np

#: TIFF field types: bytes and struct letter (fixed values of the format).
FIELD = {1: (1, "B"), 3: (2, "H"), 4: (4, "I"), 16: (8, "Q")}
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, ROWS, COUNTS, FORMAT = 256, 257, 258, 259, 273, 277, 278, 279, 339


def decode_raw(data: bytes, frame: int) -> np.ndarray:
    """Headerless little-endian 16-bit frames, ``[z, y, x]``."""
    return np.frombuffer(data, "<u2").reshape(-1, frame, frame)


def decode_tiff(data: bytes) -> np.ndarray:
    """Pages of an uncompressed greyscale TIFF, ``[z, y, x]``; others are a ValueError."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, pages = struct.unpack_from(order + "I", data, 4)[0], []
    while at:
        (n,) = struct.unpack_from(order + "H", data, at)
        tags: dict[int, tuple] = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind in FIELD:
                size, letter = FIELD[kind]
                where = at + 10 + 12 * k
                if size * count > 4:
                    (where,) = struct.unpack_from(order + "I", data, where)
                tags[tag] = struct.unpack_from(f"{order}{count}{letter}", data, where)
        bits = tags.get(BITS, (1,))[0]
        if tags.get(COMPRESSION, (1,))[0] != 1 or tags.get(SAMPLES, (1,))[0] != 1 or bits not in (8, 16, 32):
            raise ValueError("only uncompressed greyscale TIFF of 8, 16 or 32 bits is read")
        kind = ("f" if tags.get(FORMAT, (1,))[0] == 3 else "u") + str(bits // 8)
        raw = b"".join(data[a : a + c] for a, c in zip(tags[OFFSETS], tags[COUNTS], strict=True))
        pages.append(np.frombuffer(raw, order + kind).reshape(tags[HEIGHT][0], tags[WIDTH][0]))
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    return np.stack(pages)


def encode_tiff(volume: np.ndarray) -> bytes:
    """A little-endian uncompressed TIFF with a page for each plane of ``[z, y, x]``."""
    volume = np.ascontiguousarray(volume if volume.ndim == 3 else volume[None])
    kind = 3 if volume.dtype.kind == "f" else 1
    out = io.BytesIO()
    out.write(struct.pack("<2sHI", b"II", 42, 8))
    at, (n, ny, nx), size = 8, volume.shape, volume[0].nbytes
    for k in range(n):
        tags = [(WIDTH, 4, nx), (HEIGHT, 4, ny), (BITS, 3, volume.itemsize * 8), (COMPRESSION, 3, 1), (262, 3, 1), (OFFSETS, 4, at + 2 + 12 * 10 + 4), (SAMPLES, 3, 1), (ROWS, 4, ny), (COUNTS, 4, size), (FORMAT, 3, kind)]
        after = at + 2 + 12 * len(tags) + 4 + size
        after += after % 2
        out.write(struct.pack("<H", len(tags)))
        for tag, kind_, value in tags:
            out.write(struct.pack("<HHIHH", tag, kind_, 1, value, 0) if kind_ == 3 else struct.pack("<HHII", tag, kind_, 1, value))
        out.write(struct.pack("<I", after if k < n - 1 else 0))
        out.write(volume[k].astype(volume.dtype.newbyteorder("<")).tobytes())
        out.write(b"\0" * (after - out.tell()))
        at = after
    return out.getvalue()


def decode_npy(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)


def encode_npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array)
    return out.getvalue()
