"""Pictures of a bounded matrix on the driver: PPM and PNG files, made anew only, with no rest left after a failure."""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np

from resonant.functions.drawing import ANCHORS, CEILING_DB, FLOOR_DB

MAX_COLUMNS, MAX_ROWS = 3840, 2160


def colours(db: np.ndarray, floor: float = FLOOR_DB, ceiling: float = CEILING_DB) -> np.ndarray:
    """Red, green and blue of a matrix of levels, as drawing.colour() has them."""
    at = np.clip((db - floor) / (ceiling - floor), 0, 1) * (len(ANCHORS) - 1)
    cell = np.minimum(np.floor(at), len(ANCHORS) - 2).astype(int)
    share = (at - cell)[..., None]
    anchors = np.array(ANCHORS, float)
    mixed = anchors[cell] * (1 - share) + anchors[cell + 1] * share
    return np.floor(mixed + 0.5).astype(np.uint8)


def canvas(db: np.ndarray, width: int, height: int) -> np.ndarray:
    """A matrix of columns x bins as height x width levels, low bins at the bottom: rows mix neighbouring bins in linear power,
    columns repeat."""
    if not 1 <= width <= MAX_COLUMNS or not 1 <= height <= MAX_ROWS:
        raise ValueError("canvas size")
    columns, bins = db.shape
    power = 10 ** (db[np.arange(width) * columns // width] / 10)
    place = np.linspace(bins - 1, 0, height) if height > 1 else np.zeros(1)
    low = np.minimum(place.astype(int), max(bins - 2, 0))
    share = place - low
    mixed = power[:, low] * (1 - share) + power[:, np.minimum(low + 1, bins - 1)] * share
    return np.maximum(10 * np.log10(np.maximum(mixed, 1e-30)), FLOOR_DB).T


def ppm(rgb: np.ndarray) -> bytes:
    return b"P6\n%d %d\n255\n" % (rgb.shape[1], rgb.shape[0]) + rgb.astype(np.uint8).tobytes()


def png(rgb: np.ndarray) -> bytes:
    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    height, width, _ = rgb.shape
    rows = np.concatenate([np.zeros((height, 1), np.uint8), rgb.astype(np.uint8).reshape(height, 3 * width)], axis=1)
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def save(path: str, data: bytes) -> None:
    """Write a new file; an existing one is never replaced, and one that could not be finished is removed."""
    handle = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o644)
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
    except BaseException:
        os.unlink(path)
        raise
