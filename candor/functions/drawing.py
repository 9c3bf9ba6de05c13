"""Heat over images, and PNG bytes; numpy and zlib only."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from candor.functions.kernels import resize


def palette() -> np.ndarray:
    """256 colours from dark blue over cyan, yellow and red to dark red: three ramps up and down, a quarter of the way apart."""
    along = np.linspace(0, 4, 256)[:, None]
    return np.round(255 * np.clip(1.5 - np.abs(along - (3, 2, 1)), 0, 1)).astype(np.uint16)


_PALETTE = palette()


def overlay(rgb: np.ndarray, heat: np.ndarray, alpha: float = 0.5) -> np.ndarray:
    """The image under its heat: 256 levels, stretched to the image's size, coloured, and mixed in at ``alpha``, in 256ths."""
    levels = np.rint(np.clip(heat, 0, 1) * 255)
    levels = np.rint(np.clip(resize(levels, *rgb.shape[:2], cubic=True), 0, 255)).astype(np.uint8)
    part = round(256 * alpha)
    return ((_PALETTE[levels] * part + rgb.astype(np.uint16) * (256 - part)) >> 8).astype(np.uint8)


def png(rgb: np.ndarray) -> bytes:
    """An 8-bit RGB PNG file."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    h, w = rgb.shape[:2]
    rows = np.zeros((h, 1 + 3 * w), np.uint8)  # each row begins with its filter, none
    rows[:, 1:] = rgb.reshape(h, 3 * w)
    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")
