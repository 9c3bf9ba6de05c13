"""What a media file says of itself: format, size, EXIF tags, text chunks, JPEG quantisation. No pixel is decoded."""

from __future__ import annotations

import struct
import zlib
from typing import NamedTuple

import numpy as np

# EXIF tags of the first directory.
TAGS = {271: "make", 272: "model", 305: "software"}
#: Text chunks of a file and characters of them all that are looked at.
MOST_TEXTS, MOST_TEXT = 50, 20_000
#: Bytes that one compressed text chunk may unpack to.
MOST_UNPACKED = 1 << 20


class Header(NamedTuple):
    format: str | None = None
    width: int | None = None
    height: int | None = None
    has_exif: bool = False
    make: str | None = None
    model: str | None = None
    software: str | None = None
    text: str = ""
    mean_luma: float | None = None  # of the luminance quantisation table


def exif_tags(tiff: bytes) -> dict[int, str]:
    """Tag number to value of the first directory of a TIFF block; values that are not text are ''."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None or len(tiff) < 8:
        return {}
    (at,) = struct.unpack_from(order + "I", tiff, 4)
    if at + 2 > len(tiff):
        return {}
    (entries,) = struct.unpack_from(order + "H", tiff, at)
    found = {}
    for entry in range(at + 2, min(at + 2 + 12 * entries, len(tiff) - 11), 12):
        tag, kind, count = struct.unpack_from(order + "HHI", tiff, entry)
        value = ""
        if kind == 2:
            start = entry + 8 if count <= 4 else struct.unpack_from(order + "I", tiff, entry + 8)[0]
            value = tiff[start : start + count].split(b"\0")[0].decode("latin-1")
        found[tag] = value
    return found


def _with_exif(fields: dict, tiff: bytes) -> None:
    tags = exif_tags(tiff)
    fields["has_exif"] = bool(tags)
    fields.update({name: tags[tag].strip() if name != "software" else tags[tag] for tag, name in TAGS.items() if tag in tags})


def _jpeg(raw: bytes) -> dict:
    fields: dict = {"format": "JPEG"}
    texts, at = [], 2
    while at + 4 <= len(raw) and raw[at] == 0xFF:
        mark = raw[at + 1]
        if mark == 0xFF:  # padding
            at += 1
            continue
        if mark in (0xD9, 0xDA):  # the image's end, or its entropy-coded part
            break
        (size,) = struct.unpack_from(">H", raw, at + 2)
        body = raw[at + 4 : at + 2 + size]
        if mark == 0xE1 and body[:6] == b"Exif\0\0":
            _with_exif(fields, body[6:])
        elif mark == 0xFE:
            texts.append(body.decode("latin-1"))
        elif mark == 0xDB:
            place = 0
            while place < len(body):
                wide, number = body[place] >> 4, body[place] & 15
                table = np.frombuffer(body[place + 1 : place + 1 + 64 * (1 + wide)], ">u2" if wide else "u1")
                if number == 0 and len(table) == 64:
                    fields["mean_luma"] = float(table.mean())
                place += 1 + 64 * (1 + wide)
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC) and len(body) >= 5:
            fields["height"], fields["width"] = struct.unpack_from(">HH", body, 1)
        at += 2 + size
    return fields | {"texts": texts}


def _unpacked(data: bytes) -> bytes:
    try:
        return zlib.decompressobj().decompress(data, MOST_UNPACKED)
    except zlib.error:
        return b""


def _png(raw: bytes) -> dict:
    fields: dict = {"format": "PNG"}
    texts, at = [], 8
    while at + 8 <= len(raw):
        size, kind = struct.unpack_from(">I4s", raw, at)
        body = raw[at + 8 : at + 8 + size]
        if kind == b"IHDR" and len(body) >= 8:
            fields["width"], fields["height"] = struct.unpack_from(">II", body)
        elif kind == b"eXIf":
            _with_exif(fields, body)
        elif kind == b"tEXt":
            texts.append(body.partition(b"\0")[2].decode("latin-1"))
        elif kind == b"zTXt":
            texts.append(_unpacked(body.partition(b"\0")[2][1:]).decode("latin-1"))
        elif kind == b"iTXt":
            packed, rest = body.partition(b"\0")[2][:1], body.partition(b"\0")[2][2:]
            value = rest.split(b"\0", 2)[-1]
            texts.append((_unpacked(value) if packed == b"\1" else value).decode("utf-8", "replace"))
        elif kind == b"IEND":
            break
        at += 12 + size
    return fields | {"texts": texts}


def _webp(raw: bytes) -> dict:
    fields: dict = {"format": "WEBP"}
    at = 12
    while at + 8 <= len(raw):
        kind, size = struct.unpack_from("<4sI", raw, at)
        body = raw[at + 8 : at + 8 + size]
        if kind == b"EXIF":
            _with_exif(fields, body[6:] if body[:6] == b"Exif\0\0" else body)
        elif kind == b"VP8X" and len(body) >= 10:
            fields["width"], fields["height"] = (int.from_bytes(body[i : i + 3], "little") + 1 for i in (4, 7))
        elif kind == b"VP8 " and len(body) >= 10 and "width" not in fields:
            fields["width"], fields["height"] = (v & 0x3FFF for v in struct.unpack_from("<HH", body, 6))
        elif kind == b"VP8L" and len(body) >= 5 and "width" not in fields:
            bits = int.from_bytes(body[1:5], "little")
            fields["width"], fields["height"] = (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        at += 8 + size + size % 2
    return fields | {"texts": []}


def parse(raw: bytes) -> Header:
    """The header of JPEG, PNG, WebP and BMP bytes. Other and broken files give what could be read before the fault."""
    try:
        if raw[:2] == b"\xff\xd8":
            fields = _jpeg(raw)
        elif raw[:8] == b"\x89PNG\r\n\x1a\n":
            fields = _png(raw)
        elif raw[:4] == b"RIFF" and raw[8:12] == b"WEBP":
            fields = _webp(raw)
        elif raw[:2] == b"BM" and len(raw) >= 26:
            width, height = struct.unpack_from("<ii", raw, 18)
            fields = {"format": "BMP", "width": width, "height": abs(height), "texts": []}
        else:
            return Header()
    except (struct.error, IndexError, ValueError):
        return Header()
    texts = fields.pop("texts")
    return Header(**fields, text=" ".join(texts[:MOST_TEXTS])[:MOST_TEXT])
