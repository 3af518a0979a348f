"""Byte layouts of codec files and archives; see the README for the formats."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from slotgram.functions import xz
from slotgram.functions.meta import META_FILE

# Fixed values of the formats.
CODEC_MAGIC, VERSION, FLAG, ARCHIVE_MAGIC = b"EDAC", 1, 1, b"EDA\x01"


class LayoutError(ValueError):
    """A file does not follow its layout."""


def _text(raw: bytes, prefix: str = "<H") -> bytes:
    try:
        return struct.pack(prefix, len(raw)) + raw
    except struct.error as e:
        raise LayoutError("a length field overflows") from e


class Cursor:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise LayoutError("the file is truncated")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, kind: str) -> int:
        return struct.unpack(kind, self.take(struct.calcsize(kind)))[0]


def write_codec(entries: list[tuple[str, int]]) -> bytes:
    if len({s for _, s in entries}) < len(entries):
        raise LayoutError("two tokens have one slot")
    out = [CODEC_MAGIC, bytes((VERSION, FLAG)), struct.pack("<H", len(entries))]
    for token, slot in sorted(entries, key=lambda x: x[1]):
        raw = token.encode()
        if not 1 <= len(raw) <= 255:
            raise LayoutError("a token needs 1 to 255 bytes")
        out.append(struct.pack("<HB", slot, len(raw)) + raw)
    return b"".join(out)


def read_codec(data: bytes) -> list[tuple[str, int]]:
    c = Cursor(data)
    if c.take(4) != CODEC_MAGIC or c.number("B") != VERSION or c.number("B") != FLAG:
        raise LayoutError("not a codec file of version 1")
    out = []
    for _ in range(c.number("<H")):
        slot, n = c.number("<H"), c.number("B")
        out.append((c.take(n).decode(), slot))
    return out


def write_file_archive(codec: str, meta: str, encoded: bytes, preset: int = xz.PRESET) -> bytes:
    name = codec.encode()
    if len(name) & 0xFF == ord("D"):  # the low byte of this length is where the type of a directory stands
        raise LayoutError("this codec name's length would read as a directory archive")
    return ARCHIVE_MAGIC + _text(name) + b"F" + _text(meta.encode()) + struct.pack("<Q", len(encoded)) + xz.pack(encoded, preset)


def write_directory_archive(codec: str, meta: str, entries: list[tuple[str, bytes]], preset: int = xz.PRESET) -> bytes:
    """``entries``: (path, encoded), packed in path order after the metadata entry."""
    parts = [_text(codec.encode()), struct.pack("<I", len(entries) + 1)]
    for path, data in [(META_FILE, meta.encode()), *sorted(entries)]:
        parts += [_text(path.encode()), struct.pack("<Q", len(data)), data]
    return ARCHIVE_MAGIC + b"D" + xz.pack(b"".join(parts), preset)


def read_header(data: bytes) -> tuple[str, bytes, int, int]:
    """Codec name, metadata, encoded size, and where the XZ stream begins, of a file archive.  The
    stream is not touched."""
    c = Cursor(data)
    if c.take(4) != ARCHIVE_MAGIC:
        raise LayoutError("not an archive")
    if c.data[4:5] == b"D":
        raise LayoutError("a directory archive")
    try:
        codec = c.take(c.number("<H")).decode()
    except UnicodeDecodeError as e:
        raise LayoutError(str(e)) from e
    if c.take(1) != b"F":
        raise LayoutError("unknown archive type")
    return codec, c.take(c.number("<H")), c.number("<Q"), c.at


def read_archive(data: bytes) -> tuple[str, str, Iterator[tuple[int, str, bytes]]]:
    """Codec name, type, and (ord, path, content); ord 0 is the metadata.  All sizes are
    checked.  A file archive's content has the path ''."""
    c = Cursor(data)
    if c.take(4) != ARCHIVE_MAGIC:
        raise LayoutError("not an archive")
    try:
        if c.data[4:5] == b"D":
            c = Cursor(xz.unpack(data[5:]))
            codec = c.take(c.number("<H")).decode()
            rows = []
            for i in range(c.number("<I")):
                path = c.take(c.number("<H")).decode()
                rows.append((i, path, c.take(c.number("<Q"))))
            return codec, "D", iter(rows)
        codec, meta, size, at = read_header(data)
        encoded = xz.unpack(data[at:])
    except (UnicodeDecodeError, EOFError, xz.lzma.LZMAError) as e:
        raise LayoutError(str(e)) from e
    if len(encoded) != size:
        raise LayoutError("the content has another size than its header says")
    return codec, "F", iter([(0, META_FILE, meta), (1, "", encoded)])
