"""XZ streams: one LZMA2 filter with a 16 MiB dictionary, as pandas UDFs."""

from __future__ import annotations

import lzma
import struct
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DICTIONARY, PRESET = 16 << 20, 9
#: Least window of the encoder, and what stands at byte 12 of a stream: a block header of 12 bytes with
#: one LZMA2 filter, but for the byte of the dictionary's size; 0x18 there is 16 MiB.
WINDOW, HEADER, DICTIONARY_BYTE = 1 << 16, b"\x02\x00\x21\x01", b"\x18"


def pack(data: bytes, preset: int = PRESET) -> bytes:
    """The encoder's window is as large as the data needs, since its tables are cleared for each
    stream; the header names the full dictionary."""
    window = min(DICTIONARY, max(WINDOW, 1 << (len(data) - 1).bit_length()))
    out = lzma.compress(data, lzma.FORMAT_XZ, filters=[{"id": lzma.FILTER_LZMA2, "preset": preset, "dict_size": window}])
    if window == DICTIONARY or out[12:16] != HEADER:  # an empty stream has no block
        return out
    header = HEADER + DICTIONARY_BYTE + bytes(3)
    return out[:12] + header + struct.pack("<I", zlib.crc32(header)) + out[24:]


def unpack(data: bytes) -> bytes:
    """The stream's content; a truncated stream or one with a tail is refused."""
    stream = lzma.LZMADecompressor(lzma.FORMAT_XZ)
    out = stream.decompress(data)
    if not stream.eof or stream.unused_data:
        raise ValueError("the XZ stream is truncated or has a tail")
    return out


def compress(data: Column, preset: int = PRESET) -> Column:
    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda b: None if b is None else pack(bytes(b), preset))

    return run(data)


def decompress(data: Column) -> Column:
    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda b: None if b is None else unpack(bytes(b)))

    return run(data)
