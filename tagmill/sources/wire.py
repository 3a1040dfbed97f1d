"""MessagePack for responses: maps are dictionaries or lists of pairs (keys may repeat), arrays are tuples."""

from __future__ import annotations

import struct


def _head(n: int, small: int, limit: int, codes: tuple[tuple[int, int, str], ...]) -> bytes:
    """The head of a value of n elements or bytes: one byte below the limit, else the first code that is wide enough."""
    if n < limit:
        return bytes([small | n])
    for code, most, form in codes:
        if n <= most:
            return struct.pack(f">B{form}", code, n)
    raise ValueError("too long for MessagePack")


def packed(value: object) -> bytes:
    match value:
        case None:
            return b"\xc0"
        case bool():
            return b"\xc3" if value else b"\xc2"
        case int() if value >= 0:
            return _head(value, 0, 128, ((0xCC, 0xFF, "B"), (0xCD, 0xFFFF, "H"), (0xCE, 0xFFFFFFFF, "I"), (0xCF, 2**64 - 1, "Q")))
        case int():
            for code, form, bits in ((0xD0, "b", 7), (0xD1, "h", 15), (0xD2, "i", 31), (0xD3, "q", 63)):
                if value >= -(1 << bits):
                    return bytes([value & 0xFF]) if value >= -32 else struct.pack(f">B{form}", code, value)
            raise ValueError("too small for MessagePack")
        case str():
            raw = value.encode()
            return _head(len(raw), 0xA0, 32, ((0xD9, 0xFF, "B"), (0xDA, 0xFFFF, "H"), (0xDB, 0xFFFFFFFF, "I"))) + raw
        case tuple():
            return _head(len(value), 0x90, 16, ((0xDC, 0xFFFF, "H"), (0xDD, 0xFFFFFFFF, "I"))) + b"".join(map(packed, value))
        case dict():
            return packed(list(value.items()))
        case list():
            return _head(len(value), 0x80, 16, ((0xDE, 0xFFFF, "H"), (0xDF, 0xFFFFFFFF, "I"))) + b"".join(packed(k) + packed(v) for k, v in value)
    raise TypeError(type(value).__name__)
