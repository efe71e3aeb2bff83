"""Words of a text as bytes: runs of ASCII letters, digits and all that is not ASCII, only A-Z in lower case."""

from __future__ import annotations

_KEPT = {*b"0123456789", *b"abcdefghijklmnopqrstuvwxyz", *range(128, 256)}
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEPT else 32 for b in range(256))


def words_of(raw: bytes) -> list[bytes]:
    """The words of a text in UTF-8, by one byte table: a separator is one byte, and no byte of a longer code point is one."""
    return raw.translate(_TABLE).split()
