"""$HEX[..] codec and the byte classes that decide when a line is encoded."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from linesets.functions.keys import as_binary, latin1

# Bytes that force encoding by default, and the frame.
DEFAULT_RANGES = ((0x00, 0x1F), (0x3A, 0x3A), (0x7F, 0xFF))
OPENING, CLOSING = "$HEX[", "]"


def _byte(token: str) -> int:
    token = token.strip() or token
    if token.lower().startswith("0x") and len(token) > 2:
        value = int(token, 16)
    elif token.isdigit():
        value = int(token)
    elif len(token) == 1:
        value = ord(token)
    else:
        raise ValueError(f"not a byte: {token!r}")
    if not 0 <= value <= 255:
        raise ValueError(f"not a byte: {token!r}")
    return value


def parse_bytes(spec: str) -> set[int]:
    """Bytes of a list such as 'a-f,0x80-0xff,58'; digits are decimal."""
    found: set[int] = set()
    for item in spec.split(","):
        if item == "":
            continue
        low, dash, high = item.partition("-")
        if dash and low and high:
            found.update(range(_byte(low), _byte(high) + 1))
        else:
            found.add(_byte(item))
    return found


class ByteClass:
    """Set of bytes that force encoding; with_set and with_clear give new ones."""

    def __init__(self, members: Iterable[int] | None = None):
        if members is None:
            members = (b for low, high in DEFAULT_RANGES for b in range(low, high + 1))
        self.members = frozenset(members)

    def with_set(self, spec: str) -> ByteClass:
        return ByteClass(self.members | parse_bytes(spec))

    def with_clear(self, spec: str) -> ByteClass:
        return ByteClass(self.members - parse_bytes(spec))

    def pattern(self) -> str | None:
        """Java character class over one-character-per-byte text; None if empty."""
        if not self.members:
            return None
        return "[" + "".join(f"\\x{b:02x}" for b in sorted(self.members)) + "]"

    def matches(self, line: Column) -> Column:
        pattern = self.pattern()
        return F.lit(False) if pattern is None else latin1(line).rlike(pattern)


def hex_encode(line: Column, byte_class: ByteClass | None = None) -> Column:
    """The line, or its $HEX[..] form if it holds a byte of the class (binary)."""
    raw = as_binary(line)
    framed = F.concat(F.lit(OPENING), F.lower(F.hex(raw)), F.lit(CLOSING)).cast("binary")
    return F.when((byte_class or ByteClass()).matches(raw), framed).otherwise(raw)


def hex_decode(line: Column) -> Column:
    """Bytes of a $HEX[..] line up to the first non-hex pair; others unchanged."""
    text = latin1(line)
    digits = F.regexp_extract(text, r"^\$HEX\[((?:[0-9A-Fa-f]{2})*)", 1)
    return F.when(text.startswith(OPENING), F.unhex(digits)).otherwise(as_binary(line))


def recode(line: Column, decode: bool = False, byte_class: ByteClass | None = None) -> Column:
    return hex_decode(line) if decode else hex_encode(line, byte_class)


def recoded_length(line: Column, decode: bool = False, byte_class: ByteClass | None = None) -> Column:
    return F.octet_length(recode(line, decode, byte_class)).cast("bigint")
