"""Bit-level encodings: zigzag, varints, and Thrift compact records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zigzag(n: Column) -> Column:
    """Signed to unsigned order 0, -1, 1, -2, ... of 64-bit integers."""
    return F.shiftleft(n.cast("long"), 1).bitwiseXOR(F.shiftright(n.cast("long"), 63))


def unzigzag(n: Column) -> Column:
    return F.shiftrightunsigned(n, 1).bitwiseXOR(-n.bitwiseAND(F.lit(1).cast("long")))


def varint_length(n: Column) -> Column:
    """Bytes of the 7-bit encoding of an unsigned 64-bit integer."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.ltrim(F.bin(n), F.lit("0"))) / 7)).cast("long")


def varint_bytes(n: int) -> bytes:
    n &= 0xFFFFFFFFFFFFFFFF
    out = bytearray()
    while True:
        n, low = n >> 7, n & 127
        out.append(low | (128 if n else 0))
        if not n:
            return bytes(out)


def varint_value(data: bytes, at: int = 0) -> tuple[int, int]:
    """(value, next offset)."""
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def varint(n: Column | str) -> Column:
    """Bytes of the 7-bit groups of an unsigned 64-bit integer, lowest first; all but the last have the high bit."""
    n = (F.col(n) if isinstance(n, str) else n).cast("long")
    size = varint_length(n)
    part = lambda i: F.shiftrightunsigned(n, 7 * i).bitwiseAND(F.lit(127).cast("long"))
    pairs = [F.when(size > i, F.lpad(F.hex(part(i) + F.when(size > i + 1, 128).otherwise(0)), 2, "0")).otherwise("") for i in range(10)]
    return F.when(n.isNotNull(), F.unhex(F.concat(*pairs)))


def varint_decode(data: Column | str) -> Column:
    """The integer of a varint's bytes."""
    data = F.col(data) if isinstance(data, str) else data
    byte = lambda i: F.conv(F.hex(F.substring(data, i + 1, 1)), 16, 10).cast("long")
    total = F.lit(0).cast("long")
    for i in range(10):
        total = total.bitwiseOR(F.when(F.octet_length(data) > i, F.shiftleft(byte(i).bitwiseAND(F.lit(127).cast("long")), 7 * i)).otherwise(F.lit(0).cast("long")))
    return F.when(data.isNotNull(), total)


#: Thrift compact type codes.
_TRUE, _FALSE, _I32, _I64, _BINARY, _LIST, _MAP, _STRUCT = 1, 2, 5, 6, 8, 9, 11, 12


class CompactWriter:
    """Writes Thrift compact structs: fields as deltas, integers zigzagged, lengths as varints."""

    def __init__(self):
        self.out, self.last = bytearray(), [0]

    def _number(self, n: int) -> None:
        self.out += varint_bytes((n << 1) ^ (n >> 63))

    def field(self, number: int, kind: int) -> None:
        delta = number - self.last[-1]
        if 0 < delta < 16:
            self.out.append(delta << 4 | kind)
        else:
            self.out.append(kind)
            self._number(number)
        self.last[-1] = number

    def integer(self, number: int, value: int | None, kind: int = _I32) -> None:
        if value is not None:
            self.field(number, kind)
            self._number(value)

    def _string(self, value: str) -> None:
        raw = value.encode()
        self.out += varint_bytes(len(raw)) + raw

    def string(self, number: int, value: str | None) -> None:
        if value is not None:
            self.field(number, _BINARY)
            self._string(value)

    def list_header(self, number: int, size: int, kind: int) -> None:
        self.field(number, _LIST)
        self.out += bytes([size << 4 | kind]) if size < 15 else bytes([0xF0 | kind]) + varint_bytes(size)

    def strings(self, number: int, values: list[str] | None) -> None:
        if values is not None:
            self.list_header(number, len(values), _BINARY)
            for v in values:
                self._string(v)

    def counters(self, number: int, values: dict[str, int] | None) -> None:
        if values is not None:
            self.field(number, _MAP)
            self.out += varint_bytes(len(values))
            if values:
                self.out.append(_BINARY << 4 | _I64)
            for k in sorted(values):
                self._string(k)
                self._number(values[k])

    def begin(self) -> None:
        self.last.append(0)

    def end(self) -> None:
        self.out.append(0)
        self.last.pop()


def _user(w: CompactWriter, u: dict) -> None:
    w.integer(1, u.get("id"))
    w.string(2, u.get("name"))
    w.string(3, u.get("email"))
    w.strings(4, u.get("tags"))
    w.counters(5, u.get("attributes"))


def user_bytes(user: dict) -> bytes:
    """A record (id, name, email, tags, attributes) as compact bytes; absent fields take none, map keys are ordered."""
    w = CompactWriter()
    _user(w, user)
    w.end()
    return bytes(w.out)


def collection_bytes(users: list[dict]) -> bytes:
    w = CompactWriter()
    w.list_header(1, len(users), _STRUCT)
    for u in users:
        w.begin()
        _user(w, u)
        w.end()
    w.end()
    return bytes(w.out)


def read_struct(data: bytes, at: int = 0) -> tuple[dict[int, object], int]:
    """Fields of a compact struct by number, nested ones as dicts and lists, and the next offset."""

    def value(kind: int, at: int, inner: bool = False):
        if kind in (_TRUE, _FALSE):
            return (data[at] == _TRUE, at + 1) if inner else (kind == _TRUE, at)
        if kind == 3:
            return int.from_bytes(data[at : at + 1], "little", signed=True), at + 1
        if kind in (4, _I32, _I64):
            n, at = varint_value(data, at)
            return (n >> 1) ^ -(n & 1), at
        if kind == 7:
            import struct

            return struct.unpack_from("<d", data, at)[0], at + 8
        if kind == _BINARY:
            n, at = varint_value(data, at)
            return data[at : at + n], at + n
        if kind in (_LIST, 10):
            size, item = data[at] >> 4, data[at] & 15
            at += 1
            if size == 15:
                size, at = varint_value(data, at)
            out = []
            for _ in range(size):
                x, at = value(item, at, True)
                out.append(x)
            return out, at
        if kind == _MAP:
            size, at = varint_value(data, at)
            pairs, at, kinds = {}, at + (size > 0), data[at] if size else 0
            for _ in range(size):
                k, at = value(kinds >> 4, at, True)
                pairs[k], at = value(kinds & 15, at, True)
            return pairs, at
        if kind == _STRUCT:
            return read_struct(data, at)
        raise ValueError(f"compact type {kind}")

    fields, number = {}, 0
    while data[at]:
        head, at = data[at], at + 1
        if head >> 4:
            number += head >> 4
        else:
            n, at = varint_value(data, at)
            number = (n >> 1) ^ -(n & 1)
        fields[number], at = value(head & 15, at)
    return fields, at + 1
