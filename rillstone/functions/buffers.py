"""Byte builders: Column expressions over binaries, and a buffer for the driver's own input and output."""

from __future__ import annotations

import threading

from pyspark.sql import Column
from pyspark.sql import functions as F

from .charset import decoded
from .text import lit


def as_bytes(x, kind: str = "string") -> Column:
    """The bytes of a value's text."""
    from .text import number_text

    x = lit(x)
    return x if kind == "binary" else F.encode(number_text(x, kind), "UTF-8")


def append(b: Column, x, kind: str = "string") -> Column:
    return F.concat(b, as_bytes(x, kind))


def prepend(b: Column, x, kind: str = "string") -> Column:
    return F.concat(as_bytes(x, kind), b)


def insert(b: Column, at, x, kind: str = "string") -> Column:
    """x put in at a byte offset, held to the end."""
    at = F.least(F.greatest(lit(at), F.lit(0)), F.octet_length(b)).cast("int")
    return F.concat(F.substring(b, F.lit(1), at), as_bytes(x, kind), F.substring(b, at + 1, F.octet_length(b)))


def size(b: Column) -> Column:
    return F.octet_length(b)


class Buffer:
    """A growing first-in, first-out byte buffer, safe for several threads. It lives on the driver: a cluster's bytes are in files and streams."""

    def __init__(self, data: bytes | str = b"", charset: str = "utf8"):
        self.charset, self._data, self._lock = charset, bytearray(self._raw(data)), threading.RLock()

    @staticmethod
    def _raw(x) -> bytes:
        if isinstance(x, Buffer):
            return x.data()
        if isinstance(x, (bytes, bytearray, memoryview)):
            return bytes(x)
        if isinstance(x, bool):
            return b"true" if x else b"false"
        return (f"{x:g}" if isinstance(x, float) else str(x)).encode()

    def append(self, *values) -> Buffer:
        with self._lock:
            for x in values:
                self._data += self._raw(x)
        return self

    write = append

    def prepend(self, *values) -> Buffer:
        with self._lock:
            self._data[:0] = b"".join(map(self._raw, values))
        return self

    def peek(self, n: int | None = None) -> bytes:
        with self._lock:
            return bytes(self._data if n is None else self._data[:n])

    def read(self, n: int | None = None) -> bytes:
        """Takes up to n bytes from the front."""
        with self._lock:
            out = self.peek(n)
            del self._data[: len(out)]
        return out

    data = peek

    def clear(self) -> None:
        with self._lock:
            self._data.clear()

    @property
    def capacity(self) -> int:
        """Bytes held in memory; the buffer grows by itself."""
        return max(len(self._data), self._data.__sizeof__() - bytearray().__sizeof__())

    def shrink_to_fit(self) -> None:
        with self._lock:
            self._data = bytearray(bytes(self._data))

    def lines(self):
        """Takes whole lines from the front."""
        while b"\n" in self._data:
            yield self.read(self._data.index(b"\n") + 1).rstrip(b"\n")

    def atomically(self, f):
        """f(self) with no other thread in between."""
        with self._lock:
            return f(self)

    def text(self) -> str:
        return decoded(self.peek(), self.charset)

    def __len__(self) -> int:
        return len(self._data)

    def __add__(self, x) -> Buffer:
        return Buffer(self.peek(), self.charset).append(x)

    def __iadd__(self, x) -> Buffer:
        return self.append(x)

    def __eq__(self, other) -> bool:
        return isinstance(other, Buffer) and self.peek() == other.peek()

    def __lt__(self, other: Buffer) -> bool:
        """By length, then by bytes."""
        return (len(self), self.peek()) < (len(other), other.peek())

    def __hash__(self) -> int:
        return hash(self.peek())
