"""Scalar functions over Columns, charsets, byte buffers, and structural order and hash."""

from . import buffers, charset, structures, text

__all__ = ["buffers", "charset", "structures", "text"]
