"""Scalar checks and encodings: names, JSON scalars, canonical byte strings, error codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_valid(name: Column, longest: int = 256) -> Column:
    """Trimmed, not empty, without control characters, at most `longest` bytes."""
    fine = (F.trim(name) == name) & (name != "") & ~name.rlike(r"[\x00-\x1f\x7f]") & (F.octet_length(name) <= longest)
    return F.coalesce(fine, F.lit(False))


def json_scalar(text: Column) -> Column:
    """Whether a text is one JSON null, boolean, number or string, not an object or array."""
    return F.coalesce(text.rlike(r'^\s*(null|true|false|-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?|"([^"\\\x00-\x1f]|\\.)*")\s*$'), F.lit(False))


def uvarint(n: Column) -> Column:
    """LEB128 of a number that is not negative: at most nine bytes of seven bits."""
    byte = lambda x: F.unhex(F.lpad(F.hex(x), 2, "0"))
    n = n.cast("long")
    group = lambda i, more: byte(F.shiftright(n, 7 * i) % 128 + more)
    out = F.concat(*[group(i, 128) for i in range(8)], group(8, 0))
    for size in range(8, 0, -1):
        out = F.when(n < (1 << 7 * size), F.concat(*[group(i, 128) for i in range(size - 1)], group(size - 1, 0))).otherwise(out)
    return out


def digest(value: Column) -> Column:
    """SHA-256 as binary."""
    return F.unhex(F.sha2(value.cast("binary"), 256))


def masked(text: Column) -> Column:
    """A copy for debugging: letters and digits become placeholders, lengths and white space stay."""
    return F.mask(text, F.lit("X"), F.lit("x"), F.lit("0"), F.lit("?"))
