"""Digits and bits packed in integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digit(code: Column, position: int) -> Column:
    """The digit at a position, from 0; null for null and negative codes and 9, which says missing."""
    d = F.substring(code.cast("bigint").cast("string"), position + 1, 1).try_cast("int")
    return F.when((code >= 0) & (d != 9), d)


def hard_flag(code: Column, position: int) -> Column:
    """0 and 2 from digits 0 and 1."""
    d = digit(code, position)
    return F.when(d == 1, 2).otherwise(d)


def bits(value: Column, start: int, end: int, gain: float = 1.0, width: int = 8) -> Column:
    """Bits [start, end) of the zero-padded binary digits, as a number times gain."""
    text = F.bin(value.cast("long"))
    padded = F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)
    return F.conv(F.substring(padded, start + 1, end - start), 2, 10).cast("double") * gain
