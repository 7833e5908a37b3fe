"""Bitmaps as ``bitmap_construct_agg`` makes them: 32,768 bits, the lowest bit of a byte first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 32768


def bit_is_set(bits: Column, position: Column) -> Column:
    """Whether bit ``position`` (0 to 32,767) of a bitmap is 1."""
    byte = F.conv(F.hex(F.substring(bits, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (position % 8).cast("int"))) != 0
