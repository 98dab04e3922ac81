"""Column functions for bit strings and their hexadecimal form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bit_length(value: Column) -> Column:
    """Bits that hold a number: 0 for 0, 2 for 3, 3 for 4."""
    return F.when(value > 0, F.length(F.bin(value))).otherwise(F.lit(0))


def bits_to_hex(bits: Column) -> Column:
    """Lower-case hexadecimal bytes of a short bit string, filled up with zeros to whole bytes."""
    nibbles = F.transform(F.sequence(F.lit(0), F.ceil(F.length(bits) / 8).cast("int") * 2 - 1), lambda i: F.lower(F.conv(F.rpad(F.substring(bits, i * 4 + 1, F.lit(4)), 4, "0"), 2, 16)))
    return F.when(F.length(bits) > 0, F.array_join(nibbles, "")).otherwise(F.lit(""))


def number_hex(value: Column, size: int) -> Column:
    """A number as `size` big-endian bytes in hexadecimal."""
    return F.lower(F.lpad(F.hex(value.cast("long")), 2 * size, "0"))
