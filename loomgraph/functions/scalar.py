"""Integer arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def int_div(a: Column, b: int) -> Column:
    """Integer quotient of long values; exact for all of them, unlike a division of doubles."""
    return F.call_function("div", a, F.lit(b).cast("long"))


def div_up(a: Column, b: int) -> Column:
    """Integer quotient, rounded up."""
    return int_div(a + F.lit(b - 1), b)


def round_up(a: Column, b: int) -> Column:
    """The next multiple of b."""
    return div_up(a, b) * b


def bit_width(a: Column) -> Column:
    """Binary digits of a non-negative integer; 0 for 0."""
    return F.when(a == 0, 0).otherwise(F.length(F.bin(a))).cast("int")


def low_bits(a: Column, bits: int) -> Column:
    """The value modulo 2 ** bits."""
    return a.bitwiseAND(F.lit((1 << bits) - 1))
