"""Picture similarity over arrays of pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean_abs_diff(a: Column, b: Column) -> Column:
    """Mean of |a - b|."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x) / F.size(a)


def gradient_bits(pixels: Column, width: int) -> Column:
    """For each row of `width` pixels, whether each is darker than the one to its right."""
    return F.transform(F.filter(F.sequence(F.lit(0), F.size(pixels) - 2), lambda i: i % width != width - 1), lambda i: (F.get(pixels, i + 1) > F.get(pixels, i)).cast("int"))


def pack_bits(bits: Column) -> Column:
    """Bits (first is highest) to an array of 64-bit words; the last word may be short."""
    words = F.sequence(F.lit(0), F.floor((F.size(bits) - 1) / 64).cast("int"))
    return F.transform(words, lambda w: F.aggregate(F.slice(bits, w * 64 + 1, F.lit(64)), F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b.cast("long"))))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
