"""Level arithmetic and percentile definitions. Unknown stays null: a level of nothing is null, never minus infinity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def amplitude_db(x: Column) -> Column:
    return F.when(x > 0, 20 * F.log10(x))


def power_db(p: Column) -> Column:
    return F.when(p > 0, 10 * F.log10(p))


def relative_db(m: Column, peak: Column, eps: float = 1e-12) -> Column:
    """Decibels below a peak, with the guards that keep silence finite."""
    return 20 * F.log10(m / (peak + eps) + eps)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def mid(left: Column, right: Column) -> Column:
    """Single precision throughout: each lane is rounded before the sum, the sum before the halving."""
    return ((left.cast("float") + right.cast("float")) * F.lit(0.5).cast("float")).cast("float")


def side(left: Column, right: Column) -> Column:
    return ((left.cast("float") - right.cast("float")) * F.lit(0.5).cast("float")).cast("float")


def saturated_word(x: Column) -> Column:
    """A sample as a signed 32-bit word, half away from zero, held at the ends."""
    scaled = F.least(F.greatest(F.round(x * 2147483648.0), F.lit(-2147483648.0)), F.lit(2147483647.0))
    return scaled.cast("long")


def trailing_zeros(word: Column) -> Column:
    """Of a nonzero word."""
    w = word.cast("long")
    return F.bit_count(w.bitwiseAND(-w) - 1)


def bucket_rank(n: Column, percent: int) -> Column:
    """0-based nearest rank of a percentile, half up."""
    return F.floor(((n - 1) * percent + 50) / 100)
