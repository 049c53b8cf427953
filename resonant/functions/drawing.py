"""Values for drawing: colours of levels, axis ticks, and text forms of times and numbers. All built-in expressions but the six digits."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Colour anchors from the floor to the ceiling, and those two levels in decibels.
ANCHORS = ((0, 0, 0), (48, 16, 80), (160, 32, 64), (240, 128, 32), (255, 240, 160))
FLOOR_DB, CEILING_DB = -140.0, 0.0


def colour(db: Column, floor: float = FLOOR_DB, ceiling: float = CEILING_DB) -> Column:
    """Red, green and blue of a level, mixed between the two anchors around it; beyond the ends it is held."""
    at = F.least(F.greatest((db - floor) / (ceiling - floor), F.lit(0.0)), F.lit(1.0)) * (len(ANCHORS) - 1)
    cell = F.least(F.floor(at), F.lit(len(ANCHORS) - 2))
    share = at - cell

    def lane(k: int) -> Column:
        values = F.array(*[F.lit(float(a[k])) for a in ANCHORS])
        low, high = (F.element_at(values, (cell + i).cast("int")) for i in (1, 2))
        return F.round(low * (1 - share) + high * share).cast("int")

    return F.struct(lane(0).alias("r"), lane(1).alias("g"), lane(2).alias("b"))


def round_step(target: float) -> float:
    """The smallest of 1, 2, 5 and 10 times a power of ten that is not below the target."""
    scale = 10.0 ** math.floor(math.log10(target))
    return next(s for s in (1.0, 2.0, 5.0, 10.0) if s * scale >= target) * scale


def ticks(most: float) -> list[float]:
    """About six even steps from zero, and the end; a step too near to the end is left out."""
    step = round_step(most / 6)
    inner = [i * step for i in range(1, 8) if i * step < most and most - i * step >= 0.3 * step]
    return [0.0, *inner, most]


def section_text(start: Column, end: Column, at_end: Column) -> Column:
    """A section as minutes and seconds from and to, with its length, and a mark where it lasts to the end."""
    clock = lambda s: F.format_string("%02d:%02d", F.floor(s / 60).cast("long"), F.floor(s % 60).cast("long"))
    return F.concat(clock(start), F.lit(" → "), clock(end), F.format_string(" (%.1fs)", (end - start).cast("double")), F.when(at_end, " → EOF").otherwise(""))


def six_digits(value: float) -> str:
    """A number with six significant digits, as short as it goes; zeros and what is no number keep their signs."""
    return "-nan" if math.isnan(value) and math.copysign(1, value) < 0 else f"{value:.6g}"


@F.arrow_udf(T.StringType())
def _six_digits(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else six_digits(v) for v in values.to_pylist()], pa.string())


def six_digit_text(value: Column) -> Column:
    """The same as a column: fixed notation from 1e-4 up to a million, else with an exponent of two digits; no closing zeros.

    Java's formatter rounds the shortest decimal form half up, not the number itself, and knows no such notation."""
    return _six_digits(value.cast("double"))


def tick_list(most: Column) -> Column:
    """The same as ticks() as a column, for a positive end."""
    target = most / 6
    scale = F.pow(F.lit(10.0), F.floor(F.log10(target)))
    step = F.when(target <= scale, scale).when(target <= 2 * scale, 2 * scale).when(target <= 5 * scale, 5 * scale).otherwise(10 * scale)
    inner = F.filter(F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: i * step), lambda v: (v < most) & (most - v >= 0.3 * step))
    return F.concat(F.array(F.lit(0.0)), inner, F.array(most))
