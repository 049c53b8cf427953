"""Interpretation labels of measured values, and text forms. The texts and thresholds are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper limits in ascending order with their labels, then the label above them.
STEPS: dict[str, tuple[tuple[tuple[float, str], ...], str]] = {
    "sharpness": (((2.0, "[gradual: natural EQ / mastering]"), (5.0, "[moderate: normal variation]"), (15.0, "[steep: algorithmic filter possible]")), "[sharp cliff: hard mathematical low-pass filter]"),
    "hf_ratio": (((0.005, "[energy depletion: possible aggressive filter]"), (0.015, "[low: typical for mastered/pop audio]"), (0.05, "[moderate: normal mastered audio]")), "[rich: full-spectrum, dynamic recording]"),
    "banding": (((0.7, "[minimal: no heavy quantization artifacts]"), (0.85, "[moderate: normal for 16-bit PCM]"), (0.95, "[strong: expected in PCM sources]")), "[severe: heavy quantization detected]"),
    "noise": (((-80.0, "[silent void: suspicious digital cutoff]"), (-55.0, "[very quiet: typical digital silence]"), (-35.0, "[moderate: natural dither or tape hiss]")), "[loud: heavy analog noise or DSD shaping]"),
    "side": (
        ((0.15, "[healthy: wide, complex stereo]"), (0.3, "[normal: typical stereo imaging]"), (0.5, "[mild depletion: acceptable joint stereo]"), (0.7, "[moderate anomaly: heavy joint stereo]")),
        "[severe anomaly: artificial stereo width or heavy compression]",
    ),
}


def label(kind: str, value: Column) -> Column:
    """The label of a value by its kind's steps; null for an unknown value."""
    steps, above = STEPS[kind]
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for limit, text in steps:
        out = out.when(value < limit, text)
    return out.otherwise(above)


def variance_label(variance: Column, full_band: Column) -> Column:
    """Variation of the cutoff; beyond the moderate step it reads differently if the band is full."""
    erratic = F.lit("[erratic cutoff: typical of VBR lossy encoders like AAC/Opus]")
    return (
        F.when(variance.isNull(), F.lit(None).cast("string"))
        .when(variance < 1000, "[rigid/encoded-like]")
        .when(variance < 10000, "[stable: normal for mastered audio]")
        .when(variance < 100000, "[moderate: natural organic fluctuation]")
        .when(~full_band, erratic)
        .when(variance < 1000000, "[high variation: organic/analog source]")
        .otherwise("[very high variation: complex analog source]")
    )


def clock(seconds: Column) -> Column:
    """Minutes and seconds, mm:ss, fractions dropped."""
    whole = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d", F.floor(whole / 60).cast("long"), whole % 60)
