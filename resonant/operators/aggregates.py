"""Level, loudness, range and dynamics aggregates over series (part, frame, x, y)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from resonant.functions.levels import amplitude_db, bucket_rank, power_db, trailing_zeros
from resonant.operators.windows import in_order, tumbling_blocks

# The four phases of the 12-tap interpolation filter of ITU-R BS.1770-4, annex 2; phases 2 and 3 mirror 1 and 0.
_PHASE_0 = (
    0.0017089843750, 0.0109863281250, -0.0196533203125, 0.0332031250000, -0.0594482421875, 0.1373291015625,
    0.9721679687500, -0.1022949218750, 0.0476074218750, -0.0266113281250, 0.0148925781250, -0.0083007812500,
)
_PHASE_1 = (
    -0.0291748046875, 0.0292968750000, -0.0517578125000, 0.0891113281250, -0.1665039062500, 0.4650878906250,
    0.7797851562500, -0.2003173828125, 0.1015625000000, -0.0582275390625, 0.0330810546875, -0.0189208984375,
)
PEAK_PHASES = (_PHASE_0, _PHASE_1, _PHASE_1[::-1], _PHASE_0[::-1])

#: Loudness offset, absolute gate and the relative gate's share of the gated mean (-10 LU).
LOUDNESS_OFFSET = -0.691
ABSOLUTE_GATE = 10 ** ((-70 - LOUDNESS_OFFSET) / 10)
RELATIVE_GATE = 0.1
#: The range's relative gate (-20 LU).
RANGE_GATE = 0.01


def series_stats(series: DataFrame, bits: int = 16) -> DataFrame:
    """Count, peak, root mean square, offset, zeros, full-scale samples and crest factor."""
    x = F.col("x")
    grouped = series.groupBy("part").agg(
        F.count("*").alias("samples"),
        F.max(F.abs(x)).alias("peak"),
        F.sqrt(F.avg(x * x)).alias("rms"),
        F.avg(x).alias("dc"),
        F.count_if(x == 0).alias("zeros"),
        F.count_if((x <= -1) | (x >= 1 - 2.0 ** (1 - bits))).alias("full_scale"),
    )
    return grouped.withColumn("crest_db", F.when(F.col("peak") > 0, amplitude_db(F.col("peak") / F.col("rms"))))


def effective_bits(words: DataFrame, key: str, word: str, least: int = 500) -> DataFrame:
    """Declared width by the fewest trailing zeros, and the width that more than stray words use."""
    used = words.where(F.col(word) != 0).groupBy(key, trailing_zeros(F.col(word)).alias("tz")).agg(F.count("*").alias("n"))
    by = Window.partitionBy(key)
    running = used.withColumn("cumulative", F.sum("n").over(by.orderBy("tz"))).withColumn("nonzero", F.sum("n").over(by))
    enough = F.col("cumulative") >= F.greatest(F.lit(8), F.floor(F.col("nonzero") / 10000))
    return running.groupBy(key).agg(
        F.max("nonzero").alias("nonzero"), (32 - F.min("tz")).cast("long").alias("exact_bits"), F.when(F.max("nonzero") >= least, 32 - F.min(F.when(enough, F.col("tz")))).cast("long").alias("effective_bits")
    )


def pair_correlation(rows: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Means, spreads and the correlation of two channels, null where a channel hardly moves."""
    g = rows.groupBy(key).agg(
        F.count("*").alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.stddev_pop(x).alias("std_x"), F.stddev_pop(y).alias("std_y"), F.max(F.abs(x)).alias("peak_x"), F.max(F.abs(y)).alias("peak_y"), F.covar_pop(x, y).alias("cov")
    )
    moves = lambda s, p: (F.col(s) > 1e-8) & (F.col(s) > 1e-6 * F.col(p))
    eligible = (F.col("n") >= 2) & moves("std_x", "peak_x") & moves("std_y", "peak_y")
    return g.withColumn("eligible", eligible).withColumn("coefficient", F.when(F.col("eligible"), F.least(F.greatest(F.col("cov") / (F.col("std_x") * F.col("std_y")), F.lit(-1.0)), F.lit(1.0)))).drop("peak_x", "peak_y", "cov")


def gated_level(series: DataFrame, hop: int, momentary: int = 4, short: int = 30) -> DataFrame:
    """Integrated level over momentary windows with an absolute and a relative gate, and the largest momentary and short levels."""
    hops = tumbling_blocks(series, hop).select("part", "block", "ms")
    by = Window.partitionBy("part").orderBy("block")
    windows = hops.withColumns(
        {
            "rn": F.row_number().over(by),
            "m": F.avg("ms").over(by.rowsBetween(1 - momentary, 0)),
            "s": F.avg("ms").over(by.rowsBetween(1 - short, 0)),
        }
    ).where(F.col("rn") >= momentary)
    loud = F.col("m") > ABSOLUTE_GATE
    whole = Window.partitionBy("part")
    gated = windows.withColumn("first_mean", F.avg(F.when(loud, F.col("m"))).over(whole))
    relative = loud & (F.col("m") > RELATIVE_GATE * F.col("first_mean"))
    level = lambda p: F.lit(LOUDNESS_OFFSET) + power_db(p)
    return gated.groupBy("part").agg(
        F.count("*").alias("blocks"),
        F.count_if(loud).alias("abs_gated"),
        F.count_if(relative).alias("rel_gated"),
        level(F.avg(F.when(relative, F.col("m")))).alias("level"),
        level(F.max("m")).alias("momentary_max"),
        level(F.max(F.when(F.col("rn") >= short, F.col("s")))).alias("short_max"),
    )


def level_range(series: DataFrame, hop: int, span: int, step: float = 0.01) -> DataFrame:
    """Spread of short-term levels between their 10th and 95th percentile, from a histogram with nearest ranks."""
    hops = tumbling_blocks(series, hop).select("part", "block", "ms")
    by = Window.partitionBy("part").orderBy("block")
    windows = hops.withColumn("rn", F.row_number().over(by)).withColumn("p", F.avg("ms").over(by.rowsBetween(1 - span, 0))).where(F.col("rn") >= span)
    loud = windows.where(F.col("p") >= ABSOLUTE_GATE)
    kept = loud.withColumn("mean", F.avg("p").over(Window.partitionBy("part"))).where(F.col("p") >= RANGE_GATE * F.col("mean"))
    bin_ = F.floor((F.lit(LOUDNESS_OFFSET) + 10 * F.log10("p") + 70) / step).cast("long")
    hist = kept.groupBy("part", bin_.alias("bin")).agg(F.count("*").alias("n"))
    running = hist.withColumn("upto", F.sum("n").over(Window.partitionBy("part").orderBy("bin"))).withColumn("total", F.sum("n").over(Window.partitionBy("part")))
    at = lambda q: F.min(F.when(F.col("upto") > bucket_rank(F.col("total"), q), F.col("bin")))
    found = running.groupBy("part").agg(F.max("total").alias("windows"), at(10).alias("b10"), at(95).alias("b95")).where(F.col("windows") >= 2)
    centre = lambda b: -70 + (F.col(b) + 0.5) * step
    return found.select("part", "windows", centre("b10").alias("p10"), centre("b95").alias("p95"), ((F.col("b95") - F.col("b10")) * step).alias("range"))


def interpolated_peak(series: DataFrame) -> DataFrame:
    """Largest sample, and the largest value of the signal interpolated four times, the filter's tail included."""
    taps = len(_PHASE_0)
    ends = series.groupBy("part").agg(F.max("frame").alias("last"))
    tail = ends.select("part", F.explode(F.sequence(F.col("last") + 1, F.col("last") + taps - 1)).alias("frame"), F.lit(0.0).alias("x"))
    padded = series.select("part", "frame", "x").unionByName(tail)
    lagged = padded.select("part", "frame", "x", *[F.lag("x", k, 0.0).over(in_order()).alias(f"x{k}") for k in range(taps)])
    phases = [sum((F.col(f"x{k}") * c for k, c in enumerate(p)), F.lit(0.0)) for p in PEAK_PHASES]
    out = lagged.groupBy("part").agg(F.max(F.abs("x")).alias("sample_peak"), F.max(F.greatest(F.abs("x"), *[F.abs(p) for p in phases])).alias("interpolated_peak"))
    return out.withColumn("peak_db", amplitude_db(F.col("interpolated_peak")))


def level_variation(series: DataFrame, size: int, floor: float) -> DataFrame:
    """Spread of block levels in decibels, if every block is above the floor and there are two at least."""
    blocks = tumbling_blocks(series, size)
    g = blocks.groupBy("part").agg(F.count("*").alias("blocks"), F.count_if(F.col("ms") > floor).alias("eligible"), F.stddev_pop(power_db(F.col("ms"))).alias("s"))
    return g.select("part", "blocks", "eligible", F.when((F.col("blocks") >= 2) & (F.col("eligible") == F.col("blocks")), F.col("s")).alias("level_std"))


def quiet_blocks(series: DataFrame, size: int, least: int) -> DataFrame:
    """Low and high percentiles of the nonzero block levels, and which blocks are the quietest: three, or a tenth."""
    blocks = tumbling_blocks(series, size).where(F.col("rms") > 0)
    ranked = blocks.withColumn("rn", F.row_number().over(Window.partitionBy("part").orderBy("rms", "block"))).withColumn("n_all", F.count("*").over(Window.partitionBy("part")))
    quiet = F.col("rn") <= F.greatest(F.lit(3), F.floor(F.col("n_all") / 10))
    pick = lambda f: f(F.when(quiet, F.col("block")))
    g = ranked.groupBy("part").agg(
        F.count("*").alias("nonzero"), F.percentile("rms", F.lit(0.015)).alias("p015"), F.percentile("rms", F.lit(0.99)).alias("p99"), F.count_if(quiet).alias("selected"), pick(F.min).alias("first_block"), pick(F.max).alias("last_block")
    )
    return g.where(F.col("nonzero") >= least)


def block_correlation(series: DataFrame, size: int) -> DataFrame:
    """Mean of the per-block correlations of both channels, over the blocks where both move."""
    b = series.groupBy("part", F.floor(F.col("frame") / size).alias("block")).agg(F.count("*").alias("n"), F.covar_pop("x", "y").alias("cov"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy")).where(F.col("n") == size)
    ok = F.col("vx") * F.col("vy") > 1e-12
    return b.groupBy("part").agg(F.count("*").alias("blocks"), F.count_if(ok).alias("valid_blocks"), F.avg(F.when(ok, F.col("cov") / F.sqrt(F.col("vx") * F.col("vy")))).alias("correlation"))


def ceiling_count(series: DataFrame, ceiling: float) -> DataFrame:
    return series.groupBy("part").agg(F.count_if(F.abs("x") >= ceiling).alias("left"), F.count_if(F.abs("y") >= ceiling).alias("right"))


def dynamic_range(series: DataFrame, size: int) -> DataFrame:
    """Second-highest block peak over the loudest fifth of the blocks; null at a whole number of blocks, as the fixed method has it."""
    b = tumbling_blocks(series, size, keep_tail=True)
    by = Window.partitionBy("part")
    ranked = b.withColumns({"loud": F.row_number().over(by.orderBy(F.desc("ms"), "block")), "high": F.row_number().over(by.orderBy(F.desc("peak"), "block")), "blocks": F.count("*").over(by), "frames": F.sum("n").over(by)})
    target = F.rint(F.col("blocks") * 0.2).cast("long")
    g = ranked.groupBy("part").agg(
        F.max("blocks").alias("blocks"), F.max("frames").alias("frames"), F.max(target).alias("target"), F.max(F.when(F.col("high") == 2, F.col("peak"))).alias("second_peak"), F.sqrt(F.avg(F.when(F.col("loud") <= target, 2 * F.col("ms")))).alias("loud_rms")
    )
    valid = (F.col("frames") % size != 0) & (F.col("target") > 0) & (F.col("loud_rms") > 0)
    return g.select("part", "blocks", "target", F.when(valid, amplitude_db(F.col("second_peak") / F.col("loud_rms"))).alias("dr_db"))


def extrema(series: DataFrame, value: Column) -> DataFrame:
    """Smallest and largest value, how often each occurs, range, and the histogram entropy over 64 cells between them."""
    edge = Window.partitionBy("part")
    v = series.select("part", value.alias("v")).withColumns({"lo": F.min("v").over(edge), "hi": F.max("v").over(edge)})
    cell = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 64), F.lit(63))).otherwise(0)
    cells = v.groupBy("part", cell.alias("cell")).agg(F.count("*").alias("n"), F.min("v").alias("v0"), F.max("v").alias("v1"))
    total = cells.withColumn("total", F.sum("n").over(edge))
    h = total.groupBy("part").agg((-F.sum(F.col("n") / F.col("total") * F.log2(F.col("n") / F.col("total")))).alias("entropy"))
    g = v.groupBy("part").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count_if(F.col("v") == F.col("lo")).alias("low_count"), F.count_if(F.col("v") == F.col("hi")).alias("high_count"))
    return g.join(h, "part").withColumn("range_db", amplitude_db(F.col("high") - F.col("low")))


def overall_level(per_part: DataFrame) -> dict[str, Column]:
    """Second-level aggregates over channels: weighted mean square, largest peak, the offset of largest size."""
    n = F.col("samples")
    return {
        "samples": F.sum(n),
        "peak": F.max("peak"),
        "rms": F.sqrt(F.sum(F.col("rms") * F.col("rms") * n) / F.sum(n)),
        "dc": F.max_by("dc", F.abs("dc")),
    }


def platform_delta(level: Column, target: float) -> Column:
    """How far a level is from a platform's target, as signed text with one decimal; null where the level is unknown."""
    return F.when(level.isNotNull(), F.format_string("%+.1f dB", F.lit(target) - level))


# Least correlations and their verdicts, then the verdict below them.
PHASE_STEPS = (
    (0.9, "Mono-compatible"),
    (0.5, "Normal stereo"),
    (0.0, "Wide stereo"),
    (-0.3, "⚠ Possible fake stereo / heavy M-S processing"),
)
PHASE_BELOW = "⚠ Phase cancellation — check mono fold-down"


def phase_verdict(correlation: Column) -> Column:
    out = F.when(correlation.isNull(), F.lit(None).cast("string"))
    for least, text in PHASE_STEPS:
        out = out.when(correlation >= least, text)
    return out.otherwise(PHASE_BELOW)


def clipping_verdict(count: Column) -> Column:
    few = F.concat(F.lit("~ "), count.cast("string"), F.lit(" clipped sample(s) — minor"))
    many = F.concat(F.lit("⚠ "), F.format_number(count, 0), F.lit(" clipped samples — audible distortion likely"))
    return F.when(count == 0, "✓ No clipped samples").when(count < 10, few).otherwise(many)


def gate(value: Column, supported: Column, enough: Column) -> Column:
    """status and value of a detector's measurement: unsupported, inconclusive or measured; the value is known only where measured."""
    status = F.when(~F.coalesce(supported, F.lit(False)), "unsupported").when(~F.coalesce(enough & value.isNotNull(), F.lit(False)), "inconclusive").otherwise("measured")
    return F.struct(status.alias("status"), F.when(status == "measured", value).alias("value"))


def level_of(power: float) -> float | None:
    """The loudness of a mean power, on the driver."""
    return LOUDNESS_OFFSET + 10 * math.log10(power) if power > 0 else None
