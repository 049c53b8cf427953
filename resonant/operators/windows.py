"""Sequence windows over (part, frame, x): frames, blocks, runs, peaks, lookbacks.

All of them partition by part and order by frame, so one exchange by part serves a whole chain. frame counts from 0
without gaps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

def in_order() -> WindowSpec:
    """Each series from its first frame on. Built when it is used: a window needs a session."""
    return Window.partitionBy("part").orderBy("frame")


def hopping_frames(series: DataFrame, width: int, hop: int) -> DataFrame:
    """Sums over overlapping windows; a window counts only if a sample follows it (strict end)."""
    total = F.max("frame").over(Window.partitionBy("part")) + 1
    first = F.greatest(F.lit(0), F.ceil((F.col("frame") - width + 1) / hop))
    spread = series.withColumn("n", total).select("part", "frame", "x", "n", F.explode(F.sequence(first, F.floor(F.col("frame") / hop))).alias("frame_no"))
    return spread.where(F.col("frame_no") * hop + width < F.col("n")).groupBy("part", "frame_no").agg(
        F.min("frame").alias("start"), F.count("*").alias("samples"), F.sum(F.col("x") * F.col("x")).alias("energy"), F.max(F.abs("x")).alias("peak")
    )


def tumbling_blocks(series: DataFrame, size: int, keep_tail: bool = False) -> DataFrame:
    """Mean square, root mean square and peak of blocks; a partial tail is dropped unless it is kept."""
    block = F.floor(F.col("frame") / size).cast("long")
    out = series.groupBy("part", block.alias("block")).agg(F.count("*").alias("n"), F.avg(F.col("x") * F.col("x")).alias("ms"), F.max(F.abs("x")).alias("peak"))
    return (out if keep_tail else out.where(F.col("n") == size)).withColumn("rms", F.sqrt("ms"))


def runs(series: DataFrame, quiet: Column, least: int) -> DataFrame:
    """Maximal runs of consecutive frames that fulfil the condition: start, end (exclusive), length."""
    islands = series.where(quiet).withColumn("island", F.col("frame") - F.row_number().over(in_order()))
    grouped = islands.groupBy("part", "island").agg(F.min("frame").alias("start"), (F.max("frame") + 1).alias("end"), F.count("*").alias("length"))
    return grouped.where(F.col("length") >= least).drop("island")


def run_summary(series: DataFrame, found: DataFrame) -> DataFrame:
    """Number, total and longest of the runs of each part, and their share of its frames; parts without a run have zeros."""
    total = series.groupBy("part").agg(F.count("*").alias("frames"))
    per = found.groupBy("part").agg(F.count("*").alias("runs"), F.sum("length").alias("quiet"), F.max("length").alias("longest"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return total.join(per, "part", "left").select("part", "frames", zero("runs"), zero("quiet"), zero("longest"), (100.0 * F.coalesce("quiet", F.lit(0)) / F.col("frames")).alias("percent"))


def windows_in_runs(frames: DataFrame, found: DataFrame, width: int) -> DataFrame:
    """Frames that lie wholly inside one run. Runs don't overlap, so the last one that begins before a frame decides: one ordered
    pass over both, no join of intervals."""
    both = frames.withColumn("run_end", F.lit(None).cast("long")).withColumn("is_run", F.lit(False)).unionByName(
        found.select("part", "start", F.col("end").alias("run_end"), F.lit(True).alias("is_run")), allowMissingColumns=True
    )
    upto = Window.partitionBy("part").orderBy("start", F.desc("is_run")).rowsBetween(Window.unboundedPreceding, 0)
    marked = both.withColumn("run_end", F.last("run_end", ignorenulls=True).over(upto))
    return marked.where(~F.col("is_run") & (F.col("start") + width <= F.col("run_end"))).select(*frames.columns)


def local_maxima(series: DataFrame, value: Column) -> DataFrame:
    """Samples above both neighbours; a plateau counts once, at its middle (rounded down). Ends are no maxima."""
    v = series.select("part", "frame", value.alias("v"))
    steps = v.withColumn("new", F.coalesce((F.col("v") != F.lag("v").over(in_order())).cast("int"), F.lit(1)))
    plateaus = steps.withColumn("k", F.sum("new").over(in_order())).groupBy("part", "k").agg(F.min("frame").alias("start"), F.max("frame").alias("end"), F.first("v").alias("v"))
    by = Window.partitionBy("part").orderBy("k")
    peak = (F.lag("v").over(by) < F.col("v")) & (F.lead("v").over(by) < F.col("v"))
    return plateaus.withColumn("is_peak", peak).where("is_peak").select("part", (F.col("start") + F.floor((F.col("end") - F.col("start")) / 2)).cast("long").alias("frame"), F.col("v").alias("value"))


def spaced_in_order(peaks: DataFrame, distance: int) -> DataFrame:
    """From first to last, those at least this far after the last one that was kept: one pass over sorted frames, which remembers
    the last kept one only."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last = None, None
        for pdf in batches:
            parts, frames = pdf["part"].to_numpy(), pdf["frame"].to_numpy()
            edges = np.r_[0, np.flatnonzero(parts[1:] != parts[:-1]) + 1, len(parts)] if len(parts) else np.zeros(1, int)
            kept = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if parts[a] != part:
                    part, last = parts[a], None
                at = a if last is None else a + np.searchsorted(frames[a:b], last + distance)
                while at < b:
                    kept.append(at)
                    last = frames[at]
                    at = at + np.searchsorted(frames[at:b], last + distance)
            yield pdf.iloc[kept][["part", "frame"]]

    ordered = peaks.select("part", "frame").repartition("part").sortWithinPartitions("part", "frame")
    return ordered.mapInPandas(scan, peaks.select("part", "frame").schema)


def spaced_by_height(peaks: DataFrame, distance: int) -> DataFrame:
    """From the highest down (of equal ones the later first), those that no kept one is nearer to than the distance.

    Peaks on both sides of a gap of the distance or more don't touch each other, so a part is cut there and each piece is
    picked alone; only a series without any gap is one piece."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame").reset_index(drop=True)
        frame = pdf["frame"].to_numpy()
        alive, kept = np.ones(len(frame), bool), []
        for i in np.lexsort((-frame, -pdf["value"].to_numpy())):
            if alive[i]:
                kept.append(i)
                a, b = np.searchsorted(frame, frame[i] - distance, "right"), np.searchsorted(frame, frame[i] + distance, "left")
                alive[a:b] = False
        return pdf.loc[sorted(kept), ["part", "frame", "value"]]

    gap = F.coalesce((F.col("frame") - F.lag("frame").over(in_order()) >= distance).cast("int"), F.lit(0))
    pieces = peaks.withColumn("gap", gap).withColumn("piece", F.sum("gap").over(in_order())).drop("gap")
    return pieces.groupBy("part", "piece").applyInPandas(pick, peaks.schema)


def loudest_apart(blocks: DataFrame, energy: str, count: int, distance: int) -> DataFrame:
    """The count blocks of largest energy of each part (of equal ones the earlier), each further than the distance from those before
    it in that order. No block within the distance of a kept one can follow, so at most count * (2 * distance + 1) of the
    loudest are looked at; they are ranked by Spark."""
    most = count * (2 * distance + 1)
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("energy"), "block"))
    top = blocks.select("part", "block", F.col(energy).alias("energy")).withColumn("rank", rank).where(F.col("rank") <= most)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        for b in pdf.sort_values("rank")["block"].tolist():
            if len(kept) < count and all(abs(b - k) > distance for k in kept):
                kept.append(b)
        return pdf[pdf["block"].isin(kept)].sort_values("block")[["part", "block", "energy"]]

    return top.groupBy("part").applyInPandas(pick, top.drop("rank").schema)


def lookback(series: DataFrame, far: int, near: int, history: int) -> DataFrame:
    """For each marked frame e: the mean square over [e - far, e - near), if that much history lies before it."""
    square = F.col("x") * F.col("x")
    before = in_order().rowsBetween(-far, -near - 1)
    power = series.withColumn("context", F.avg(square).over(before)).withColumn("seen", F.count("*").over(before))
    eligible = (F.col("frame") >= history) & (F.col("seen") == far - near)
    return power.where("hit").select("part", "frame", eligible.alias("eligible"), F.when(eligible, F.col("context")).alias("power"))


def centred_mean(series: DataFrame, value: Column, width: int, warmup: int = 0) -> DataFrame:
    """Means over centred windows of odd width, where the window is whole and its centre is past the warm-up."""
    half = width // 2
    around = in_order().rowsBetween(-half, half)
    out = series.withColumn("smooth", F.avg(value).over(around)).withColumn("n", F.count("*").over(around))
    return out.where((F.col("n") == width) & (F.col("frame") >= warmup)).select("part", "frame", "smooth")


def nearest_edge_mean(series: DataFrame, value: Column, width: int) -> DataFrame:
    """Centred means whose windows repeat the first or last value beyond the ends."""
    half = width // 2
    whole = Window.partitionBy("part").orderBy("frame").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    around = in_order().rowsBetween(-half, half)
    v = series.withColumn("v", value).withColumn("total", F.count("*").over(whole)).withColumn("head", F.first("v").over(whole)).withColumn("tail", F.last("v").over(whole))
    before = F.greatest(F.lit(0), half - F.col("frame"))
    after = F.greatest(F.lit(0), F.col("frame") + half - F.col("total") + 1)
    return v.withColumn("s", F.sum("v").over(around)).select("part", "frame", ((F.col("s") + before * F.col("head") + after * F.col("tail")) / width).alias("smooth"))


def deltas(series: DataFrame) -> DataFrame:
    """Absolute differences of neighbours: largest, mean and root mean square."""
    d = series.withColumn("d", F.abs(F.col("x") - F.lag("x").over(in_order())))
    return d.groupBy("part").agg(F.max("d").alias("max_delta"), F.avg("d").alias("mean_delta"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rms_delta"))


def zero_crossings(series: DataFrame, value: Column) -> DataFrame:
    """Changes of sign, zeros ignored; the series counts as starting below zero, so a first positive sample is a crossing."""
    signs = series.select("part", "frame", value.alias("v")).where("v <> 0")
    flips = signs.withColumn("flip", (F.col("v") > 0) != F.lag(F.col("v") > 0, 1, False).over(in_order()))
    counted = flips.groupBy("part").agg(F.count_if("flip").alias("crossings"))
    return series.groupBy("part").agg(F.count("*").alias("samples")).join(counted, "part", "left").select("part", "samples", F.coalesce("crossings", F.lit(0)).alias("crossings"))


def flat_runs(series: DataFrame, value: Column) -> DataFrame:
    """Squared lengths of the closed runs at the smallest and at the largest value; a run that lasts to the end isn't closed."""
    v = series.select("part", "frame", value.alias("v"))
    edge = Window.partitionBy("part")
    marked = v.withColumns({"lo": F.min("v").over(edge), "hi": F.max("v").over(edge), "last": F.max("frame").over(edge)})
    out = v.groupBy("part").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    for name, col in (("low", "lo"), ("high", "hi")):
        islands = marked.where(F.col("v") == F.col(col)).withColumn("island", F.col("frame") - F.row_number().over(in_order()))
        per = islands.groupBy("part", "island").agg(F.count("*").alias("n"), F.max(F.col("frame") == F.col("last")).alias("open"))
        total = per.groupBy("part").agg(F.sum("n").alias(f"{name}_count"), F.sum(F.when(~F.col("open"), F.col("n") * F.col("n")).otherwise(0)).alias(f"{name}_squares"))
        out = out.join(total, "part")
    return out


def stateful_noise_floor(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    """Running maxima over a ring of width samples, the least of them so far: for mapInPandas over sorted partitions. Whole runs of
    a part at once; between batches it remembers the last width - 1 samples and the least."""
    part, tail, seen, least = None, np.zeros(0), 0, np.inf
    for pdf in batches:
        parts, x = pdf["part"].to_numpy(), np.abs(pdf["x"].to_numpy(np.float64))
        edges = np.r_[0, np.flatnonzero(parts[1:] != parts[:-1]) + 1, len(parts)] if len(parts) else np.zeros(1, int)
        out = np.full(len(parts), np.nan)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if parts[a] != part:
                part, tail, seen, least = parts[a], np.zeros(0), 0, np.inf
            joined = np.concatenate([tail, x[a:b]])
            ring = pd.Series(joined).rolling(width, min_periods=1).max().to_numpy()[len(tail) :]
            index = seen + np.arange(b - a)
            floor = np.minimum.accumulate(np.where(index >= width - 1, ring, np.inf))
            floor = np.minimum(floor, least)
            out[a:b] = np.where(np.isfinite(floor), floor, np.nan)
            least, seen, tail = floor[-1], seen + b - a, joined[-(width - 1) :] if width > 1 else np.zeros(0)
        yield pd.DataFrame({"part": pdf["part"], "frame": pdf["frame"], "floor": pd.Series(out, dtype="Float64").where(~np.isnan(out), None)})


def level_median(values: DataFrame, key: str, value: Column, low_db: float, high_db: float, per_decade: float, zero: float) -> DataFrame:
    """Bounds of the median of levels from a histogram of quarter decibels: n, lower, upper (null where it is beyond the top).

    Cell 0 holds zeros, cell 1 what is up to zero, the last one what is beyond the top; per_decade is 20 for amplitudes and 10
    for powers. The histogram is counted before the exchange."""
    cells = int((high_db - low_db) * 4)
    top = 10.0 ** (high_db / per_decade)
    inside = 2 + F.least(F.floor((per_decade * F.log10(value) - low_db) * 4), F.lit(cells - 1))
    cell = F.when(value == 0, 0).when(value <= zero, 1).when(value >= top, cells + 2).otherwise(inside).cast("long")
    hist = values.groupBy(key, cell.alias("cell")).agg(F.count("*").alias("n"))
    by = Window.partitionBy(key)
    upto = hist.withColumns({"upto": F.sum("n").over(by.orderBy("cell")), "total": F.sum("n").over(by)})
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("cell")))
    found = upto.groupBy(key).agg(F.max("total").alias("n"), at(F.floor((F.col("total") - 1) / 2)).alias("a"), at(F.floor(F.col("total") / 2)).alias("b"))
    edge = lambda c, k: F.pow(F.lit(10.0), (F.lit(low_db) + (c - 2 + k) * 0.25) / per_decade)
    lower = lambda c: F.when(c <= 1, 0.0).when(c == cells + 2, top).otherwise(edge(c, 0))
    upper = lambda c: F.when(c == 0, 0.0).when(c == 1, zero).when(c < cells + 2, edge(c, 1))
    a, b = F.col("a"), F.col("b")
    return found.select(key, "n", ((lower(a) + lower(b)) / 2).alias("lower"), ((upper(a) + upper(b)) / 2).alias("upper"))


def envelope_peaks(envelope: DataFrame, distance: int, least: float, factor: float) -> DataFrame:
    """Peaks (part, frame, value) of an envelope (part, frame, v) above the larger of least and factor times the upper bound of its
    median, at least the distance apart in order."""
    median = level_median(envelope, "part", F.col("v"), -180.0, 40.0, 20.0, 1e-9)
    limit = median.select("part", F.greatest(F.lit(least), factor * F.col("upper")).alias("threshold")).where("threshold is not null")
    high = local_maxima(envelope, F.col("v")).join(limit, "part").where(F.col("value") > F.col("threshold")).select("part", "frame", "value")
    return spaced_in_order(high, distance).join(high, ["part", "frame"])
