"""Spectral features over bins (channel, frame_no, bin, m): one row for each bin of each frame, m a magnitude.

Per-frame and per-bin sums are ordinary aggregates, so partial aggregation shrinks the rows before each exchange.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from resonant.functions.levels import relative_db

EPS = 1e-12


def active(bins: DataFrame) -> DataFrame:
    """Bins of the frames within 60 dB of the channel's loudest; adds the frame's peak."""
    frames = bins.groupBy("channel", "frame_no").agg(F.max("m").alias("peak"))
    loudest = frames.withColumn("top", F.max("peak").over(Window.partitionBy("channel"))).where(F.col("peak") > (F.col("top") + EPS) * 1e-3).drop("top")
    return bins.join(loudest, ["channel", "frame_no"])


def mean_spectrum(bins: DataFrame) -> DataFrame:
    """Mean magnitude of each bin and its level below the loudest bin's."""
    avg = bins.groupBy("channel", "bin").agg(F.avg("m").alias("avg"), F.sum(F.col("m") * F.col("m")).alias("sq"), F.count("*").alias("frames"))
    return avg.withColumn("db", relative_db(F.col("avg"), F.max("avg").over(Window.partitionBy("channel"))))


def cutoffs(bins: DataFrame, floor_db: float) -> DataFrame:
    """The highest bin of each active frame that is above the floor below the frame's peak, else 0."""
    above = relative_db(F.col("m"), F.col("peak")) > floor_db
    return active(bins).groupBy("channel", "frame_no").agg(F.coalesce(F.max(F.when(above, F.col("bin"))), F.lit(0)).alias("cutoff"))


def features(bins: DataFrame, floor_db: float, hf_from: int, span: int) -> DataFrame:
    """Frames, 95th percentile and variance of the cutoff, and from the mean spectrum: cliff, sharpness, high share, entropy, noise above the cutoff."""
    n = int(bins.agg(F.max("bin")).first()[0] or 0) + 1
    cut = cutoffs(bins, floor_db).groupBy("channel").agg(F.count("*").alias("active_frames"), F.percentile("cutoff", F.lit(0.95)).alias("cutoff"), F.var_pop("cutoff").alias("cutoff_variance"))
    total = bins.groupBy("channel").agg(F.countDistinct("frame_no").alias("frames"))
    spec = mean_spectrum(active(bins)).join(cut.select("channel", "cutoff"), "channel")
    step = spec.withColumn("step", F.abs(F.col("db") - F.lag("db").over(Window.partitionBy("channel").orderBy("bin"))))
    at = lambda d: F.least(F.greatest(F.floor(F.col("cutoff") + d), F.lit(0)), F.lit(n - 1))
    level = lambda d: F.max(F.when(F.col("bin") == at(d), F.col("db")))
    p = F.col("avg") / (F.col("all") + EPS)
    whole = step.withColumn("all", F.sum("avg").over(Window.partitionBy("channel")))
    high = F.col("bin") >= at(0)
    shape = whole.groupBy("channel").agg(
        (level(-span) - level(span)).alias("cliff_db"),
        F.max(F.when((F.col("bin") > at(-4 * span)) & (F.col("bin") < at(span)), F.col("step"))).alias("sharpness"),
        (F.sum(F.when(F.col("bin") >= hf_from, F.col("avg")).otherwise(0.0)) / (F.sum("avg") + EPS)).alias("hf_ratio"),
        (-F.sum(F.when(p > 0, p * F.log2(p)))).alias("entropy"),
        (20 * F.log10(F.sqrt(F.sum(F.when(high, F.col("sq"))) / F.sum(F.when(high, F.col("frames")))) + EPS)).alias("noise_db"),
    )
    return total.join(cut, "channel").join(shape, "channel")


def band(bins: DataFrame, low: int, high: int) -> Column:
    return (F.col("bin") >= low) & (F.col("bin") <= high)


def band_power(bins: DataFrame, low: int, high: int, quiet_below: float) -> DataFrame:
    """Mean band power over all frames and over those whose peak is below a limit; null with fewer than four."""
    per = bins.groupBy("channel", "frame_no").agg(F.max("m").alias("peak"), F.sum(F.when(band(bins, low, high), F.col("m") * F.col("m")).otherwise(0.0)).alias("p"))
    quiet = F.col("peak") < quiet_below
    g = per.groupBy("channel").agg(F.count("*").alias("frames"), F.avg("p").alias("mean_square"), F.count_if(quiet).alias("quiet_frames"), F.avg(F.when(quiet, F.col("p"))).alias("q"))
    return g.select("channel", "frames", F.when(F.col("frames") >= 4, F.col("mean_square")).alias("mean_square"), "quiet_frames", F.when(F.col("quiet_frames") >= 4, F.col("q")).alias("quiet_mean_square"))


def band_lag_correlation(bins: DataFrame, low: int, high: int, lags: tuple[int, ...], size: int) -> DataFrame:
    """Circular correlation of the band at these lags, from its power spectrum."""
    p = F.col("m") * F.col("m")
    inside = bins.where(band(bins, low, high))
    cells = [((F.sum(p * F.cos(F.col("bin") * (2 * math.pi * lag / size)))) / F.sum(p)).alias(f"lag_{lag}") for lag in lags]
    return inside.groupBy("channel").agg(F.sum(p).alias("power"), *cells)


def scatter_bound(bins: DataFrame, n: int, share: float, most: float) -> DataFrame:
    """Where local spread of the log spectrum collapses: per frame the last bin whose twice-smoothed spread is above a share of
    its largest; per channel how many frames have one, the mean and the most frequent one (of equal ones the lowest).

    A frame's n bins become one array, so both smoothings, whose neighbours repeat the end bins, need no exchange."""
    level = F.greatest(20 * F.log10(F.col("m") + EPS), F.lit(-110.0)) / 10 * math.log(10)
    frames = bins.groupBy("channel", "frame_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", level.alias("l")))), lambda x: x["l"]).alias("l"))
    places = F.sequence(F.lit(0), F.lit(n - 1))

    def let(value: Column, body: Callable[[Column], Column]) -> Column:
        """body of a value that is computed once, however often it is used."""
        return F.transform(F.array(value), body)[0]

    def around(v: Column, i: Column) -> list[Column]:
        return [F.element_at(v, F.least(F.greatest(i + k, F.lit(0)), F.lit(n - 1)) + 1) for k in range(-2, 3)]

    def mean(v: list[Column]) -> Column:
        return sum(v[1:], v[0]) / 5

    def spread(v: list[Column]) -> Column:
        return let(mean(v), lambda m: F.sqrt(mean([(x - m) * (x - m) for x in v])))

    def last(t: Column) -> Column:
        return let(F.array_max(t), lambda top: F.when(top > 1e-6, F.array_max(F.transform(t, lambda x, i: F.when(x >= F.least(F.lit(most), share * top), i)))))

    spreads = F.transform(places, lambda i: spread(around(F.col("l"), i)))
    edge = let(spreads, lambda s: let(F.transform(places, lambda i: mean(around(s, i))), last))
    bound = frames.select("channel", edge.cast("long").alias("bound")).where("bound is not null")
    mode = bound.groupBy("channel", "bound").agg(F.count("*").alias("n")).groupBy("channel").agg(F.max_by("bound", F.struct("n", (-F.col("bound")))).alias("mode"))
    return bound.groupBy("channel").agg(F.count("*").alias("bound_frames"), F.avg("bound").alias("average")).join(mode, "channel")


def sparsity(bins: DataFrame, cutoff: int, below_db: float) -> DataFrame:
    """Share of the bins below the cutoff that are far below their frame's peak, with four frames and ten bins at least."""
    a = active(bins).where((F.col("bin") >= 1) & (F.col("bin") < cutoff))
    g = a.groupBy("channel").agg(F.countDistinct("frame_no").alias("frames"), F.count("*").alias("cells"), F.count_if(relative_db(F.col("m"), F.col("peak")) < below_db).alias("holes"))
    ok = (F.col("frames") >= 4) & (F.lit(cutoff - 1) >= 10)
    return g.select("channel", "frames", "holes", F.when(ok, F.col("holes") / F.col("cells")).alias("sparsity"))


def rolloff(bins: DataFrame, low: tuple[int, int], high: tuple[int, int]) -> DataFrame:
    """Mean levels of two bands below the loudest bin, and the slope between them."""
    spec = mean_spectrum(active(bins))
    mean = lambda r: F.avg(F.when(band(spec, *r), F.col("db")))
    g = spec.groupBy("channel").agg(mean(low).alias("low_db"), mean(high).alias("high_db"))
    return g.withColumn("slope", (F.col("high_db") - F.col("low_db")) / ((sum(high) - sum(low)) / 2))


def envelope_correlation(bins: DataFrame, low: tuple[int, int], high: tuple[int, int], least: int) -> DataFrame:
    """Correlation over frames of the root powers of two bands."""
    part = lambda r: F.sqrt(F.sum(F.when(band(bins, *r), F.col("m") * F.col("m")).otherwise(0.0)))
    f = active(bins).groupBy("channel", "frame_no").agg(part(low).alias("a"), part(high).alias("b"))
    g = f.groupBy("channel").agg(F.count("*").alias("frames"), F.covar_pop("a", "b").alias("cov"), F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb"), F.avg("a").alias("ma"), F.avg("b").alias("mb"))
    ok = (F.col("frames") >= least) & (F.col("sa") > 1e-8) & (F.col("sb") > 1e-8) & (F.col("sa") > 1e-3 * F.col("ma")) & (F.col("sb") > 1e-3 * F.col("mb"))
    return g.select("channel", "frames", F.when(ok, F.col("cov") / (F.col("sa") * F.col("sb"))).alias("correlation"))


def spectral_lags(bins: DataFrame, low: int, high: int, lags: tuple[int, ...]) -> DataFrame:
    """Autocovariance of the centred mean log spectrum at these bin distances, over its whole norm."""
    spec = mean_spectrum(active(bins)).where(band(bins, low, high))
    c = spec.withColumn("c", F.col("db") - F.avg("db").over(Window.partitionBy("channel"))).select("channel", "bin", "c")
    norm = c.groupBy("channel").agg(F.sum(F.col("c") * F.col("c")).alias("norm"), F.stddev_pop("c").alias("std"))
    shift = F.explode(F.array(*[F.lit(k) for k in lags]))
    left = c.select("channel", F.col("bin").alias("b1"), F.col("c").alias("c1"), shift.alias("lag")).withColumn("bin", F.col("b1") + F.col("lag"))
    pairs = left.join(c, ["channel", "bin"]).groupBy("channel", "lag").agg(F.count("*").alias("pairs"), F.sum(F.col("c1") * F.col("c")).alias("s"))
    return pairs.join(norm, "channel").select("channel", F.col("lag").cast("long").alias("lag"), "pairs", F.when((F.col("std") > 0.1) & (F.col("pairs") >= 8), F.col("s") / F.col("norm")).alias("correlation"))


def banding(bins: DataFrame, low: int, high: int) -> DataFrame:
    """One less the mean spread of the bins' levels over 15 dB, held between 0 and 1."""
    lv = active(bins).where(band(bins, low, high)).withColumn("db", relative_db(F.col("m"), F.col("peak")))
    per = lv.groupBy("channel", "bin").agg(F.stddev_pop("db").alias("s"))
    return per.groupBy("channel").agg(F.least(F.greatest(1 - F.avg("s") / 15, F.lit(0.0)), F.lit(1.0)).alias("banding"))


def side_ratio(bins: DataFrame, mid: int, side: int, low: int, stride: int) -> DataFrame:
    """Sum of one channel's magnitudes over another's from a bin up, over every stride-th frame, and its step."""
    sums = bins.where((F.col("bin") >= low) & (F.col("frame_no") % stride == 0)).agg(*[F.sum(F.when(F.col("channel") == c, F.col("m"))).alias(n) for c, n in ((mid, "mid"), (side, "side"))])
    r = F.col("side") / F.col("mid")
    return sums.withColumn("ratio", F.when(F.col("mid") > 0, r)).withColumn("anomaly", F.when(F.col("ratio") < 0.02, 1.0).when(F.col("ratio") < 0.08, 0.6).when(F.col("ratio").isNotNull(), 0.0))


def top_band(bins: DataFrame, n: int) -> DataFrame:
    """Share of the top tenth of the bins, and the mean above a limit over the mean of a band below it."""
    spec = mean_spectrum(active(bins))
    share = F.sum(F.when(F.col("bin") >= int(n * 0.9), F.col("avg")).otherwise(0.0)) / F.sum("avg")
    mean = lambda a, b: F.avg(F.when(band(spec, a, b), F.col("avg")))
    return spec.groupBy("channel").agg(share.alias("top_share"), (mean(3 * n // 4, n - 1) / mean(n // 4, n // 2)).alias("ultra_ratio")).withColumn("low_passed", F.col("top_share") < 5e-5)


def comb_peaks(lags: DataFrame, wanted: tuple[int, ...], least: float, factor: float) -> DataFrame:
    """How many wanted lags stand out from the lags beside them; two or more are a comb."""
    by = Window.partitionBy("channel").orderBy("lag")
    next_to = lambda move, d: move("lag").over(by) == F.col("lag") + d
    side = lambda move, d: F.when(next_to(move, d), F.abs(move("correlation").over(by)))
    known = F.coalesce(next_to(F.lag, -1), F.lit(False)) | F.coalesce(next_to(F.lead, 1), F.lit(False))
    near = lags.select("channel", "lag", "correlation", side(F.lag, -1).alias("before"), side(F.lead, 1).alias("after"), known.alias("known"))
    # a channel too flat for correlations has its lags without values, and no peaks
    beside = near.where(F.col("lag").isin(*wanted) & F.col("known")).withColumn("beside", F.greatest("before", "after"))
    hit = (F.col("correlation") > least) & (F.col("correlation") > factor * F.col("beside"))
    return beside.groupBy("channel").agg(F.count_if(hit).alias("peaks")).withColumn("comb", F.col("peaks") >= 2)


def phases(bins: DataFrame, low: int) -> DataFrame:
    """Phase of every other bin from a bin on, that of neighbouring bins taken as a complex pair, with the frame's number among all
    frames of its channel (index), whether it is active, and whether the pair is above its frame's floor (loud)."""
    frames = bins.groupBy("channel", "frame_no").agg(F.max("m").alias("peak"))
    top = F.max("peak").over(Window.partitionBy("channel"))
    numbered = frames.select("channel", "frame_no", "peak", (F.row_number().over(Window.partitionBy("channel").orderBy("frame_no")) - 1).cast("long").alias("index"), (F.col("peak") > (top + EPS) * 1e-3).alias("active"))
    ahead = F.lead("v").over(Window.partitionBy("channel", "frame_no").orderBy("bin"))
    pairs = bins.where(F.col("bin") >= low).withColumn("w", ahead).where((F.col("bin") % 2 == 0) & F.col("w").isNotNull())
    loud = F.sqrt(F.col("v") * F.col("v") + F.col("w") * F.col("w")) > F.greatest(F.lit(1e-8), F.col("peak") * 1e-4)
    return pairs.join(numbered, ["channel", "frame_no"]).select("channel", "bin", "index", "active", loud.alias("loud"), F.atan2("w", "v").alias("phase"))


def _entropy_of_differences(differences: DataFrame) -> DataFrame:
    """Pairs and entropy in bits of the wrapped differences d over 36 cells."""
    wrapped = differences.withColumn("d", F.col("d") - 2 * math.pi * F.floor((F.col("d") + math.pi) / (2 * math.pi)))
    cell = F.least(F.floor((F.col("d") + math.pi) / (2 * math.pi) * 36), F.lit(35))
    hist = wrapped.groupBy("channel", cell.alias("cell")).agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy("channel")))
    p = F.col("n") / F.col("total")
    return hist.groupBy("channel").agg(F.max("total").alias("pairs"), (-F.sum(p * F.log2(p))).alias("entropy"))


def phase_entropy(bins: DataFrame, low: int) -> DataFrame:
    """Entropy of the phase differences of adjacent frames: both active, one right after the other, both pairs above their floor."""
    by = Window.partitionBy("channel", "bin").orderBy("index")
    before = phases(bins, low).select("*", F.lag("phase").over(by).alias("p0"), F.lag("index").over(by).alias("i0"), F.lag("active").over(by).alias("a0"), F.lag("loud").over(by).alias("l0"))
    adjacent = (F.col("index") == F.col("i0") + 1) & F.col("active") & F.col("a0") & F.col("loud") & F.col("l0")
    return _entropy_of_differences(before.where(adjacent).select("channel", (F.col("phase") - F.col("p0")).alias("d")))


def legacy_phase_entropy(bins: DataFrame, low: int) -> DataFrame:
    """The same without floors and across gaps: each active frame against the active one before it."""
    by = Window.partitionBy("channel", "bin").orderBy("index")
    rows = phases(bins, low).where("active")
    return _entropy_of_differences(rows.select("channel", (F.col("phase") - F.lag("phase").over(by)).alias("d")).where("d is not null"))


def mirrored_bins(sources: tuple[int, ...], rate: int, width: int, bins: int, guard: int, reach: int, least: int) -> list[tuple[int, int, int, float]]:
    """(source rate, bin, its mirror around the source's band limit rounded down, the rest) of each pair that is compared."""
    step = rate / width
    out = []
    for source in sources:
        limit = source / 2
        centre = round(limit / step)
        half = min(reach, bins - 4 - centre - guard, centre - guard)
        if half >= least:
            for low in range(centre - guard - half, centre - guard):
                target = 2 * limit / step - low
                out.append((source, low, int(target), target - int(target)))
    return out


def mirror_correlation(bins: DataFrame, pairs: list[tuple[int, int, int, float]]) -> DataFrame:
    """Mean over the active frames of the correlation of log magnitudes below a band limit with those mirrored above it. The pairs
    are a small table; a frame is one array, so the join on its bins is a lookup."""
    frames = active(bins).groupBy("channel", "frame_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "m"))), lambda x: x["m"]).alias("m"))
    table = F.array(*[F.struct(F.lit(s).cast("long").alias("source_rate"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(f).alias("f")) for s, lo, hi, f in pairs])
    rows = frames.select("channel", "frame_no", "m", F.explode(table).alias("p")).select("channel", "frame_no", "p.*", "m")
    at = lambda c, d: F.element_at("m", (F.col(c) + d).cast("int"))
    logs = rows.select("channel", "frame_no", "source_rate", F.log(at("lo", 1) + EPS).alias("a"), F.log(at("hi", 1) * (1 - F.col("f")) + at("hi", 2) * F.col("f") + EPS).alias("b"))
    per = logs.groupBy("channel", "frame_no", "source_rate").agg(F.count("*").alias("pairs"), (F.covar_pop("a", "b") / (F.sqrt(F.var_pop("a") * F.var_pop("b")) + EPS)).alias("c"))
    return per.groupBy("channel", "source_rate").agg(F.max("pairs").alias("pairs"), F.count("*").alias("frames"), F.avg("c").alias("correlation"))


def base_features(bins: DataFrame, floor_db: float, hf_from: int, span: int, rate: int, least: int = 4) -> DataFrame:
    """The features of the mid channel's base set: as features(), but the high share is one of totals, known above 30 kHz only,
    and nothing is known with fewer frames or active frames than least."""
    plain = features(bins, floor_db, hf_from, span)
    sums = active(bins).groupBy("channel").agg((F.sum(F.when(F.col("bin") >= hf_from, F.col("m")).otherwise(0.0)) / (F.sum("m") + EPS)).alias("share"))
    ready = (F.col("frames") >= least) & (F.col("active_frames") >= least)
    known = [F.when(ready, F.col(c)).alias(c) for c in ("cutoff", "cutoff_variance", "cliff_db", "sharpness", "entropy", "noise_db")]
    share = F.when(ready & F.lit(rate > 30_000), F.col("share")).alias("hf_ratio")
    return plain.join(sums, "channel").select("channel", "frames", "active_frames", *known, share, F.when(ready, "measured").otherwise("inconclusive").alias("status"))


def strided_cutoffs(bins: DataFrame, floor_db: float, most: int = 2500) -> DataFrame:
    """Cutoffs of every active frame, or of every k-th where a channel has more than most active frames (k = active / most + 1)."""
    by = Window.partitionBy("channel")
    c = cutoffs(bins, floor_db).withColumns({"index": F.row_number().over(by.orderBy("frame_no")) - 1, "active_frames": F.count("*").over(by)})
    stride = F.when(F.col("active_frames") > most, F.floor(F.col("active_frames") / most) + 1).otherwise(1)
    return c.where(F.col("index") % stride == 0).drop("index", "active_frames")


def rate_hypotheses(bins: DataFrame, sources: tuple[int, ...], rate: int) -> DataFrame:
    """Mean levels around each lower rate's band limit: edge, notch, above, ceiling; and what pattern they make."""
    spec = mean_spectrum(active(bins))
    n = rate // 2
    hyp = F.explode(F.array(*[F.lit(s) for s in sources])).alias("source_rate")
    rows = spec.select("channel", "bin", "db", hyp).withColumn("limit", F.col("source_rate") / 2).where(F.col("limit") + 4 <= n - 2)
    mean = lambda a, b: F.avg(F.when((F.col("bin") >= F.col("limit") + a) & (F.col("bin") < (F.col("limit") + b if isinstance(b, int) else b)), F.col("db")))
    g = rows.groupBy("channel", "source_rate").agg(mean(-6, -2).alias("edge"), mean(-1, 2).alias("notch"), mean(3, 8).alias("above"), mean(3, F.lit(n - 2)).alias("ceiling"))
    notch = (F.col("edge") - F.col("notch") >= 2) & (F.col("above") - F.col("notch") >= 2)
    wall = (F.col("ceiling") < F.col("edge") - 4) & (F.col("ceiling") < -9)
    return g.withColumn("source_rate", F.col("source_rate").cast("long")).withColumn("mode", F.when(notch, "notch").when(wall, "wall").otherwise("none"))


def time_coarsened(bins: DataFrame, columns: int) -> DataFrame:
    """Mean power of columns of merged frames in decibels: the smallest power of two of frames that leaves at most so many columns."""
    count = bins.groupBy("channel").agg((F.max("frame_no") + 1).alias("n"))
    width = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("n") / columns, F.lit(1.0)))))
    cells = bins.join(count, "channel").withColumn("column", F.floor(F.col("frame_no") / width).cast("long"))
    p = F.avg(F.col("m") * F.col("m"))
    return cells.groupBy("channel", "column", "bin").agg(F.greatest(F.when(p > 0, 10 * F.log10(p)).otherwise(-140.0), F.lit(-140.0)).alias("power_db"))


def dft(signal: DataFrame, n: int) -> DataFrame:
    """Magnitudes of the discrete Fourier transform of short series (key, i, x) by sums of products: no kernel."""
    bins = F.explode(F.sequence(F.lit(0), F.lit(n // 2))).alias("bin")
    angle = F.col("bin") * F.col("i") % n * (2 * math.pi / n)
    g = signal.select("key", "i", "x", bins).groupBy("key", "bin").agg(F.sum(F.col("x") * F.cos(angle)).alias("re"), F.sum(F.col("x") * F.sin(angle)).alias("im"))
    return g.select("key", F.col("bin").cast("long").alias("bin"), F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("magnitude"))
