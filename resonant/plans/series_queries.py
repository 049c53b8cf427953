"""Queries over series: windows, runs, levels, loudness, dynamics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resonant.functions import levels
from resonant.functions.labels import clock
from resonant.operators import aggregates as A
from resonant.operators import windows as W
from resonant.plans.registry import query
from resonant.sources.bindings import SERIES_SQL, series, table

QUIET, LEAST_RUN = 0.25, 3
S = f"WITH {SERIES_SQL}"

_STATS_SQL = """
  SELECT part, count(*) AS samples, max(abs(x)) AS peak, sqrt(avg(x * x)) AS rms, avg(x) AS dc, count(*) FILTER (WHERE x = 0) AS zeros,
         count(*) FILTER (WHERE x <= -1 OR x >= 1 - pow(2e0, -15)) AS full_scale
  FROM series GROUP BY part"""
_RUNS_SQL = f"""
runs AS (
  SELECT part, min(frame) AS start, max(frame) + 1 AS "end", count(*) AS length
  FROM (SELECT part, frame, frame - row_number() OVER (PARTITION BY part ORDER BY frame) AS island FROM series WHERE abs(x) < {QUIET}e0)
  GROUP BY part, island HAVING count(*) >= {LEAST_RUN})"""
_CREST = "round(CASE WHEN peak > 0 THEN 20 * log10(peak / rms) END, 6) AS crest_db"
_PROFILE = "round(peak, 6) AS peak, round(rms, 6) AS rms, round(dc, 6) AS dc, zeros, full_scale"


@query(
    "entry_series_profile",
    f"""{S}, stats AS ({_STATS_SQL}), {_RUNS_SQL}
SELECT s.part, samples, {_PROFILE}, {_CREST}, CAST(coalesce(r.n, 0) AS BIGINT) AS runs, CAST(coalesce(r.q, 0) AS BIGINT) AS quiet, CAST(coalesce(r.m, 0) AS BIGINT) AS longest
FROM stats s LEFT JOIN (SELECT part, count(*) AS n, sum(length) AS q, max(length) AS m FROM runs GROUP BY part) r USING (part)""",
)
def entry_series_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level statistics with the quiet runs of each series."""
    s = series(spark, sf_dir)
    runs = W.run_summary(s, W.runs(s, F.abs("x") < QUIET, LEAST_RUN)).select("part", "runs", "quiet", "longest")
    return A.series_stats(s).join(runs, "part")


@query("a01_series_stats", f"{S}, stats AS ({_STATS_SQL}) SELECT part, samples, {_PROFILE}, {_CREST} FROM stats")
def a01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.series_stats(series(spark, sf_dir))


@query(
    "a02_effective_bits",
    """
WITH w AS (SELECT l_returnflag AS flag, CAST(l_quantity * 4096 AS BIGINT) AS word FROM lineitem),
t AS (SELECT flag, bit_count((word & -word) - 1) AS tz, count(*) AS n FROM w WHERE word <> 0 GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY flag ORDER BY tz) AS cumulative, sum(n) OVER (PARTITION BY flag) AS nonzero FROM t)
SELECT flag, CAST(max(nonzero) AS BIGINT) AS nonzero, CAST(32 - min(tz) AS BIGINT) AS exact_bits,
       CAST(CASE WHEN max(nonzero) >= 500 THEN 32 - min(CASE WHEN cumulative >= greatest(8, floor(nonzero / 10000)) THEN tz END) END AS BIGINT) AS effective_bits
FROM r GROUP BY flag""",
)
def a02(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), (F.col("l_quantity") * 4096).cast("long").alias("word"))
    return A.effective_bits(words, "flag", "word")


@query(
    "a03_pair_correlation",
    """
WITH g AS (
  SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS mean_x, avg(l_discount) AS mean_y, stddev_pop(l_quantity) AS std_x, stddev_pop(l_discount) AS std_y,
         max(abs(l_quantity)) AS px, max(abs(l_discount)) AS py, covar_pop(l_quantity, l_discount) AS cov FROM lineitem GROUP BY 1),
e AS (SELECT *, n >= 2 AND std_x > 1e-8 AND std_x > 1e-6 * px AND std_y > 1e-8 AND std_y > 1e-6 * py AS eligible FROM g)
SELECT l_returnflag, n, round(mean_x, 6) AS mean_x, round(mean_y, 6) AS mean_y, round(std_x, 6) AS std_x, round(std_y, 6) AS std_y, eligible,
       round(CASE WHEN eligible THEN least(greatest(cov / (std_x * std_y), -1), 1) END, 6) AS coefficient FROM e""",
)
def a03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.pair_correlation(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "l_discount")


_HOPS = "hops AS (SELECT part, frame // {h} AS block, avg(x * x) AS ms FROM series GROUP BY 1, 2 HAVING count(*) = {h})"
_LOUD = f"{A.ABSOLUTE_GATE!r}"


def _level(p: str) -> str:
    return f"round({A.LOUDNESS_OFFSET}e0 + CASE WHEN {p} > 0 THEN 10 * log10({p}) END, 6)"


@query(
    "a05_gated_level",
    f"""{S}, {_HOPS.format(h=2)},
w AS (
  SELECT part, row_number() OVER o AS rn, avg(ms) OVER (PARTITION BY part ORDER BY block ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS m,
         avg(ms) OVER (PARTITION BY part ORDER BY block ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS s FROM hops WINDOW o AS (PARTITION BY part ORDER BY block)),
k AS (SELECT *, avg(CASE WHEN m > {_LOUD} THEN m END) OVER (PARTITION BY part) AS first_mean FROM w WHERE rn >= 4)
SELECT part, count(*) AS blocks, count(*) FILTER (WHERE m > {_LOUD}) AS abs_gated, count(*) FILTER (WHERE m > {_LOUD} AND m > 0.1e0 * first_mean) AS rel_gated,
       {_level("avg(m) FILTER (WHERE m > " + _LOUD + " AND m > 0.1e0 * first_mean)")} AS level, {_level("max(m)")} AS momentary_max,
       {_level("max(s) FILTER (WHERE rn >= 30)")} AS short_max
FROM k GROUP BY part""",
)
def a05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.gated_level(series(spark, sf_dir), hop=2)


@query(
    "a06_level_range",
    f"""{S}, {_HOPS.format(h=2)},
w AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY block) AS rn, avg(ms) OVER (PARTITION BY part ORDER BY block ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS p FROM hops),
l AS (SELECT *, avg(p) OVER (PARTITION BY part) AS mean FROM w WHERE rn >= 6 AND p >= {_LOUD}),
h AS (SELECT part, CAST(floor(({A.LOUDNESS_OFFSET}e0 + 10 * log10(p) + 70) / 0.01e0) AS BIGINT) AS bin, count(*) AS n FROM l WHERE p >= 0.01e0 * mean GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY part ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY part) AS total FROM h),
f AS (SELECT part, CAST(max(total) AS BIGINT) AS windows, min(bin) FILTER (WHERE upto > ((total - 1) * 10 + 50) // 100) AS b10, min(bin) FILTER (WHERE upto > ((total - 1) * 95 + 50) // 100) AS b95 FROM r GROUP BY part)
SELECT part, windows, round(-70 + (b10 + 0.5e0) * 0.01e0, 6) AS p10, round(-70 + (b95 + 0.5e0) * 0.01e0, 6) AS p95, round((b95 - b10) * 0.01e0, 6) AS range FROM f WHERE windows >= 2""",
)
def a06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.level_range(series(spark, sf_dir), hop=2, span=6)


_TAPS = ", ".join(f"lag(x, {k}, 0) OVER o AS x{k}" for k in range(12))
_FIR = ", ".join("abs(0e0 + " + " + ".join(f"x{k} * {c!r}e0" for k, c in enumerate(p)) + ")" for p in A.PEAK_PHASES)


@query(
    "a07_interpolated_peak",
    f"""{S}, padded AS (
  SELECT part, frame, x FROM series UNION ALL
  SELECT part, last + unnest(range(1, 12)), 0e0 FROM (SELECT part, max(frame) AS last FROM series GROUP BY part)),
l AS (SELECT part, x, {_TAPS} FROM padded WINDOW o AS (PARTITION BY part ORDER BY frame)),
p AS (SELECT part, max(abs(x)) AS sample_peak, max(greatest(abs(x), {_FIR})) AS interpolated_peak FROM l GROUP BY part)
SELECT part, round(sample_peak, 6) AS sample_peak, round(interpolated_peak, 6) AS interpolated_peak, round(20 * log10(interpolated_peak), 6) AS peak_db FROM p""",
)
def a07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.interpolated_peak(series(spark, sf_dir))


_BLOCKS = "blocks AS (SELECT part, frame // {n} AS block, count(*) AS n, avg(x * x) AS ms, max(abs(x)) AS peak FROM series GROUP BY 1, 2{having})"


def _blocks(n: int, tail: bool = False) -> str:
    return _BLOCKS.format(n=n, having="" if tail else f" HAVING count(*) = {n}")


@query(
    "a10_level_variation",
    f"""{S}, {_blocks(8)}
SELECT part, count(*) AS blocks, count(*) FILTER (WHERE ms > 0.01e0) AS eligible,
       round(CASE WHEN count(*) >= 2 AND count(*) = count(*) FILTER (WHERE ms > 0.01e0) THEN stddev_pop(10 * log10(ms)) END, 6) AS level_std FROM blocks GROUP BY part""",
)
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.level_variation(series(spark, sf_dir), 8, 0.01)


@query(
    "a11_quiet_blocks",
    f"""{S}, {_blocks(4)},
r AS (SELECT part, block, sqrt(ms) AS rms, row_number() OVER (PARTITION BY part ORDER BY sqrt(ms), block) AS rn, count(*) OVER (PARTITION BY part) AS n_all FROM blocks WHERE ms > 0)
SELECT part, count(*) AS nonzero, round(quantile_cont(rms, 0.015), 6) AS p015, round(quantile_cont(rms, 0.99), 6) AS p99,
       count(*) FILTER (WHERE rn <= greatest(3, n_all // 10)) AS selected, min(block) FILTER (WHERE rn <= greatest(3, n_all // 10)) AS first_block,
       max(block) FILTER (WHERE rn <= greatest(3, n_all // 10)) AS last_block FROM r GROUP BY part HAVING count(*) >= 5""",
)
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.quiet_blocks(series(spark, sf_dir), 4, 5)


@query(
    "a27_block_correlation",
    f"""{S}, b AS (SELECT part, frame // 8 AS block, covar_pop(x, y) AS cov, var_pop(x) AS vx, var_pop(y) AS vy FROM series GROUP BY 1, 2 HAVING count(*) = 8)
SELECT part, count(*) AS blocks, count(*) FILTER (WHERE vx * vy > 1e-12) AS valid_blocks, round(avg(CASE WHEN vx * vy > 1e-12 THEN cov / sqrt(vx * vy) END), 6) AS correlation,
       CASE WHEN avg(CASE WHEN vx * vy > 1e-12 THEN cov / sqrt(vx * vy) END) IS NULL THEN NULL
            WHEN avg(CASE WHEN vx * vy > 1e-12 THEN cov / sqrt(vx * vy) END) >= 0.9e0 THEN 'Mono-compatible' WHEN avg(CASE WHEN vx * vy > 1e-12 THEN cov / sqrt(vx * vy) END) >= 0.5e0 THEN 'Normal stereo'
            WHEN avg(CASE WHEN vx * vy > 1e-12 THEN cov / sqrt(vx * vy) END) >= 0 THEN 'Wide stereo' WHEN avg(CASE WHEN vx * vy > 1e-12 THEN cov / sqrt(vx * vy) END) >= -0.3e0 THEN '⚠ Possible fake stereo / heavy M-S processing'
            ELSE '⚠ Phase cancellation — check mono fold-down' END AS verdict
FROM b GROUP BY part""",
)
def a27(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.block_correlation(series(spark, sf_dir), 8).withColumn("verdict", A.phase_verdict(F.col("correlation")))


@query("a28_ceiling_count", f'{S} SELECT part, count(*) FILTER (WHERE abs(x) >= 0.4e0) AS "left", count(*) FILTER (WHERE abs(y) >= 0.4e0) AS "right" FROM series GROUP BY part')
def a28(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.ceiling_count(series(spark, sf_dir), 0.4)


@query(
    "a29_silence_share",
    f"""{S}, {_RUNS_SQL}, t AS (SELECT part, count(*) AS frames FROM series GROUP BY part)
SELECT t.part, frames, CAST(coalesce(sum(length), 0) AS BIGINT) AS quiet, round(100e0 * coalesce(sum(length), 0) / frames, 6) AS percent,
       lpad(CAST(coalesce(sum(length), 0) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(coalesce(sum(length), 0) % 60 AS VARCHAR), 2, '0') AS clock
FROM t LEFT JOIN runs USING (part) GROUP BY t.part, frames""",
)
def a29(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir)
    return W.run_summary(s, W.runs(s, F.abs("x") < QUIET, LEAST_RUN)).select("part", "frames", "quiet", "percent", clock(F.col("quiet")).alias("clock"))


@query(
    "a30_extrema_stats",
    f"""{S}, e AS (SELECT part, x, min(x) OVER (PARTITION BY part) AS lo, max(x) OVER (PARTITION BY part) AS hi FROM series),
c AS (SELECT part, CASE WHEN hi > lo THEN least(floor((x - lo) / (hi - lo) * 64), 63) ELSE 0 END AS cell, count(*) AS n FROM e GROUP BY 1, 2),
t AS (SELECT part, n / sum(n) OVER (PARTITION BY part) AS p FROM c),
h AS (SELECT part, -sum(p * log2(p)) AS entropy FROM t GROUP BY part)
SELECT part, round(min(x), 6) AS low, round(max(x), 6) AS high, count(*) FILTER (WHERE x = lo) AS low_count, count(*) FILTER (WHERE x = hi) AS high_count,
       round(any_value(entropy), 6) AS entropy, round(20 * log10(max(x) - min(x)), 6) AS range_db FROM e JOIN h USING (part) GROUP BY part""",
)
def a30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.extrema(series(spark, sf_dir), F.col("x"))


@query(
    "a30_overall_level",
    f"""{S}, stats AS ({_STATS_SQL})
SELECT CAST(sum(samples) AS BIGINT) AS samples, round(max(peak), 6) AS peak, round(sqrt(sum(rms * rms * samples) / sum(samples)), 6) AS rms, round(arg_max(dc, abs(dc)), 6) AS dc FROM stats""",
)
def a30_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = A.series_stats(series(spark, sf_dir))
    return stats.agg(*[c.alias(n) for n, c in A.overall_level(stats).items()])


@query(
    "a31_delta_stats",
    f"""{S}, d AS (SELECT part, abs(x - lag(x) OVER (PARTITION BY part ORDER BY frame)) AS d FROM series)
SELECT part, round(max(d), 6) AS max_delta, round(avg(d), 6) AS mean_delta, round(sqrt(avg(d * d)), 6) AS rms_delta FROM d GROUP BY part""",
)
def a31(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.deltas(series(spark, sf_dir))


@query(
    "a32_dynamic_range",
    f"""{S}, {_blocks(8, tail=True)},
r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY ms DESC, block) AS loud, row_number() OVER (PARTITION BY part ORDER BY peak DESC, block) AS high,
             count(*) OVER (PARTITION BY part) AS nb, sum(n) OVER (PARTITION BY part) AS frames FROM blocks),
g AS (SELECT part, max(nb) AS blocks, max(frames) AS frames, CAST(round_even(max(nb) * 0.2e0, 0) AS BIGINT) AS target, max(peak) FILTER (WHERE high = 2) AS second_peak,
             sqrt(avg(2 * ms) FILTER (WHERE loud <= round_even(nb * 0.2e0, 0))) AS loud_rms FROM r GROUP BY part)
SELECT part, blocks, target, round(CASE WHEN frames % 8 <> 0 AND target > 0 AND loud_rms > 0 AND second_peak > 0 THEN 20 * log10(second_peak / loud_rms) END, 6) AS dr_db FROM g""",
)
def a32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.dynamic_range(series(spark, sf_dir), 8)


_FRAMES = """
frames AS (
  SELECT part, f AS frame_no, min(frame) AS start, count(*) AS samples, sum(x * x) AS energy, max(abs(x)) AS peak
  FROM (SELECT part, frame, x, unnest(range(CAST(greatest(0, ceil((frame - 7) / 4)) AS BIGINT), frame // 4 + 1)) AS f, count(*) OVER (PARTITION BY part) AS n FROM series)
  WHERE f * 4 + 8 < n GROUP BY 1, 2)"""


@query("w01_hopping_frames", f"{S}, {_FRAMES} SELECT part, frame_no, start, samples, round(energy, 6) AS energy, round(peak, 6) AS peak FROM frames")
def w01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.hopping_frames(series(spark, sf_dir), 8, 4)


@query("w03_tumbling_rms", f"{S}, {_blocks(8)} SELECT part, block, n, round(ms, 6) AS ms, round(peak, 6) AS peak, round(sqrt(ms), 6) AS rms FROM blocks")
def w03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.tumbling_blocks(series(spark, sf_dir), 8)


@query(
    "w05_sliding_level",
    f"""{S}, {_HOPS.format(h=2)}
SELECT part, block, round(avg(ms) OVER (PARTITION BY part ORDER BY block ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS momentary FROM hops
QUALIFY row_number() OVER (PARTITION BY part ORDER BY block) >= 4""",
)
def w05(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    by = Window.partitionBy("part").orderBy("block")
    hops = W.tumbling_blocks(series(spark, sf_dir), 2)
    return hops.withColumn("rn", F.row_number().over(by)).withColumn("momentary", F.avg("ms").over(by.rowsBetween(-3, 0))).where("rn >= 4").select("part", "block", "momentary")


@query("w08_quiet_runs", f"{S}, {_RUNS_SQL} SELECT part, start, \"end\", length FROM runs")
def w08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.runs(series(spark, sf_dir), F.abs("x") < QUIET, LEAST_RUN)


@query(
    "w09_windows_in_runs",
    f"""{S}, {_RUNS_SQL}, w AS (SELECT part, frame AS start FROM series)
SELECT w.part, count(*) AS windows FROM w WHERE EXISTS (SELECT 1 FROM runs r WHERE r.part = w.part AND r.start <= w.start AND w.start + 3 <= r."end") GROUP BY w.part""",
)
def w09(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir)
    found = W.runs(s, F.abs("x") < QUIET, LEAST_RUN)
    frames = s.select("part", F.col("frame").alias("start"))
    return W.windows_in_runs(frames, found, 3).groupBy("part").agg(F.count("*").alias("windows"))


@query(
    "w11_centred_envelope",
    f"""{S}, e AS (SELECT part, frame, avg(abs(x)) OVER w * pi() / 2 AS smooth, count(*) OVER w AS n FROM series WINDOW w AS (PARTITION BY part ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT part, frame, round(smooth, 6) AS smooth FROM e WHERE n = 5 AND frame >= 4""",
)
def w11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = W.centred_mean(series(spark, sf_dir), F.abs("x"), 5, warmup=4)
    return out.withColumn("smooth", F.col("smooth") * F.pi() / 2)


@query(
    "w12_edge_clamped_mean",
    f"""{S}, t AS (SELECT part, max(frame) AS last FROM series GROUP BY part),
o AS (SELECT part, frame, greatest(0, least(last, frame + k)) AS src FROM series JOIN t USING (part), (SELECT unnest(range(-2, 3)) AS k))
SELECT o.part, o.frame, round(sum(abs(s.x)) / 5, 6) AS smooth FROM o JOIN series s ON s.part = o.part AND s.frame = o.src GROUP BY 1, 2""",
)
def w12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.nearest_edge_mean(series(spark, sf_dir), F.abs("x"), 5)


_MAXIMA = """
steps AS (SELECT part, frame, abs(x) AS v, CASE WHEN abs(x) = lag(abs(x)) OVER (PARTITION BY part ORDER BY frame) THEN 0 ELSE 1 END AS new FROM series),
plateaus AS (
  SELECT part, k, min(frame) AS start, max(frame) AS stop, min(v) AS v
  FROM (SELECT *, sum(new) OVER (PARTITION BY part ORDER BY frame) AS k FROM steps) GROUP BY part, k),
peaks AS (
  SELECT part, start + (stop - start) // 2 AS frame, v AS value FROM plateaus
  QUALIFY lag(v) OVER (PARTITION BY part ORDER BY k) < v AND lead(v) OVER (PARTITION BY part ORDER BY k) < v)"""


@query("w13_local_maxima", f"{S}, {_MAXIMA} SELECT part, frame, round(value, 6) AS value FROM peaks")
def w13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.local_maxima(series(spark, sf_dir), F.abs("x"))


@query(
    "w14_spaced_peaks",
    f"""WITH RECURSIVE {SERIES_SQL}, {_MAXIMA},
kept AS (
  SELECT part, min(frame) AS frame FROM peaks GROUP BY part
  UNION ALL
  SELECT k.part, (SELECT min(p.frame) FROM peaks p WHERE p.part = k.part AND p.frame - k.frame >= 5) FROM kept k
  WHERE (SELECT min(p.frame) FROM peaks p WHERE p.part = k.part AND p.frame - k.frame >= 5) IS NOT NULL)
SELECT part, frame FROM kept""",
)
def w14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.spaced_in_order(W.local_maxima(series(spark, sf_dir), F.abs("x")), 5)


@query("w15_height_peaks")
def w15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy by height: tested against a brute-force version."""
    return W.spaced_by_height(W.local_maxima(series(spark, sf_dir), F.abs("x")), 5)


@query("o02_loudest_apart")
def o02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy by energy with an exclusion distance: tested against a brute-force version."""
    return W.loudest_apart(W.tumbling_blocks(series(spark, sf_dir), 4), "ms", 3, 2)


_QUARTERS = """CASE WHEN v = 0 THEN 0 WHEN v <= {zero} THEN 1 WHEN v >= {top} THEN {cells} + 2 ELSE 2 + least(floor(({unit} * log10(v) - ({low})) * 4), {cells} - 1) END"""


def _median_sql(source: str, low: int, high: int, unit: int, zero: str) -> str:
    """CTEs hist, ranks and med of the levels v by part in this source."""
    cells, top = 4 * (high - low), 10 ** (high // unit)
    edge = lambda c, k: f"pow(10, ({low} + ({c} - 2 + {k}) * 0.25e0) / {unit})"
    lower = lambda c: f"CASE WHEN {c} <= 1 THEN 0e0 WHEN {c} = {cells + 2} THEN {top}e0 ELSE {edge(c, 0)} END"
    upper = lambda c: f"CASE WHEN {c} = 0 THEN 0e0 WHEN {c} = 1 THEN {zero} WHEN {c} < {cells + 2} THEN {edge(c, 1)} END"
    return f"""hist AS (SELECT part, {_QUARTERS.format(zero=zero, top=top, cells=cells, unit=unit, low=low)} AS cell, count(*) AS n FROM {source} GROUP BY 1, 2),
ranks AS (SELECT part, cell, sum(n) OVER (PARTITION BY part ORDER BY cell) AS upto, sum(n) OVER (PARTITION BY part) AS total FROM hist),
ab AS (SELECT part, CAST(max(total) AS BIGINT) AS n, min(cell) FILTER (WHERE upto > (total - 1) // 2) AS a, min(cell) FILTER (WHERE upto > total // 2) AS b FROM ranks GROUP BY 1),
med AS (SELECT part, n, ({lower("a")} + {lower("b")}) / 2 AS lower, ({upper("a")} + {upper("b")}) / 2 AS upper FROM ab)"""


@query("x06_envelope_median", f"{S}, e AS (SELECT part, abs(x) AS v FROM series), {_median_sql('e', -180, 40, 20, '1e-9')} SELECT part, n, round(lower, 6) AS lower, round(upper, 6) AS upper FROM med")
def x06_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.level_median(series(spark, sf_dir), "part", F.abs("x"), -180.0, 40.0, 20.0, 1e-9)


@query(
    "x06_envelope_peaks",
    f"""WITH RECURSIVE {SERIES_SQL}, e AS (SELECT part, abs(x) AS v FROM series), {_median_sql('e', -180, 40, 20, '1e-9')}, {_MAXIMA},
high AS (SELECT p.part, p.frame, p.value FROM peaks p JOIN med USING (part) WHERE p.value > greatest(1e-4, 1.5e0 * upper)),
kept AS (
  SELECT part, min(frame) AS frame FROM high GROUP BY part
  UNION ALL
  SELECT k.part, (SELECT min(p.frame) FROM high p WHERE p.part = k.part AND p.frame - k.frame >= 5) FROM kept k
  WHERE (SELECT min(p.frame) FROM high p WHERE p.part = k.part AND p.frame - k.frame >= 5) IS NOT NULL)
SELECT part, frame, round(value, 6) AS value FROM kept JOIN high USING (part, frame)""",
)
def x06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of an envelope above a multiple of its median, spaced in order."""
    envelope = series(spark, sf_dir).select("part", "frame", F.abs("x").alias("v"))
    return W.envelope_peaks(envelope, 5, 1e-4, 1.5)


@query(
    "x07_preceding_energy",
    f"""{S}, q AS (SELECT part, x * x AS v FROM series), {_median_sql('q', -200, 40, 10, '1e-20')},
l AS (SELECT part, frame, hit, avg(x * x) OVER w AS context, count(*) OVER w AS seen FROM series WINDOW w AS (PARTITION BY part ORDER BY frame ROWS BETWEEN 6 PRECEDING AND 4 PRECEDING)),
o AS (SELECT part, frame >= 8 AND seen = 3 AS eligible, context FROM l WHERE hit)
SELECT part, count(*) AS events, count(*) FILTER (WHERE eligible) AS eligible, round(any_value(greatest(1e-12, 3 * upper)), 6) AS threshold,
       count(*) FILTER (WHERE eligible AND context > greatest(1e-12, 3 * upper)) AS affected FROM o JOIN med USING (part) GROUP BY part""",
)
def x07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose preceding power is above three times the median power."""
    s = series(spark, sf_dir)
    limit = W.level_median(s, "part", F.col("x") * F.col("x"), -200.0, 40.0, 10.0, 1e-20).select("part", F.greatest(F.lit(1e-12), 3 * F.col("upper")).alias("threshold"))
    looked = W.lookback(s, 6, 3, 8).join(limit, "part")
    return looked.groupBy("part").agg(F.count("*").alias("events"), F.count_if("eligible").alias("eligible"), F.max("threshold").alias("threshold"), F.count_if(F.col("eligible") & (F.col("power") > F.col("threshold"))).alias("affected"))


@query(
    "p11_verdicts",
    f"""{S}, c AS (SELECT part, CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END AS r, count(*) FILTER (WHERE abs(x) >= 0.2e0) * (1 + part % 40) AS n FROM series GROUP BY part)
SELECT part, CASE WHEN r IS NULL THEN NULL {" ".join(f"WHEN r >= {k}e0 THEN '{t}'" for k, t in A.PHASE_STEPS)} ELSE '{A.PHASE_BELOW}' END AS phase,
       CASE WHEN n = 0 THEN '✓ No clipped samples' WHEN n < 10 THEN '~ ' || n || ' clipped sample(s) — minor' ELSE '⚠ ' || format('{{:,}}', n) || ' clipped samples — audible distortion likely' END AS clipping FROM c""",
)
def p11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict texts of a correlation and of a count of clipped samples."""
    sd = F.stddev_pop("x") * F.stddev_pop("y")
    g = series(spark, sf_dir).groupBy("part").agg(F.when(sd > 0, F.covar_pop("x", "y") / sd).alias("r"), (F.count_if(F.abs("x") >= 0.2) * (1 + F.col("part") % 40)).alias("n"))
    return g.select("part", A.phase_verdict(F.col("r")).alias("phase"), A.clipping_verdict(F.col("n")).alias("clipping"))


@query("w06_noise_floor_ring")
def w06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least running maximum over a ring, order-dependent: tested against a brute-force version."""
    s = series(spark, sf_dir).select("part", "frame", "x").repartition("part").sortWithinPartitions("part", "frame")
    return s.mapInPandas(lambda it: W.stateful_noise_floor(it, 6), "part long, frame long, floor double")


@query(
    "w16_event_lookback",
    f"""{S}, l AS (
  SELECT part, frame, hit, avg(x * x) OVER w AS context, count(*) OVER w AS seen FROM series WINDOW w AS (PARTITION BY part ORDER BY frame ROWS BETWEEN 6 PRECEDING AND 4 PRECEDING))
SELECT part, count(*) AS events, count(*) FILTER (WHERE frame >= 8 AND seen = 3) AS eligible, count(*) FILTER (WHERE frame >= 8 AND seen = 3 AND context > 0.1e0) AS above,
       round(count(*) FILTER (WHERE frame >= 8 AND seen = 3 AND context > 0.1e0) / nullif(count(*) FILTER (WHERE frame >= 8 AND seen = 3), 0), 6) AS fraction
FROM l WHERE hit GROUP BY part""",
)
def w16(spark: SparkSession, sf_dir: str) -> DataFrame:
    looked = W.lookback(series(spark, sf_dir), 6, 3, 8)
    g = looked.groupBy("part").agg(F.count("*").alias("events"), F.count_if("eligible").alias("eligible"), F.count_if(F.col("power") > 0.1).alias("above"))
    return g.withColumn("fraction", levels.ratio(F.col("above"), F.col("eligible")))


@query("w20_zero_crossings", f"""{S}, z AS (SELECT part, (x - 0e0 > 0) <> lag(x > 0, 1, false) OVER (PARTITION BY part ORDER BY frame) AS flip FROM series WHERE x <> 0),
c AS (SELECT part, count(*) FILTER (WHERE flip) AS crossings FROM z GROUP BY part)
SELECT s.part, count(*) AS samples, coalesce(any_value(c.crossings), 0) AS crossings FROM series s LEFT JOIN c USING (part) GROUP BY s.part""")
def w20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.zero_crossings(series(spark, sf_dir), F.col("x"))


def _flat(name: str, edge: str) -> str:
    return f"""{name} AS (
  SELECT part, CAST(sum(n) AS BIGINT) AS {name}_count, CAST(sum(CASE WHEN open THEN 0 ELSE n * n END) AS BIGINT) AS {name}_squares
  FROM (SELECT part, count(*) AS n, max(frame) = any_value(last) AS open FROM (SELECT *, frame - row_number() OVER (PARTITION BY part ORDER BY frame) AS island FROM m WHERE v = {edge}) GROUP BY part, island) GROUP BY part)"""


@query(
    "w21_flat_runs",
    f"""{S}, m AS (SELECT part, frame, round(x, 1) AS v, min(round(x, 1)) OVER (PARTITION BY part) AS lo, max(round(x, 1)) OVER (PARTITION BY part) AS hi, max(frame) OVER (PARTITION BY part) AS last FROM series),
{_flat("low", "lo")}, {_flat("high", "hi")}
SELECT part, any_value(lo) AS low, any_value(hi) AS high, any_value(low_count) AS low_count, any_value(low_squares) AS low_squares, any_value(high_count) AS high_count, any_value(high_squares) AS high_squares
FROM m JOIN low USING (part) JOIN high USING (part) GROUP BY part""",
)
def w21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.flat_runs(series(spark, sf_dir), F.round("x", 1))


@query("p02_saturated_words", f"{S} SELECT part, frame, CAST(least(greatest(round(x * 2147483648e0), -2147483648e0), 2147483647e0) AS BIGINT) AS word, abs(x) > 1 AS clipped FROM series")
def p02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).select("part", "frame", levels.saturated_word(F.col("x")).alias("word"), (F.abs("x") > 1).alias("clipped"))


@query(
    "p03_mid_side",
    f"""{S}, f AS (SELECT part, frame, CAST((CAST(x AS FLOAT) + CAST(y AS FLOAT)) * CAST(0.5 AS FLOAT) AS FLOAT) AS m, CAST((CAST(x AS FLOAT) - CAST(y AS FLOAT)) * CAST(0.5 AS FLOAT) AS FLOAT) AS s FROM series)
SELECT part, round(avg(CAST(m AS DOUBLE) * m), 6) AS mid_power, round(avg(CAST(s AS DOUBLE) * s), 6) AS side_power, round(max(abs(CAST(m AS DOUBLE) + s)), 6) AS left_peak FROM f GROUP BY part""",
)
def p03(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = series(spark, sf_dir).select("part", levels.mid(F.col("x"), F.col("y")).cast("double").alias("m"), levels.side(F.col("x"), F.col("y")).cast("double").alias("s"))
    return f.groupBy("part").agg(F.avg(F.col("m") * F.col("m")).alias("mid_power"), F.avg(F.col("s") * F.col("s")).alias("side_power"), F.max(F.abs(F.col("m") + F.col("s"))).alias("left_peak"))


@query(
    "p13_platform_deltas",
    f"""{S}, {_HOPS.format(h=2)}, l AS (SELECT part, {_level("avg(ms)")} AS level FROM hops GROUP BY part)
SELECT part, level, printf('%+.1f dB', -16e0 - level) AS delta_16, printf('%+.1f dB', -14e0 - level) AS delta_14 FROM l""",
)
def p13(spark: SparkSession, sf_dir: str) -> DataFrame:
    hops = W.tumbling_blocks(series(spark, sf_dir), 2)
    l = hops.groupBy("part").agg(F.round(A.LOUDNESS_OFFSET + levels.power_db(F.avg("ms")), 6).alias("level"))
    return l.select("part", "level", A.platform_delta(F.col("level"), -16.0).alias("delta_16"), A.platform_delta(F.col("level"), -14.0).alias("delta_14"))


@query(
    "o04_listed_runs",
    f"""{S}, {_RUNS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY start) AS k, count(*) OVER (PARTITION BY part) AS total FROM runs)
SELECT part, start, "end", total, total > 2 AS truncated FROM r WHERE k <= 2""",
)
def o04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two runs of each series with the full count: the list is short, the total whole."""
    from pyspark.sql.window import Window

    found = W.runs(series(spark, sf_dir), F.abs("x") < QUIET, LEAST_RUN)
    by = Window.partitionBy("part")
    r = found.withColumn("k", F.row_number().over(by.orderBy("start"))).withColumn("total", F.count("*").over(by))
    return r.where("k <= 2").select("part", "start", "end", "total", (F.col("total") > 2).alias("truncated"))
