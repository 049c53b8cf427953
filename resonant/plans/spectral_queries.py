"""Queries over spectra: embeddings stand in for magnitude frames, a bin is 1 Hz wide."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resonant.operators import aggregates as A
from resonant.operators import spectral as P
from resonant.plans.registry import query
from resonant.sources.bindings import BINS, RATE, SPECTRA_SQL, spectra

_DB = "20 * log10({m} / ({p} + 1e-12) + 1e-12)"
_ACT = f"""WITH {SPECTRA_SQL},
peaks AS (SELECT channel, frame_no, max(m) AS peak FROM spectra GROUP BY 1, 2),
loud AS (SELECT * FROM peaks QUALIFY peak > (max(peak) OVER (PARTITION BY channel) + 1e-12) * 1e-3),
act AS (SELECT s.*, l.peak FROM spectra s JOIN loud l USING (channel, frame_no))"""
_SPEC = f"""{_ACT}, avgs AS (SELECT channel, bin, avg(m) AS avg, sum(m * m) AS sq, count(*) AS frames FROM act GROUP BY 1, 2),
spec AS (SELECT *, {_DB.format(m="avg", p="max(avg) OVER (PARTITION BY channel)")} AS db FROM avgs)"""
_CUT = f"cut AS (SELECT channel, frame_no, coalesce(max(bin) FILTER (WHERE {_DB.format(m='m', p='peak')} > -20), 0) AS cutoff FROM act GROUP BY 1, 2)"


@query("p04_active_frames", f"{_ACT} SELECT channel, count(DISTINCT frame_no) AS active_frames, round(max(peak), 6) AS top FROM act GROUP BY 1")
def p04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.active(spectra(spark, sf_dir)).groupBy("channel").agg(F.countDistinct("frame_no").alias("active_frames"), F.max("peak").alias("top"))


def _at(d: int) -> str:
    return f"least(greatest(floor(cutoff + {d}), 0), {BINS - 1})"


@query(
    "a04_spectral_features",
    f"""{_SPEC}, {_CUT},
c AS (SELECT channel, count(*) AS active_frames, quantile_cont(cutoff, 0.95) AS cutoff, var_pop(cutoff) AS cutoff_variance FROM cut GROUP BY 1),
t AS (SELECT channel, count(DISTINCT frame_no) AS frames FROM spectra GROUP BY 1),
w AS (SELECT s.*, c.cutoff, abs(db - lag(db) OVER (PARTITION BY channel ORDER BY bin)) AS step, avg / (sum(avg) OVER (PARTITION BY channel) + 1e-12) AS p FROM spec s JOIN c USING (channel)),
g AS (SELECT channel, max(db) FILTER (WHERE bin = {_at(-3)}) - max(db) FILTER (WHERE bin = {_at(3)}) AS cliff_db,
        max(step) FILTER (WHERE bin > {_at(-12)} AND bin < {_at(3)}) AS sharpness,
        coalesce(sum(avg) FILTER (WHERE bin >= 48), 0) / (sum(avg) + 1e-12) AS hf_ratio, -sum(CASE WHEN p > 0 THEN p * log2(p) END) AS entropy,
        20 * log10(sqrt(sum(sq) FILTER (WHERE bin >= {_at(0)}) / sum(frames) FILTER (WHERE bin >= {_at(0)})) + 1e-12) AS noise_db FROM w GROUP BY 1)
SELECT channel, frames, active_frames, round(cutoff, 6) AS cutoff, round(cutoff_variance, 6) AS cutoff_variance, round(cliff_db, 6) AS cliff_db, round(sharpness, 6) AS sharpness,
       round(hf_ratio, 6) AS hf_ratio, round(entropy, 6) AS entropy, round(noise_db, 6) AS noise_db FROM t JOIN c USING (channel) JOIN g USING (channel)""",
)
def a04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.features(spectra(spark, sf_dir), floor_db=-20.0, hf_from=48, span=3)


_BASE = f"""{_SPEC}, {_CUT},
c AS (SELECT channel, count(*) AS active_frames, quantile_cont(cutoff, 0.95) AS cutoff, var_pop(cutoff) AS cutoff_variance FROM cut GROUP BY 1),
t AS (SELECT channel, count(DISTINCT frame_no) AS frames FROM spectra GROUP BY 1),
w AS (SELECT s.*, c.cutoff, abs(db - lag(db) OVER (PARTITION BY channel ORDER BY bin)) AS step, avg / (sum(avg) OVER (PARTITION BY channel) + 1e-12) AS p FROM spec s JOIN c USING (channel)),
g AS (SELECT channel, max(db) FILTER (WHERE bin = {_at(-3)}) - max(db) FILTER (WHERE bin = {_at(3)}) AS cliff_db,
        max(step) FILTER (WHERE bin > {_at(-12)} AND bin < {_at(3)}) AS sharpness,
        coalesce(sum(avg) FILTER (WHERE bin >= 48), 0) / (sum(avg) + 1e-12) AS hf_ratio, -sum(CASE WHEN p > 0 THEN p * log2(p) END) AS entropy,
        20 * log10(sqrt(sum(sq) FILTER (WHERE bin >= {_at(0)}) / sum(frames) FILTER (WHERE bin >= {_at(0)})) + 1e-12) AS noise_db FROM w GROUP BY 1)"""


@query(
    "a19_base_features",
    f"""{_BASE}, h AS (SELECT channel, coalesce(sum(m) FILTER (WHERE bin >= 48), 0) / (sum(m) + 1e-12) AS share FROM act GROUP BY 1), r AS (SELECT *, frames >= 4 AND active_frames >= 4 AS ready FROM t JOIN c USING (channel) JOIN g USING (channel) JOIN h USING (channel))
SELECT channel, frames, active_frames, {", ".join(f"round(CASE WHEN ready THEN {x} END, 6) AS {x}" for x in ("cutoff", "cutoff_variance", "cliff_db", "sharpness", "entropy", "noise_db"))},
       round(CASE WHEN ready THEN share END, 6) AS hf_ratio, CASE WHEN ready THEN 'measured' ELSE 'inconclusive' END AS status FROM r""",
)
def a19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.base_features(spectra(spark, sf_dir), floor_db=-20.0, hf_from=48, span=3, rate=44_100)


@query(
    "p05_gates",
    f"""{_SPEC}, n AS (SELECT channel, max(frames) AS frames, avg(db) FILTER (WHERE bin BETWEEN 50 AND 54) AS high_db FROM spec GROUP BY 1)
SELECT channel, CASE WHEN channel >= 8 THEN 'unsupported' WHEN frames < 20 OR high_db IS NULL THEN 'inconclusive' ELSE 'measured' END AS status, round(CASE WHEN channel < 8 AND frames >= 20 THEN high_db END, 6) AS value FROM n""",
)
def p05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of unsupported, inconclusive and measured a measurement is; its value is known only where measured."""
    bins = spectra(spark, sf_dir)
    high = P.mean_spectrum(P.active(bins)).groupBy("channel").agg(F.max("frames").alias("frames"), F.avg(F.when(F.col("bin").between(50, 54), F.col("db"))).alias("high_db"))
    return high.select("channel", A.gate(F.col("high_db"), F.col("channel") < 8, F.col("frames") >= 20).alias("g")).select("channel", "g.*")


@query(
    "a08_band_power",
    f"""WITH {SPECTRA_SQL}, f AS (SELECT channel, frame_no, max(m) AS peak, coalesce(sum(m * m) FILTER (WHERE bin BETWEEN 32 AND 48), 0) AS p FROM spectra GROUP BY 1, 2)
SELECT channel, count(*) AS frames, round(CASE WHEN count(*) >= 4 THEN avg(p) END, 6) AS mean_square, count(*) FILTER (WHERE peak < 0.3e0) AS quiet_frames,
       round(CASE WHEN count(*) FILTER (WHERE peak < 0.3e0) >= 4 THEN avg(p) FILTER (WHERE peak < 0.3e0) END, 6) AS quiet_mean_square FROM f GROUP BY 1""",
)
def a08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.band_power(spectra(spark, sf_dir), 32, 48, 0.3)


_LAG = ", ".join(f"round(sum(m * m * cos(bin * {2 * math.pi * k / RATE!r}e0)) / sum(m * m), 6) AS lag_{k}" for k in (3, 7))


@query("a09_band_lag_correlation", f"WITH {SPECTRA_SQL} SELECT channel, round(sum(m * m), 6) AS power, {_LAG} FROM spectra WHERE bin BETWEEN 20 AND 60 GROUP BY 1")
def a09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.band_lag_correlation(spectra(spark, sf_dir), 20, 60, (3, 7), RATE)


@query(
    "a12_scatter_bound",
    f"""WITH {SPECTRA_SQL}, l AS (SELECT channel, frame_no, bin, greatest(20 * log10(m + 1e-12), -110) / 10 * {math.log(10)!r}e0 AS l FROM spectra),
o AS (SELECT unnest(range(-2, 3)) AS o),
s AS (SELECT a.channel, a.frame_no, a.bin, stddev_pop(b.l) AS s FROM l a, o JOIN l b ON b.channel = a.channel AND b.frame_no = a.frame_no AND b.bin = least(greatest(a.bin + o, 0), 63) GROUP BY 1, 2, 3),
t AS (SELECT a.channel, a.frame_no, a.bin, avg(b.s) AS t FROM s a, o JOIN s b ON b.channel = a.channel AND b.frame_no = a.frame_no AND b.bin = least(greatest(a.bin + o, 0), 63) GROUP BY 1, 2, 3),
f AS (SELECT *, max(t) OVER (PARTITION BY channel, frame_no) AS top FROM t),
b AS (SELECT channel, frame_no, max(bin) AS bound FROM f WHERE top > 1e-6 AND t >= least(0.6e0, 0.6e0 * top) GROUP BY 1, 2),
m AS (SELECT channel, bound AS mode FROM (SELECT channel, bound, count(*) AS n FROM b GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY channel ORDER BY n DESC, bound) = 1)
SELECT channel, count(*) AS bound_frames, round(avg(bound), 6) AS average, any_value(mode) AS mode FROM b JOIN m USING (channel) GROUP BY channel""",
)
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.scatter_bound(spectra(spark, sf_dir), BINS, share=0.6, most=0.6)


_PHASES = f"""WITH {SPECTRA_SQL}, f AS (SELECT channel, frame_no, max(m) AS peak FROM spectra GROUP BY 1, 2),
n AS (SELECT channel, frame_no, peak, row_number() OVER (PARTITION BY channel ORDER BY frame_no) AS i, peak > (max(peak) OVER (PARTITION BY channel) + 1e-12) * 1e-3 AS active FROM f),
p AS (SELECT channel, frame_no, bin, v, lead(v) OVER (PARTITION BY channel, frame_no ORDER BY bin) AS w FROM spectra WHERE bin >= 20),
q AS (SELECT p.channel, bin, i, active, atan2(w, v) AS phase, sqrt(v * v + w * w) > greatest(1e-8, peak * 1e-4) AS loud FROM p JOIN n USING (channel, frame_no) WHERE bin % 2 = 0 AND w IS NOT NULL)"""
_PHASE_ENTROPY = f"""w AS (SELECT channel, d - {2 * math.pi!r}e0 * floor((d + {math.pi!r}e0) / {2 * math.pi!r}e0) AS d FROM d WHERE d IS NOT NULL),
h AS (SELECT channel, least(floor((d + {math.pi!r}e0) / {2 * math.pi!r}e0 * 36), 35) AS cell, count(*) AS n FROM w GROUP BY 1, 2),
t AS (SELECT channel, n, sum(n) OVER (PARTITION BY channel) AS total FROM h)
SELECT channel, CAST(max(total) AS BIGINT) AS pairs, round(-sum(n / total * log2(n / total)), 6) AS entropy FROM t GROUP BY 1"""


@query(
    "a13_phase_entropy",
    f"""{_PHASES}, d AS (SELECT b.channel, b.phase - a.phase AS d FROM q a JOIN q b ON a.channel = b.channel AND a.bin = b.bin AND b.i = a.i + 1 WHERE a.active AND b.active AND a.loud AND b.loud), {_PHASE_ENTROPY}""",
)
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.phase_entropy(spectra(spark, sf_dir), 20)


@query("w18_legacy_phase", f"""{_PHASES}, d AS (SELECT channel, phase - lag(phase) OVER (PARTITION BY channel, bin ORDER BY i) AS d FROM q WHERE active), {_PHASE_ENTROPY}""")
def w18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase differences of active frames across gaps, without floors."""
    return P.legacy_phase_entropy(spectra(spark, sf_dir), 20)


_MIRROR = P.mirrored_bins((64, 88, 96), RATE, RATE, BINS, guard=2, reach=12, least=4)


@query(
    "j07_mirrored_bins",
    f"""{_ACT}, k(source_rate, lo, hi, f) AS (VALUES {", ".join(f"({s}, {lo}, {hi}, {f!r}e0)" for s, lo, hi, f in _MIRROR)}),
z AS (SELECT channel, frame_no, list(m ORDER BY bin) AS m FROM act GROUP BY 1, 2),
g AS (SELECT channel, frame_no, source_rate, ln(m[lo + 1] + 1e-12) AS x, ln(m[hi + 1] * (1 - f) + m[hi + 2] * f + 1e-12) AS y FROM z, k),
r AS (SELECT channel, frame_no, source_rate, count(*) AS pairs, covar_pop(x, y) / (sqrt(var_pop(x) * var_pop(y)) + 1e-12) AS c FROM g GROUP BY 1, 2, 3)
SELECT channel, CAST(source_rate AS BIGINT) AS source_rate, max(pairs) AS pairs, count(*) AS frames, round(avg(c), 6) AS correlation FROM r GROUP BY 1, 2""",
)
def j07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.mirror_correlation(spectra(spark, sf_dir), _MIRROR)


@query(
    "a14_rate_hypotheses",
    f"""{_SPEC}, h AS (SELECT unnest([64, 88, 96, 112]) AS source_rate), r AS (SELECT channel, bin, db, source_rate, source_rate / 2 AS l FROM spec, h WHERE source_rate / 2 + 4 <= 62),
g AS (SELECT channel, source_rate, avg(db) FILTER (WHERE bin >= l - 6 AND bin < l - 2) AS edge, avg(db) FILTER (WHERE bin >= l - 1 AND bin < l + 2) AS notch,
             avg(db) FILTER (WHERE bin >= l + 3 AND bin < l + 8) AS above, avg(db) FILTER (WHERE bin >= l + 3 AND bin < 62) AS ceiling FROM r GROUP BY 1, 2)
SELECT channel, CAST(source_rate AS BIGINT) AS source_rate, round(edge, 6) AS edge, round(notch, 6) AS notch, round(above, 6) AS above, round(ceiling, 6) AS ceiling,
       CASE WHEN edge - notch >= 2 AND above - notch >= 2 THEN 'notch' WHEN ceiling < edge - 4 AND ceiling < -9 THEN 'wall' ELSE 'none' END AS mode FROM g""",
)
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.rate_hypotheses(spectra(spark, sf_dir), (64, 88, 96, 112), RATE)


@query(
    "a15_rolloff",
    f"""{_SPEC} SELECT channel, round(avg(db) FILTER (WHERE bin BETWEEN 10 AND 14), 6) AS low_db, round(avg(db) FILTER (WHERE bin BETWEEN 50 AND 54), 6) AS high_db,
       round((avg(db) FILTER (WHERE bin BETWEEN 50 AND 54) - avg(db) FILTER (WHERE bin BETWEEN 10 AND 14)) / 40, 6) AS slope FROM spec GROUP BY 1""",
)
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.rolloff(spectra(spark, sf_dir), (10, 14), (50, 54))


@query(
    "a16_envelope_correlation",
    f"""{_ACT}, f AS (SELECT channel, frame_no, sqrt(coalesce(sum(m * m) FILTER (WHERE bin BETWEEN 4 AND 20), 0)) AS a, sqrt(coalesce(sum(m * m) FILTER (WHERE bin BETWEEN 40 AND 60), 0)) AS b FROM act GROUP BY 1, 2),
g AS (SELECT channel, count(*) AS frames, covar_pop(a, b) AS cov, stddev_pop(a) AS sa, stddev_pop(b) AS sb, avg(a) AS ma, avg(b) AS mb FROM f GROUP BY 1)
SELECT channel, frames, round(CASE WHEN frames >= 10 AND sa > 1e-8 AND sb > 1e-8 AND sa > 1e-3 * ma AND sb > 1e-3 * mb THEN cov / (sa * sb) END, 6) AS correlation FROM g""",
)
def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.envelope_correlation(spectra(spark, sf_dir), (4, 20), (40, 60), 10)


@query(
    "a17_sparsity",
    f"""{_ACT}, g AS (SELECT channel, count(DISTINCT frame_no) AS frames, count(*) AS cells, count(*) FILTER (WHERE {_DB.format(m="m", p="peak")} < -30) AS holes FROM act WHERE bin >= 1 AND bin < 50 GROUP BY 1)
SELECT channel, frames, holes, round(CASE WHEN frames >= 4 THEN holes / cells END, 6) AS sparsity FROM g""",
)
def a17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sparsity(spectra(spark, sf_dir), 50, -30.0)


_LAGS = (7, 8, 9, 15, 16, 17, 23, 24, 25)
_LAG_CTE = f"""c AS (SELECT channel, bin, db - avg(db) OVER (PARTITION BY channel) AS c FROM spec WHERE bin BETWEEN 0 AND 63),
n AS (SELECT channel, sum(c * c) AS norm, stddev_pop(c) AS std FROM c GROUP BY 1),
k AS (SELECT unnest({list(_LAGS)}) AS lag),
lags AS (SELECT a.channel, lag, count(*) AS pairs, CASE WHEN any_value(std) > 0.1 AND count(*) >= 8 THEN sum(a.c * b.c) / any_value(norm) END AS correlation
  FROM c a, k JOIN c b ON b.channel = a.channel AND b.bin = a.bin + lag JOIN n ON n.channel = a.channel GROUP BY 1, 2)"""


@query("a18_spectral_lags", f"{_SPEC}, {_LAG_CTE} SELECT channel, CAST(lag AS BIGINT) AS lag, pairs, round(correlation, 6) AS correlation FROM lags")
def a18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.spectral_lags(spectra(spark, sf_dir), 0, BINS - 1, _LAGS)


@query(
    "a24_comb_peaks",
    f"""{_SPEC}, {_LAG_CTE}, p AS (
  SELECT a.channel, a.lag, max(a.correlation) AS c, max(abs(b.correlation)) AS beside FROM lags a JOIN lags b ON a.channel = b.channel AND abs(a.lag - b.lag) = 1 WHERE a.lag IN (8, 16, 24) GROUP BY 1, 2)
SELECT channel, count(*) FILTER (WHERE c > 0.05e0 AND c > 1.2e0 * beside) AS peaks, count(*) FILTER (WHERE c > 0.05e0 AND c > 1.2e0 * beside) >= 2 AS comb FROM p GROUP BY 1""",
)
def a24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.comb_peaks(P.spectral_lags(spectra(spark, sf_dir), 0, BINS - 1, _LAGS), (8, 16, 24), 0.05, 1.2)


@query(
    "a21_banding",
    f"""{_ACT}, s AS (SELECT channel, bin, stddev_pop({_DB.format(m="m", p="peak")}) AS s FROM act WHERE bin BETWEEN 40 AND 55 GROUP BY 1, 2)
SELECT channel, round(least(greatest(1 - avg(s) / 15, 0), 1), 6) AS banding FROM s GROUP BY 1""",
)
def a21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.banding(spectra(spark, sf_dir), 40, 55)


@query(
    "a22_side_ratio",
    f"""WITH {SPECTRA_SQL}, g AS (SELECT sum(m) FILTER (WHERE channel = 0) AS mid, sum(m) FILTER (WHERE channel = 1) AS side FROM spectra WHERE bin >= 30 AND frame_no % 4 = 0)
SELECT round(mid, 6) AS mid, round(side, 6) AS side, round(CASE WHEN mid > 0 THEN side / mid END, 6) AS ratio,
       CASE WHEN side / mid < 0.02e0 THEN 1e0 WHEN side / mid < 0.08e0 THEN 0.6e0 WHEN side / mid IS NOT NULL THEN 0e0 END AS anomaly FROM g""",
)
def a22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.side_ratio(spectra(spark, sf_dir), 0, 1, 30, 4)


@query(
    "a23_top_band",
    f"""{_SPEC}, g AS (SELECT channel, coalesce(sum(avg) FILTER (WHERE bin >= 57), 0) / sum(avg) AS top_share, avg(avg) FILTER (WHERE bin BETWEEN 48 AND 63) / avg(avg) FILTER (WHERE bin BETWEEN 16 AND 32) AS ultra_ratio FROM spec GROUP BY 1)
SELECT channel, round(top_share, 6) AS top_share, round(ultra_ratio, 6) AS ultra_ratio, top_share < 5e-5 AS low_passed FROM g""",
)
def a23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.top_band(spectra(spark, sf_dir), BINS)


@query(
    "a35_time_coarsened",
    f"""WITH {SPECTRA_SQL}, c AS (SELECT channel, max(frame_no) + 1 AS n FROM spectra GROUP BY 1),
w AS (SELECT s.channel, CAST(floor(frame_no / pow(2, ceil(log2(greatest(n / 16, 1))))) AS BIGINT) AS "column", bin, avg(m * m) AS p FROM spectra s JOIN c USING (channel) GROUP BY 1, 2, 3)
SELECT channel, "column", bin, round(greatest(CASE WHEN p > 0 THEN 10 * log10(p) ELSE -140 END, -140), 6) AS power_db FROM w""",
)
def a35(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.time_coarsened(spectra(spark, sf_dir), 16)


@query(
    "k01_dft",
    f"""WITH s AS (SELECT k AS key, i, sin(2 * pi() * i * (3 * k + 2) / 64) + 0.5e0 * cos(2 * pi() * i * (5 * k + 1) / 64) AS x FROM (SELECT unnest(range(4)) AS k), (SELECT unnest(range(64)) AS i)),
b AS (SELECT unnest(range(33)) AS bin),
d AS (SELECT key, bin, sum(x * cos(bin * i % 64 * {2 * math.pi / 64!r}e0)) AS re, sum(x * sin(bin * i % 64 * {2 * math.pi / 64!r}e0)) AS im FROM s, b GROUP BY 1, 2)
SELECT key, bin, round(sqrt(re * re + im * im), 6) AS magnitude FROM d""",
)
def k01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short transforms of generated tones, as sums of products."""
    i = spark.range(64).select(F.col("id").alias("i"))
    keys = F.explode(F.array(*[F.lit(k).cast("long") for k in range(4)])).alias("key")
    tone = lambda f: 2 * F.pi() * F.col("i") * f / 64
    signal = i.select("i", keys).withColumn("x", F.sin(tone(3 * F.col("key") + 2)) + 0.5 * F.cos(tone(5 * F.col("key") + 1)))
    return P.dft(signal, 64)
