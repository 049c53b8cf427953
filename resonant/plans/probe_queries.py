"""Queries over probes of series and their histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resonant.operators import probes as O
from resonant.operators import spectral as P
from resonant.plans.registry import query
from resonant.plans.spectral_queries import _ACT, _CUT
from resonant.sources.bindings import SERIES_SQL, series, spectra

_PLAN_SQL = f"""WITH {SERIES_SQL}, l AS (SELECT part, max(frame) + 1 AS n FROM series GROUP BY part),
c AS (SELECT part, n, least(least(greatest(n // 15, 9), 36), n // 6) AS k FROM l),
p AS (SELECT part, i AS probe, CASE WHEN k = 1 THEN 0 ELSE (n - 6) * i // (k - 1) END AS start FROM (SELECT part, n, k, unnest(range(k)) AS i FROM c WHERE k >= 1))"""


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = series(spark, sf_dir).groupBy("part").agg((F.max("frame") + 1).alias("n"))
    return O.plan(lengths, "n", rate=1, span=6)


@query("x01_probe_plan", f'{_PLAN_SQL} SELECT part, probe, start, start + 6 AS "end" FROM p')
def x01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)


@query(
    "j04_probe_samples",
    f"""{_PLAN_SQL} SELECT p.part, probe, count(*) AS samples, round(sqrt(avg(x * x)), 6) AS rms, round(max(abs(x)), 6) AS peak FROM p JOIN series s ON s.part = p.part AND s.frame >= p.start AND s.frame < p.start + 6 GROUP BY 1, 2""",
)
def j04(spark: SparkSession, sf_dir: str) -> DataFrame:
    caught = O.inside(series(spark, sf_dir), _plan(spark, sf_dir), 6)
    return caught.groupBy("part", "probe").agg(F.count("*").alias("samples"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.max(F.abs("x")).alias("peak"))


@query(
    "a20_histogram_mode",
    f"""{_ACT}, {_CUT}, i AS (SELECT channel, cutoff, row_number() OVER (PARTITION BY channel ORDER BY frame_no) - 1 AS i, count(*) OVER (PARTITION BY channel) AS k FROM cut),
s AS (SELECT channel, cutoff FROM i WHERE i % CASE WHEN k > 2500 THEN k // 2500 + 1 ELSE 1 END = 0),
b AS (SELECT channel, cutoff, CASE WHEN min(cutoff) OVER w = max(cutoff) OVER w THEN min(cutoff) OVER w - 0.5e0 ELSE min(cutoff) OVER w END AS lo, CASE WHEN min(cutoff) OVER w = max(cutoff) OVER w THEN max(cutoff) OVER w + 0.5e0 ELSE max(cutoff) OVER w END AS hi FROM s WINDOW w AS (PARTITION BY channel)),
h AS (SELECT channel, lo, hi, least(floor((cutoff - lo) / (hi - lo) * 20), 19) AS cell, count(*) AS n, sum(cutoff) AS t FROM b GROUP BY 1, 2, 3, 4),
m AS (SELECT channel, CAST(sum(n) OVER (PARTITION BY channel) AS BIGINT) AS n, sum(t) OVER (PARTITION BY channel) / sum(n) OVER (PARTITION BY channel) AS average, lo + (cell + 0.5e0) * (hi - lo) / 20 AS mode, row_number() OVER (PARTITION BY channel ORDER BY n DESC, cell) AS rn FROM h)
SELECT channel, n, round(average, 6) AS average, round(mode, 6) AS mode FROM m WHERE rn = 1""",
)
def a20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cutoffs of all active frames (strided only beyond 2,500 a channel): mean and mode over twenty cells."""
    return O.histogram_mode(P.strided_cutoffs(spectra(spark, sf_dir), -20.0), "channel", "cutoff")
