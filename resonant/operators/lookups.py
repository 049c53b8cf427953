"""Lookups: values against a tolerance table, the nearest entry, and lower-rate hypotheses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Codec, profile, band limit and tolerance in Hz.
WALLS = (
    ("MP3 (LAME)", "320 kbps", 20220.0, 150.0),
    ("MP3 (LAME)", "320 kbps @48k", 20510.0, 150.0),
    ("MP3 (LAME)", "256 kbps", 19530.0, 150.0),
    ("MP3 (LAME)", "256 kbps @48k", 19760.0, 150.0),
    ("MP3 (LAME)", "192 kbps", 18840.0, 150.0),
    ("MP3 (LAME)", "192 kbps @48k", 19010.0, 150.0),
    ("MP3 (LAME)", "160 kbps", 17460.0, 150.0),
    ("MP3 (LAME)", "128 kbps", 16770.0, 150.0),
    ("MP3 (LAME)", "96 kbps", 15410.0, 150.0),
    ("MP3 (LAME)", "64 kbps", 11270.0, 250.0),
    ("AAC", "~192 kbps", 19350.0, 150.0),
    ("AAC", "~192 kbps @48k", 19560.0, 150.0),
    ("AAC", "~128 kbps", 17280.0, 150.0),
    ("AAC", "~96 kbps", 15860.0, 180.0),
    ("Vorbis", "q4 (~128 kbps)", 19000.0, 150.0),
    ("Vorbis", "q4 @48k", 19180.0, 150.0),
    ("Vorbis", "q2 (~96 kbps)", 16575.0, 150.0),
    ("Opus", "CELT 20 kHz band limit (any bitrate)", 20460.0, 260.0),
)


def walls(spark: SparkSession) -> DataFrame:
    """The table of band limits with its order; 18 rows, so joins with it broadcast it."""
    return spark.createDataFrame([(i, *w) for i, w in enumerate(WALLS)], "pos int, codec string, profile string, wall double, tolerance double")


def within_tolerance(values: DataFrame, key: str, value: str, limit: float) -> DataFrame:
    """All entries whose distance is within their own tolerance, nearest first; values from the limit on have none."""
    w = F.broadcast(walls(values.sparkSession))
    near = values.where(F.col(value) < limit).join(w, F.abs(F.col(value) - w["wall"]) <= w["tolerance"]).withColumn("distance", F.abs(F.col(value) - F.col("wall")))
    order = Window.partitionBy(key).orderBy("distance", "pos")
    return near.select(key, "codec", "profile", "wall", "distance", F.row_number().over(order).alias("rank"))


def nearest(values: DataFrame, key: str, value: str, limit: float) -> DataFrame:
    """The nearest entry within tolerance; of equally near ones the first in the table."""
    return within_tolerance(values, key, value, limit).where("rank = 1").drop("rank")


def lower_rates(values: DataFrame, rate: str, sources: tuple[int, ...] = (44100, 48000, 88200, 96000)) -> DataFrame:
    """Lower rates whose band, with a margin, fits under that of the rate."""
    return values.withColumn("source_rate", F.explode(F.array(*[F.lit(s).cast("long") for s in sources]))).where(F.col("source_rate") / 2 + 1200 <= F.col(rate) / 2 - 200)
