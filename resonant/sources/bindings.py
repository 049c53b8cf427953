"""Ordered series, spectra and cases from the driver's tables: stand-ins for sampled signals, so that SQL can check results.

A series has columns part, frame (0-based, without gaps), x and y (two channels) and hit (a marked event). Spectra
have channel, frame_no, bin and m (a magnitude); the stand-in rate makes a bin 1 Hz wide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bins of a stand-in spectrum, and the rate at which they are 1 Hz wide.
BINS = 64
RATE = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("part"),
        (F.row_number().over(order) - 1).cast("long").alias("frame"),
        ((F.col("value") - 100.0) / 300.0).alias("x"),
        (F.get_json_object("props", "$.k").cast("double") / 100.0 - 0.5).alias("y"),
        (F.col("event_type") == "error").alias("hit"),
    )


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("channel"), F.col("vec_id").alias("frame_no"), F.posexplode("embedding").alias("bin", "v"))
    return rows.select("channel", "frame_no", F.col("bin").cast("long").alias("bin"), F.abs(F.col("v").cast("double")).alias("m"), F.col("v").cast("double").alias("v"))


SERIES_SQL = """
series AS (
  SELECT user_id AS part, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame,
         (value - 100e0) / 300e0 AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100e0 - 0.5e0 AS y, event_type = 'error' AS hit
  FROM events)"""

SPECTRA_SQL = """
spectra AS (
  SELECT CAST(label AS BIGINT) AS channel, vec_id AS frame_no, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS bin,
         abs(CAST(unnest(embedding) AS DOUBLE)) AS m, CAST(unnest(embedding) AS DOUBLE) AS v
  FROM embeddings)"""
