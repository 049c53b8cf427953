"""Probes: spans laid evenly over a series, the samples inside them, and histograms of what they show."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def plan(lengths: DataFrame, frames: str, rate: int, span: int, least: int = 9, most: int = 36, per: int = 15) -> DataFrame:
    """start and end of each probe of a series: as many as fit a rule, evenly from its start to its end.

    Their number is the frames over per * rate, held between least and most, and no more than fit side by side."""
    n = F.col(frames)
    count = F.least(F.least(F.greatest(F.floor(n / (per * rate)), F.lit(least)), F.lit(most)), F.floor(n / span))
    spread = lengths.withColumn("count", count).where("count >= 1").withColumn("i", F.explode(F.sequence(F.lit(0), (F.col("count") - 1).cast("int"))))
    start = F.when(F.col("count") == 1, 0).otherwise(F.floor((n - span) * F.col("i") / F.greatest(F.col("count") - 1, F.lit(1)))).cast("long")
    return spread.select("part", F.col("i").cast("long").alias("probe"), start.alias("start"), (start + span).alias("end"))


def inside(series: DataFrame, probes: DataFrame, span: int) -> DataFrame:
    """Samples of each probe. Spans are cut into cells of their own length, so the range join is an equi-join on part and
    cell with at most two cells a probe, whatever the length of the series."""
    cells = probes.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / span), F.floor((F.col("end") - 1) / span))))
    keyed = series.withColumn("cell", F.floor(F.col("frame") / span))
    return keyed.join(cells, ["part", "cell"]).where((F.col("frame") >= F.col("start")) & (F.col("frame") < F.col("end"))).drop("cell")


def histogram_mode(values: DataFrame, key: str, value: str, cells: int = 20) -> DataFrame:
    """Mean, and the middle of the fullest of equal cells between the smallest and the largest value; of equally full ones the lowest."""
    by = Window.partitionBy(key)
    v = values.select(key, F.col(value).cast("double").alias("v")).withColumns({"lo": F.min("v").over(by), "hi": F.max("v").over(by)})
    flat = F.col("lo") == F.col("hi")
    v = v.withColumns({"lo": F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")), "hi": F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi"))})
    cell = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * cells), F.lit(cells - 1))
    counts = v.groupBy(key, "lo", "hi", cell.alias("cell")).agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    best = counts.groupBy(key, "lo", "hi").agg(F.max_by("cell", F.struct("n", -F.col("cell"))).alias("cell"), (F.sum("s") / F.sum("n")).alias("average"), F.sum("n").alias("n"))
    return best.select(key, "n", "average", (F.col("lo") + (F.col("cell") + 0.5) * (F.col("hi") - F.col("lo")) / cells).alias("mode"))
