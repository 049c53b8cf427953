"""Saved reports round trip, strictness, ticks and number texts."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resonant.functions import drawing
from resonant.plans.catalogue import ORACLE_SQL, QUERIES
from resonant.sources import reports

SHAPE = T.StructType([T.StructField("b", T.LongType()), T.StructField("a", T.StringType())])


def test_round_trip_and_strictness(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x"), (None, 'q"uote'), (3, None)], SHAPE)
    reports.write(rows, f"{tmp_path}/r")
    assert sorted(map(tuple, reports.read(spark, f"{tmp_path}/r", SHAPE).collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
    with pytest.raises(ValueError):
        reports.read(spark, f"{tmp_path}/r", SHAPE, version="2")
    with pytest.raises(ValueError):
        reports.read(spark, f"{tmp_path}/r", T.StructType(SHAPE.fields[:1]))
    text = spark.createDataFrame([("[1]",), ("no",), ('{"version":"1","a":"x"}',), ('{"version":"1","a":"x","b":1}',)], "value string")
    assert [r.problem for r in reports.violations(text, "value", SHAPE).collect()] == ["not an object", "not an object", "missing field"]


def test_ticks_and_digits():
    assert drawing.ticks(60) == [0.0, 10.0, 20.0, 30.0, 40.0, 50.0, 60]
    assert drawing.ticks(22050)[:3] == [0.0, 5000.0, 10000.0] and drawing.ticks(22050)[-1] == 22050
    assert drawing.round_step(0.03) == pytest.approx(0.05)
    assert drawing.six_digits(1234567.0) == "1.23457e+06" and drawing.six_digits(0.5) == "0.5"


def test_six_digit_column_is_that_of_each_number(spark):
    """Signed zeros, halves below and above their decimal form, carries, and what is no number."""
    values = [0.0, -0.0, 1.000005, 1.000015, 2.000005, 0.5000005, 12345.65, 123456.5, 1234565.0, 999999.5, -999999.5, 9.9999995e-5, 1e-4, 5e-324, 1.7976931348623157e308, math.inf, -math.inf, math.nan, None]
    rows = spark.createDataFrame(list(enumerate(values)), "i long, v double").select("i", drawing.six_digit_text(F.col("v")).alias("text")).orderBy("i").collect()
    assert [r.text for r in rows] == [None if v is None else "%g" % v for v in values]


def test_six_digits_of_odd_events_match_sql(spark, tmp_path):
    """Zeros of both signs, infinities, no numbers, halves at the seventh digit and negative ids."""
    odd = [0.0, -0.0, math.inf, math.nan, None, 12345.65, 1.000005, 5e-324, 1e308]
    rows = [(i * (-1) ** (i % 2), odd[i % 9]) for i in range(500)]
    spark.createDataFrame(rows, "event_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = QUERIES["f08_six_digits"](spark, str(tmp_path)).orderBy("event_id").collect()
    assert [tuple(r) for r in got] == sorted(db.execute(ORACLE_SQL["f08_six_digits"]).fetchall())
