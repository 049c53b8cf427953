"""Queries that make report texts, records and colours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resonant.functions import drawing
from resonant.operators import spectral as P
from resonant.operators import windows as W
from resonant.plans.registry import query
from resonant.plans.series_queries import _RUNS_SQL, LEAST_RUN, QUIET, S
from resonant.sources import reports
from resonant.sources.bindings import SPECTRA_SQL, series, spectra, table


@query(
    "s12_report_records",
    """SELECT '{"version":"1","n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || CASE WHEN n_nationkey % 5 = 0 THEN 'null' ELSE CAST(n_regionkey AS VARCHAR) END || '}' AS json FROM nation""",
)
def s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").withColumn("n_regionkey", F.when(F.col("n_nationkey") % 5 != 0, F.col("n_regionkey")))
    return reports.as_json(n)


@query(
    "s14_text_rows",
    f"""{S}, {_RUNS_SQL}, t AS (SELECT part, max(frame) + 1 AS n FROM series GROUP BY part)
SELECT part, start, '| ' || printf('%02d:%02d → %02d:%02d (%.1fs)', start // 60, start % 60, "end" // 60, "end" % 60, CAST(length AS DOUBLE)) || CASE WHEN "end" = n THEN ' → EOF' ELSE '' END || ' | ' || CASE WHEN length > 3 THEN CAST(length AS VARCHAR) ELSE '-' END || ' |' AS line
FROM runs JOIN t USING (part)""",
)
def s14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quiet sections as lines of a text table."""
    s = series(spark, sf_dir)
    total = s.groupBy("part").agg((F.max("frame") + 1).alias("n"))
    r = W.runs(s, F.abs("x") < QUIET, LEAST_RUN).join(total, "part")
    text = drawing.section_text(F.col("start"), F.col("end"), F.col("end") == F.col("n"))
    return r.select("part", "start", reports.table_line(text, F.when(F.col("length") > 3, F.col("length").cast("string"))).alias("line"))


_MIX = "CAST(round({a}[CAST(c AS INTEGER) + 1] * (1 - (p - c)) + {a}[CAST(c AS INTEGER) + 2] * (p - c)) AS INTEGER)"


@query(
    "f10_colours",
    f"""WITH {SPECTRA_SQL}, n AS (SELECT channel, max(frame_no) + 1 AS n FROM spectra GROUP BY 1),
w AS (SELECT s.channel, CAST(floor(frame_no / pow(2, ceil(log2(greatest(n / 8, 1))))) AS BIGINT) AS "column", bin, avg(m * m) AS q FROM spectra s JOIN n USING (channel) GROUP BY 1, 2, 3),
d AS (SELECT channel, "column", bin, least(greatest((round(10 * log10(q), 3) + 140) / 140, 0), 1) * 4 AS p FROM w WHERE q > 0), e AS (SELECT *, least(floor(p), 3) AS c FROM d)
SELECT channel, "column", bin, {", ".join(f"{_MIX.format(a=[float(x[k]) for x in drawing.ANCHORS])} AS {n}" for k, n in enumerate("rgb"))} FROM e""",
)
def f10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coarsened spectrogram as colours."""
    cells = P.time_coarsened(spectra(spark, sf_dir), 8)
    return cells.select("channel", "column", "bin", drawing.colour(F.round("power_db", 3)).alias("c")).select("channel", "column", "bin", "c.*")


@query("s13_violations", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'version' WHEN event_id % 7 = 0 THEN 'unknown field' ELSE 'missing field' END AS problem FROM events WHERE event_id % 5 = 0 OR event_id % 7 = 0 OR event_id % 11 = 0""")
def s13_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved records of another version, with unknown fields or without known ones."""
    from pyspark.sql import types as T

    i = F.col("event_id")
    json = F.concat(F.lit('{"version":"'), F.when(i % 5 == 0, "2").otherwise("1"), F.lit('","event_id":'), i.cast("string"), F.when(i % 7 == 0, ',"extra":1').otherwise(""), F.when(i % 11 == 0, "").otherwise(',"k":2'), F.lit("}"))
    shape = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("k", T.LongType())])
    bad = reports.violations(table(spark, sf_dir, "events").select(json.alias("json")), "json", shape)
    return bad.select(F.get_json_object("json", "$.event_id").cast("long").alias("event_id"), "problem")


@query("f08_six_digits", "SELECT event_id, printf('%g', v) AS text FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value * pow(10, event_id % 17 - 8) WHEN event_id % 50 = 1 THEN 0e0 ELSE -value END AS v FROM events)")
def f08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with six significant digits."""
    i = F.col("event_id")
    # pow() of the JVM is a unit off the nearest number for some powers of ten; negative ids have negative remainders
    powers = F.array(*[F.lit(float(f"1e{k}")) for k in range(-24, 9)])
    v = F.when(i % 3 == 0, F.col("value") * F.element_at(powers, (i % 17 + 17).cast("int"))).when(i % 50 == 1, 0.0).otherwise(-F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", drawing.six_digit_text(v).alias("text"))


@query(
    "f09_ticks",
    """WITH t AS (SELECT o_orderkey AS key, o_totalprice AS most, pow(10, floor(log10(o_totalprice / 6))) AS scale FROM orders WHERE o_totalprice > 0),
s AS (SELECT key, most, CASE WHEN most / 6 <= scale THEN scale WHEN most / 6 <= 2 * scale THEN 2 * scale WHEN most / 6 <= 5 * scale THEN 5 * scale ELSE 10 * scale END AS step FROM t)
SELECT key, array_to_string(list_transform(list_concat([0e0], list_filter(list_transform(range(1, 8), lambda i: i * step), lambda v: v < most AND most - v >= 0.3e0 * step), [most]), lambda v: printf('%.2f', v)), ' ') AS ticks FROM s""",
)
def f09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axis ticks of each order's total."""
    o = table(spark, sf_dir, "orders").where("o_totalprice > 0")
    return o.select(F.col("o_orderkey").alias("key"), F.array_join(F.transform(drawing.tick_list(F.col("o_totalprice")), lambda v: F.format_string("%.2f", v)), " ").alias("ticks"))


@query(
    "s14_batch_lines",
    """SELECT c_custkey AS track, '"' || c_name || '" | ' || c_mktsegment || ' | ' || CASE WHEN c_custkey % 7 = 0 THEN 'None' ELSE 'Some(' || c_nationkey || ')' END || ' | ' || CASE WHEN c_acctbal < 0 THEN 'None' ELSE 'Some(DR' || c_custkey % 20 || ')' END || ' | None | complete' AS line FROM customer""",
)
def s14_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch layout's lines."""
    k = F.col("c_custkey")
    line = reports.batch_line(F.col("c_name"), F.col("c_mktsegment"), F.when(k % 7 != 0, F.col("c_nationkey")), F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("DR"), (k % 20).cast("string"))), F.lit(None).cast("double"), F.lit("complete"))
    return table(spark, sf_dir, "customer").select(k.alias("track"), line.alias("line"))


@query(
    "s14_product_text",
    """SELECT n_nationkey AS track, '"' || n_name || '": analyzed' || chr(10) || 'Reference method (uncalibrated): none' || chr(10) || 'Scores are not probabilities or proof of authenticity, source or sound quality.' || chr(10)
  || 'Native ancestry: INCONCLUSIVE; evidence index: unavailable.' || chr(10) || 'Reference scores:' || chr(10) || '{"main":' || n_regionkey || '}' || chr(10) || 'Product diagnostics:' || chr(10) || '["' || n_name || '"]' AS text FROM nation""",
)
def s14_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product layout's text."""
    sections = {"Reference scores": F.struct(F.col("n_regionkey").alias("main")), "Product diagnostics": F.array("n_name")}
    text = reports.product_text(F.col("n_name"), F.lit("analyzed"), F.lit("none"), sections)
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("track"), text.alias("text"))
