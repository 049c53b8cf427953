"""Saved reports: versioned JSON records, strict reading, violations instead of guesses, text tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = "1"


def as_json(rows: DataFrame, version: str = VERSION) -> DataFrame:
    """One JSON text a row, with the version and the columns in name order; nulls stay visible."""
    fields = [F.lit(version).alias("version"), *(F.col(c) for c in sorted(rows.columns))]
    return rows.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def write(rows: DataFrame, path: str, version: str = VERSION) -> None:
    as_json(rows, version).write.text(path)


def read(spark: SparkSession, path: str, schema: T.StructType, version: str = VERSION) -> DataFrame:
    """Records of exactly this version and these fields; others raise."""
    text = spark.read.text(path)
    bad = violations(text, "value", schema, version).count()
    if bad:
        raise ValueError(f"{bad} records of another version or with other fields")
    full = T.StructType([T.StructField("version", T.StringType()), *sorted(schema.fields, key=lambda f: f.name)])
    return text.select(F.from_json("value", full, {"mode": "FAILFAST"}).alias("r")).select(*[F.col(f"r.{f.name}") for f in schema.fields])


def violations(text: DataFrame, column: str, schema: T.StructType, version: str = VERSION) -> DataFrame:
    """(problem, json) of the records that can't be read: no object, another version, unknown or missing fields."""
    keys = F.json_object_keys(column)
    want = F.array(*[F.lit(k) for k in sorted([*schema.names, "version"])])
    problem = (
        F.when(keys.isNull(), "not an object").when(~F.get_json_object(column, "$.version").eqNullSafe(F.lit(version)), "version")
        .when(F.size(F.array_except(keys, want)) > 0, "unknown field").when(F.size(F.array_except(want, keys)) > 0, "missing field")
    )
    return text.select(problem.alias("problem"), F.col(column).alias("json")).where("problem is not null")


def table_line(*cells: Column) -> Column:
    """A row of a text table; unknown cells are dashes."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c, F.lit("-")) for c in cells]), F.lit(" |"))


# What the layouts begin with.
BATCH_HEAD = ("Batch summary — uncalibrated reference method", "Track | Status | Main | DR (legacy first channel) | Native LUFS | Reference status")
PRODUCT_NOTES = ("Scores are not probabilities or proof of authenticity, source or sound quality.", "Native ancestry: INCONCLUSIVE; evidence index: unavailable.")


def batch_line(source: Column, status: Column, main: Column, dr: Column, lufs: Column, reference: Column) -> Column:
    """A track's line of the batch layout; the source is quoted as JSON, unknown values read None."""
    known = lambda c: F.coalesce(F.concat(F.lit("Some("), c, F.lit(")")), F.lit("None"))
    quoted = F.regexp_extract(F.to_json(F.struct(source.alias("s"))), r'(?s)^\{"s":(.*)\}$', 1)
    return F.concat_ws(" | ", quoted, status, known(main.cast("string")), known(dr), known(lufs.cast("string")), reference)


def batch_text(lines: DataFrame, order: str, line: str = "line") -> DataFrame:
    """The whole layout as one row: for as many tracks as one report has, a fixed bound of the format."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda x: x[line]), "\n")
    return lines.agg(F.concat(F.lit("\n".join(BATCH_HEAD) + "\n"), body).alias("text"))


def product_text(source: Column, status: Column, summary: Column, sections: dict[str, Column]) -> Column:
    """The product layout: title, notes, then each section's name and its value as JSON."""
    title = F.concat(F.regexp_extract(F.to_json(F.struct(source.alias("s"))), r'(?s)^\{"s":(.*)\}$', 1), F.lit(": "), status)
    parts = [F.concat(F.lit(f"{name}:\n"), F.coalesce(F.to_json(value), F.lit("null"))) for name, value in sections.items()]
    return F.concat_ws("\n", title, F.concat(F.lit("Reference method (uncalibrated): "), summary), *[F.lit(n) for n in PRODUCT_NOTES], *parts)
