"""Line deduplication by site-relative frequency.

Documents are grouped by host (the source column of documents). A line's ratio is the number of the host's pages that
contain it, divided by the number of the host's pages; lines whose ratio is above boilerplate_ratio are dropped from
all pages of that host. Rows of one host with the very same text are one page here: counted as many, a document with
many copies would pass for boilerplate and lose all of its text, where telling copies apart is a near-duplicate
operator's work. Frequencies come from all rows: the (host, line, page) triples are 64-bit hashes, made distinct by all
three and then counted by (host, line) after pre-aggregation, so a host with a third of all rows, and a line on all of
its pages, spread over all tasks, and no text is shuffled for counting; what has equal hashes counts as equal.

The lines above the ratio are few by arithmetic (at most lines per page / ratio for each host). Their hashes are written
once and joined back per host: by broadcast if their measured number is small; else by a shuffle join in which the hosts
with a thousandth of all rows or more (so at most a thousand) are split into salted parts.

Defined cases: lines are cut at \\n and compared after removing blanks at both ends; empty lines are never dropped; a
null text stays null with 0 lines; a null host is a host of its own; a line must be on at least min_pages pages of the
host, so that hosts of a few pages lose nothing by chance; extra columns pass through apply_to(), whatever their names;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resonant.llm.common import free_name, lookup, materialize

BOILERPLATE_RATIO = 0.02
MIN_PAGES = 3
#: Boilerplate lines up to this many are broadcast (8 bytes each); above it the join shuffles.
BROADCAST_LINES = 500_000


def _key(line: Column) -> Column:
    """The hash of a line without blanks at its ends; null for an empty one."""
    bare = F.trim(line)
    return F.when(bare != "", F.xxhash64(bare))


def boilerplate(docs: DataFrame, text: str = "text", host: str = "source", ratio: float = BOILERPLATE_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, h (the line's hash), pages, host_pages of every line above the ratio."""
    pages = docs.select(F.col(host).alias("host"), F.col(text).alias("text")).withColumn("page", F.xxhash64("text"))
    totals = pages.groupBy("host").agg(F.countDistinct("page").alias("host_pages"))
    lines = pages.select("host", "page", F.explode(F.array_distinct(F.transform(F.split("text", "\n", -1), _key))).alias("h")).where("h is not null")
    counts = lines.groupBy("host", "h").agg(F.countDistinct("page").alias("pages"))
    return (
        counts.where(F.col("pages") >= min_pages)
        .join(totals.withColumnRenamed("host", "h2"), F.col("host").eqNullSafe(F.col("h2")))
        .where(F.col("pages") > ratio * F.col("host_pages"))
        .select("host", "h", "pages", "host_pages")
    )


def apply_to(
    docs: DataFrame, text: str = "text", host: str = "source", ratio: float = BOILERPLATE_RATIO, min_pages: int = MIN_PAGES, counts: bool = True, broadcast_lines: int = BROADCAST_LINES
) -> DataFrame:
    """All columns of docs with the text cleaned, plus n_lines and n_dropped where counts are wanted."""
    lines = materialize(boilerplate(docs, text, host, ratio, min_pages))
    own, split, drop = (free_name(docs, x) for x in ("own_lines", "split_lines", "drop_lines"))
    few = lines.limit(broadcast_lines + 1).count() <= broadcast_lines
    joined = lookup(docs, F.col(host), lines.groupBy("host").agg(F.collect_list("h").alias(own)), few)
    keys = F.transform(split, _key)
    out = joined.withColumn(split, F.split(text, "\n", -1)).withColumn(drop, F.when(F.col(own).isNotNull(), F.array_intersect(keys, own)))
    kept = F.when(F.size(drop) > 0, F.filter(split, lambda x: ~F.coalesce(F.array_contains(drop, _key(x)), F.lit(False)))).otherwise(F.col(split))
    out = out.withColumn(own, kept)
    if counts:
        size = lambda c: F.when(F.col(text).isNull(), 0).otherwise(F.size(c))
        out = out.withColumns({"n_lines": size(split).cast("long"), "n_dropped": (size(split) - size(own)).cast("long")})
    return out.withColumn(text, F.array_join(own, "\n")).drop(own, split, drop)


def result(docs: DataFrame) -> DataFrame:
    """doc_id, the cleaned text and its counts."""
    return apply_to(docs.select("doc_id", "source", "text")).select("doc_id", "text", "n_lines", "n_dropped")


ORACLE_SQL = f"""
WITH pages AS (SELECT host, text, row_number() OVER () AS page FROM (SELECT DISTINCT source AS host, text FROM documents)),
totals AS (SELECT host, count(*) AS host_pages FROM pages GROUP BY host),
split_lines AS (SELECT page, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM pages),
counts AS (SELECT host, trim(line) AS key, count(DISTINCT page) AS pages FROM split_lines WHERE trim(line) <> '' GROUP BY 1, 2),
dropped AS (
  SELECT c.host, c.key FROM counts c JOIN totals t ON c.host IS NOT DISTINCT FROM t.host
  WHERE c.pages >= {MIN_PAGES} AND c.pages > CAST({BOILERPLATE_RATIO} AS DOUBLE) * t.host_pages),
marked AS (
  SELECT l.page, l.line, l.pos, d.key IS NOT NULL AS gone
  FROM split_lines l LEFT JOIN dropped d ON l.host IS NOT DISTINCT FROM d.host AND trim(l.line) = d.key),
cleaned AS (
  SELECT page, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS text, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped
  FROM marked GROUP BY page)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(c.text, '') END AS text,
       CAST(coalesce(c.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(c.n_dropped, 0) AS BIGINT) AS n_dropped
FROM documents d JOIN pages p ON d.source IS NOT DISTINCT FROM p.host AND d.text IS NOT DISTINCT FROM p.text LEFT JOIN cleaned c USING (page)
"""
