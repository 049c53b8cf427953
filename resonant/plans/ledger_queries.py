"""The whole rule ledger, and detector assembly, on arithmetic stand-ins that reach all branches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resonant.operators import evaluation as E
from resonant.operators import rules as R
from resonant.operators import spectral as P
from resonant.plans.registry import query
from resonant.plans.report_queries import _FEATURES_SQL, _POINTS_SQL, features
from resonant.plans.spectral_queries import _ACT
from resonant.sources.bindings import SERIES_SQL, series, spectra, table

_K = "key"
_MORE = {
    "preecho": "CASE WHEN key % 31 <> 0 THEN (key % 23) * 1e0 END",
    "comb": "CASE WHEN key % 29 <> 0 THEN key % 4 = 0 END",
    "hiss": "CASE WHEN key % 37 <> 0 THEN -70 + (key % 40) * 1e0 END",
    "hiss_corr": "(key % 10) / 20e0",
    "slope": "CASE WHEN key % 41 <> 0 THEN -((key % 15) * 1e0) END",
    "void": "-60 - (key % 50) * 1e0",
    "silence_seconds": "(key % 6) * 1e0",
    "silence_ratio": "CASE WHEN key % 43 <> 0 THEN (key % 50) / 100e0 END",
    "vinyl_noise": "-90 + (key % 47) * 1e0",
    "vinyl_corr": "(key % 9) / 15e0",
    "vinyl_std": "(key % 8) * 1e0",
    "clicks": "CASE WHEN key % 53 <> 0 THEN (key % 70) * 1e0 END",
    "bound": "(key * 7 % 20000) * 1e0",
    "phase": "4 + (key % 10) / 10e0",
    "sparsity": "(key % 50) / 100e0",
    "envelope": "(key % 40) / 100e0",
    "fingerprint": "key % 3 = 0",
    "majority": "CASE WHEN key % 59 <> 0 THEN key % 13 = 0 END",
    "anomalies": "CASE WHEN key % 61 <> 0 THEN CAST(key % 6 AS INTEGER) END",
    "single_matches": "key % 2 = 0",
    "any_void": "key % 5 = 0",
    "median_matches": "key % 7 = 0",
    "wall": "16000 + (key % 10) * 100e0",
}

_LEDGER_SQL = f"""WITH {_FEATURES_SQL}, {_POINTS_SQL},
e AS (SELECT * EXCLUDE (cassette), {", ".join(f"{e} AS {n}" for n, e in _MORE.items())} FROM scored),
a AS (SELECT *,
  CASE WHEN resample_rate > 0 THEN 45 ELSE 0 END AS r10,
  CASE WHEN cutoff >= 21000 THEN 0 WHEN preecho IS NULL THEN NULL WHEN preecho > 10 THEN 15 WHEN preecho >= 5 THEN 10 ELSE 0 END AS r12,
  CASE WHEN cutoff >= 21000 THEN 0 WHEN comb IS NULL THEN NULL WHEN comb THEN 10 ELSE 0 END AS r14,
  CASE WHEN cutoff >= 19000 THEN false WHEN least(20000e0, rate / 2 - 100) <= cutoff + CASE WHEN cutoff < 16000 THEN 1000 ELSE 500 END THEN false WHEN hiss IS NULL THEN NULL WHEN hiss <= -55 THEN false ELSE hiss_corr < 0.2e0 END AS th,
  CASE WHEN slope IS NULL THEN NULL WHEN slope > -6 AND slope < -3 THEN 20 WHEN slope < -10 THEN -20 ELSE 0 END AS sp,
  CASE WHEN sqrt(variance) > 50 AND sqrt(variance) < 300 THEN 15 WHEN sqrt(variance) < 30 THEN -10 ELSE 0 END AS fp,
  CASE WHEN comb THEN 0 WHEN NOT comb THEN 15 END AS cp FROM e),
b AS (SELECT *, CASE WHEN cutoff >= 19000 THEN 0 WHEN th IS NULL THEN NULL ELSE CASE WHEN th THEN 30 ELSE 0 END + sp + cp + fp END AS r15 FROM a),
c AS (SELECT *, CASE WHEN NOT th THEN false WHEN r15 IS NOT NULL THEN r15 >= 30 AND th WHEN 30 + coalesce(sp, 20) + fp + coalesce(cp, 15) < 30 THEN false
                     WHEN th AND 30 + coalesce(sp, -20) + fp + coalesce(cp, 0) >= 30 THEN true END AS cassette FROM b),
d AS (SELECT *, CASE WHEN cassette IS NULL THEN NULL WHEN cassette THEN -40 ELSE 0 END AS r16,
  CASE WHEN rate < 88200 OR cutoff <= 0 OR cutoff >= 0.6e0 * rate / 2 OR cliff <= 25 OR resample_rate > 0 THEN 0 WHEN void < -80 THEN 20 ELSE 0 END AS r17,
  CASE WHEN cassette THEN 0 WHEN cassette IS NULL OR majority IS NULL THEN NULL WHEN majority THEN 55 ELSE 0 END AS r18, cassette OR majority AS sv FROM c),
f2 AS (SELECT *,
  CASE WHEN sv THEN 0 WHEN sv IS NULL THEN NULL WHEN (anomalies = 1 AND single_matches) IS NULL THEN NULL WHEN anomalies = 1 AND single_matches THEN 25 ELSE 0 END AS r19,
  CASE WHEN sv THEN 0 WHEN sv IS NULL OR anomalies IS NULL THEN NULL WHEN anomalies < 2 THEN 0 ELSE CASE WHEN anomalies >= 4 THEN 40 ELSE 30 END + CASE WHEN any_void THEN 25 ELSE 0 END + CASE WHEN median_matches THEN 15 ELSE 0 END END AS r20,
  CASE WHEN cassette THEN 0 WHEN cassette IS NULL THEN NULL WHEN silence_seconds < 2 OR rate / 2 - 100 < 16000 THEN 0 WHEN silence_ratio IS NULL THEN NULL WHEN silence_ratio > 0.3e0 THEN 50 ELSE 0 END AS r21 FROM d),
g AS (SELECT *, r21 > 0 AS dirty, cassette OR r21 > 0 AS rv, (cutoff > 0 AND cutoff < 0.93e0 * rate / 2 AND rate / 2 - 100 - (cutoff + 800) >= 400) OR (cutoff > 0 AND cutoff < rate / 2 - 2100) AS geo FROM f2),
h AS (SELECT *, CASE WHEN rv THEN 0 WHEN rv IS NULL THEN NULL WHEN NOT geo THEN 0 WHEN vinyl_noise < -70 THEN CASE WHEN cutoff < 22500 AND cliff > 25 THEN 20 ELSE 0 END
                     WHEN vinyl_corr >= 0.3e0 OR vinyl_std >= 5 THEN 0 WHEN clicks IS NULL THEN NULL WHEN clicks BETWEEN 5 AND 50 THEN -50 ELSE -40 END AS r22 FROM g),
i AS (SELECT *, CASE WHEN cassette IS NULL OR dirty IS NULL OR r22 IS NULL THEN NULL ELSE NOT rv AND r22 < 0 END AS vinyl FROM h),
j AS (SELECT *, cassette OR vinyl AS an,
  wall <= 16500 AND cutoff > 0.85e0 * rate / 2 AND resample_rate = 0 AND NOT majority AND silence_seconds >= 2 AND rate / 2 - 100 >= 16000 AND silence_ratio >= 0 AND silence_ratio < 0.15e0 AS cl FROM i),
k AS (SELECT *, CASE WHEN cassette THEN 0 WHEN cassette IS NULL OR cl IS NULL THEN NULL WHEN cl THEN -30 ELSE 0 END AS r23,
  CASE WHEN an THEN 0 WHEN an IS NULL THEN NULL WHEN fingerprint AND (cliff > 30 OR void < -85) THEN 10 ELSE 0 END AS r24,
  CASE WHEN an THEN 0 WHEN an IS NULL THEN NULL WHEN rate >= 40000 AND bound > 0 AND bound < 16500 THEN 25 ELSE 0 END AS r25,
  CASE WHEN cutoff < 0.85e0 * rate / 2 AND cutoff < 22500 AND cliff > 25 AND phase > 4.5e0 THEN 10 ELSE 0 END AS r26, CASE WHEN cutoff < 0.95e0 * rate / 2 AND sparsity > 0.3e0 THEN 10 ELSE 0 END AS r27,
  CASE WHEN cutoff > 16500 AND bound > 0 AND bound < cutoff - 2000 AND envelope < 0.15e0 THEN 15 ELSE 0 END AS r28,
  CASE WHEN cassette THEN 0 WHEN cassette IS NULL THEN NULL WHEN rate NOT IN (44100, 48000) THEN 0 WHEN aac_score >= 0.10e0 THEN 55 WHEN aac_score >= 0.06e0 THEN 15 ELSE 0 END AS r29 FROM j),
t AS (SELECT *, main + {" + ".join(f"r{n}" for n in (10, 12, 14, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29))} AS total FROM k),
l AS (SELECT *, CAST(CASE WHEN total IS NULL THEN NULL ELSE least(greatest(CASE WHEN rate IN (44100, 48000) AND vorbis_score >= 0.03e0 THEN greatest(total, 55) ELSE total END, 0), 100) END AS INTEGER) AS score FROM t)"""
_RULES = tuple(f"r{n}" for n in range(10, 30) if n not in (11, 13))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir).drop("cassette")
    f = f.join(R.scores(f.withColumn("cassette", F.lit(False)), (_K,)).select(_K, "main"), _K)
    return R.ledger(f.select("*", *[F.expr(e).alias(n) for n, e in _MORE.items()]))


@query("r_ledger", f"{_LEDGER_SQL} SELECT key, main, " + ", ".join(f"CAST({r} AS INTEGER) AS {r}" for r in _RULES) + ", cassette, dirty, vinyl, score FROM l")
def r_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of every later rule, the vetoes, and the final score."""
    return ledger(spark, sf_dir).select(_K, "main", *[F.col(r).cast("int").alias(r) for r in _RULES], "cassette", "dirty", "vinyl", "score")


@query("r15_cassette_counts", f"{_LEDGER_SQL} SELECT cassette, vinyl, count(*) AS n, count(score) AS scored FROM l GROUP BY 1, 2")
def r15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).groupBy("cassette", "vinyl").agg(F.count("*").alias("n"), F.count("score").alias("scored"))


@query(
    "x09_integer_padding",
    """WITH d AS (SELECT p_partkey AS key, CAST(24 AS BIGINT) AS declared, CASE WHEN p_size % 6 <> 0 THEN CAST(p_size % 25 AS BIGINT) END AS used FROM part)
SELECT key, 'integer_precision' AS id, 'bit_depth' AS family, CASE WHEN used IS NULL THEN 'inconclusive' WHEN used + 8 <= declared THEN 'hit' ELSE 'not_detected' END AS status, used FROM d""",
)
def x09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight or more unused low bits are a hit; unknown use is inconclusive."""
    d = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.lit(24).cast("long").alias("declared"), F.when(F.col("p_size") % 6 != 0, (F.col("p_size") % 25).cast("long")).alias("used"))
    status = F.when(F.col("used").isNull(), "inconclusive").when(F.col("used") + 8 <= F.col("declared"), "hit").otherwise("not_detected")
    return d.select("key", F.lit("integer_precision").alias("id"), F.lit("bit_depth").alias("family"), status.alias("status"), "used")


_ENV_SQL = """e AS (SELECT channel, frame_no, sqrt(coalesce(sum(m * m) FILTER (WHERE bin BETWEEN 4 AND 20), 0)) AS a, sqrt(coalesce(sum(m * m) FILTER (WHERE bin BETWEEN 40 AND 60), 0)) AS b FROM act GROUP BY 1, 2),
env AS (SELECT channel, corr(a, b) AS value FROM e GROUP BY 1),
spa AS (SELECT channel, count(*) FILTER (WHERE 20 * log10(m / (peak + 1e-12) + 1e-12) < -30) / count(*) AS value FROM act WHERE bin >= 1 AND bin < 50 GROUP BY 1)"""


@query(
    "x10_detector_rows",
    f"""{_ACT}, {_ENV_SQL}
SELECT channel, 'band_envelope_correlation' AS id, 'spectral_structure' AS family, 'measured' AS status, round(value, 6) AS value FROM env
UNION ALL SELECT channel, 'below_cutoff_sparsity', 'spectral_structure', 'measured', round(value, 6) FROM spa""",
)
def x10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of several detectors as one table; a value that is null is unsupported or inconclusive, not zero."""
    bins = spectra(spark, sf_dir)
    row = lambda df, id_, value: df.select("channel", F.lit(id_).alias("id"), F.lit("spectral_structure").alias("family"), F.when(F.col(value).isNull(), "inconclusive").otherwise("measured").alias("status"), F.col(value).alias("value"))
    return E.union_all([row(P.envelope_correlation(bins, (4, 20), (40, 60), 10), "band_envelope_correlation", "correlation"), row(P.sparsity(bins, 50, -30.0), "below_cutoff_sparsity", "sparsity")])


@query(
    "x11_basis_winner",
    """WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0.02e0 THEN l_discount END AS score, l_extendedprice FROM lineitem)
SELECT l_orderkey, arg_max(l_linenumber, (score, -l_linenumber, -l_extendedprice)) FILTER (WHERE score IS NOT NULL) AS winner, max(score) AS score FROM s GROUP BY 1""",
)
def x11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate with the largest score, the first on equal ones; null without any."""
    s = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_tax") > 0.02, F.col("l_discount")).alias("score"))
    best = F.max_by(F.when(F.col("score").isNotNull(), F.col("l_linenumber")), F.when(F.col("score").isNotNull(), F.struct("score", -F.col("l_linenumber"))))
    return s.groupBy("l_orderkey").agg(best.alias("winner"), F.max("score").alias("score"))


@query(
    "x12_ordered_hit",
    """WITH c AS (SELECT l_suppkey, l_linenumber, l_quantity, l_discount >= 0.09e0 AS hit FROM lineitem)
SELECT l_suppkey, min(l_linenumber) FILTER (WHERE hit) AS first_hit, count(*) FILTER (WHERE hit) AS hits FROM c GROUP BY 1""",
)
def x12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first candidate, in the order of the table of candidates, that has a mode."""
    c = table(spark, sf_dir, "lineitem").withColumn("hit", F.col("l_discount") >= 0.09)
    return c.groupBy("l_suppkey").agg(F.min(F.when(F.col("hit"), F.col("l_linenumber"))).alias("first_hit"), F.count_if("hit").alias("hits"))


@query(
    "x13_fake_bandwidth",
    """WITH f AS (SELECT p_partkey AS key, CASE p_partkey % 3 WHEN 0 THEN 44100 WHEN 1 THEN 96000 ELSE 192000 END AS rate, CASE WHEN p_size % 5 <> 0 THEN (p_partkey * 53) % 60000 END AS cutoff, CASE WHEN p_size % 7 <> 0 THEN p_size END AS cliff, -50 - p_size AS void FROM part)
SELECT key, rate >= 88200 AND cutoff > 0 AND cutoff < 0.6e0 * rate / 2 AND cliff > 25 AND void < -80 AS candidate FROM f""",
)
def x13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-valued: one false input decides, else an unknown one leaves it unknown."""
    k, s = F.col("p_partkey"), F.col("p_size")
    rate = F.when(k % 3 == 0, 44100).when(k % 3 == 1, 96000).otherwise(192000)
    cutoff, cliff, void = F.when(s % 5 != 0, (k * 53) % 60000), F.when(s % 7 != 0, s), -50 - s
    test = (rate >= 88200) & (cutoff > 0) & (cutoff < 0.6 * rate / 2) & (cliff > 25) & (void < -80)
    return table(spark, sf_dir, "part").select(k.alias("key"), test.alias("candidate"))


@query(
    "j10_binding_violations",
    """SELECT d.doc_id, d.source AS left_source, r.source AS right_source FROM documents d JOIN (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 10 = 0 THEN 'other' ELSE source END AS source, lang FROM documents) r USING (doc_id)
WHERE d.source IS DISTINCT FROM r.source OR d.lang IS DISTINCT FROM r.lang""",
)
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a report and what it is bound to that differ in a bound field; null equals null."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("left_source"), F.col("lang").alias("left_lang"))
    i = F.col("doc_id")
    r = table(spark, sf_dir, "documents").select("doc_id", F.when(i % 9 == 0, None).when(i % 10 == 0, "other").otherwise(F.col("source")).alias("right_source"), F.col("lang").alias("right_lang"))
    same = F.col("left_source").eqNullSafe(F.col("right_source")) & F.col("left_lang").eqNullSafe(F.col("right_lang"))
    return d.join(r, "doc_id").where(~same).select("doc_id", "left_source", "right_source")


@query("j12_first_tag", "SELECT user_id, arg_min(event_type, event_id) AS first_value, min(event_id) AS source_order FROM events GROUP BY 1")
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first_value"), F.min("event_id").alias("source_order"))


@query(
    "j13_alias_paths",
    """WITH a(alias, path) AS (VALUES ('loudness.k', '$.k'), ('missing.field', '$.absent'))
SELECT event_id, alias, json_extract_string(props, path) AS value, CASE WHEN json_extract_string(props, path) IS NULL THEN 'unavailable' ELSE 'available' END AS status FROM events, a""",
)
def j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flat field catalogue over saved records: each alias with its value and whether it is there."""
    aliases = {"loudness.k": "$.k", "missing.field": "$.absent"}
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("alias"), F.get_json_object("props", p).alias("value")) for a, p in aliases.items()]))
    return table(spark, sf_dir, "events").select("event_id", rows.alias("r")).select("event_id", "r.*", F.when(F.col("r.value").isNull(), "unavailable").otherwise("available").alias("status"))


@query("p01_words", "SELECT l_orderkey, l_linenumber, round((l_quantity * 65536) / 2147483648e0, 10) AS sample, round(CAST(l_quantity AS BIGINT) / 32767e0, 10) AS tool_sample FROM lineitem", digits=10)
def p01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word aligned to its high bits as a sample, and as the statistics tool's 16-bit sample."""
    word = F.col("l_quantity").cast("long") * 65536
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (word / 2147483648.0).alias("sample"), (F.shiftright(word, 16) / 32767.0).alias("tool_sample"))


@query(
    "p15_encoded_bitrate",
    """SELECT o_custkey, CASE WHEN min(o_orderstatus) = max(o_orderstatus) THEN NULL ELSE round(sum(o_totalprice) * 8 * 48000 / (count(*) * 1024), 2) END AS bitrate FROM orders GROUP BY 1""",
    digits=2,
)
def p15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits per second over whole packets; null where the passes disagree."""
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("bytes"), (F.count("*") * 1024).alias("frames"), (F.min("o_orderstatus") != F.max("o_orderstatus")).alias("stable"))
    return g.select("o_custkey", F.when(F.col("stable"), F.col("bytes") * 8 * 48000 / F.col("frames")).alias("bitrate"))


@query(
    "w04_whole_seconds",
    f"""WITH {SERIES_SQL}, f AS (SELECT part, frame AS start, avg(x * x) OVER (PARTITION BY part ORDER BY frame ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS p, count(*) OVER (PARTITION BY part ORDER BY frame ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS n FROM series)
SELECT part, start // 10 AS second, count(*) AS windows, round(avg(p), 6) AS power FROM f WHERE n = 4 AND start // 10 = (start + 3) // 10 GROUP BY 1, 2""",
)
def w04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of four frames that lie wholly inside one second of ten frames."""
    from resonant.operators.windows import in_order

    ahead = in_order().rowsBetween(0, 3)
    f = series(spark, sf_dir).withColumn("p", F.avg(F.col("x") * F.col("x")).over(ahead)).withColumn("n", F.count("*").over(ahead))
    second = F.floor(F.col("frame") / 10)
    return f.where((F.col("n") == 4) & (second == F.floor((F.col("frame") + 3) / 10))).groupBy("part", second.alias("second")).agg(F.count("*").alias("windows"), F.avg("p").alias("power"))


@query(
    "f06_comment_split",
    """WITH c AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'novalue' ELSE event_type || '=a=' || user_id END AS raw FROM events)
SELECT event_id, CASE WHEN contains(raw, '=') THEN upper(split_part(raw, '=', 1)) END AS key, CASE WHEN contains(raw, '=') THEN substr(raw, instr(raw, '=') + 1) END AS value FROM c""",
)
def f06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments split at their first equals sign, after a trip through base64; without one they have no key."""
    raw = F.when(F.col("event_id") % 4 == 0, "novalue").otherwise(F.concat("event_type", F.lit("=a="), F.col("user_id").cast("string")))
    c = table(spark, sf_dir, "events").select("event_id", F.decode(F.unbase64(F.base64(raw)), "UTF-8").alias("raw"))
    at = F.instr("raw", "=")
    return c.select("event_id", F.when(at > 0, F.upper(F.substr("raw", F.lit(1), at - 1))).alias("key"), F.when(at > 0, F.substr("raw", at + 1)).alias("value"))
