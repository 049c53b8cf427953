"""Queries on lookups, rules, ranking, evaluation, tags and saved reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resonant.functions.labels import STEPS, label, variance_label
from resonant.operators import evaluation as E
from resonant.operators import lookups as L
from resonant.operators import metadata as M
from resonant.operators import rules as R
from resonant.plans.registry import query
from resonant.sources.bindings import SERIES_SQL, series, table

_WALLS_SQL = "walls(pos, codec, profile, wall, tolerance) AS (VALUES " + ", ".join(f"({i}, '{c}', '{p}', {w}e0, {t}e0)" for i, (c, p, w, t) in enumerate(L.WALLS)) + ")"
_VALUES_SQL = "v AS (SELECT p_partkey AS key, 11000 + (p_partkey * 41) % 10000 + p_size / 4e0 AS hz FROM part)"
_NEAR_SQL = """n AS (SELECT key, codec, profile, wall, abs(hz - wall) AS distance, pos FROM v JOIN walls ON abs(hz - wall) <= tolerance WHERE hz < 21609e0)"""


def _hz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), (11000 + (F.col("p_partkey") * 41) % 10000 + F.col("p_size") / 4.0).alias("hz"))


@query("p06_tolerance_lookup", f"WITH {_WALLS_SQL}, {_VALUES_SQL}, {_NEAR_SQL} SELECT key, codec, profile, wall, round(distance, 6) AS distance, CAST(row_number() OVER (PARTITION BY key ORDER BY distance, pos) AS INTEGER) AS rank FROM n")
def p06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.within_tolerance(_hz(spark, sf_dir), "key", "hz", 21609.0)


@query("p07_nearest_wall", f"WITH {_WALLS_SQL}, {_VALUES_SQL}, {_NEAR_SQL} SELECT key, codec, profile, wall, round(distance, 6) AS distance FROM n QUALIFY row_number() OVER (PARTITION BY key ORDER BY distance, pos) = 1")
def p07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.nearest(_hz(spark, sf_dir), "key", "hz", 21609.0)


@query(
    "p08_lower_rates",
    """WITH v AS (SELECT p_partkey AS key, CAST([44100, 48000, 96000, 192000][p_partkey % 4 + 1] AS BIGINT) AS rate FROM part), s AS (SELECT CAST(unnest([44100, 48000, 88200, 96000]) AS BIGINT) AS source_rate)
SELECT key, rate, source_rate FROM v, s WHERE source_rate / 2 + 1200 <= rate / 2 - 200""",
)
def p08(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = F.array(*[F.lit(r).cast("long") for r in (44100, 48000, 96000, 192000)])
    return L.lower_rates(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.element_at(rates, (F.col("p_partkey") % 4 + 1).cast("int")).alias("rate")), "rate")


_FEATURES = {
    "rate": "CAST(CASE p_partkey % 3 WHEN 0 THEN 44100 WHEN 1 THEN 48000 ELSE 96000 END AS BIGINT)",
    "cutoff": "12000e0 + (p_partkey * 37) % 9000 + p_size",
    "sharpness": "p_size / 2.5e0",
    "cliff": "CAST(p_partkey % 47 AS DOUBLE)",
    "hf": "CASE WHEN p_size <> 13 THEN (p_partkey % 100) / 1000e0 END",
    "noise": "CAST(-(p_partkey % 90) AS DOUBLE)",
    "variance": "CAST((p_partkey * 13) % 20000 AS DOUBLE)",
    "banding": "(p_partkey % 100) / 100e0",
    "side": "p_size / 50e0",
    "entropy": "(p_partkey % 12) + 0.5e0",
    "dsd": "CASE WHEN p_size = 7 THEN 1 ELSE 0 END",
    "resample_rate": "CASE WHEN p_partkey % 11 = 0 THEN 44100 ELSE 0 END",
    "fake_bandwidth": "p_partkey % 17 = 0",
    "majority_wall": "p_partkey % 13 = 0",
    "cassette": "p_partkey % 19 = 0",
    "aac_score": "(p_partkey % 40) / 250e0",
    "vorbis_score": "(p_partkey % 60) / 1000e0",
}
_FEATURES_SQL = "f AS (SELECT p_partkey AS key, " + ", ".join(f"{e} AS {n}" for n, e in _FEATURES.items()) + " FROM part)"


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide feature row for each part: arithmetic stand-ins that reach all branches."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), *[F.expr(e).alias(n) for n, e in _FEATURES.items()])


_POINTS_SQL = """points AS (
  SELECT f.*,
    CASE WHEN cutoff < 0.85e0 * rate / 2 AND cutoff < 18500 THEN 2 ELSE 0 END AS r01,
    CASE WHEN sharpness > 15 THEN 3 WHEN cutoff < 0.93e0 * rate / 2 AND cliff > 35 THEN 3 WHEN sharpness > 8 OR (cutoff < 0.93e0 * rate / 2 AND cliff > 20) THEN 1 ELSE 0 END AS r02,
    CASE WHEN hf IS NULL THEN NULL WHEN hf < 0.005e0 THEN 1 ELSE 0 END AS r03,
    CASE WHEN noise < -70 THEN 3 WHEN noise < -40 THEN 1 ELSE 0 END AS r04,
    CASE WHEN cutoff >= 0.85e0 * rate / 2 THEN 0 WHEN variance < 1000 THEN 1 ELSE 0 END AS r05,
    CASE WHEN cutoff < 0.8e0 * rate / 2 AND banding > 0.92e0 THEN 1 ELSE 0 END + CASE WHEN side > 0.6e0 THEN 2 ELSE 0 END AS r06,
    CASE WHEN dsd <> 0 THEN 0 ELSE CASE WHEN noise > -50 THEN 1 ELSE 0 END + CASE WHEN cutoff > 0.85e0 * rate / 2 THEN
      CASE WHEN hf IS NULL THEN NULL WHEN hf > 0.05e0 THEN 1 ELSE 0 END + CASE WHEN entropy > 8.5e0 THEN 1 ELSE 0 END ELSE 0 END END AS r07,
    CASE WHEN sharpness < 5 THEN 1 ELSE 0 END + CASE WHEN side < 0.2e0 THEN 1 ELSE 0 END + CASE WHEN cutoff > 0.85e0 * rate / 2 AND variance > 10000 THEN 1 ELSE 0 END AS r08
  FROM f),
sums AS (SELECT *, r01 + r02 + r03 + r04 + r05 + r06 AS lossy, r07 + r08 AS "natural" FROM points),
nets AS (SELECT *, CASE WHEN lossy IS NOT NULL AND "natural" IS NOT NULL THEN greatest(lossy - "natural", 0) END AS net FROM sums),
scored AS (SELECT *, CAST(round_even(net * 45e0 / 14, 0) AS INTEGER) AS main FROM nets)"""


@query(
    "r_scores",
    f"""WITH {_FEATURES_SQL}, {_POINTS_SQL}
SELECT key, CAST(lossy AS INTEGER) AS lossy, CAST("natural" AS INTEGER) AS "natural", CAST(net AS INTEGER) AS net, round(least(lossy * 100e0 / 14, 100), 6) AS raw_lossy_pct, main,
       CASE WHEN net IS NULL THEN 'partial' ELSE 'available' END AS status FROM scored""",
)
def r_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.scores(features(spark, sf_dir), ("key",))


_TRACE_SQL = " UNION ALL ".join(f"SELECT key, 'R0{k}' AS rule_id, '{'lossy' if k < 7 else 'natural'}' AS effect, CAST(r0{k} AS INTEGER) AS result, CASE WHEN r0{k} IS NULL THEN 'missing_input' WHEN r0{k} <> 0 THEN 'applied' ELSE 'not_triggered' END AS state FROM points" for k in range(1, 9))
_EXCLUDED_SQL = " UNION ALL ".join(f"SELECT key, '{r}', 'none', CAST(NULL AS INTEGER), 'excluded_by_contract' FROM points" for r in ("R11", "R13", "R32"))


@query("r_trace", f"WITH {_FEATURES_SQL}, {_POINTS_SQL} {_TRACE_SQL} UNION ALL {_EXCLUDED_SQL}")
def r_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.trace(features(spark, sf_dir), ("key",))


@query(
    "r_verdict",
    f"""WITH {_FEATURES_SQL}, {_POINTS_SQL},
a1 AS (SELECT *, main + CASE WHEN resample_rate > 0 THEN 45 ELSE 0 END - CASE WHEN cassette THEN 40 ELSE 0 END + CASE WHEN fake_bandwidth THEN 20 ELSE 0 END + CASE WHEN majority_wall AND NOT cassette THEN 55 ELSE 0 END
  + CASE WHEN rate IN (44100, 48000) AND NOT cassette AND aac_score >= 0.10e0 THEN 55 WHEN rate IN (44100, 48000) AND NOT cassette AND aac_score >= 0.06e0 THEN 15 ELSE 0 END AS m FROM scored),
a2 AS (SELECT *, least(greatest(CASE WHEN rate IN (44100, 48000) AND vorbis_score >= 0.03e0 THEN greatest(m, 55) ELSE m END, 0), 100) AS adj FROM a1),
a3 AS (SELECT *, CASE WHEN main IS NULL THEN NULL ELSE adj END AS adjusted FROM a2)
SELECT key, main, CAST(adjusted AS INTEGER) AS adjusted,
       CASE WHEN adjusted IS NULL THEN 'INCONCLUSIVE' WHEN adjusted >= 86 THEN 'LIKELY_LOSSY' WHEN resample_rate > 0 OR fake_bandwidth OR adjusted >= 55 THEN 'SUSPICIOUS' WHEN adjusted >= 31 THEN 'CAUTION'
            WHEN adjusted >= 11 THEN 'LIKELY_GENUINE' ELSE 'GENUINE' END AS verdict FROM a3""",
)
def r_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    scored = R.adjusted(f.join(R.scores(f, ("key",)).select("key", "main"), "key"), R.codec_adjustments())
    return scored.select("key", "main", "adjusted", R.verdict(F.col("adjusted"), F.lit(False), F.col("resample_rate"), F.col("fake_bandwidth")).alias("verdict"))


@query(
    "r33_depth",
    """WITH d AS (SELECT p_partkey AS key, CASE WHEN p_size % 9 <> 0 THEN 24 END AS declared, CASE WHEN p_size % 7 <> 0 THEN 24 - p_size % 12 END AS used FROM part)
SELECT key, CASE WHEN declared IS NULL OR used IS NULL THEN 'unknown' WHEN used + 8 <= declared THEN '⚠ padded' WHEN used < declared THEN '~ partly used' ELSE 'full' END AS label FROM d""",
)
def r33(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.when(F.col("p_size") % 9 != 0, 24).alias("declared"), F.when(F.col("p_size") % 7 != 0, 24 - F.col("p_size") % 12).alias("used"))
    return d.select("key", R.depth_label(F.col("declared"), F.col("used")).alias("label"))


def _label_sql(kind: str, value: str) -> str:
    steps, above = STEPS[kind]
    return f"CASE WHEN {value} IS NULL THEN NULL " + " ".join(f"WHEN {value} < {limit}e0 THEN '{text}'" for limit, text in steps) + f" ELSE '{above}' END"


_KINDS = {"sharpness": "sharpness", "hf_ratio": "hf", "banding": "banding", "noise": "noise", "side": "side"}


@query(
    "p10_labels",
    f"WITH {_FEATURES_SQL} SELECT key, "
    + ", ".join(f"{_label_sql(k, c)} AS {k}" for k, c in _KINDS.items())
    + """, CASE WHEN variance < 1000 THEN '[rigid/encoded-like]' WHEN variance < 10000 THEN '[stable: normal for mastered audio]' WHEN variance < 100000 THEN '[moderate: natural organic fluctuation]' END AS variance FROM f""",
)
def p10(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    return f.select("key", *[label(k, F.col(c)).alias(k) for k, c in _KINDS.items()], variance_label(F.col("variance"), F.col("cutoff") > 0.85 * F.col("rate") / 2).alias("variance"))


@query(
    "o01_variant_ranking",
    """WITH v AS (
  SELECT o_custkey AS track, o_orderkey AS input_index, o_orderstatus <> 'P' AS available, CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(o_orderkey % 7 AS INTEGER) END AS main_score, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 2 = 0 END AS flag,
         CASE WHEN o_orderkey % 6 <> 0 THEN o_totalprice END AS cutoff, CAST(o_orderkey % 3 AS INTEGER) AS depth, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 15 AS INTEGER) END AS dr, o_orderkey * 100 AS precision_rate,
         CASE WHEN o_custkey % 5 = 0 THEN o_orderstatus ELSE 'one' END AS compatibility FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY CASE WHEN available THEN 0 ELSE 1 END, coalesce(main_score, 999), coalesce(flag, false), coalesce(cutoff, 0) DESC, depth, coalesce(dr, -1) DESC, precision_rate DESC, input_index) AS rn,
             count(DISTINCT CASE WHEN available THEN compatibility END) OVER (PARTITION BY track) <= 1 AS same FROM v)
SELECT track, input_index, CASE WHEN same THEN CAST(rn AS INTEGER) END AS rank, same AND rn = 1 AND available AS winner,
       concat_ws(',', CASE WHEN main_score IS NULL THEN 'main_score' END, CASE WHEN flag IS NULL THEN 'rate_history_flag' END, CASE WHEN cutoff IS NULL THEN 'cutoff_hz' END, CASE WHEN dr IS NULL THEN 'dr' END) AS missing_fields FROM r""",
)
def o01(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    some = lambda n, c: F.when(k % n != 0, c)
    v = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("track"), k.alias("input_index"), (F.col("o_orderstatus") != "P").alias("available"), F.when(F.col("o_orderpriority") != "5-LOW", (k % 7).cast("int")).alias("main_score"), some(5, k % 2 == 0).alias("rate_history_flag"),
        some(6, F.col("o_totalprice")).alias("cutoff_hz"), (k % 3).cast("int").alias("depth_category"), some(4, (k % 15).cast("int")).alias("dr"), (k * 100).alias("precision_rate"), F.when(F.col("o_custkey") % 5 == 0, F.col("o_orderstatus")).otherwise("one").alias("compatibility"),
    )
    return E.rank_variants(v, "track")


_CASES_SQL = """cases AS (
  SELECT CAST(d.doc_id % 900 AS BIGINT) AS id, source AS source_group, CASE WHEN source = 'src1' AND d.doc_id % 2 = 0 OR source < 'src2' THEN 'challenge' ELSE 'tuning' END AS split,
         CASE WHEN d.doc_id % 11 = 0 THEN 'unknown' WHEN quality = 1 THEN 'present' ELSE 'absent' END AS label, ['generated_control', 'reviewed_history', 'recorded_added_stage', 'other'][CAST(d.doc_id % 4 AS INTEGER) + 1] AS provenance,
         CASE WHEN d.doc_id % 13 = 0 THEN NULL WHEN d.doc_id % 17 = 0 THEN 'no hash' ELSE sha256(text) END AS pcm_hash
  FROM documents d JOIN labels l USING (doc_id))"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    i = F.col("doc_id")
    names = F.array(*[F.lit(p) for p in ("generated_control", "reviewed_history", "recorded_added_stage", "other")])
    return d.select(
        (i % 900).alias("id"), F.col("source").alias("source_group"), F.when(((F.col("source") == "src1") & (i % 2 == 0)) | (F.col("source") < "src2"), "challenge").otherwise("tuning").alias("split"),
        F.when(i % 11 == 0, "unknown").when(F.col("quality") == 1, "present").otherwise("absent").alias("label"), F.element_at(names, (i % 4 + 1).cast("int")).alias("provenance"),
        F.when(i % 13 == 0, None).when(i % 17 == 0, "no hash").otherwise(F.sha2("text", 256)).alias("pcm_hash"),
    )


@query(
    "e01_manifest_violations",
    f"""WITH {_CASES_SQL},
m AS (SELECT *, count(*) OVER (PARTITION BY id) AS same_id, count(DISTINCT split) OVER (PARTITION BY source_group) AS splits, CASE WHEN pcm_hash IS NOT NULL THEN count(DISTINCT source_group) OVER (PARTITION BY pcm_hash) END AS hash_groups FROM cases)
SELECT 'duplicate case id' AS violation, id FROM m WHERE same_id > 1
UNION ALL SELECT 'group in several splits', id FROM m WHERE splits > 1
UNION ALL SELECT 'label and provenance', id FROM m WHERE NOT ((label = 'absent' AND provenance IN ('generated_control', 'reviewed_history')) OR (label = 'present' AND provenance IN ('generated_control', 'reviewed_history', 'recorded_added_stage')) OR (label = 'unknown' AND split = 'challenge'))
UNION ALL SELECT 'invalid hash', id FROM m WHERE NOT regexp_full_match(pcm_hash, '[0-9a-f]{{64}}')
UNION ALL SELECT 'hash in several groups', id FROM m WHERE hash_groups > 1
UNION ALL SELECT 'labelled without hash', id FROM m WHERE pcm_hash IS NULL AND label <> 'unknown'""",
)
def e01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.manifest_violations(cases(spark, sf_dir))


@query(
    "e02_submissions",
    f"""WITH {_CASES_SQL}, k AS (SELECT id, any_value(split) AS binding, min(pcm_hash) AS pcm_hash, min(source_group) AS source_group FROM cases GROUP BY 1),
r AS (SELECT CAST(doc_id % 1000 AS BIGINT) AS id, doc_id AS seq, CASE WHEN doc_id % 6 = 0 THEN 'other' ELSE 'x' END AS mark, CASE WHEN doc_id % 19 = 0 THEN 'bad' ELSE sha256(text) END AS pcm_hash FROM documents),
b AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'other' ELSE 'x' END AS case_binding, pcm_hash AS case_hash FROM k),
g AS (SELECT pcm_hash AS h FROM k WHERE pcm_hash IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source_group) > 1),
n AS (SELECT r.*, row_number() OVER (PARTITION BY r.id ORDER BY seq) AS nth, b.id IS NOT NULL AS known, case_binding, case_hash, g.h IS NOT NULL AS leaked FROM r LEFT JOIN b USING (id) LEFT JOIN g ON g.h = r.pcm_hash),
w AS (SELECT id, seq, CASE WHEN NOT known THEN 'unknown case' WHEN nth > 1 THEN 'submitted before' WHEN mark IS DISTINCT FROM case_binding THEN 'binding' WHEN NOT regexp_full_match(pcm_hash, '[0-9a-f]{{64}}') THEN 'invalid hash' WHEN case_hash <> pcm_hash THEN 'other hash' WHEN leaked THEN 'hash of another group' END AS reason FROM n)
SELECT id, seq, reason IS NULL AS accepted, reason FROM w""",
)
def e02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports submitted for the manifest's cases: which are accepted, and why others are not."""
    k = cases(spark, sf_dir).groupBy("id").agg(F.min("pcm_hash").alias("pcm_hash"), F.min("source_group").alias("source_group"))
    manifest = k.withColumn("binding", F.when(F.col("id") % 5 == 0, "other").otherwise("x"))
    i = F.col("doc_id")
    reports = table(spark, sf_dir, "documents").select((i % 1000).alias("id"), i.alias("seq"), F.when(i % 6 == 0, "other").otherwise("x").alias("binding"), F.when(i % 19 == 0, "bad").otherwise(F.sha2("text", 256)).alias("pcm_hash"))
    return E.submissions(manifest, reports)


@query(
    "a39_distinct_sets",
    """SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kinds, count(*) - count(DISTINCT floor(value)) AS repeats FROM events GROUP BY 1""",
)
def a39_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values as a sorted list, and how many rows repeat one."""
    g = table(spark, sf_dir, "events").groupBy("user_id")
    return g.agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"), (F.count("*") - F.countDistinct(F.floor("value"))).alias("repeats"))


@query(
    "e03_outcomes",
    f"""WITH {SERIES_SQL}, g AS (SELECT part, count(*) AS slots, count(*) FILTER (WHERE hit AND x > 1) AS hits, count(*) FILTER (WHERE x <= 0.9e0) AS undetected FROM series GROUP BY part)
SELECT part, CASE WHEN part % 9 = 0 OR slots < 50 THEN 'abstain' WHEN hits > 0 THEN 'hit' WHEN undetected = slots THEN 'no_hit' ELSE 'abstain' END AS outcome FROM g""",
)
def e03(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = series(spark, sf_dir).groupBy("part").agg(F.count("*").alias("slots"), F.count_if(F.col("hit") & (F.col("x") > 1)).alias("hits"), F.count_if(F.col("x") <= 0.9).alias("undetected"))
    return g.select("part", E.outcome(F.col("part") % 9 != 0, F.col("slots") >= 50, F.lit(True), F.col("hits"), F.col("undetected"), F.col("slots")).alias("outcome"))


@query(
    "a34_strata",
    """WITH c AS (SELECT lang, quality, source, CASE WHEN n_chars < 200 THEN 'abstain' WHEN n_chars > 1500 THEN 'hit' ELSE 'no_hit' END AS outcome FROM documents JOIN labels USING (doc_id)),
g AS (SELECT lang, quality, source, count(*) AS n, count(*) FILTER (WHERE outcome = 'hit') AS h, count(*) FILTER (WHERE outcome = 'no_hit') AS nh, count(*) FILTER (WHERE outcome = 'abstain') AS a FROM c GROUP BY 1, 2, 3)
SELECT lang, quality, count(*) AS groups, CAST(sum(n) AS BIGINT) AS files, round(avg(h / n), 6) AS mean_hit, round(avg(nh / n), 6) AS mean_no_hit, round(avg(a / n), 6) AS mean_abstain FROM g GROUP BY 1, 2""",
)
def a34(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("lang", "quality", F.col("source").alias("source_group"), F.when(F.col("n_chars") < 200, "abstain").when(F.col("n_chars") > 1500, "hit").otherwise("no_hit").alias("outcome"))
    return E.strata(c, ("lang", "quality"))


_IDS = ("vorbis_transform_grid", "segment_wall", "resampling_candidates", "integer_precision", "programme_loudness")
_FAMILIES = {"vorbis_transform_grid": "transform_grid", "segment_wall": "spectral_wall", "resampling_candidates": "sample_rate_history", "integer_precision": "bit_depth", "programme_loudness": "listening_level"}
_DETECTORS_SQL = f"""d AS (
  SELECT user_id, {list(_IDS)}[CAST(event_id % 5 AS INTEGER) + 1] AS id, {[_FAMILIES[i] for i in _IDS]}[CAST(event_id % 5 AS INTEGER) + 1] AS family, CASE WHEN event_id % 23 = 0 THEN 2 ELSE 1 END AS version,
         ['hit', 'measured', 'not_detected', 'inconclusive', 'unsupported'][CAST(floor(value) % 5 AS INTEGER) + 1] AS status FROM events)"""


def detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, i: F.element_at(F.array(*[F.lit(x) for x in names]), (i + 1).cast("int"))
    k = F.col("event_id") % 5
    return table(spark, sf_dir, "events").select(
        "user_id", pick(_IDS, k).alias("id"), pick([_FAMILIES[i] for i in _IDS], k).alias("family"), F.when(F.col("event_id") % 23 == 0, 2).otherwise(1).alias("version"), pick(E.STATUSES, F.floor("value") % 5).alias("status")
    )


@query(
    "a33_evidence_groups",
    f"""WITH {_DETECTORS_SQL},
m AS (SELECT *, CASE WHEN version <> 1 THEN 'uninterpreted' ELSE CASE family WHEN 'transform_grid' THEN 'codec_transforms' WHEN 'spectral_wall' THEN 'spectral_patterns' WHEN 'sample_rate_history' THEN 'sample_rate_history' WHEN 'bit_depth' THEN 'integer_precision' WHEN 'listening_level' THEN 'listening_levels' END END AS domain FROM d),
p AS (SELECT *, CASE WHEN status = 'hit' AND domain <> 'uninterpreted' THEN CASE id WHEN 'vorbis_transform_grid' THEN 'Vorbis transform grid' WHEN 'segment_wall' THEN 'repeated or mixed spectral walls' WHEN 'resampling_candidates' THEN 'sample-rate hypotheses' WHEN 'integer_precision' THEN 'unused low-order integer bits' END END AS pattern FROM m)
SELECT user_id, domain, {", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in E.STATUSES)}, coalesce(string_agg(DISTINCT pattern, '; ' ORDER BY pattern), '') AS patterns FROM p GROUP BY 1, 2""",
)
def a33(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.evidence_groups(detectors(spark, sf_dir), "user_id")


_PROBES_SQL = "p AS (SELECT l_suppkey AS key, l_quantity > 5 AS eligible, l_discount > 0.07e0 AS wall FROM lineitem)"


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), (F.col("l_quantity") > 5).alias("eligible"), (F.col("l_discount") > 0.07).alias("wall"))


@query(
    "a36_wall_pattern",
    f"""WITH {_PROBES_SQL}, g AS (SELECT key, count(*) AS probes, count(*) FILTER (WHERE eligible) AS eligible, count(*) FILTER (WHERE eligible AND wall) AS walls FROM p GROUP BY 1)
SELECT *, CASE WHEN eligible = 0 THEN 'unknown' WHEN walls = 0 THEN 'none' WHEN walls = 1 THEN 'isolated' WHEN walls = eligible THEN 'repeated' ELSE 'mixed' END AS pattern FROM g""",
)
def a36(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.wall_pattern(_probes(spark, sf_dir), "key", "eligible", "wall")


@query("a37_majority_vote", f"WITH {_PROBES_SQL}, g AS (SELECT key, count(*) FILTER (WHERE eligible) AS eligible, count(*) FILTER (WHERE eligible AND wall) AS walls FROM p GROUP BY 1) SELECT *, CASE WHEN eligible >= 3 THEN walls * 2 >= eligible END AS majority FROM g")
def a37(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.majority(_probes(spark, sf_dir), "key", "eligible", "wall")


@query(
    "a38_anomaly_regions",
    """WITH p AS (SELECT l_suppkey AS key, l_linenumber AS s, l_extendedprice AS c, l_tax >= 0.08e0 AS v FROM lineitem),
l AS (SELECT key, s, max(c) AS c, arg_max(v, c) AS v FROM p GROUP BY 1, 2)
SELECT key, count(*) AS regions, round(median(c), 6) AS median_cutoff, bool_or(v) AS any_void, count(*) >= 2 AS several, count(*) >= 4 AS many FROM l GROUP BY 1""",
)
def a38(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_linenumber").alias("s"), F.col("l_extendedprice").alias("c"), (F.col("l_tax") >= 0.08).alias("v"))
    return E.anomaly_regions(p, "key", "s", "c", "c", "v")


@query(
    "j08_missing_reports",
    """WITH r AS (SELECT doc_id AS id FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id FROM documents WHERE doc_id % 50 = 1)
SELECT doc_id AS id, 'missing' AS problem FROM labels WHERE doc_id NOT IN (SELECT id FROM r)
UNION ALL SELECT id, 'duplicate' FROM r WHERE id IN (SELECT doc_id FROM labels) GROUP BY id HAVING count(*) > 1""",
)
def j08(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    reports = ids.where("id % 7 <> 0").unionByName(ids.where("id % 50 = 1"))
    return E.missing_reports(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), reports)


@query("j09_hash_leakage", "SELECT sha256(text) AS digest, count(DISTINCT source) AS groups, count(*) AS rows FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source) > 1")
def j09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.leaked_hashes(table(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("digest")), "source", "digest")


@query(
    "j11_slots",
    """WITH e AS (SELECT DISTINCT u.user_id, t.event_type FROM events u, (SELECT DISTINCT event_type FROM events) t), c AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE value > 60 GROUP BY 1, 2)
SELECT user_id, event_type, coalesce(n, 0) AS n FROM e LEFT JOIN c USING (user_id, event_type) WHERE coalesce(n, 0) <> 1""",
)
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    types = F.explode(F.array(*[F.lit(t) for t in ("click", "error", "purchase", "signup", "view")])).alias("event_type")
    return E.slot_problems(events.select("user_id").distinct().select("user_id", types), events.where("value > 60").select("user_id", "event_type"), ("user_id", "event_type"))


@query(
    "f01_text_budget",
    """WITH b AS (SELECT source, doc_id, strlen(text) AS n, CASE WHEN strlen(text) <= 4000 THEN strlen(text) ELSE 0 END AS bytes FROM documents),
r AS (SELECT *, sum(bytes) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM b)
SELECT source, count(*) AS entries, count(*) FILTER (WHERE n <= 4000 AND upto <= 20000) AS kept, CAST(coalesce(sum(bytes) FILTER (WHERE n <= 4000 AND upto <= 20000), 0) AS BIGINT) AS kept_bytes, count(*) FILTER (WHERE NOT (n <= 4000 AND upto <= 20000)) AS omitted FROM r GROUP BY 1""",
)
def f01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.budgeted(table(spark, sf_dir, "documents"), "source", "text", "doc_id", 4000, 20000)


_KEYS = ("title", "Track", "ALBUM", "year", "Album Artist", "performer", "BPM", "comment", "Encoder", "other", "REPLAYGAIN_TRACK_GAIN", "AART")
_FIELDS = ("title", "title", "album", "date", "album_artist", "artist", "bpm", "comments", "writing_library", None, "replaygain_track_gain", "album_artist")


@query(
    "f02_named_keys",
    f"""WITH t AS (SELECT user_id, {[f or "" for f in _FIELDS]}[CAST(event_id % 12 AS INTEGER) + 1] AS field, event_type AS value, event_id FROM events)
SELECT user_id, field, arg_min(value, event_id) AS value, count(*) AS tags FROM t WHERE field <> '' GROUP BY 1, 2""",
)
def f02(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.element_at(F.array(*[F.lit(k) for k in _KEYS]), (F.col("event_id") % 12 + 1).cast("int"))
    tags = table(spark, sf_dir, "events").select("user_id", key.alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("source_order"))
    return M.first_of_each_field(tags, "user_id")


_NOTES = ("Xing joint stereo", "mp3tag v3", "LAME 3.100 320 kbps", "MQA Studio master", "nomqa", "mqaencoder", "see MQA.", "plain")
_NOTE_SQL = f"n AS (SELECT p_partkey AS key, p_name || ' ' || {list(_NOTES)}[CAST(p_partkey % 8 AS INTEGER) + 1] AS note FROM part)"


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.element_at(F.array(*[F.lit(n) for n in _NOTES]), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.concat_ws(" ", "p_name", note).alias("note"))


@query("f03_signatures", f"WITH {_NOTE_SQL} SELECT key, concat_ws(',', " + ", ".join(f"CASE WHEN contains(replace(lower(note), 'mp3tag', ''), '{s}') THEN '{s}' END" for s in M.SIGNATURES) + ") AS found FROM n")
def f03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _notes(spark, sf_dir).select("key", F.array_join(M.signatures(F.col("note")), ",").alias("found"))


@query("f04_bounded_claim", f"WITH {_NOTE_SQL} SELECT key, regexp_matches(lower(note), '(^|[^a-z0-9])mqa($|[^a-z0-9])') OR regexp_matches(lower(note), '(^|[^a-z0-9])mqa\\s*(encoder|encode|studio)($|[^a-z0-9])') AS claim FROM n")
def f04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _notes(spark, sf_dir).select("key", M.bounded_claim(F.col("note")).alias("claim"))


_GAINS = (" -7.25 dB", "+1.5 dB", "", "loud", "-3.0dB", "-9 dB album")


@query(
    "f05_gain_audit",
    f"""WITH s AS (SELECT p_partkey AS key, {list(_GAINS)}[CAST(p_partkey % 6 AS INTEGER) + 1] AS stored, {[-7.25, 1.5, None, None, -3.0, -9.0]}[CAST(p_partkey % 6 AS INTEGER) + 1] AS gain, CASE WHEN p_size % 10 <> 0 THEN -14 - p_size / 4e0 END AS lufs FROM part),
a AS (SELECT key, CASE WHEN trim(stored) = '' THEN 'missing_tag' WHEN lufs IS NULL THEN 'missing_loudness' WHEN gain IS NULL THEN 'invalid_tag' ELSE 'available' END AS status, CAST(gain AS DOUBLE) AS gain, lufs FROM s)
SELECT key, status, CASE WHEN status = 'available' THEN round(gain, 6) END AS gain_db, CASE WHEN status = 'available' THEN round(-18 + gain, 6) END AS implied, CASE WHEN status = 'available' THEN round(abs(-18 + gain - lufs), 6) END AS delta_db,
       CASE WHEN status = 'available' THEN CASE WHEN abs(-18 + gain - lufs) < 1 THEN 'matches' WHEN abs(-18 + gain - lufs) < 3 THEN 'minor_discrepancy' ELSE 'discrepancy' END END AS comparison FROM a""".replace("None", "NULL"),
)
def f05(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = F.element_at(F.array(*[F.lit(g) for g in _GAINS]), (F.col("p_partkey") % 6 + 1).cast("int"))
    lufs = F.when(F.col("p_size") % 10 != 0, -14 - F.col("p_size") / 4.0)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), M.gain_audit(stored, lufs).alias("a")).select("key", "a.*")


@query("f07_digests", "SELECT event_id, sha256(props) AS digest, regexp_full_match(sha256(props), '[0-9a-f]{64}') AS valid FROM events")
def f07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.sha2("props", 256).alias("digest")).withColumn("valid", M.is_digest(F.col("digest")))


@query("f11_canonical_digest", """SELECT n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') AS digest FROM nation""")
def f11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of a record's JSON with its fields in name order."""
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", F.sha2(F.to_json(F.struct(*sorted(n.columns))), 256).alias("digest"))


@query(
    "f12_marker_scan",
    f"""WITH {SERIES_SQL}, b AS (SELECT part, frame, CAST(round((y + 0.5e0) * 100) AS BIGINT) % 2 AS b FROM series),
w AS (SELECT part, frame, b AS b0, lead(b, 1) OVER o AS b1, lead(b, 2) OVER o AS b2, lead(b, 3) OVER o AS b3 FROM b WINDOW o AS (PARTITION BY part ORDER BY frame))
SELECT part, frame FROM w WHERE b0 = 1 AND b1 = 1 AND b2 = 0 AND b3 = 1""",
)
def f12(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = series(spark, sf_dir).select("part", "frame", (F.round((F.col("y") + 0.5) * 100).cast("long") % 2).alias("bit"))
    return M.marker_positions(bits, "1101")


@query("p14_header_observations", """SELECT event_id, abs(value - k) > 0.5e0 AS duration_differs, CASE WHEN k > 0 THEN round(value / k, 10) END AS rate_ratio, event_type IN ('click', 'view') AS known_extension
FROM (SELECT event_id, value, event_type, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)""", digits=10)
def p14(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    return e.select("event_id", (F.abs(F.col("value") - F.col("k")) > 0.5).alias("duration_differs"), F.when(F.col("k") > 0, F.col("value") / F.col("k")).alias("rate_ratio"), F.lower(F.ltrim("event_type")).isin("click", "view").alias("known_extension"))


@query("s13_json_roundtrip", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, true AS same FROM events")
def s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text to record and back, strictly, and once more: both records are the same."""
    shape, strict = "k bigint", {"mode": "FAILFAST"}
    once = table(spark, sf_dir, "events").select("event_id", F.from_json("props", shape, strict).alias("r"))
    return once.select("event_id", F.col("r.k").alias("k"), (F.from_json(F.to_json("r"), shape, strict).k.eqNullSafe(F.col("r.k"))).alias("same"))


@query("s16_exit_status", "SELECT bool_or(event_type = 'error') AS any_failed, CASE WHEN bool_or(event_type = 'error') THEN 1 ELSE 0 END AS exit_code FROM events")
def s16(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.bool_or(F.col("event_type") == "error")
    return table(spark, sf_dir, "events").agg(failed.alias("any_failed"), F.when(failed, 1).otherwise(0).alias("exit_code"))
