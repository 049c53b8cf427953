"""Reports against labelled cases: manifest checks, outcomes, strata with equal group weight, evidence counts, ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from resonant.operators.metadata import is_digest

# Family to evidence domain, and detector id to pattern name.
DOMAINS = {
    "spectral_wall": "spectral_patterns", "spectral_measurements": "spectral_patterns", "spectral_structure": "spectral_patterns",
    "transform_grid": "codec_transforms", "sample_rate_history": "sample_rate_history", "bit_depth": "integer_precision",
    "noise_measurements": "source_profile_measurements", "transient_measurements": "source_profile_measurements",
    "listening_level": "listening_levels", "channel_measurements": "channel_relationships",
}
PATTERNS = {
    "aac_quantization_lattice_mono": "AAC quantization lattice", "aac_quantization_lattice_mid": "AAC quantization lattice", "aac_quantization_lattice_side": "AAC quantization lattice",
    "vorbis_transform_grid": "Vorbis transform grid", "segment_wall": "repeated or mixed spectral walls", "resampling_candidates": "sample-rate hypotheses", "integer_precision": "unused low-order integer bits",
}
STATUSES = ("hit", "measured", "not_detected", "inconclusive", "unsupported")


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def domain_of(family: Column, version: Column) -> Column:
    return F.when(version == 1, F.coalesce(_lookup(DOMAINS, family), F.lit("uninterpreted"))).otherwise("uninterpreted")


def evidence_groups(detectors: DataFrame, key: str) -> DataFrame:
    """Per key and domain: how many detectors have each status, and the distinct names of the patterns that were hit."""
    d = detectors.where(F.col("family") != "mqa_signalling").withColumn("domain", domain_of(F.col("family"), F.col("version")))
    named = F.when((F.col("status") == "hit") & (F.col("domain") != "uninterpreted"), _lookup(PATTERNS, F.col("id")))
    return d.groupBy(key, "domain").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.array_join(F.array_sort(F.collect_set(named)), "; ").alias("patterns"))


def strata(cases: DataFrame, by: tuple[str, ...], group: str = "source_group", outcome: str = "outcome") -> DataFrame:
    """Shares of hit, no hit and abstention in each stratum: within each group first, then over groups with equal weight.
    Abstentions stay in the denominators."""
    kinds = ("hit", "no_hit", "abstain")
    per = cases.groupBy(*by, group).agg(F.count("*").alias("n"), *[F.count_if(F.col(outcome) == k).alias(k) for k in kinds])
    return per.groupBy(*by).agg(F.count("*").alias("groups"), F.sum("n").alias("files"), *[F.avg(F.col(k) / F.col("n")).alias(f"mean_{k}") for k in kinds])


def manifest_violations(cases: DataFrame) -> DataFrame:
    """(violation, id) of cases (id, source_group, split, label, provenance, pcm_hash) that break the manifest's rules."""
    per = lambda c: Window.partitionBy(c)
    hash_ok = F.col("pcm_hash").rlike("^[0-9a-f]{64}$")
    known = ((F.col("label") == "absent") & F.col("provenance").isin("generated_control", "reviewed_history")) | ((F.col("label") == "present") & F.col("provenance").isin("generated_control", "reviewed_history", "recorded_added_stage"))
    marked = cases.withColumns(
        {
            "same_id": F.count("*").over(per("id")),
            "splits": F.size(F.collect_set("split").over(per("source_group"))),
            "hash_groups": F.when(F.col("pcm_hash").isNotNull(), F.size(F.collect_set("source_group").over(per("pcm_hash")))),
        }
    )
    tests = {
        "duplicate case id": F.col("same_id") > 1,
        "group in several splits": F.col("splits") > 1,
        "label and provenance": ~F.coalesce(known | ((F.col("label") == "unknown") & (F.col("split") == "challenge")), F.lit(False)),
        "invalid hash": ~hash_ok,
        "hash in several groups": F.col("hash_groups") > 1,
        "labelled without hash": F.col("pcm_hash").isNull() & (F.col("label") != "unknown"),
    }
    names = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), n) for n, t in tests.items()]))
    return marked.select(F.explode(names).alias("violation"), "id")


def missing_reports(cases: DataFrame, reports: DataFrame, key: str = "id") -> DataFrame:
    """Cases without a report, and those with several."""
    missing = cases.join(reports, key, "left_anti").select(key, F.lit("missing").alias("problem"))
    twice = reports.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").join(cases, key, "left_semi").select(key, F.lit("duplicate").alias("problem"))
    return missing.unionByName(twice)


def leaked_hashes(rows: DataFrame, group: str, digest: str) -> DataFrame:
    """Digests that occur in more than one group, with how many groups and rows; by aggregation, not by pairs."""
    return rows.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.countDistinct(group).alias("groups"), F.count("*").alias("rows")).where("groups > 1")


def submissions(cases: DataFrame, reports: DataFrame) -> DataFrame:
    """id, accepted and reason of every report (id, binding, pcm_hash, seq) for the cases (id, source_group, binding, pcm_hash).

    A report needs a case, must be its first one, be bound as the case is and have its digest, and the digest must not be one
    that cases of another group expect. All at once, by joins and one ordered window; the first reason that holds counts."""
    expected = cases.where("pcm_hash is not null").select("source_group", "pcm_hash").distinct()
    shared = expected.groupBy("pcm_hash").agg(F.count("*").alias("groups")).where("groups > 1").select("pcm_hash", F.lit(True).alias("leaked"))
    own = cases.select("id", F.col("binding").alias("case_binding"), F.col("pcm_hash").alias("case_hash"), F.lit(True).alias("known")).dropDuplicates(["id"])
    nth = F.row_number().over(Window.partitionBy("id").orderBy("seq"))
    r = reports.withColumn("nth", nth).join(own, "id", "left").join(shared, "pcm_hash", "left")
    reason = (
        F.when(F.col("known").isNull(), "unknown case").when(F.col("nth") > 1, "submitted before").when(~F.col("binding").eqNullSafe(F.col("case_binding")), "binding")
        .when(~F.coalesce(is_digest(F.col("pcm_hash")), F.lit(False)), "invalid hash").when(F.col("case_hash").isNotNull() & (F.col("case_hash") != F.col("pcm_hash")), "other hash").when(F.col("leaked"), "hash of another group")
    )
    return r.select("id", "seq", reason.isNull().alias("accepted"), reason.alias("reason"))


def slot_problems(expected: DataFrame, detectors: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Expected slots that don't occur exactly once."""
    counts = detectors.groupBy(*keys).agg(F.count("*").alias("n"))
    return expected.join(counts, list(keys), "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long")).where("n <> 1")


def outcome(analysed: Column, complete: Column, slots_ok: Column, hits: Column, undetected: Column, slots: Column) -> Column:
    """Abstain unless the report is analysed, whole and has each slot once; any hit is a hit; all undetected is none."""
    usable = F.coalesce(analysed & complete & slots_ok, F.lit(False))
    return F.when(~usable, "abstain").when(hits > 0, "hit").when(undetected == slots, "no_hit").otherwise("abstain")


#: The ranking key: column, default for sorting where it is unknown, descending.
RANK_KEY = (("main_score", 999, False), ("rate_history_flag", False, False), ("cutoff_hz", 0.0, True), ("depth_category", 0, False), ("dr", -1, True), ("precision_rate", 0, True))


def rank_variants(variants: DataFrame, track: str, index: str = "input_index") -> DataFrame:
    """Ranks a track's variants, available ones first, by the key; null ranks where available ones are not comparable
    (their compatibility differs). Unknown fields stay null and are listed."""
    by = Window.partitionBy(track)
    order = [F.when(F.col("available"), 0).otherwise(1).asc()]
    for name, default, down in RANK_KEY:
        c = F.coalesce(F.col(name), F.lit(default))
        order.append(c.desc() if down else c.asc())
    same = F.size(F.collect_set(F.when(F.col("available"), F.col("compatibility"))).over(by)) <= 1
    ranked = variants.withColumn("same", same).withColumn("rn", F.row_number().over(by.orderBy(*order, F.col(index).asc())))
    missing = F.array_join(F.array_compact(F.array(*[F.when(F.col(n).isNull(), n) for n, _, _ in RANK_KEY])), ",")
    return ranked.select(track, index, F.when(F.col("same"), F.col("rn")).cast("int").alias("rank"), (F.col("same") & (F.col("rn") == 1) & F.col("available")).alias("winner"), missing.alias("missing_fields"))


def wall_pattern(probes: DataFrame, key: str, eligible: str, wall: str) -> DataFrame:
    """Counts of probes, eligible ones and walls; none, isolated, repeated or mixed."""
    g = probes.groupBy(key).agg(F.count("*").alias("probes"), F.count_if(F.col(eligible)).alias("eligible"), F.count_if(F.col(eligible) & F.col(wall)).alias("walls"))
    pattern = F.when(F.col("eligible") == 0, "unknown").when(F.col("walls") == 0, "none").when(F.col("walls") == 1, "isolated").when(F.col("walls") == F.col("eligible"), "repeated").otherwise("mixed")
    return g.withColumn("pattern", pattern)


def majority(probes: DataFrame, key: str, eligible: str, wall: str) -> DataFrame:
    """Whether half or more of at least three eligible probes have a wall; null with fewer."""
    g = probes.groupBy(key).agg(F.count_if(F.col(eligible)).alias("eligible"), F.count_if(F.col(eligible) & F.col(wall)).alias("walls"))
    return g.withColumn("majority", F.when(F.col("eligible") >= 3, F.col("walls") * 2 >= F.col("eligible")))


def anomaly_regions(probes: DataFrame, key: str, start: str, order: str, cutoff: str, void: str) -> DataFrame:
    """Distinct starts (the last row of one wins), how many, whether many, their median cutoff and any void."""
    last = probes.groupBy(key, start).agg(F.max_by(cutoff, order).alias("c"), F.max_by(void, order).alias("v"))
    return last.groupBy(key).agg(F.count("*").alias("regions"), F.median("c").alias("median_cutoff"), F.bool_or("v").alias("any_void")).withColumn("several", F.col("regions") >= 2).withColumn("many", F.col("regions") >= 4)


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Detector rows of several detectors as one table."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
