"""Rule scoring over a wide feature row, with three-valued inputs.

A rule is a CASE that tests its inputs in order, so an early decision doesn't ask for later inputs, and an unknown input
that it does ask for makes the rule unknown. Points are null for unknown; a score is null as soon as one of its rules is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The most points that lossy indicators can give, and the scale of the main score.
MOST_POINTS, SCALE = 14, 45.0


def known(*needed: Column) -> Column:
    out = F.lit(True)
    for c in needed:
        out = out & c.isNotNull()
    return out


def points(test: Column, n: int) -> Column:
    """n if it holds, 0 if not, null if unknown."""
    return F.when(test.isNull(), F.lit(None).cast("int")).when(test, n).otherwise(0)


@dataclass(frozen=True)
class Rule:
    id: str
    effect: str
    value: Column


def base_rules() -> list[Rule]:
    """Rules of the columns rate, cutoff, sharpness, cliff, hf, noise, variance, banding, side, entropy, dsd."""
    c = {n: F.col(n) for n in ("cutoff", "sharpness", "cliff", "hf", "noise", "variance", "banding", "side", "entropy", "dsd")}
    n = F.col("rate") / 2.0
    cut = c["cutoff"]
    null = F.lit(None).cast("int")
    weak = F.when((c["sharpness"] > 8), 1)
    cliff = F.when(cut.isNull(), null).when(cut < 0.93 * n, F.when(c["cliff"].isNull(), null).when(c["cliff"] > 35, 3).otherwise(F.when(c["cliff"] > 20, 1).otherwise(F.coalesce(weak, F.lit(0))))).otherwise(F.coalesce(weak, F.lit(0)))
    band = F.when(cut < 0.8 * n, points(c["banding"] > 0.92, 1)).when(cut.isNotNull(), 0)
    wide = F.when(cut > 0.85 * n, points(c["hf"] > 0.05, 1) + points(c["entropy"] > 8.5, 1)).when(cut.isNotNull(), 0)
    return [
        Rule("R01", "lossy", F.when(cut.isNull(), null).otherwise(points((cut < 0.85 * n) & (cut < 18500), 2))),
        Rule("R02", "lossy", F.when(c["sharpness"].isNull(), null).when(c["sharpness"] > 15, 3).otherwise(cliff)),
        Rule("R03", "lossy", points(c["hf"] < 0.005, 1)),
        Rule("R04", "lossy", F.when(c["noise"].isNull(), null).when(c["noise"] < -70, 3).when(c["noise"] < -40, 1).otherwise(0)),
        Rule("R05", "lossy", F.when(cut >= 0.85 * n, 0).when(cut.isNotNull(), points(c["variance"] < 1000, 1))),
        Rule("R06", "lossy", band + points(c["side"] > 0.60, 2)),
        Rule("R07", "natural", F.when(c["dsd"].isNull(), null).when(c["dsd"] != 0, 0).otherwise(points(c["noise"] > -50, 1) + wide)),
        Rule("R08", "natural", points(c["sharpness"] < 5, 1) + points(c["side"] < 0.2, 1) + F.when(cut > 0.85 * n, points(c["variance"] > 10000, 1)).when(cut.isNotNull(), 0)),
    ]


def scores(features: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """lossy, natural, net, raw percentage and main score of each row; null while an input is missing."""
    rules = base_rules()
    total = lambda effect: sum((r.value for r in rules if r.effect == effect), F.lit(0)).cast("int")
    s = features.select(*keys, total("lossy").alias("lossy"), total("natural").alias("natural"))
    net = F.when(known(F.col("lossy"), F.col("natural")), F.greatest(F.col("lossy") - F.col("natural"), F.lit(0)))
    s = s.withColumn("net", net.cast("int"))
    return s.select(
        *keys, "lossy", "natural", "net",
        F.least(F.col("lossy") * 100.0 / MOST_POINTS, F.lit(100.0)).alias("raw_lossy_pct"),
        F.rint(F.col("net") * SCALE / MOST_POINTS).cast("int").alias("main"),
        F.when(F.col("net").isNull(), "partial").otherwise("available").alias("status"),
    )


def trace(features: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row for each rule: its points and whether it applied, was not triggered, or lacked an input. R11, R13 and R32 are
    excluded by contract and say so."""
    rows = [F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.effect).alias("effect"), r.value.cast("int").alias("result"), F.when(r.value.isNull(), "missing_input").when(r.value != 0, "applied").otherwise("not_triggered").alias("state")) for r in base_rules()]
    rows += [F.struct(F.lit(i).alias("rule_id"), F.lit("none").alias("effect"), F.lit(None).cast("int").alias("result"), F.lit("excluded_by_contract").alias("state")) for i in ("R11", "R13", "R32")]
    return features.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.*")


@dataclass(frozen=True)
class Adjustment:
    """A later step of the main score: an addition, a floor, or a deduction that vetoes what follows it."""

    id: str
    kind: str
    test: Column
    amount: int
    unless: Column | None = None


def adjusted(base: DataFrame, steps: list[Adjustment], score: str = "main") -> DataFrame:
    """The score after all steps in order, held between 0 and 100; a vetoed step changes nothing; unknown tests make it unknown."""
    value = F.col(score)
    for s in steps:
        hit = s.test & ~s.unless if s.unless is not None else s.test
        # greatest() passes over nulls; an unknown score stays unknown
        new = F.when(value.isNotNull(), F.greatest(value, F.lit(s.amount))) if s.kind == "floor" else value + s.amount
        value = F.when(hit.isNull(), F.lit(None).cast("int")).when(hit, new).otherwise(value)
    held = F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(0)), F.lit(100)))
    return base.withColumn("adjusted", held.cast("int"))


def verdict(main: Column, known_lossy: Column, resample_rate: Column, fake: Column) -> Column:
    """The first that holds of the cascade."""
    return (
        F.when(known_lossy, "CAUTION")
        .when(main.isNull(), "INCONCLUSIVE")
        .when(main >= 86, "LIKELY_LOSSY")
        .when(resample_rate > 0, "SUSPICIOUS")
        .when(fake, "SUSPICIOUS")
        .when(main >= 55, "SUSPICIOUS")
        .when(main >= 31, "CAUTION")
        .when(main >= 11, "LIKELY_GENUINE")
        .otherwise("GENUINE")
    )


def codec_adjustments() -> list[Adjustment]:
    """Steps of the columns resample_rate, fake_bandwidth, majority_wall, cassette, aac_score, vorbis_score and rate."""
    r = F.col("rate").isin(44100, 48000)
    cassette = F.col("cassette")
    return [
        Adjustment("R10", "add", F.col("resample_rate") > 0, 45),
        Adjustment("R16", "add", cassette, -40),
        Adjustment("R17", "add", F.col("fake_bandwidth"), 20),
        Adjustment("R18", "add", F.col("majority_wall"), 55, cassette),
        Adjustment("R29a", "add", r & (F.col("aac_score") >= 0.10), 55, cassette),
        Adjustment("R29b", "add", r & (F.col("aac_score") >= 0.06) & (F.col("aac_score") < 0.10), 15, cassette),
        Adjustment("R30", "floor", r & (F.col("vorbis_score") >= 0.03), 55),
    ]


def depth_label(declared: Column, used: Column) -> Column:
    """Declared against used bits: unknown, padded by eight bits or more, padded by fewer, or whole."""
    return F.when(declared.isNull() | used.isNull(), "unknown").when(used + 8 <= declared, "⚠ padded").when(used < declared, "~ partly used").otherwise("full")


def either(a: Column, b: Column) -> Column:
    """Three-valued or."""
    return a | b


def unless(veto: Column, value: Column) -> Column:
    """0 under a veto, unknown under an unknown one, else the value."""
    return F.when(veto, 0).when(veto.isNull(), F.lit(None).cast("int")).otherwise(value)


def tape_decision(score: Column, hiss: Column, comb: Column, slope_points: Column, flutter_points: Column) -> Column:
    """Whether a transfer from tape is likely; where inputs are missing, only if every value that they could have says the same."""
    comb_points = F.when(comb, 0).when(~comb, 15)
    low = F.when(hiss, 30).otherwise(0) + F.coalesce(slope_points, F.lit(-20)) + F.coalesce(flutter_points, F.lit(-10)) + F.coalesce(comb_points, F.lit(0))
    high = F.lit(30) + F.coalesce(slope_points, F.lit(20)) + F.coalesce(flutter_points, F.lit(15)) + F.coalesce(comb_points, F.lit(15))
    return F.when(~hiss, False).when(score.isNotNull(), (score >= 30) & hiss).when(high < 30, False).when(hiss & (low >= 30), True)


def ledger(features: DataFrame, base: str = "main") -> DataFrame:
    """Points of the later rules (r10 to r30), the decisions that veto others, and the final score of each row.

    Columns beside those of the base rules: resample_rate, preecho, comb, hiss, hiss_corr, slope, void, silence_seconds,
    silence_ratio, vinyl_noise, vinyl_corr, vinyl_std, clicks, bound, phase, sparsity, envelope, fingerprint, majority,
    anomalies, single_matches, any_void, median_matches, wall, aac_score, vorbis_score.
    """
    c = F.col
    ny, cut, null = c("rate") / 2.0, c("cutoff"), F.lit(None).cast("int")
    asks = lambda test, early, then: F.when(test.isNull(), null).when(test, early).otherwise(then)
    steps = lambda v, *pairs: F.when(v.isNull(), null).otherwise(F.coalesce(*[F.when(t, n) for t, n in pairs], F.lit(0)))

    d = features.withColumns({
        "r10": points(c("resample_rate") > 0, 45),
        "r12": asks(cut >= 21000, 0, steps(c("preecho"), (c("preecho") > 10, 15), (c("preecho") >= 5, 10))),
        "r14": asks(cut >= 21000, 0, points(c("comb"), 10)),
        "tape_hiss": F.when(cut.isNull(), F.lit(None).cast("boolean")).when(cut >= 19000, False).when(F.least(F.lit(20000.0), ny - 100) <= cut + F.when(cut < 16000, 1000.0).otherwise(500.0), False)
        .when(c("hiss").isNull(), F.lit(None).cast("boolean")).when(c("hiss") <= -55, False).otherwise(c("hiss_corr") < 0.2),
        "slope_points": steps(c("slope"), ((c("slope") > -6) & (c("slope") < -3), 20), (c("slope") < -10, -20)),
        "flutter_points": steps(c("variance"), ((F.sqrt("variance") > 50) & (F.sqrt("variance") < 300), 15), (F.sqrt("variance") < 30, -10)),
    })
    r15 = asks(cut >= 19000, 0, F.when(c("tape_hiss").isNull(), null).when(c("tape_hiss"), 30).otherwise(0) + c("slope_points") + F.when(c("comb"), 0).when(~c("comb"), 15) + c("flutter_points"))
    d = d.withColumn("r15", r15).withColumn("cassette", tape_decision(c("r15"), c("tape_hiss"), c("comb"), c("slope_points"), c("flutter_points")))
    d = d.withColumns({
        "r16": points(c("cassette"), -40),
        "r17": F.when(c("rate") < 88200, 0).otherwise(asks((cut <= 0) | (cut >= 0.6 * ny), 0, asks(c("cliff") <= 25, 0, asks(c("resample_rate") > 0, 0, points(c("void") < -80, 20))))),
        "r18": unless(c("cassette"), points(c("majority"), 55)),
        "segment_veto": either(c("cassette"), c("majority")),
    }).withColumns({
        "r19": unless(c("segment_veto"), points((c("anomalies") == 1) & c("single_matches"), 25)),
        "r20": unless(c("segment_veto"), asks(c("anomalies") < 2, 0, F.when(c("anomalies") >= 4, 40).otherwise(30) + points(c("any_void"), 25) + points(c("median_matches"), 15))),
        "r21": unless(c("cassette"), asks((c("silence_seconds") < 2) | (ny - 100 < 16000), 0, points(c("silence_ratio") > 0.3, 50))),
    })
    d = d.withColumn("dirty", c("r21") > 0)
    geometry = ((cut > 0) & (cut < 0.93 * ny) & (ny - 100 - (cut + 800) >= 400)) | ((cut > 0) & (cut < ny - 2100))
    looks_vinyl = F.when(c("vinyl_corr") >= 0.3, False).when(c("vinyl_corr").isNotNull(), c("vinyl_std") < 5)
    silent = c("vinyl_noise") < -70
    record = F.when(looks_vinyl.isNull(), null).when(looks_vinyl, F.when(c("clicks").isNull(), null).when((c("clicks") >= 5) & (c("clicks") <= 50), -50).otherwise(-40)).otherwise(0)
    d = d.withColumn("r22_veto", either(c("cassette"), c("dirty"))).withColumn(
        "r22", unless(c("r22_veto"), asks(~geometry, 0, F.when(silent.isNull(), null).when(silent, asks(cut >= 22500, 0, points(c("cliff") > 25, 20))).otherwise(record)))
    )
    vinyl = F.when(c("cassette").isNull() | c("dirty").isNull() | c("r22").isNull(), F.lit(None).cast("boolean")).otherwise(~c("r22_veto") & (c("r22") < 0))
    clean = (c("wall") <= 16500) & (cut > 0.85 * ny) & (c("resample_rate") == 0) & ~c("majority") & (c("silence_seconds") >= 2) & (ny - 100 >= 16000) & (c("silence_ratio") >= 0) & (c("silence_ratio") < 0.15)
    d = d.withColumn("vinyl", vinyl).withColumn("analog", either(c("cassette"), c("vinyl"))).withColumns({
        "r23": unless(c("cassette"), points(clean, -30)),
        "r24": unless(c("analog"), asks(~c("fingerprint"), 0, F.when(c("cliff").isNull(), null).when(c("cliff") > 30, 10).otherwise(points(c("void") < -85, 10)))),
        "r25": unless(c("analog"), F.when(c("rate") < 40000, 0).otherwise(points((c("bound") > 0) & (c("bound") < 16500), 25))),
        "r26": asks((cut >= 0.85 * ny) | (cut >= 22500), 0, asks(c("cliff") <= 25, 0, points(c("phase") > 4.5, 10))),
        "r27": asks(cut >= 0.95 * ny, 0, points(c("sparsity") > 0.30, 10)),
        "r28": asks(cut <= 16500, 0, asks((c("bound") <= 0) | (c("bound") >= cut - 2000), 0, points(c("envelope") < 0.15, 15))),
        "r29": unless(c("cassette"), F.when(~c("rate").isin(44100, 48000), 0).otherwise(steps(c("aac_score"), (c("aac_score") >= 0.10, 55), (c("aac_score") >= 0.06, 15)))),
    })
    added = ("r10", "r12", "r14", "r16", "r17", "r18", "r19", "r20", "r21", "r22", "r23", "r24", "r25", "r26", "r27", "r28", "r29")
    total = sum((c(r) for r in added), c(base))
    floor = F.when(~c("rate").isin(44100, 48000), False).otherwise(c("vorbis_score") >= 0.03)
    held = F.when(total.isNull() | floor.isNull(), null).otherwise(F.least(F.greatest(F.when(floor, F.greatest(total, F.lit(55))).otherwise(total), F.lit(0)), F.lit(100)))
    return d.withColumn("score", held.cast("int")).drop("tape_hiss", "slope_points", "flutter_points", "segment_veto", "r22_veto")
