"""Three-valued scoring, verdict steps, ranking, claims and audits on small cases."""

import pytest
from pyspark.sql import functions as F

from resonant.functions.levels import trailing_zeros
from resonant.operators import evaluation as E
from resonant.operators import lookups as L
from resonant.operators import metadata as M
from resonant.operators import rules as R

FEATURES = "key int, rate long, cutoff double, sharpness double, cliff double, hf double, noise double, variance double, banding double, side double, entropy double, dsd int"


def test_scores_round_half_to_even_and_stay_unknown(spark):
    rows = [
        (1, 44100, 15000.0, 20.0, None, 0.001, -80.0, 10.0, 0.95, 0.7, 5.0, 0),  # early decision: cliff isn't asked for
        (2, 44100, 15000.0, 9.0, None, 0.001, -80.0, 10.0, 0.95, 0.7, 5.0, 0),  # cliff is asked for and unknown
        (3, 44100, 21000.0, 1.0, 0.0, 0.1, -45.0, 20000.0, 0.5, 0.1, 9.0, 0),
    ]
    got = {r.key: (r.lossy, r.natural, r.net, r.main, r.status) for r in R.scores(spark.createDataFrame(rows, FEATURES), ("key",)).collect()}
    assert got[1] == (2 + 3 + 1 + 3 + 1 + 3, 0, 13, 42, "available")
    assert got[2][0] is None and got[2][3] is None and got[2][4] == "partial"
    assert got[3] == (1, 3 + 3, 0, 0, "available")


@pytest.mark.parametrize("net, want", [(0, 0), (1, 3), (7, 22), (14, 45)])
def test_main_score_of_net(spark, net, want):
    assert spark.range(1).select(F.rint(F.lit(net) * R.SCALE / R.MOST_POINTS).cast("int")).first()[0] == want


@pytest.mark.parametrize("main, resample, fake, want", [(86, 0, False, "LIKELY_LOSSY"), (85, 44100, False, "SUSPICIOUS"), (85, 0, True, "SUSPICIOUS"), (55, 0, False, "SUSPICIOUS"), (54, 0, False, "CAUTION"), (31, 0, False, "CAUTION"), (30, 0, False, "LIKELY_GENUINE"), (11, 0, False, "LIKELY_GENUINE"), (10, 0, False, "GENUINE"), (None, 0, False, "INCONCLUSIVE")])
def test_verdict_steps(spark, main, resample, fake, want):
    got = spark.range(1).select(R.verdict(F.lit(main).cast("int"), F.lit(False), F.lit(resample), F.lit(fake))).first()[0]
    assert got == want


def test_veto_and_floor(spark):
    base = spark.createDataFrame([(1, 50, True), (2, 50, False), (3, None, False)], "key int, main int, cassette boolean")
    steps = [R.Adjustment("a", "add", F.lit(True), 30, F.col("cassette")), R.Adjustment("b", "floor", F.lit(True), 60)]
    assert {r.key: r.adjusted for r in R.adjusted(base, steps).collect()} == {1: 60, 2: 80, 3: None}


def test_nearest_wall_takes_the_first_of_equally_near_ones(spark):
    v = spark.createDataFrame([(1, 20355.0), (2, 9000.0), (3, 20365.0)], "key int, hz double")
    got = {r.key: (r.codec, r.wall) for r in L.nearest(v, "key", "hz", 21609.0).collect()}
    assert got == {1: ("Opus", 20460.0), 3: ("Opus", 20460.0)}
    assert L.within_tolerance(v, "key", "hz", 21609.0).where("key = 1").count() == 2


def test_ranking_with_unknown_fields_and_incompatible_variants(spark):
    shape = "track int, input_index int, available boolean, main_score int, rate_history_flag boolean, cutoff_hz double, depth_category int, dr int, precision_rate long, compatibility string"
    rows = [
        (1, 0, True, 10, False, 20000.0, 0, 9, 1, "a"),
        (1, 1, True, 10, False, 21000.0, 0, 9, 1, "a"),
        (1, 2, False, 0, False, 22000.0, 0, 9, 1, "b"),
        (1, 3, True, None, None, None, None, None, None, "a"),
        (2, 0, True, 1, False, 1.0, 0, 1, 1, "a"),
        (2, 1, True, 2, False, 1.0, 0, 1, 1, "b"),
    ]
    got = {(r.track, r.input_index): (r["rank"], r.winner, r.missing_fields) for r in E.rank_variants(spark.createDataFrame(rows, shape), "track").collect()}
    assert [got[1, i][0] for i in range(4)] == [2, 1, 4, 3] and got[1, 1][1]
    assert got[1, 3][2].split(",") == [n for n, _, _ in E.RANK_KEY]
    assert got[2, 0] == (None, False, "") and got[2, 1][0] is None


@pytest.mark.parametrize("text, want", [("MQA", True), ("amqa", False), ("mqa-studio", True), ("mqaencoder", True), ("mqaencoders", False), ("mqa  Studio", True), ("x MQA.", True), ("mqa1", False), ("", False)])
def test_bounded_claim(spark, text, want):
    assert spark.range(1).select(M.bounded_claim(F.lit(text))).first()[0] is want


@pytest.mark.parametrize("stored, lufs, status, kind", [("-7.0 dB", -25.0, "available", "matches"), ("-7.0 dB", -24.0, "available", "minor_discrepancy"), ("-7.0 dB", -22.0, "available", "discrepancy"), ("  ", -10.0, "missing_tag", None), ("-7", None, "missing_loudness", None), ("loud", -10.0, "invalid_tag", None), ("+1.5dB", -16.0, "available", "matches"), ("--3", -10.0, "invalid_tag", None)])
def test_gain_audit(spark, stored, lufs, status, kind):
    r = spark.range(1).select(M.gain_audit(F.lit(stored), F.lit(lufs).cast("double")).alias("a")).first().a
    assert (r.status, r.comparison) == (status, kind)


def test_abstentions_stay_in_denominators_and_groups_weigh_the_same(spark):
    rows = [("s", "g1", "hit"), ("s", "g1", "abstain"), ("s", "g2", "hit")]
    r = E.strata(spark.createDataFrame(rows, "k string, source_group string, outcome string"), ("k",)).first()
    assert (r.groups, r.files, r.mean_hit, r.mean_abstain) == (2, 3, 0.75, 0.25)


def test_trailing_zeros(spark):
    df = spark.createDataFrame([(1,), (8,), (-16,), (-(1 << 31),)], "w long").select(trailing_zeros(F.col("w")))
    assert [r[0] for r in df.collect()] == [0, 3, 4, 31]
