"""Window operators against loops, and at their edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from resonant.operators import aggregates as A
from resonant.operators import windows as W
from resonant.plans.catalogue import QUERIES
from resonant.sources.bindings import series
from tests.conftest import DATA


def make(spark, values, part=1):
    return spark.createDataFrame([(part, i, float(v)) for i, v in enumerate(values)], "part long, frame long, x double")


@pytest.mark.parametrize("n, want", [(7, 0), (8, 0), (9, 1), (12, 1), (13, 2)])
def test_a_frame_needs_a_sample_after_it(spark, n, want):
    assert W.hopping_frames(make(spark, range(n)), 8, 4).count() == want


def test_runs_of_exactly_the_least_length_count(spark):
    s = make(spark, [0, 0, 9, 0, 0, 0, 9, 0])
    got = [(r.start, r.end, r.length) for r in W.runs(s, F.abs("x") < 1, 3).collect()]
    assert got == [(3, 6, 3)]


def test_plateau_counts_once_at_its_middle(spark):
    s = make(spark, [0, 2, 2, 2, 1, 3, 3, 0, 5])
    assert sorted((r.frame, r.value) for r in W.local_maxima(s, F.col("x")).collect()) == [(2, 2.0), (5, 3.0)]


def test_spaced_by_height_matches_greedy_loop(spark):
    peaks = W.local_maxima(series(spark, DATA), F.abs("x"))
    got = {(r.part, r.frame) for r in W.spaced_by_height(peaks, 5).collect()}
    by_part = {}
    for r in peaks.collect():
        by_part.setdefault(r.part, []).append((r.value, r.frame))
    want = set()
    for part, rows in by_part.items():
        kept = []
        for v, f in sorted(rows, key=lambda x: (-x[0], -x[1])):
            if all(abs(f - k) >= 5 for k in kept):
                kept.append(f)
        want |= {(part, f) for f in kept}
    assert got == want


def test_ring_floor_matches_loop(spark):
    got = {(r.part, r.frame): r.floor for r in QUERIES["w06_noise_floor_ring"](spark, DATA).collect()}
    rows = {}
    for r in series(spark, DATA).collect():
        rows.setdefault(r.part, []).append((r.frame, abs(r.x)))
    for part, xs in rows.items():
        v = [x for _, x in sorted(xs)]
        least = None
        for i in range(len(v)):
            if i >= 5:
                m = max(v[i - 5 : i + 1])
                least = m if least is None else min(least, m)
            assert got[part, i] == (None if least is None else pytest.approx(round(least, 6)))


def test_stateful_stream_matches_loop(spark):
    got = {(r.user_id, r.k): r.level for r in QUERIES["t_stateful_filter"](spark, DATA).collect()}
    levels, counts = {}, {}
    for r in spark.read.parquet(f"{DATA}/events.parquet").orderBy("ts", "event_id").collect():
        levels[r.user_id] = levels.get(r.user_id, 0.0) + 0.25 * (r.value - levels.get(r.user_id, 0.0))
        counts[r.user_id] = counts.get(r.user_id, 0) + 1
        assert got[r.user_id, counts[r.user_id]] == pytest.approx(levels[r.user_id], abs=1e-6)


def test_levels_of_silence_are_null_not_infinite(spark):
    row = A.series_stats(make(spark, [0, 0, 0])).first()
    assert row.peak == 0 and row.crest_db is None and row.zeros == 3


def test_empty_series(spark):
    s = make(spark, []).withColumn("y", F.col("x")).withColumn("hit", F.lit(True))
    for df in (A.series_stats(s), W.runs(s, F.lit(True), 1), W.local_maxima(s, F.col("x")), A.gated_level(s, 2), A.interpolated_peak(s.select("part", "frame", "x")), W.lookback(s, 6, 3, 8)):
        assert df.count() == 0


def test_gated_level_of_a_steady_tone(spark):
    x = np.sin(2 * np.pi * np.arange(400) / 8)
    row = A.gated_level(make(spark, x), hop=8, momentary=4, short=30).first()
    assert row.level == pytest.approx(-0.691 + 10 * np.log10(0.5), abs=1e-9)
    assert row.abs_gated == row.blocks == row.rel_gated


def test_loudest_apart_matches_a_loop(spark):
    rows = [(r.part, r.block, r.ms) for r in W.tumbling_blocks(series(spark, DATA), 4).select("part", "block", "ms").collect()]
    want = set()
    for part in {p for p, _, _ in rows}:
        kept = []
        for block, ms in sorted(((b, m) for p, b, m in rows if p == part), key=lambda x: (-x[1], x[0])):
            if len(kept) < 3 and all(abs(block - k) > 2 for k in kept):
                kept.append(block)
        want |= {(part, b) for b in kept}
    assert {(r.part, r.block) for r in QUERIES["o02_loudest_apart"](spark, DATA).collect()} == want


def test_spacing_matches_loops_across_batches(spark):
    rng = np.random.default_rng(2)
    rows = [(p, int(f), float(v)) for p in (1, 2) for f, v in zip(np.cumsum(rng.integers(1, 9, 3000)), rng.integers(0, 50, 3000), strict=True)]
    peaks = spark.createDataFrame(rows, "part long, frame long, value double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {(r.part, r.frame) for r in W.spaced_in_order(peaks, 7).collect()}
        high = {(r.part, r.frame) for r in W.spaced_by_height(peaks, 7).collect()}
        order = peaks.selectExpr("part", "frame", "value AS x").repartition("part").sortWithinPartitions("part", "frame")
        floor = {(r.part, r.frame): r.floor for r in order.mapInPandas(lambda it: W.stateful_noise_floor(it, 6), "part long, frame long, floor double").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for p in (1, 2):
        own = [(f, v) for q, f, v in rows if q == p]
        last, kept = None, set()
        for f, _ in own:
            if last is None or f - last >= 7:
                kept.add((p, f))
                last = f
        assert {x for x in got if x[0] == p} == kept
        tall = []
        for f, v in sorted(own, key=lambda x: (-x[1], -x[0])):
            if all(abs(f - k) >= 7 for k in tall):
                tall.append(f)
        assert {f for q, f in high if q == p} == set(tall)
        least = None
        for i, (f, _) in enumerate(own):
            if i >= 5:
                m = max(v for _, v in own[i - 5 : i + 1])
                least = m if least is None else min(least, m)
            assert floor[p, f] == least


def test_level_median_bounds_the_median(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([np.zeros(3), rng.lognormal(-3, 2, 501)])
    row = W.level_median(make(spark, x), "part", F.col("x"), -180.0, 40.0, 20.0, 1e-9).first()
    assert row.n == 504 and row.lower <= np.median(x) <= row.upper <= row.lower * 1.04
