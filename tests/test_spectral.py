"""Spectral queries on spectra too flat for correlations."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from resonant.operators import spectral as P
from resonant.plans.catalogue import ORACLE_SQL, QUERIES


def test_flat_channels_have_no_peaks_but_a_row(spark, tmp_path):
    rng = np.random.default_rng(3)
    flat = [(i, 0, [1.0 + 1e-4 * float(x) for x in rng.random(64)]) for i in range(20)]
    rough = [(100 + i, 1, [float(x) for x in rng.random(64)]) for i in range(20)]
    comb = [(200 + i, 2, [1.0 if k % 8 == 0 else 0.1 for k in range(64)]) for i in range(20)]
    spark.createDataFrame(flat + rough + comb, "vec_id long, label int, embedding array<double>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("a18_spectral_lags", "a24_comb_peaks"):
        got = QUERIES[name](spark, str(tmp_path))
        want = db.execute(ORACLE_SQL[name])
        names = [d[0] for d in want.description]
        assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(want.fetchall(), key=repr)
    assert [tuple(r) for r in got.select("channel", "peaks", "comb").where("channel <> 1").orderBy("channel").collect()] == [(0, 0, False), (2, 3, True)]


def test_lags_without_a_neighbour_are_no_candidates(spark):
    rows = [(0, 8, None), (0, 9, None), (1, 8, 0.9), (1, 10, 0.1), (2, 8, 0.9), (2, 9, None), (3, 7, 0.1), (3, 8, 0.9), (3, 15, 0.1), (3, 16, 0.9)]
    lags = spark.createDataFrame(rows, "channel long, lag long, correlation double").withColumn("pairs", F.lit(9))
    assert sorted(map(tuple, P.comb_peaks(lags, (8, 16), 0.05, 1.2).collect())) == [(0, 0, False), (2, 0, False), (3, 2, True)]
