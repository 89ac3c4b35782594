"""Comparison of runs: threshold search, effective bets and the guard on evidence levels, against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlake.operators import evidence as e


def curves(spark, n=90, days=60, missing=True, seed=4):
    rng = np.random.default_rng(seed)
    base = rng.normal(0, 0.01, (days, 6))
    rows = []
    for i in range(n):
        x = base[:, i % 6] * (-1 if i % 5 == 0 else 1) + rng.normal(0, 0.002, days)
        x = np.full(days, 0.001) if i == 7 else x
        gone = set(rng.choice(days, 5, replace=False).tolist()) if missing and i % 9 == 0 else set()
        rows += [(f"r{i:03d}", t, float(x[t])) for t in range(days) if t not in gone]
    pdf = pd.DataFrame(rows, columns=["run_id", "t", "net_return"])
    df = spark.createDataFrame(pdf).select("run_id", F.timestamp_seconds(F.col("t") * 86400).alias("timestamp"), "net_return", F.lit(0.0).alias("drawdown"), F.lit("OUT_OF_SAMPLE").alias("evidence_level"))
    wide = pdf.pivot(index="t", columns="run_id", values="net_return")
    wide["r007"] = np.nan  # without spread
    return df, wide.corr(min_periods=2).fillna(0.0)


@pytest.mark.parametrize(("missing", "least"), [(True, 20), (False, 20), (True, 1000)])
def test_close_pairs_are_all_pairs_over_the_threshold(spark, missing, least):
    df, want = curves(spark, missing=missing)
    found = e.close_pairs(df, 0.8, pivots=6, cells=300, least=least).collect()
    pairs = {(a, b): want.loc[a, b] for i, a in enumerate(want.columns) for b in want.columns[i + 1 :] if abs(want.loc[a, b]) >= 0.8}
    assert len(found) == len(pairs) > 300 and {(r.run_id_a, r.run_id_b) for r in found} == set(pairs)
    assert all(abs(r.return_correlation - pairs[r.run_id_a, r.run_id_b]) < 1e-9 for r in found)


def test_tiles_that_cannot_hold_a_close_pair_are_pruned(spark):
    df, _ = curves(spark, missing=False)
    tiles = e.tiles_of(e._points(df.where("run_id <> 'r007'")), pivots=12, cells=300, least=20).cache()
    n = tiles.select("tile").distinct().count()
    assert e.tile_pairs(tiles, 0.8).distinct().count() == e.tile_pairs(tiles, 0.8).count() < 0.6 * n * (n + 1) / 2
    assert e.tile_pairs(tiles, 0.001).count() == n * (n + 1) // 2


@pytest.mark.parametrize("missing", [True, False])
def test_effective_bets_and_promoted(spark, missing):
    df, want = curves(spark, n=30, missing=missing)
    np.fill_diagonal(want.values, 1.0)
    found = e.effective_bets(df, span=16, cells=500).first()[0]
    assert abs(found - len(want) ** 2 / np.square(want.to_numpy()).sum()) < 1e-6
    promoted = df.where("run_id IN ('r003', 'r010')").select("run_id")
    got = {r.run_id: r.maximum_correlation for r in e.max_correlation_to_promoted(df, promoted, cells=400).collect()}
    for run in want.columns:
        assert abs(got[run] - max(abs(want.loc[run, p]) for p in ("r003", "r010") if p != run)) < 1e-9
    assert e.max_correlation_to_promoted(df, promoted.limit(0)).count() == 0


def test_only_one_evidence_level_is_compared(spark):
    df, _ = curves(spark, n=12, missing=False)
    mixed = df.unionByName(df.where("run_id = 'r001'").withColumns({"run_id": F.lit("fit"), "evidence_level": F.lit("IN_SAMPLE")}))
    assert {"fit"} & {r for p in e.close_pairs(mixed, 0.5).collect() for r in p[:2]}
    assert not {"fit"} & {r for p in e.close_pairs(e.evidence_of(mixed), 0.5).collect() for r in p[:2]}
    assert e.evidence_of(mixed, "IN_SAMPLE").select("run_id").distinct().collect()[0][0] == "fit"
    with pytest.raises(ValueError, match="IN_SAMPLE"):
        e.evidence_of(df, "IN_SAMPLE")
    with pytest.raises(ValueError, match="one of"):
        e.evidence_of(df, "LIVE")
    with pytest.raises(ValueError, match="column"):
        e.evidence_of(df.drop("evidence_level"))
