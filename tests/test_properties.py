"""Metamorphic checks: the past does not see the future, symbols do not see each other, splits conserve turnover."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barlake.operators import actions as ca
from barlake.operators import features as ft
from barlake.operators import signals as g
from barlake.operators.learned import NAMES, fit_folds
from tests.test_blocks import walk


def rows(df, cut="2020-03-20"):
    return df.filter(F.col("timestamp") < cut).toPandas().sort_values(["symbol", "timestamp"]).reset_index(drop=True)


def test_future_does_not_move_the_past(spark):
    base = walk(120, "A", 1)
    moved = base.copy()
    moved.loc[80:, ["open", "high", "low", "close"]] *= 5
    a, b = (rows(ft.build_features(spark.createDataFrame(p))) for p in (base, moved))
    pd.testing.assert_frame_equal(a, b)
    a, b = (rows(g.donchian_trend(spark.createDataFrame(p))) for p in (base, moved))
    pd.testing.assert_frame_equal(a, b)


def test_other_symbols_and_row_order_do_not_matter(spark):
    a, b = walk(100, "A", 1), walk(100, "B", 2)
    alone = rows(ft.build_features(spark.createDataFrame(a)))
    mixed = rows(ft.build_features(spark.createDataFrame(pd.concat([b, a]).sample(frac=1, random_state=0))).filter("symbol = 'A'"))
    pd.testing.assert_frame_equal(alone, mixed)


def test_split_keeps_turnover_and_ex_date_is_unadjusted(spark):
    bars = spark.createDataFrame(walk(20, "A", 1)).withColumn("adjustment", F.lit("UNADJUSTED"))
    acts = spark.createDataFrame([("A", "2020-01-11", "SPLIT", 2.0, None)], "symbol string, ex_date string, action_type string, share_multiplier double, dividend_amount double")
    acts = acts.withColumn("ex_date", F.col("ex_date").cast("date"))
    out = ca.adjust_bars(bars, acts, "SPLIT_ADJUSTED").toPandas().sort_values("timestamp").reset_index(drop=True)
    raw = walk(20, "A", 1)
    np.testing.assert_allclose(out["close"][:10], raw["close"][:10] / 2)
    np.testing.assert_allclose(out["close"][10:], raw["close"][10:])
    np.testing.assert_allclose(out["close"] * out["volume"], raw["close"] * raw["volume"])


def test_reverse_adjustment_is_refused(spark):
    bars = spark.createDataFrame(walk(5, "A", 1))
    try:
        ca.adjust_bars(bars, bars, "UNADJUSTED", "SPLIT_ADJUSTED")
    except ValueError as error:
        assert "cannot convert" in str(error)
    else:
        raise AssertionError("conversion was allowed")


def test_basis_detection_sees_raw_and_adjusted_splits(spark):
    def series(symbol, ratio):
        f = walk(20, symbol, 4)
        f[["open", "high", "low", "close"]] = 100.0
        f.loc[10:, ["open", "high", "low", "close"]] = 100.0 / ratio
        return f
    bars = spark.createDataFrame(pd.concat([series("RAW", 10.0), series("ADJ", 1.0), series("ODD", 3.3)]))
    acts = spark.createDataFrame([(s, "2020-01-11", "SPLIT", 10.0, None) for s in ("RAW", "ADJ", "ODD")], "symbol string, ex_date string, action_type string, share_multiplier double, dividend_amount double")
    days = spark.range(40).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("session_date"))
    found = ca.detect_basis(bars, acts.withColumn("ex_date", F.col("ex_date").cast("date")), days).collect()
    assert {r.symbol: r.detection for r in found} == {"RAW": "UNADJUSTED", "ADJ": "SPLIT_ADJUSTED", "ODD": "AMBIGUOUS"}


def test_logistic_folds_match_direct_fit(spark):
    rng = np.random.default_rng(0)
    n = 1500
    x = rng.normal(size=(n, 4)) * [1, 2, 0.5, 3]
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.3 + x @ [0.8, -0.3, 0.2, 0.0])))).astype(float)
    known = np.sort(rng.integers(0, 1000, n))
    rows_ = spark.createDataFrame(pd.DataFrame({**{c: x[:, i] for i, c in enumerate(NAMES)}, "label": y, "known_us": known})).repartition(3)
    beta, center, scale, usable = fit_folds(rows_, np.array([100, 500, 1000]), minimum=500)
    assert usable.tolist() == [False, True, True]
    for f, date in ((1, 500), (2, 1000)):
        use = known <= date
        z = np.column_stack([np.ones(use.sum()), (x[use] - x[use].mean(0)) / x[use].std(0)])
        p = 1 / (1 + np.exp(-z @ beta[f]))
        np.testing.assert_allclose(z.T @ (p - y[use]) + np.r_[0, beta[f][1:]], 0, atol=1e-6)
