"""Walk-forward logistic ranking, fitted for all rebalance dates at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.functions.windows import INDEX, full
from barlake.operators import features as ft
from barlake.operators.signals import rank_and_weight
from barlake.session import staged

NAMES = ("momentum_21", "momentum_126", "volatility_20", "volume_change")


def learning_frame(panel: DataFrame, horizon: int = 20) -> DataFrame:
    """Features, the label that becomes known ``horizon`` rows later, and when it is known."""
    s = ft.series(panel, "symbol", ("timestamp",), lookback=127, lookahead=horizon)
    s = s.with_columns({"_ret": ft.change(s, "close")})
    ahead = F.lead("close", horizon).over(s.w)
    future = ahead / F.nullif(F.col("close"), F.lit(0.0)) - 1
    return s.with_columns({
        "momentum_21": ft.change(s, "close", 21), "momentum_126": ft.change(s, "close", 126),
        "volatility_20": full(s, F.stddev_pop("_ret"), "_ret", 20), "volume_change": ft.change(s, "volume", 20),
        "label": F.when(future.isNotNull(), (future > 0).cast("double")), "label_available_at": F.lead("timestamp", horizon).over(s.w),
    }).done(keep_index=True)


def _moments(rows: DataFrame, dates: np.ndarray) -> pd.DataFrame:
    """Count, positives, sums and squares of each fold's training rows, as map-side partial sums."""
    k = len(NAMES)
    schema = "fold int, n double, pos double, " + ", ".join(f"{p}{i} double" for p in "sq" for i in range(k))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(dates), 2 + 2 * k))
        for pdf in batches:
            x, y, known = pdf[list(NAMES)].to_numpy(), pdf["label"].to_numpy(), pdf["known_us"].to_numpy()
            mask = (known[None, :] <= dates[:, None]).astype(float)
            total += mask @ np.column_stack([np.ones(len(y)), y, x, x * x])
        yield pd.DataFrame(total, columns=["n", "pos", *[f"{p}{i}" for p in "sq" for i in range(k)]]).assign(fold=np.arange(len(dates)))[
            ["fold", "n", "pos", *[f"{p}{i}" for p in "sq" for i in range(k)]]]

    parts = rows.mapInPandas(run, schema)
    return parts.groupBy("fold").agg(*[F.sum(c).alias(c) for c in parts.columns[1:]]).orderBy("fold").toPandas()


def _newton_step(rows: DataFrame, dates: np.ndarray, center: np.ndarray, scale: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of every fold at its current weights, one pass over the rows."""
    m = beta.shape[1]
    cols = [f"g{i}" for i in range(m)] + [f"h{i}" for i in range(m * m)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grad, hess = np.zeros((len(dates), m)), np.zeros((len(dates), m * m))
        for pdf in batches:
            x, y, known = pdf[list(NAMES)].to_numpy(), pdf["label"].to_numpy(), pdf["known_us"].to_numpy()
            for f in range(len(dates)):
                use = known <= dates[f]
                if not use.any():
                    continue
                z = np.column_stack([np.ones(int(use.sum())), (x[use] - center[f]) / scale[f]])
                p = 1.0 / (1.0 + np.exp(-(z @ beta[f])))
                grad[f] += z.T @ (p - y[use])
                hess[f] += ((z * (p * (1 - p))[:, None]).T @ z).ravel()
        yield pd.DataFrame(np.column_stack([grad, hess]), columns=cols).assign(fold=np.arange(len(dates)))[["fold", *cols]]

    parts = rows.mapInPandas(run, "fold int, " + ", ".join(f"{c} double" for c in cols))
    got = parts.groupBy("fold").agg(*[F.sum(c).alias(c) for c in cols]).orderBy("fold").toPandas()
    values = got[cols].to_numpy()
    return values[:, :m], values[:, m:].reshape(-1, m, m)


def fit_folds(rows: DataFrame, dates: np.ndarray, minimum: int, strength: float = 1.0, steps: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """L2-penalised logistic weights per rebalance date on the rows whose label was known by then.

    What reaches the driver is one weight vector and its sums per date, never rows.  A fit
    that has not settled after ``steps`` Newton steps is an error, not a result.
    """
    sums = _moments(rows, dates)
    n, pos, k = sums["n"].to_numpy(), sums["pos"].to_numpy(), len(NAMES)
    safe = np.maximum(n, 1)[:, None]
    center = sums[[f"s{i}" for i in range(k)]].to_numpy() / safe
    scale = np.sqrt(np.maximum(sums[[f"q{i}" for i in range(k)]].to_numpy() / safe - center**2, 0))
    scale[scale == 0] = 1.0
    usable = (n >= minimum) & (pos > 0) & (pos < n)
    beta = np.zeros((len(dates), k + 1))
    penalty = np.diag([0.0, *[1.0] * k]) / strength
    for _ in range(steps):
        grad, hess = _newton_step(rows, np.where(usable, dates, -1), center, scale, beta)
        move = np.zeros_like(beta)
        for f in np.flatnonzero(usable):
            move[f] = np.linalg.solve(hess[f] + penalty, grad[f] + penalty @ beta[f])
        beta -= move
        if np.abs(move).max(initial=0.0) < 1e-9:
            return beta, center, scale, usable
    raise RuntimeError(f"no convergence in {steps} Newton steps; the last moved a weight by {np.abs(move).max():.3g}")


def walk_forward_scores(panel: DataFrame, horizon: int = 20, minimum: int = 500) -> DataFrame:
    """Probability of a rise per symbol on every month-end date, from a model refitted for that date.

    The feature frame is written once, because each fitting step reads it again.
    """
    spark = panel.sparkSession
    frame = staged(learning_frame(panel, horizon))
    complete = frame.dropna(subset=list(NAMES))
    last = ft.month_end_flag(frame, per_symbol=False).filter("month_end").select("timestamp").distinct()
    stamps = [r.us for r in last.select(F.unix_micros("timestamp").alias("us")).orderBy("us").collect()]
    dates = np.array(stamps, dtype=np.int64)
    rows = complete.dropna(subset=["label"]).select(*NAMES, "label", F.unix_micros("label_available_at").alias("known_us"))
    beta, center, scale, usable = fit_folds(rows, dates, minimum)
    weights = beta[:, 1:] / scale
    bias = beta[:, 0] - (weights * center).sum(axis=1)
    models = spark.createDataFrame(
        [(int(dates[f]), float(bias[f]), *[float(w) for w in weights[f]]) for f in np.flatnonzero(usable)],
        "_us bigint, _bias double, " + ", ".join(f"_w{i} double" for i in range(len(NAMES))))
    current = complete.withColumn("_us", F.unix_micros("timestamp")).join(models, "_us")
    z = F.col("_bias")
    for i, name in enumerate(NAMES):
        z = z + F.col(f"_w{i}") * F.col(name)
    scored = current.select("symbol", "timestamp", (1 / (1 + F.exp(-z))).alias("score"))
    return frame.drop(*NAMES, "label", "label_available_at", "_ret").join(scored, ["symbol", "timestamp"], "left")


def walk_forward_logistic(panel: DataFrame, horizon: int = 20, minimum: int = 500, **kw) -> DataFrame:
    scored = walk_forward_scores(panel, horizon, minimum)
    assert INDEX in scored.columns
    return rank_and_weight(scored, "walk_forward_logistic", 253, **kw)
