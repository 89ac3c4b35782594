"""Comparison of runs, walk-forward evidence, promotion gates and certification."""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions.windows import Running, asof, growth, index_rows, scan
from barlake.session import ensure_checkpoint_dir, staged

SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")
PAIR_SCHEMA = "run_id_a string, run_id_b string, " + ", ".join(f"{c} double" for c in SUMS) + ", both_down double, either_down double"
LEVELS = ("OUT_OF_SAMPLE", "IN_SAMPLE")


def evidence_of(curves: DataFrame, level: str = "OUT_OF_SAMPLE") -> DataFrame:
    """The rows of one evidence level, so that in-sample results never enter a comparison of runs.

    Refuses an unknown level, a table without ``evidence_level`` and a table without any row of the level.
    """
    if level not in LEVELS:
        raise ValueError(f"evidence level must be one of {LEVELS}")
    if "evidence_level" not in curves.columns:
        raise ValueError("no column evidence_level")
    chosen = curves.filter(F.col("evidence_level") == level)
    if chosen.isEmpty():
        raise ValueError(f"no {level} evidence for these runs")
    return chosen


def _tiled(curves: DataFrame, tiles: int, slot_seconds: int | None) -> DataFrame:
    """Each run's rows copied to the tile pairs it takes part in (``tiles`` copies, not one per partner)."""
    tile = F.pmod(F.xxhash64("run_id"), F.lit(tiles)).cast("int")
    others = F.sequence(F.lit(0), F.lit(tiles - 1))
    placed = curves.select("run_id", "timestamp", "net_return", "drawdown", tile.alias("_t")).withColumn("_o", F.explode(others))
    slot = F.floor(F.col("timestamp").cast("double") / slot_seconds).cast("long") if slot_seconds else F.lit(0).cast("long")
    return placed.select("run_id", "timestamp", "net_return", "drawdown", "_t", F.least("_t", "_o").alias("_i"), F.greatest("_t", "_o").alias("_j"), slot.alias("_slot"))


def _matrices(pdf: pd.DataFrame, value: str) -> tuple[np.ndarray, list[str], np.ndarray, list[str], bool]:
    i, j = int(pdf["_i"].iloc[0]), int(pdf["_j"].iloc[0])
    wide = pdf.drop_duplicates(["timestamp", "run_id"]).pivot(index="timestamp", columns="run_id", values=value)
    tile = pdf.drop_duplicates("run_id").set_index("run_id")["_t"]
    left = [r for r in wide.columns if tile[r] == i]
    right = [r for r in wide.columns if tile[r] == j]
    return wide[left].to_numpy(dtype=float), left, wide[right].to_numpy(dtype=float), right, i == j


def _named(left: list[str], right: list[str], same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block of pairs: (place on the left, on the right, smaller name, larger name, whether they swap)."""
    x, y = np.array(left, dtype=object)[:, None], np.array(right, dtype=object)[None, :]
    p, q = np.nonzero((x < y) if same else (x != y))
    swap = x[p, 0] > y[0, q]
    return p, q, np.where(swap, y[0, q], x[p, 0]), np.where(swap, x[p, 0], y[0, q]), swap


def product_sums(a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    """Sums over shared points of each column of ``a`` with each of ``b``; NaN is a missing point."""
    ma, mb = (~np.isnan(a)).astype(float), (~np.isnan(b)).astype(float)
    a, b = np.nan_to_num(a), np.nan_to_num(b)
    return {"n": ma.T @ mb, "sx": a.T @ mb, "sy": ma.T @ b, "sxx": (a * a).T @ mb, "syy": ma.T @ (b * b), "sxy": a.T @ b}


def correlation_of(s: dict[str, np.ndarray]) -> np.ndarray:
    """Correlations from ``product_sums``; 0 with fewer than two points or without spread."""
    n = np.maximum(s["n"], 1)
    vx, vy = (np.maximum(s[q] - s[m] * s[m] / n, 0.0) for q, m in (("sxx", "sx"), ("syy", "sy")))
    spread = np.sqrt(vx) * np.sqrt(vy)
    ok = (s["n"] >= 2) & (vx > 1e-12 * s["sxx"]) & (vy > 1e-12 * s["syy"])
    return np.where(ok, np.clip((s["sxy"] - s["sx"] * s["sy"] / n) / np.where(ok, spread, 1.0), -1, 1), 0.0)


def pair_sums(curves: DataFrame, tiles: int = 1, slot_seconds: int = 10 * 365 * 86_400) -> DataFrame:
    """Additive sums of every pair of runs over shared timestamps, and their counts under water.

    The report of all pairs.  Runs are hashed into tiles and time into slots; a task sees two tiles for one slot as
    matrices, so the data is copied ``tiles`` times and the sums are matrix products.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        a, left, b, right, same = _matrices(pdf, "net_return")
        da, _, db, _, _ = _matrices(pdf, "drawdown")
        p, q, x, y, swap = _named(left, right, same)
        sums = {k: v[p, q] for k, v in product_sums(a, b).items()}
        for u, v in (("sx", "sy"), ("sxx", "syy")):
            sums[u], sums[v] = np.where(swap, sums[v], sums[u]), np.where(swap, sums[u], sums[v])
        with np.errstate(invalid="ignore"):
            under, other = (da < 0).astype(float), (db < 0).astype(float)
        both = (under.T @ other)[p, q]
        either = under.sum(axis=0)[p] + other.sum(axis=0)[q] - both
        return pd.DataFrame({"run_id_a": x, "run_id_b": y, **sums, "both_down": both, "either_down": either})

    partial = _tiled(curves, tiles, slot_seconds).groupBy("_i", "_j", "_slot").applyInPandas(one, PAIR_SCHEMA)
    return partial.groupBy("run_id_a", "run_id_b").agg(*[F.sum(c).alias(c) for c in (*SUMS, "both_down", "either_down")])


def _corr() -> Column:
    c = F.col
    cov = c("sxy") - c("sx") * c("sy") / c("n")
    spread = F.sqrt(F.greatest(c("sxx") - c("sx") * c("sx") / c("n"), F.lit(0.0))) * F.sqrt(F.greatest(c("syy") - c("sy") * c("sy") / c("n"), F.lit(0.0)))
    return F.when((c("n") >= 2) & (spread > 0), cov / spread).otherwise(0.0)


def return_correlation(curves: DataFrame, tiles: int = 1) -> DataFrame:
    """The matrix of all correlations of net returns, 0 where fewer than two points are shared; see ``close_pairs``."""
    return pair_sums(curves, tiles).select("run_id_a", "run_id_b", _corr().alias("return_correlation"), F.col("n").alias("points"))


def drawdown_overlap(curves: DataFrame, tiles: int = 1) -> DataFrame:
    """Share of timestamps with both runs under water among those with either."""
    share = F.when(F.col("either_down") > 0, F.col("both_down") / F.col("either_down")).otherwise(0.0)
    return pair_sums(curves, tiles).select("run_id_a", "run_id_b", share.alias("drawdown_overlap"))


def regime_correlation(curves: DataFrame, tiles: int = 1) -> DataFrame:
    """Correlation where the pair mean is positive, negative, or at least its median size.

    The median of a pair needs all its timestamps, so a task holds two tiles of whole curves; raise ``tiles`` until that
    fits.  A run is compared with its whole tile at once.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        a, left, b, right, same = _matrices(pdf, "net_return")
        p, q, x, y, _ = _named(left, right, same)
        found = {k: np.zeros((len(left), len(right))) for k in ("up", "down", "high_vol")}
        for i in range(len(left)):
            own = np.where(np.isnan(b), np.nan, a[:, [i]])
            mean = (own + b) / 2
            with np.errstate(invalid="ignore"), warnings.catch_warnings():
                warnings.simplefilter("ignore", RuntimeWarning)  # a pair without a shared point
                masks = {"up": mean > 0, "down": mean < 0, "high_vol": np.abs(mean) >= np.nanmedian(np.abs(mean), axis=0)}
            for name, mask in masks.items():
                u, v = np.where(mask, own, 0.0), np.where(mask, b, 0.0)
                sums = {"n": mask.sum(axis=0), "sx": u.sum(axis=0), "sy": v.sum(axis=0), "sxx": (u * u).sum(axis=0), "syy": (v * v).sum(axis=0), "sxy": (u * v).sum(axis=0)}
                found[name][i] = correlation_of(sums)
        return pd.DataFrame({"run_id_a": x, "run_id_b": y, **{k: v[p, q] for k, v in found.items()}})

    return _tiled(curves, tiles, None).groupBy("_i", "_j").applyInPandas(one, "run_id_a string, run_id_b string, up double, down double, high_vol double")


# --- threshold search ------------------------------------------------------------------------------
#
# Runs with the same timestamps form a class.  In a class, standardised curves are unit vectors and the angle between two
# of them, arccos of their correlation, obeys the triangle inequality.  Angles to a few pivot curves therefore bound the
# angle between two tiles of runs, and tiles that cannot hold a close pair are never multiplied.  Classes of few runs are
# pooled in tiles that meet all others.  A task multiplies two tiles and returns close pairs only.

PIVOTS = 8
CELLS = 1 << 20  # points of curves that a tile holds
LEAST_CLASS = 64  # runs of a class with tiles of its own


def _points(curves: DataFrame) -> DataFrame:
    return curves.select(F.col("run_id").cast("string").alias("run_id"), "timestamp", F.col("net_return").cast("double").alias("x")).where("run_id IS NOT NULL AND timestamp IS NOT NULL AND x IS NOT NULL AND NOT isnan(x)")


def tiles_of(points: DataFrame, pivots: int = PIVOTS, cells: int = CELLS, least: int = LEAST_CLASS) -> DataFrame:
    """(run_id, tile, class, angles): the tile of each run; class and angles to the class's pivots are null where pooled."""
    stamp = F.xxhash64("timestamp")
    stats = points.groupBy("run_id").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), F.bit_xor(stamp).alias("_a"), F.sum(F.shiftrightunsigned(stamp, 33)).alias("_b"))
    named = staged(stats.withColumn("class", F.xxhash64("n", "_a", "_b")).drop("_a", "_b"))
    classes = named.groupBy("class").agg(F.count("*").alias("runs")).where(F.col("runs") >= least)
    own = named.where("sd > 0").join(classes, "class")
    order = Window.partitionBy("class").orderBy(F.xxhash64("run_id"), "run_id")
    chosen = own.withColumn("k", F.row_number().over(order)).where(F.col("k") <= pivots).select("class", "run_id", "k", "mean", "sd")
    z = (F.col("x") - F.col("mean")) / F.col("sd")
    curves = points.join(chosen, "run_id").groupBy("class", "timestamp").agg(*[F.max(F.when(F.col("k") == k, z)).alias(f"z{k}") for k in range(1, pivots + 1)])
    dots = points.join(own, "run_id").join(curves, ["class", "timestamp"]).groupBy("run_id", "class", "n").agg(*[(F.sum(z * F.col(f"z{k}")) / F.count("*")).alias(f"c{k}") for k in range(1, pivots + 1)])
    angle = lambda k: F.when(F.col(f"c{k}").isNull(), math.pi / 2).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), f"c{k}"))))
    near = F.array(*[F.struct(-F.abs(F.coalesce(f"c{k}", F.lit(0.0))).alias("far"), F.when(F.col(f"c{k}") < 0, -k).otherwise(k).alias("k")) for k in range(1, pivots + 1)])
    placed = staged(dots.select("run_id", "class", "n", F.array(*[angle(k) for k in range(1, pivots + 1)]).alias("angles"), F.array_min(near)["k"].alias("pivot")))
    parts = placed.groupBy("class", "pivot").agg(F.ceil(F.sum("n") / cells).alias("parts"))
    pure = placed.join(parts, ["class", "pivot"]).select("run_id", F.concat_ws(":", "class", "pivot", F.pmod(F.xxhash64("run_id"), F.col("parts"))).alias("tile"), "class", "angles")
    rest = named.join(pure.select("run_id"), "run_id", "left_anti")
    pooled = max(1, math.ceil((rest.agg(F.sum("n")).first()[0] or 0) / cells))
    mixed = rest.select("run_id", F.pmod(F.xxhash64("run_id"), F.lit(pooled)).cast("string").alias("tile"), F.lit(None).cast("long").alias("class"), F.lit(None).cast("array<double>").alias("angles"))
    return staged(pure.unionByName(mixed))


def tile_pairs(tiles: DataFrame, threshold: float) -> DataFrame:
    """(i, j): the tiles that may hold a pair with a correlation of ``threshold`` or more in size; each pair once."""
    reach = math.acos(threshold) + 1e-6  # rounding of angles
    ends = staged(tiles.where("class IS NOT NULL").select("tile", "class", F.posexplode("angles").alias("k", "angle")).groupBy("tile", "class", "k").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi")).groupBy("tile", "class").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "lo"))), lambda s: s["lo"]).alias("lo"), F.transform(F.array_sort(F.collect_list(F.struct("k", "hi"))), lambda s: s["hi"]).alias("hi")))
    other = ends.select(F.col("tile").alias("j"), "class", F.col("lo").alias("lo_j"), F.col("hi").alias("hi_j"))
    gap = lambda lo, hi: F.array_max(F.zip_with(F.zip_with("lo", hi, lambda x, y: x - y), F.zip_with(lo, "hi", lambda x, y: x - y), lambda x, y: F.greatest(x, y)))
    flip = lambda c: F.transform(c, lambda x: F.lit(math.pi) - x)
    pure = ends.join(other, "class").where(F.col("tile") <= F.col("j")).where((gap("lo_j", "hi_j") <= reach) | (gap(flip("hi_j"), flip("lo_j")) <= reach)).select(F.col("tile").alias("i"), "j")
    pooled = staged(tiles.where("class IS NULL").select(F.col("tile").cast("int").alias("m")).distinct())
    last = pooled.agg(F.max("m")).first()[0]
    if last is None:
        return pure
    among = pooled.select(F.col("m").cast("string").alias("i"), F.explode(F.sequence("m", F.lit(last)).cast("array<string>")).alias("j"))
    across = ends.select(F.explode(F.sequence(F.lit(0), F.lit(last)).cast("array<string>")).alias("i"), F.col("tile").alias("j"))
    return pure.unionByName(among).unionByName(across)


def _tile_matrices(rows: pa.Table) -> tuple[list[str], np.ndarray, list[str], np.ndarray]:
    """Names and matrices [timestamp, run] of both sides; curves are centred, which no correlation notices."""
    _, at = np.unique(rows.column("timestamp").cast(pa.int64()).to_numpy(), return_inverse=True)
    side, out = rows.column("side").to_numpy(), []
    for k in (0, 1):
        own = np.flatnonzero(side == k)
        names = rows.column("run_id").take(pa.array(own)).combine_chunks().dictionary_encode()
        names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
        grid = np.full((at.max(initial=-1) + 1, len(names.dictionary)), np.nan)
        grid[at[own], names.indices.to_numpy()] = rows.column("x").to_numpy()[own]
        mean = np.nanmean(grid, axis=0) if len(own) else np.zeros(0)
        grid = grid - mean
        grid[np.abs(grid) < 1e-12 * np.abs(mean)] = 0.0
        out += [names.dictionary.to_pylist(), grid]
    return tuple(out)


def _side_by_side(points: DataFrame, left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """The points of both tiles of each pair of tiles; ``left`` and ``right`` place runs in tiles."""
    one = points.join(left.select("run_id", F.col("tile").alias("i")), "run_id").join(pairs, "i").withColumn("side", F.lit(0))
    two = points.join(right.select("run_id", F.col("tile").alias("j")), "run_id").join(pairs, "j").withColumn("side", F.lit(1))
    return one.unionByName(two)


def close_pairs(curves: DataFrame, threshold: float, pivots: int = PIVOTS, cells: int = CELLS, least: int = LEAST_CLASS) -> DataFrame:
    """(run_id_a, run_id_b, return_correlation, points) of the pairs with a correlation of ``threshold`` or more in size.

    Exactly the rows of ``return_correlation`` that pass the threshold (between 0 and 1), without the others.  Runs
    without points, rows without a timestamp or a return are left out; a repeated timestamp of a run counts once.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    points = _points(curves)
    tiles = tiles_of(points, pivots, cells, least)

    def product(key: tuple, rows: pa.Table) -> pa.Table:
        left, a, right, b = _tile_matrices(rows)
        sums = product_sums(a, b)
        corr = correlation_of(sums)
        p, q = np.nonzero(np.abs(corr) >= threshold - 1e-12)
        x, y = np.array(left, dtype=object)[p], np.array(right, dtype=object)[q]
        keep = x < y if key[0].as_py() == key[1].as_py() else x != y
        x, y, value, n = x[keep], y[keep], corr[p, q][keep], sums["n"][p, q][keep]
        return pa.table({"run_id_a": pa.array(np.minimum(x, y), pa.string()), "run_id_b": pa.array(np.maximum(x, y), pa.string()), "return_correlation": value, "points": n})

    placed = _side_by_side(points, tiles, tiles, staged(tile_pairs(tiles, threshold)))
    return placed.groupBy("i", "j").applyInArrow(product, "run_id_a string, run_id_b string, return_correlation double, points double")


def clusters(runs: DataFrame, pairs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Connected components of strongly correlated runs, labelled by their smallest run id.

    Labels spread along edges and are then shortened by one jump, until none moves.  Each round's lineage is cut by a
    checkpoint in the cluster's shared folder.
    """
    ensure_checkpoint_dir(runs.sparkSession)
    close = pairs.filter(F.abs("return_correlation") >= threshold)
    edges = close.select("run_id_a", "run_id_b").union(close.select("run_id_b", "run_id_a")).toDF("src", "dst").checkpoint()
    labels = runs.select("run_id").distinct().withColumn("label", F.col("run_id"))
    while True:
        near = edges.join(labels, edges.dst == labels.run_id).groupBy("src").agg(F.min("label").alias("_near"))
        spread = labels.join(near, labels.run_id == near.src, "left").select("run_id", "label", F.least("label", F.coalesce("_near", "label")).alias("_new"))
        roots = spread.select(F.col("run_id").alias("_root"), F.col("_new").alias("_jump"))
        stepped = spread.join(roots, spread._new == roots._root).select("run_id", F.col("_jump").alias("label"), (F.col("_jump") != F.col("label")).alias("_moved")).checkpoint()
        labels = stepped.select("run_id", "label")
        if stepped.filter("_moved").isEmpty():
            break
    return labels.withColumnRenamed("label", "cluster_id")


def jaccard_overlap(items: DataFrame, members: Sequence[str], tiles: int = 1, slots: int = 8) -> DataFrame:
    """|A and B| / |A or B| of two runs' item sets, for every pair of runs sharing an item.

    As in ``pair_sums`` runs are hashed into tiles and items into slots; a task counts shared
    items of its runs with one membership matrix and emits one row per pair.
    """
    schema = "run_id_a string, run_id_b string, shared double"
    held = items.select("run_id", *members).distinct()
    tile = F.pmod(F.xxhash64("run_id"), F.lit(tiles)).cast("int")
    placed = held.withColumns({"_t": tile, "_slot": F.pmod(F.xxhash64(*members), F.lit(slots)).cast("int")})
    placed = placed.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).withColumns({
        "_i": F.least("_t", "_o"), "_j": F.greatest("_t", "_o")}).drop("_o")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        item = pdf.groupby(list(members), dropna=False).ngroup().to_numpy()
        code, names = pd.factorize(pdf["run_id"], sort=True)
        held_by = np.zeros((item.max() + 1, len(names)))
        held_by[item, code] = 1.0
        tiles_of = pdf.drop_duplicates("run_id").set_index("run_id")["_t"]
        i, j = int(pdf["_i"].iloc[0]), int(pdf["_j"].iloc[0])
        both = held_by.T @ held_by
        rows = [
            (names[a], names[b], both[a, b]) for a in range(len(names)) for b in range(a + 1, len(names))
            if both[a, b] > 0 and {int(tiles_of[names[a]]), int(tiles_of[names[b]])} == {i, j}
        ]
        return pd.DataFrame(rows, columns=["run_id_a", "run_id_b", "shared"])

    shared = placed.groupBy("_i", "_j", "_slot").applyInPandas(one, schema).groupBy("run_id_a", "run_id_b").agg(F.sum("shared").alias("_both"))
    sizes = held.groupBy("run_id").agg(F.count(F.lit(1)).alias("_size"))
    named = lambda s: sizes.select(F.col("run_id").alias(f"run_id_{s}"), F.col("_size").alias(f"_n{s}"))
    df = shared.join(named("a"), "run_id_a").join(named("b"), "run_id_b")
    return df.select("run_id_a", "run_id_b", (F.col("_both") / (F.col("_na") + F.col("_nb") - F.col("_both"))).alias("overlap"))


SPAN = 1024  # timestamps of one side of a block of the Gram matrix


def effective_bets(curves: DataFrame, span: int = SPAN, cells: int = CELLS) -> DataFrame:
    """(sum of eigenvalues)^2 / sum of squares = runs^2 / sum of squared correlations, without pairs of runs.

    Of runs on the same timestamps the squared correlations add up to the squares of the Gram matrix over timestamps,
    whose blocks are sums over runs.  Each pair of classes of runs is restricted to the timestamps both have, where the
    same holds with the product of two Gram matrices.  A run without spread correlates with itself only.
    """
    points = _points(curves).dropDuplicates(["run_id", "timestamp"])
    stamp = F.xxhash64("timestamp")
    stats = points.groupBy("run_id").agg(F.count("*").alias("n"), F.bit_xor(stamp).alias("_a"), F.sum(F.shiftrightunsigned(stamp, 33)).alias("_b"))
    named = staged(stats.select("run_id", "n", F.xxhash64("n", "_a", "_b").alias("class")))
    days = staged(points.join(named, "run_id").select("class", "timestamp").distinct())
    two = lambda c, d: days.select("timestamp", F.col("class").alias(c), F.col("class").alias(d))
    shared = two("c", "_1").drop("_1").join(two("d", "_2").drop("_2"), "timestamp").where("c <= d")
    place = F.row_number().over(Window.partitionBy("c", "d").orderBy("timestamp")) - 1
    numbered = staged(shared.select("c", "d", "timestamp", place.alias("at")))
    sides = F.explode(F.when(F.col("c") == F.col("d"), F.array(F.struct(F.col("c").alias("class"), F.lit(0).alias("side")))).otherwise(F.array(F.struct(F.col("c").alias("class"), F.lit(0).alias("side")), F.struct(F.col("d").alias("class"), F.lit(1).alias("side")))))
    dated = numbered.select("c", "d", "timestamp", "at", sides.alias("s")).select("c", "d", "timestamp", "at", "s.class", "s.side")
    mine = points.join(named.select("run_id", "class"), "run_id").join(dated, ["class", "timestamp"])
    moments = staged(mine.groupBy("c", "d", "side", "run_id").agg(F.count("*").alias("m"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), F.max(F.abs("x")).alias("size")))
    real = (F.col("m") >= 2) & (F.col("sd") > 1e-12 * F.col("size"))
    z = staged(mine.join(moments.where(real).drop("size"), ["c", "d", "side", "run_id"]).select("c", "d", "side", "run_id", "at", ((F.col("x") - F.col("mean")) / (F.col("sd") * F.sqrt("m"))).alias("z")))
    blocks = z.select("c", "d", F.floor(F.col("at") / span).alias("b")).distinct()
    mates = blocks.join(blocks.withColumnRenamed("b", "b2"), ["c", "d"]).where("b <= b2")
    copies = F.explode(F.when(F.col("b") == F.col("b2"), F.array(F.col("b"))).otherwise(F.array("b", "b2"))).alias("own")
    part = F.pmod(F.xxhash64("run_id"), F.lit(max(1, math.ceil(z.count() / cells)))).alias("part")
    dealt = z.withColumn("own", F.floor(F.col("at") / span)).join(mates.select("c", "d", "b", "b2", copies), ["c", "d", "own"]).select("c", "d", "side", "b", "b2", part, "run_id", "at", "z")

    def gram(key: tuple, rows: pa.Table) -> pa.Table:
        first, second = (key[i].as_py() * span for i in (3, 4))
        run = rows.column("run_id").combine_chunks().dictionary_encode()
        run = run.combine_chunks() if isinstance(run, pa.ChunkedArray) else run
        at, value = rows.column("at").to_numpy(), rows.column("z").to_numpy()
        sides = []
        for start in (first, second):
            grid, inside = np.zeros((len(run.dictionary), span)), (at >= start) & (at < start + span)
            grid[run.indices.to_numpy()[inside], at[inside] - start] = value[inside]
            sides.append(grid)
        return pa.table({**{n: pa.array([k.as_py()], pa.int64()) for n, k in zip(("c", "d", "side", "b", "b2"), key[:5], strict=True)}, "gram": pa.array([(sides[0].T @ sides[1]).tobytes()], pa.binary())})

    def squares(key: tuple, rows: pa.Table) -> pa.Table:
        c, d, b, b2 = (k.as_py() for k in key)
        total = [np.zeros(span * span), np.zeros(span * span)]
        for side, raw in zip(rows.column("side").to_pylist(), rows.column("gram"), strict=True):
            total[side] += np.frombuffer(raw.as_py(), float)
        dot = float(total[0] @ total[0 if c == d else 1])
        return pa.table({"square": [dot * (1 if b == b2 else 2) * (1 if c == d else 2)]})

    names = "c long, d long, side long, b long, b2 long"
    grams = dealt.withColumn("side", F.col("side").cast("long")).groupBy("c", "d", "side", "b", "b2", "part").applyInArrow(gram, f"{names}, gram binary")
    found = grams.groupBy("c", "d", "b", "b2").applyInArrow(squares, "square double").agg(F.coalesce(F.sum("square"), F.lit(0.0)).alias("square"), F.lit(1).alias("_one"))
    own = moments.where("c = d").agg(F.sum(F.when(real, 1).otherwise(0)).alias("real"), F.lit(1).alias("_one"))
    runs = curves.select("run_id").distinct().agg(F.count("run_id").alias("_n"), F.lit(1).alias("_one"))
    return runs.join(found, "_one").join(own, "_one").select((F.col("_n") * F.col("_n") / (F.col("_n") + F.col("square") - F.coalesce("real", F.lit(0)))).alias("effective_bets"))


SUMMARY_METRICS = ("sharpe", "sortino", "calmar", "max_drawdown")


def strategy_summary(fold_metrics: DataFrame, attribution: DataFrame) -> DataFrame:
    """Mean fold metrics with breadth, P&L and cost per run."""
    means = fold_metrics.groupBy("run_id").pivot("metric_name", list(SUMMARY_METRICS)).agg(F.avg("metric_value"))
    breadth = attribution.groupBy("run_id").agg(
        F.count_distinct("symbol").alias("symbols_contributing"), F.sum("realized_pnl").alias("realized_pnl"), F.sum("cost").alias("cost"))
    return means.join(breadth, "run_id", "left").na.fill(0)


def explain_loss(attribution: DataFrame, run_id: str | None = None, symbol: str | None = None) -> DataFrame:
    """P&L by symbol, reason and exit class."""
    df = attribution if run_id is None else attribution.filter(F.col("run_id") == run_id)
    df = df if symbol is None else df.filter(F.col("symbol") == symbol)
    return df.groupBy("run_id", "symbol", "reason", "exit_classification").agg(*_loss())


def _loss() -> list[Column]:
    return [
        F.sum("realized_pnl").alias("pnl"), F.sum("gross_pnl").alias("gross_pnl"), F.sum("cost").alias("cost"), F.sum("quantity").alias("quantity"),
        F.avg("holding_period_days").alias("average_holding_days"), F.count(F.lit(1)).alias("events")]


def loss_by_sector(attribution: DataFrame, sectors: DataFrame) -> DataFrame:
    df = attribution.drop("sector").join(sectors, "symbol", "left")
    return df.groupBy("run_id", F.coalesce("sector", F.lit("UNKNOWN")).alias("sector")).agg(F.sum("realized_pnl").alias("pnl"), F.sum("cost").alias("cost"))


def loss_groupings(attribution: DataFrame) -> DataFrame:
    """The same totals at three levels at once: run, run and reason, run and symbol."""
    levels = [["run_id"], ["run_id", "reason"], ["run_id", "symbol"]]
    sets = [[F.col(c) for c in level] for level in levels]
    return attribution.groupingSets(sets, "run_id", "reason", "symbol").agg(F.sum("realized_pnl").alias("pnl"), F.sum("cost").alias("cost"))


def worst_round_trips(trips: DataFrame, run_id: str, limit: int) -> DataFrame:
    return trips.filter(F.col("run_id") == run_id).orderBy("net_pnl", "exit_timestamp", "trade_id").limit(limit)


# --- walk-forward -------------------------------------------------------------------------------

def _numbered_dates(panel: DataFrame) -> DataFrame:
    dates = panel.select("timestamp").distinct().withColumn("_one", F.lit(1))
    return index_rows(dates, "_one", ("timestamp",), name="_n")


def fold_dates(panel: DataFrame, train: int, test: int, lookback: int = 0) -> DataFrame:
    """Test timestamps with their fold; an incomplete last fold is dropped."""
    cursor = max(train, lookback)
    tested = _numbered_dates(panel).filter(F.col("_n") >= cursor).withColumn("_k", F.floor((F.col("_n") - cursor) / test))
    whole = tested.groupBy("_k").agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") == test)
    return tested.join(whole, "_k").select("timestamp", F.format_string("wf-%03d", (F.col("_k") + 1).cast("int")).alias("fold_id"))


def walk_forward_folds(panel: DataFrame, train: int, test: int, lookback: int = 0) -> DataFrame:
    """Expanding train range and stepped test range of every complete fold."""
    cursor = max(train, lookback)
    numbered = _numbered_dates(panel)
    tested = fold_dates(panel, train, test, lookback).groupBy("fold_id").agg(
        F.min("timestamp").alias("test_start"), F.max("timestamp").alias("test_end"), F.count(F.lit(1)).alias("test_size"))
    ends = numbered.filter((F.col("_n") + 1 >= cursor) & ((F.col("_n") + 1 - cursor) % test == 0)).select(
        F.format_string("wf-%03d", (F.floor((F.col("_n") + 1 - cursor) / test) + 1).cast("int")).alias("fold_id"),
        F.col("timestamp").alias("train_end"), (F.col("_n") + 1).alias("train_size"), "_one")
    begin = panel.agg(F.min("timestamp").alias("train_start")).withColumn("_one", F.lit(1))
    return tested.join(ends, "fold_id").join(begin, "_one").drop("_one")


def select_parameters(scores: DataFrame, keys: Sequence[str] = ("fold_id",)) -> DataFrame:
    """Per fold the candidate with the best sharpe, then drawdown, then parameter text."""
    best = F.max(F.struct("sharpe", "max_drawdown", "parameters_json"))
    return scores.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.parameters_json", F.col("b.sharpe").alias("training_score"))


def walk_forward_select(training: DataFrame, testing: DataFrame, keys: Sequence[str] = ("fold_id",)) -> DataFrame:
    """Per fold the candidate that was best on the training window, with its score on the test window.

    Both tables hold one row per ``keys`` and candidate; folds without a test window are left out.
    """
    tested = testing.select(*keys, "parameters_json", F.col("sharpe").alias("test_score"))
    return select_parameters(training, keys).join(tested, [*keys, "parameters_json"])


def oos_curve(curve: DataFrame, dates: DataFrame, capital: float = 100_000.0, keys: Sequence[str] = ("run_id", "fold_id")) -> DataFrame:
    """Test-window rows of each fold with equity re-based and drawdown recomputed."""
    tested = curve.drop("fold_id", "equity", "drawdown").join(dates, "timestamp")
    return growth(tested, keys, ("timestamp",), "net_return", capital).withColumn("evidence_level", F.lit("OUT_OF_SAMPLE"))


def fold_slice(events: DataFrame, folds: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Events inside a fold's test range: the latest fold started, if it has not ended.

    All events share one key here, so they are chunked by day.
    """
    starts = folds.select(F.lit(1).alias("_one"), F.col("test_start"), "test_end", "fold_id")
    marked = asof(events.drop("fold_id").withColumn("_one", F.lit(1)), starts, "_one", ts, "test_start", ["fold_id", "test_end"], seconds=86_400)
    inside = marked.filter(F.col("fold_id").isNotNull() & (F.col(ts) <= F.col("test_end")))
    return inside.drop("_one", "test_end", "test_start_asof")


def content_key(df: DataFrame, columns: Sequence[str], name: str = "content_key") -> DataFrame:
    """Deterministic key from the sorted JSON of the given columns."""
    return df.withColumn(name, F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256))


def job_matrix(
    symbols: DataFrame, strategies: Sequence[tuple[str, str]], parameters: Mapping[str, Sequence[str]], done: DataFrame, coverage: DataFrame,
    snapshot: str, timeframe: str = "1d",
) -> DataFrame:
    """One row per strategy, target and parameter set not yet done, with data coverage.

    ``strategies`` are (name, scope) pairs and ``parameters`` their JSON texts: configuration
    carried as literal arrays, so the matrix is an explode of the symbol list, not a product join.
    """
    choice = lambda scope: F.array(*[
        F.struct(F.lit(n).alias("strategy_name"), F.lit(s).alias("strategy_scope"), F.lit(p).alias("parameters_json"))
        for n, s in strategies if s == scope for p in parameters.get(n, ["{}"])])
    scopes = {s for _, s in strategies}
    parts = []
    if "SINGLE_ASSET" in scopes:
        parts.append(symbols.select("symbol", F.inline(choice("SINGLE_ASSET"))))
    if "CROSS_SECTIONAL" in scopes:
        whole = symbols.agg(F.count(F.lit(1)).alias("_n"))
        parts.append(whole.select(F.lit("*").alias("symbol"), F.inline(choice("CROSS_SECTIONAL"))))
    jobs = reduce(DataFrame.unionByName, parts).withColumns({"snapshot_id": F.lit(snapshot), "timeframe": F.lit(timeframe)})
    keyed = content_key(jobs, ["symbol", "strategy_name", "strategy_scope", "parameters_json", "snapshot_id", "timeframe"], "job_key")
    return keyed.join(done.select("job_key"), "job_key", "left_anti").join(coverage, "symbol", "left")


# --- promotion ----------------------------------------------------------------------------------

@dataclass(frozen=True)
class PromotionPolicy:
    """Default gates."""

    minimum_sharpe: float = 0.5
    minimum_sortino: float = 0.7
    minimum_profit_factor: float = 1.1
    maximum_drawdown: float = 0.05
    minimum_trades: int = 20
    maximum_cluster_correlation: float = 0.75
    minimum_walk_forward_folds: int = 3
    minimum_positive_fold_fraction: float = 0.60
    cost_stress_multiplier: float = 2.0
    minimum_parameter_stability: float = 0.50
    minimum_portfolio_contributors: int = 5
    maximum_profit_concentration: float = 0.50


CATEGORIES = ("DATA_LINEAGE", "DATA_QUALITY", "CAUSALITY", "PIT_SURVIVORSHIP", "OOS_WALK_FORWARD")


def parameter_stability(folds: DataFrame) -> DataFrame:
    """Share of a run's folds that chose its most frequent parameter set."""
    counts = folds.groupBy("run_id", "parameters_json").agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy("run_id").agg((F.max("c") / F.sum("c")).alias("parameter_stability"))


def cost_stress(curve: DataFrame, attribution: DataFrame, multiplier: float = 2.0) -> DataFrame:
    """Does the run still gain when its costs are multiplied?"""
    start = F.col("equity") / F.nullif(1 + F.col("net_return"), F.lit(0.0))
    ends = curve.filter("evidence_level = 'OUT_OF_SAMPLE'").groupBy("run_id", "fold_id").agg(
        F.min_by(start, "timestamp").alias("_a"), F.max_by("equity", "timestamp").alias("_b"))
    spent = attribution.groupBy("run_id", "fold_id").agg(F.sum("cost").alias("_c"))
    net = F.col("_b") - F.col("_a") - (multiplier - 1) * F.coalesce("_c", F.lit(0.0))
    total = ends.join(spent, ["run_id", "fold_id"], "left").groupBy("run_id").agg(F.sum(net).alias("stressed_pnl"))
    return total.withColumn("cost_stress", F.coalesce(F.col("stressed_pnl") > 0, F.lit(False)))


def profit_breadth(attribution: DataFrame, contributors: int = 5, concentration: float = 0.5) -> DataFrame:
    """Enough profitable symbols, none of them too large a share of the profit."""
    winners = attribution.groupBy("run_id", "symbol").agg(F.sum("realized_pnl").alias("p")).filter("p > 0")
    out = winners.groupBy("run_id").agg(F.count(F.lit(1)).alias("contributors"), (F.max("p") / F.sum("p")).alias("top_share"))
    runs = attribution.select("run_id").distinct().join(out, "run_id", "left").na.fill({"contributors": 0, "top_share": 1.0})
    return runs.withColumn("profit_breadth", (F.col("contributors") >= contributors) & (F.col("top_share") <= concentration))


def latest_promoted(reviews: DataFrame, order: Sequence[str] = ("reviewed_at",)) -> DataFrame:
    """Runs whose newest review promotes them."""
    newest = reviews.groupBy("run_id").agg(F.max_by(F.struct("stage", "decision", "human_approved"), F.struct(*order)).alias("r"))
    return newest.select("run_id", "r.*").filter("stage IN ('PAPER_CANDIDATE', 'PAPER_ACTIVE') AND decision = 'PASS' AND human_approved")


def max_correlation_to_promoted(curves: DataFrame, promoted: DataFrame, cells: int = CELLS) -> DataFrame:
    """(run_id, maximum_correlation): the largest absolute correlation of each run to another, promoted one.

    Tiles of all runs meet tiles of promoted runs only; a task returns one row a run.
    """
    points = _points(curves)
    chosen = promoted.select(F.col("run_id").cast("string").alias("run_id")).distinct()
    sizes = points.groupBy("run_id").agg(F.count("*").alias("n"))
    some = lambda df: max(1, math.ceil((df.agg(F.sum("n")).first()[0] or 0) / cells))
    all_tiles, few = some(sizes), some(sizes.join(chosen, "run_id", "left_semi"))
    tile = lambda df, n: df.withColumn("tile", F.pmod(F.xxhash64("run_id"), F.lit(n)))
    pairs = curves.sparkSession.range(all_tiles).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(few - 1)).cast("array<bigint>")).alias("j"))

    def largest(rows: pa.Table) -> pa.Table:
        left, a, right, b = _tile_matrices(rows)
        corr = np.abs(correlation_of(product_sums(a, b)))
        other = np.array(left, dtype=object)[:, None] != np.array(right, dtype=object)[None, :]
        has = np.flatnonzero(other.any(axis=1)) if len(right) else np.zeros(0, np.int64)
        return pa.table({"run_id": pa.array([left[i] for i in has], pa.string()), "c": np.where(other, corr, -1.0)[has].max(axis=1) if len(has) else np.zeros(0)})

    placed = _side_by_side(points, tile(sizes.select("run_id"), all_tiles), tile(chosen, few), pairs)
    return placed.groupBy("i", "j").applyInArrow(largest, "run_id string, c double").groupBy("run_id").agg(F.max("c").alias("maximum_correlation"))


def certify_runs(
    runs: DataFrame, run_datasets: DataFrame, datasets: DataFrame, certificates: DataFrame, checks: DataFrame, fills: DataFrame,
    orders: DataFrame, intervals: DataFrame, oos: DataFrame, required: Sequence[str],
) -> DataFrame:
    """Five evidence categories per run, PASS or FAIL, for all runs at once.

    ``runs``: run_id, universe_name (NULL for single assets), mode, data_hash, frame_hash.
    ``run_datasets``: run_id, dataset_id of every contributing dataset.
    """
    from barlake.operators.quality import require_certified

    have = run_datasets.select("run_id").distinct()
    good = datasets.filter("status = 'VERIFIED' AND lifecycle_status = 'CANONICAL_PROMOTED'").select("dataset_id")
    unverified = run_datasets.join(good, "dataset_id", "left_anti").select("run_id")
    unframed = runs.filter("frame_hash IS NULL OR frame_hash <> data_hash").select("run_id")
    none = runs.select("run_id").join(have, "run_id", "left_anti")
    verdict = require_certified(datasets, certificates, checks, required)
    uncertified = run_datasets.join(verdict.filter("blocker IS NULL"), "dataset_id", "left_anti").select("run_id")
    early = fills.join(orders.select("order_id", "requested_at"), "order_id").filter(F.col("timestamp") < F.col("requested_at")).select("run_id")
    known = intervals.select(F.upper("universe_name").alias("_u")).distinct()
    portfolio = runs.filter("universe_name IS NOT NULL").withColumn("_u", F.upper("universe_name"))
    unproven = portfolio.join(known, "_u", "left_anti").select("run_id")
    seen = oos.select("run_id").distinct()
    untested = runs.filter("mode <> 'DEBUG'").select("run_id").join(seen, "run_id", "left_anti")
    failures = {
        "DATA_LINEAGE": unverified.union(unframed).union(none), "DATA_QUALITY": uncertified.union(none), "CAUSALITY": early,
        "PIT_SURVIVORSHIP": unproven, "OOS_WALK_FORWARD": untested,
    }
    bad = reduce(DataFrame.union, [df.select("run_id", F.lit(name).alias("category")).distinct() for name, df in failures.items()])
    grid = runs.select("run_id", F.explode(F.array(*[F.lit(c) for c in CATEGORIES])).alias("category"))
    return grid.join(bad.withColumn("_bad", F.lit(True)), ["run_id", "category"], "left").select(
        "run_id", "category", F.when(F.col("_bad"), "FAIL").otherwise("PASS").alias("status"))


def promotion_gates(
    runs: DataFrame, fold_metrics: DataFrame, evidence: DataFrame, certificates: DataFrame, stability: DataFrame, stress: DataFrame,
    breadth: DataFrame, promoted: DataFrame, correlation: DataFrame, policy: PromotionPolicy = PromotionPolicy(),
) -> DataFrame:
    """Eighteen gates per run, with score, failed gates and stage.

    ``runs`` carries run_id, is_portfolio, human_approved and paper_activation; a run's own
    promotion does not count against it.
    """
    names = ("sharpe", "sortino", "profit_factor", "max_drawdown", "trades")
    means = fold_metrics.groupBy("run_id").pivot("metric_name", list(names)).agg(F.avg("metric_value"))
    per_fold = fold_metrics.groupBy("run_id", "fold_id").agg(F.max(F.when(F.col("metric_name") == "sharpe", F.col("metric_value"))).alias("s"))
    folds = per_fold.groupBy("run_id").agg(F.count(F.lit(1)).alias("_folds"), F.avg((F.coalesce("s", F.lit(0.0)) > 0).cast("double")).alias("_positive"))
    points = evidence.filter("evidence_level = 'OUT_OF_SAMPLE'").groupBy("run_id").agg(F.count(F.lit(1)).alias("_points"))
    cert = certificates.groupBy("run_id").pivot("category", list(CATEGORIES)).agg(F.max("status"))
    others = promoted.agg(F.count(F.lit(1)).alias("_all")).withColumn("_one", F.lit(1))
    own = promoted.select("run_id").withColumn("_own", F.lit(1))
    df = runs.withColumn("_one", F.lit(1)).join(others, "_one")
    for part in (own, means, folds, points, cert, stability, stress.select("run_id", F.col("cost_stress").alias("_stress")),
                 breadth.select("run_id", F.col("profit_breadth").alias("_breadth")), correlation):
        df = df.join(part, "run_id", "left")
    v = lambda c, d=0.0: F.coalesce(F.col(c), F.lit(d))
    passed = lambda c: F.coalesce(F.col(c) == "PASS", F.lit(False))
    alone = (F.col("_all") - v("_own", 0)) <= 0
    measured = F.col("maximum_correlation").isNotNull()
    gates = {
        "sharpe": v("sharpe") >= policy.minimum_sharpe, "sortino": v("sortino") >= policy.minimum_sortino,
        "profit_factor": v("profit_factor") >= policy.minimum_profit_factor, "drawdown": F.abs(v("max_drawdown", 1.0)) <= policy.maximum_drawdown,
        "trades": v("trades") >= policy.minimum_trades, "out_of_sample": (v("_points", 0) > 0) & passed("OOS_WALK_FORWARD"),
        "walk_forward_metrics": F.col("_folds").isNotNull(), "minimum_folds": v("_folds", 0) >= policy.minimum_walk_forward_folds,
        "fold_consistency": v("_positive") >= policy.minimum_positive_fold_fraction, "cost_stress": v("_stress", False),
        "parameter_stability": v("parameter_stability") >= policy.minimum_parameter_stability,
        "profit_breadth": ~F.col("is_portfolio") | v("_breadth", False), "zero_survivorship_bias": passed("PIT_SURVIVORSHIP"),
        "data_quality_verified": passed("DATA_QUALITY"), "causality_certified": passed("CAUSALITY"), "data_lineage_verified": passed("DATA_LINEAGE"),
        "correlation_evidence": alone | measured,
        "independent": alone | (measured & (v("maximum_correlation", 1.0) < policy.maximum_cluster_correlation)),
    }
    failed = F.array_compact(F.array(*[F.when(~test, name) for name, test in gates.items()]))
    out = df.select("run_id", "human_approved", "paper_activation", failed.alias("reasons"))
    clear = F.size("reasons") == 0
    stage = (
        F.when(clear & F.col("human_approved") & F.col("paper_activation"), "PAPER_ACTIVE").when(clear & F.col("human_approved"), "PAPER_CANDIDATE")
        .when(clear, "BACKTEST_VALIDATED").otherwise("RESEARCH_ONLY")
    )
    return out.withColumns({
        "score": 1 - F.size("reasons") / len(gates), "decision": F.when(clear, "PASS").otherwise("REJECT"), "stage": stage})


def paper_authorized(reviews: DataFrame, order: Sequence[str] = ("reviewed_at",)) -> DataFrame:
    """Runs that may trade on paper by their newest review."""
    return latest_promoted(reviews, order).select("run_id")


def dataset_group(panel: DataFrame, exclusions: DataFrame, members: DataFrame, snapshot: str, timeframe: str, data_hash: str) -> DataFrame:
    """Group id with each member's dataset or the reason it was left out."""
    used = panel.select("symbol", "dataset_id").distinct()
    why = exclusions.groupBy("symbol").agg(F.min("reason").alias("exclusion_reason"))
    group = F.lit(f"{snapshot}:{timeframe}:{data_hash[:16]}")
    return members.select("symbol").distinct().join(used, "symbol", "left").join(why, "symbol", "left").withColumn("group_id", group)


def returns_of(benchmark: DataFrame, price: str = "benchmark_close") -> DataFrame:
    """Return of a benchmark price per timestamp, from the value before it."""
    one = benchmark.withColumn("_one", F.lit(1))
    prior = scan(one, "_one", ("timestamp",), [Running("_before", "last", F.col(price), inclusive=False)])
    return prior.select("timestamp", (F.col(price) / F.nullif(F.col("_before"), F.lit(0.0)) - 1).alias("benchmark_return")).filter("benchmark_return IS NOT NULL")
