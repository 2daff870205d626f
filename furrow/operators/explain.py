"""What models say: partial dependence, Shapley values of trees, and frames that compare models."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.operators.modelling import Result, assembled
from furrow.scratch import fresh_path


def feature_grid(df: DataFrame, feature: str, points: int = 100) -> list[float]:
    """The distinct values if there are no more than `points`, else evenly from the 5th to the 95th percentile."""
    few = df.select(feature).where(F.col(feature).isNotNull()).distinct().limit(points + 1).collect()
    if len(few) <= points:
        return sorted(float(r[0]) for r in few)
    low, high = df.agg(F.percentile(feature, F.lit(0.05)), F.percentile(feature, F.lit(0.95))).first()
    return np.linspace(low, high, points).tolist()


def grid_frame(df: DataFrame, features: list[str], points: int) -> DataFrame:
    """All combinations of the features' grid values, g0, g1, ...: at most points ** len(features) rows."""
    spark = df.sparkSession
    out = None
    for i, f in enumerate(features):
        own = spark.createDataFrame([(v,) for v in feature_grid(df, f, points)], f"g{i} double")
        out = own if out is None else out.crossJoin(own)
    return out


def ice(model: Model, df: DataFrame, all_features: list[str], features: list[str], points: int = 100) -> DataFrame:
    """(rid, g0, ..., prediction): each row's prediction with the features set to each grid value."""
    grid = grid_frame(df, features, points)
    rows = df.dropna(subset=all_features).select("rid", *all_features).crossJoin(F.broadcast(grid))
    rows = rows.withColumns({f: F.col(f"g{i}") for i, f in enumerate(features)})
    return model.transform(assembled(rows, all_features)).select("rid", *(f"g{i}" for i in range(len(features))), "prediction")


def pdp_ice(model: Model, df: DataFrame, all_features: list[str], target_features: list[str], points: int = 100) -> tuple[DataFrame, DataFrame]:
    """((feature, value, pdp), (feature, rid, value, prediction)) for exactly three features."""
    if len(target_features) != 3:
        raise ValueError("three features are needed")
    lines = None
    for f in target_features:
        own = ice(model, df, all_features, [f], points).select(F.lit(f).alias("feature"), "rid", F.col("g0").alias("value"), "prediction")
        lines = own if lines is None else lines.unionByName(own)
    return lines.groupBy("feature", "value").agg(F.avg("prediction").alias("pdp")), lines


def pdp_2d(model: Model, df: DataFrame, all_features: list[str], pairs: list[tuple[str, str]], points: int = 20, bands: int = 10, most: int | None = None) -> DataFrame:
    """(feature_1, feature_2, value_1, value_2, pdp, band): mean predictions over pairs of grid values, and which of the equal bands each is in. most: so many rows by hash, if given."""
    from furrow.operators.modelling import some_rows

    rows = df if most is None else some_rows(df, most)
    out = None
    for a, b in pairs:
        own = ice(model, rows, all_features, [a, b], points).groupBy("g0", "g1").agg(F.avg("prediction").alias("pdp"))
        own = own.select(F.lit(a).alias("feature_1"), F.lit(b).alias("feature_2"), F.col("g0").alias("value_1"), F.col("g1").alias("value_2"), "pdp")
        out = own if out is None else out.unionByName(own)
    return banded(out, out, bands)


def banded(df: DataFrame, by: DataFrame, bands: int) -> DataFrame:
    """df with band: which of so many equal intervals of by's pdp, for each pair of features."""
    edges = by.groupBy("feature_1", "feature_2").agg(F.min("pdp").alias("__low"), F.max("pdp").alias("__high"))
    place = F.expr(f"cast(greatest(0, least({bands - 1}, if(__high = __low, 0, floor((pdp - __low) / ((__high - __low) / {bands}))))) as int)")
    return df.join(F.broadcast(edges), ["feature_1", "feature_2"]).withColumn("band", place).drop("__low", "__high")


def compare_pdp_2d(models: dict[str, Model], df: DataFrame, all_features: list[str], pairs: list[tuple[str, str]], points: int = 20, bands: int = 10) -> DataFrame:
    """pdp_2d() of two models under their names, both in the bands of the first."""
    frames = {n: pdp_2d(m, df, all_features, pairs, points, bands).drop("band") for n, m in models.items()}
    first = next(iter(frames.values()))
    out = None
    for n, f in frames.items():
        own = banded(f, first, bands).withColumn("model", F.lit(n))
        out = own if out is None else out.unionByName(own)
    return out


@dataclass
class Leaf:
    """A leaf: its value times its tree's weight, and for each feature on its path the interval (low, high] and the share of rows that stay."""

    value: float
    features: list[int]
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


def leaves_of(model: Model, spark) -> list[Leaf]:
    """The leaves of a Spark tree ensemble, read from its saved form."""
    path = fresh_path(spark, "model")
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    trees: dict[int, dict] = {}
    for r in nodes:
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    weights = list(getattr(model, "treeWeights", [])) or [1.0] * len(trees)
    scale = 1.0 if type(model).__name__.startswith("GBT") else 1.0 / max(sum(weights), 1e-300)
    out: list[Leaf] = []

    def walk(tree: dict, i: int, held: dict, weight: float) -> None:
        r = tree[i]
        if r["leftChild"] < 0:
            f = sorted(held)
            out.append(Leaf(r["prediction"] * weight, f, np.array([held[k][0] for k in f]), np.array([held[k][1] for k in f]), np.array([held[k][2] for k in f])))
            return
        k, at = r["split"]["featureIndex"], r["split"]["leftCategoriesOrThreshold"][0]
        low, high, share = held.get(k, (-np.inf, np.inf, 1.0))
        total = max(r["rawCount"], 1)
        for child, a, b in ((r["leftChild"], low, min(high, at)), (r["rightChild"], max(low, at), high)):
            walk(tree, child, held | {k: (a, b, share * tree[child]["rawCount"] / total)}, weight)

    for t in sorted(trees):
        walk(trees[t], 0, {}, weights[t] * scale)
    return out


def polynomial(o: np.ndarray, z: np.ndarray, without: tuple[int, ...]) -> np.ndarray:
    """Coefficients by subset size of the product over features of (share + stays * t): (rows, sizes)."""
    out = np.ones((o.shape[0], 1))
    for j in range(o.shape[1]):
        if j not in without:
            grown = np.zeros((o.shape[0], out.shape[1] + 1))
            grown[:, :-1] += out * z[j]
            grown[:, 1:] += out * o[:, j, None]
            out = grown
    return out


def tree_shap(leaves: list[Leaf], x: np.ndarray) -> tuple[np.ndarray, float]:
    """(values, base): Shapley values of each row and feature where absent features follow the training rows down the tree. base + sum = prediction."""
    phi, base = np.zeros(x.shape), 0.0
    for leaf in leaves:
        base += leaf.value * float(np.prod(leaf.share))
        d = len(leaf.features)
        if not d:
            continue
        v = x[:, leaf.features]
        o = ((v > leaf.low) & (v <= leaf.high)).astype(float)
        w = np.array([math.factorial(s) * math.factorial(d - s - 1) / math.factorial(d) for s in range(d)])
        for i, f in enumerate(leaf.features):
            phi[:, f] += leaf.value * (o[:, i] - leaf.share[i]) * (polynomial(o, leaf.share, (i,)) @ w)
    return phi, base


def tree_shap_interactions(leaves: list[Leaf], x: np.ndarray) -> np.ndarray:
    """(rows, features, features): interaction values; a row of the matrix sums to the feature's Shapley value."""
    n, f = x.shape
    out = np.zeros((n, f, f))
    for leaf in leaves:
        d = len(leaf.features)
        if d < 2:
            continue
        v = x[:, leaf.features]
        o = ((v > leaf.low) & (v <= leaf.high)).astype(float)
        w = np.array([math.factorial(s) * math.factorial(d - s - 2) / (2 * math.factorial(d - 1)) for s in range(d - 1)])
        for i in range(d):
            for j in range(i + 1, d):
                got = leaf.value * (o[:, i] - leaf.share[i]) * (o[:, j] - leaf.share[j]) * (polynomial(o, leaf.share, (i, j)) @ w)
                out[:, leaf.features[i], leaf.features[j]] += got
                out[:, leaf.features[j], leaf.features[i]] += got
    phi, _ = tree_shap(leaves, x)
    for i in range(f):
        out[:, i, i] = phi[:, i] - out[:, i].sum(1) + out[:, i, i]
    return out


def shap_values(model: Model, df: DataFrame, features: list[str], fraction: float = 1.0, seed: int = 42) -> DataFrame:
    """(rid, feature, value, phi, base) for a sample of rows; the model's leaves go to all tasks, their number is the model's."""
    leaves = df.sparkSession.sparkContext.broadcast(leaves_of(model, df.sparkSession))
    rows = df.dropna(subset=features).select("rid", *features)
    rows = rows if fraction >= 1 else rows.sample(False, fraction, seed)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = f[features].to_numpy(float)
            phi, base = tree_shap(leaves.value, x)
            yield pd.DataFrame({"rid": np.repeat(f["rid"].to_numpy(), len(features)), "feature": np.tile(features, len(f)), "value": x.ravel(), "phi": phi.ravel(), "base": base})

    return rows.mapInPandas(run, "rid long, feature string, value double, phi double, base double")


def shap_interactions(model: Model, df: DataFrame, features: list[str], chosen: list[str] | None = None, fraction: float = 1.0, seed: int = 42) -> DataFrame:
    """(rid, feature_1, feature_2, phi) for the chosen features."""
    leaves = df.sparkSession.sparkContext.broadcast(leaves_of(model, df.sparkSession))
    rows = df.dropna(subset=features).select("rid", *features)
    rows = rows if fraction >= 1 else rows.sample(False, fraction, seed)
    at = [features.index(c) for c in (chosen or features)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            phi = tree_shap_interactions(leaves.value, f[features].to_numpy(float))[:, at][:, :, at]
            names = [features[i] for i in at]
            k = len(names)
            yield pd.DataFrame({"rid": np.repeat(f["rid"].to_numpy(), k * k), "feature_1": np.tile(np.repeat(names, k), len(f)), "feature_2": np.tile(names, k * len(f)), "phi": phi.ravel()})

    return rows.mapInPandas(run, "rid long, feature_1 string, feature_2 string, phi double")


def shap_summary(values: DataFrame) -> DataFrame:
    """(feature, mean_abs): how much each feature moves predictions."""
    return values.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs"))


def comparative_parity(results: list[Result]) -> DataFrame:
    """(model, rid, y_true, y_pred)."""
    out = None
    for r in results:
        own = r.oof.select(F.lit(r.name).alias("model"), "rid", "y_true", "y_pred")
        out = own if out is None else out.unionByName(own)
    return out


def comparative_residuals(results: list[Result]) -> DataFrame:
    return comparative_parity(results).withColumn("residual", F.col("y_true") - F.col("y_pred"))


def comparative_importances(importances: dict[str, DataFrame], top_n: int = 15) -> DataFrame:
    """One row a feature with a column for each model, the top_n by the mean of what is known."""
    out = None
    for n, f in importances.items():
        own = f.select("feature", F.col("importance").alias(n))
        out = own if out is None else out.join(own, "feature", "full_outer")
    names = list(importances)
    known = " + ".join(f"if(`{n}` is null, 0, 1)" for n in names)
    total = " + ".join(f"coalesce(`{n}`, 0d)" for n in names)
    return out.withColumn("mean_importance", F.expr(f"({total}) / ({known})")).orderBy(F.desc("mean_importance"), "feature").limit(top_n)
