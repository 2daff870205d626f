"""Spatial cross-validation, models over Spark ML, and their measures."""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.operators.grid import block_key
from furrow.operators.lag import positions
from furrow.scratch import cut

FOLDS = 5
#: Points that a variogram takes at most (documented bound: pairs grow with its square).
VARIOGRAM_POINTS = 5000


def some_rows(df: DataFrame, most: int, seed: int = 42, key: str = "rid") -> DataFrame:
    """At most that many rows: those whose hashes of seed and key come first."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(most)


def variogram_bins(points: DataFrame, value: str, bins: int = 10, max_lag: float | None = None, most: int = VARIOGRAM_POINTS, seed: int = 42) -> DataFrame:
    """(bin, lag, gamma, pairs): half the mean squared difference of values in equal bins of distance up to max_lag (the median distance)."""
    rows = cut(some_rows(points.dropna(subset=["x", "y", value]), most, seed).select("rid", "x", "y", F.col(value).alias("v")), "variogram")
    a, b = rows.alias("a"), F.broadcast(rows).alias("b")
    d = F.sqrt(F.expr("(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"))
    pairs = a.join(b, F.expr("a.rid < b.rid")).select(d.alias("d"), F.expr("(a.v - b.v) * (a.v - b.v) / 2").alias("g"))
    if max_lag is None:
        xy = np.array([(r["x"], r["y"]) for r in rows.collect()], float).reshape(-1, 2)
        max_lag = median_distance(xy)
    width = float(max_lag) / bins
    binned = pairs.where((F.col("d") > 0) & (F.col("d") <= float(max_lag))).withColumn("bin", F.expr(f"cast(least(ceil(d / {width!r}d) - 1, {bins - 1}) as int)"))
    return binned.groupBy("bin").agg(F.avg("g").alias("gamma"), F.count("*").alias("pairs")).select("bin", ((F.col("bin") + 1) * width).alias("lag"), "gamma", "pairs")


def median_distance(xy: np.ndarray) -> float:
    if len(xy) < 2:
        return 1.0
    i, j = np.triu_indices(len(xy), 1)
    return float(np.median(np.hypot(*(xy[i] - xy[j]).T)))


def spherical(h: np.ndarray, reach: float) -> np.ndarray:
    u = np.minimum(h / reach, 1)
    return 1.5 * u - 0.5 * u**3


def fit_spherical(lag: np.ndarray, gamma: np.ndarray, steps: int = 400) -> tuple[float, float]:
    """(range, sill) of least squares: for a given range the sill is linear, so one search over ranges does."""
    best = (np.inf, 0.0, 0.0)
    for reach in np.linspace(lag.max() / steps, lag.max() * 2, steps * 2):
        f = spherical(lag, reach)
        sill = float((f * gamma).sum() / max((f * f).sum(), 1e-300))
        error = float(((gamma - sill * f) ** 2).sum())
        if error < best[0]:
            best = (error, float(reach), sill)
    return best[1], best[2]


def optimal_block_size(points: DataFrame, value: str, most: int = VARIOGRAM_POINTS, harvester_width: float = 10, seed: int = 42) -> int:
    """The variogram's range as the nearest multiple of the harvester's width."""
    rows = variogram_bins(points, value, most=most, seed=seed).orderBy("bin").collect()
    reach, _ = fit_spherical(np.array([r["lag"] for r in rows]), np.array([r["gamma"] for r in rows]))
    return int(math.floor(reach / harvester_width + 0.5) * harvester_width)


def variogram_curve(points: DataFrame, value: str, **how) -> DataFrame:
    """variogram_bins() with the fitted curve and the range."""
    bins = cut(variogram_bins(points, value, **how), "variogram-bins")
    rows = bins.orderBy("bin").collect()
    reach, sill = fit_spherical(np.array([r["lag"] for r in rows]), np.array([r["gamma"] for r in rows]))
    u = f"least(lag / {reach!r}d, 1d)"
    return bins.withColumn("fitted", F.expr(f"{sill!r}d * (1.5 * {u} - 0.5 * pow({u}, 3))")).withColumn("range", F.lit(reach))


def block_split(df: DataFrame, size: float, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """df with block_id and is_test: whole blocks, ceil(test_size * blocks) of them by a seeded permutation of the blocks in the order of their numbers."""
    keyed = block_key(df, size)
    blocks = [r[0] for r in keyed.select("block_x", "block_y", "block_id").distinct().orderBy("block_x", "block_y").select("block_id").collect()]
    order = np.random.RandomState(seed).permutation(len(blocks))
    test = [(blocks[i],) for i in order[: math.ceil(test_size * len(blocks))]]
    marked = df.sparkSession.createDataFrame(test, "block_id string").withColumn("is_test", F.lit(True))
    return keyed.join(F.broadcast(marked), "block_id", "left").withColumn("is_test", F.coalesce("is_test", F.lit(False)))


def random_split(df: DataFrame, test_size: float = 0.3, seed: int = 42) -> DataFrame:
    """df with is_test for the share of rows whose hashes come first."""
    place = positions(df.withColumn("__h", F.xxhash64(F.lit(seed), "rid")), ["__h", "rid"])
    n = df.count()
    return place.withColumn("is_test", F.col("__pos") < math.ceil(test_size * n)).drop("__h", "__pos")


def group_folds(df: DataFrame, size: float, folds: int = FOLDS) -> DataFrame:
    """df with block_id and fold: blocks from the largest on go to the lightest fold (the first of equals). Only block sizes come to the driver."""
    keyed = block_key(df, size)
    sizes = keyed.groupBy("block_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "block_id").collect()
    load, rows = [0] * folds, []
    for r in sizes:
        f = load.index(min(load))
        load[f] += r["n"]
        rows.append((r["block_id"], f))
    return keyed.join(F.broadcast(df.sparkSession.createDataFrame(rows, "block_id string, fold int")), "block_id")


def regression_metrics(df: DataFrame, truth: str = "y_true", predicted: str = "y_pred", by: list[str] = ()) -> DataFrame:
    """n, r2 and rmse, over all or by groups; r2 is null where the truth does not vary."""
    rows = df.dropna(subset=[truth, predicted])
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(F.pow(F.col(truth) - F.col(predicted), 2)).alias("sse"), (F.var_pop(truth) * F.count("*")).alias("sst")
    )
    return out.select(*by, "n", F.expr("if(sst = 0, null, 1 - sse / sst)").alias("r2"), F.sqrt(F.col("sse") / F.col("n")).alias("rmse"))


@dataclass
class Result:
    """What a fitted model leaves."""

    name: str
    model: Model
    features: list[str]
    oof: DataFrame | None = None
    importances: DataFrame | None = None
    extra: dict = field(default_factory=dict)


def assembled(df: DataFrame, features: list[str], target: str | None = None) -> DataFrame:
    rows = df.dropna(subset=[*features, *([target] if target else [])])
    out = VectorAssembler(inputCols=features, outputCol="features").transform(rows)
    return out.withColumn("label", F.col(target).cast("double")) if target else out


def forest(trees: int = 150, depth: int = 10, seed: int = 42, **params) -> RandomForestRegressor:
    return RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed, **params)


def boosted(rounds: int = 150, depth: int = 5, seed: int = 42, **params) -> GBTRegressor:
    return GBTRegressor(maxIter=rounds, maxDepth=depth, seed=seed, **params)


def cross_validated(df: DataFrame, features: list[str], target: str, estimator, block_size: float = 50, parallel: int = 2) -> DataFrame:
    """rid, x, y, fold, y_true, y_pred: each row predicted by a model that saw none of its block's fold. Folds are fitted side by side."""
    rows = cut(group_folds(assembled(df, features, target), block_size).select("rid", "x", "y", "fold", "features", "label"), "folds")

    def one(k: int) -> DataFrame:
        model = estimator.copy().fit(rows.where(F.col("fold") != k))
        return model.transform(rows.where(F.col("fold") == k)).select("rid", "x", "y", "fold", F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"))

    with ThreadPoolExecutor(parallel) as pool:
        parts = list(pool.map(one, [r[0] for r in rows.select("fold").distinct().orderBy("fold").collect()]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def predict_spatial(df: DataFrame, features: list[str], target: str, estimator, name: str, block_size: float = 50, cv: bool = True, repeats: int = 10, seed: int = 42) -> Result:
    """The spatial cross-validation's predictions, a model fitted on all rows, and its permutation importances (on the rows it was fitted on)."""
    rows = assembled(df, features, target)
    model = estimator.fit(rows)
    if not cv:
        return Result(name, model, features)
    oof = cut(cross_validated(df, features, target, estimator, block_size), "oof")
    return Result(name, model, features, oof, permutation_importance(model, df, features, target, repeats, seed))


def rf_predict_spatial(df: DataFrame, features: list[str], target: str, block_size: float = 50, name: str = "rf_spatial", params: dict | None = None, cv: bool = True, **how) -> Result:
    return predict_spatial(df, features, target, forest(**(params or {})), name, block_size, cv, **how)


def xgb_predict_spatial(df: DataFrame, features: list[str], target: str, block_size: float = 50, name: str = "xgb_spatial", params: dict | None = None, cv: bool = True, **how) -> Result:
    """As rf_predict_spatial() with gradient-boosted trees."""
    return predict_spatial(df, features, target, boosted(**(params or {})), name, block_size, cv, **how)


def permutation_importance(model: Model, df: DataFrame, features: list[str], target: str, repeats: int = 10, seed: int = 42) -> DataFrame:
    """(feature, importance, sd): how much R² falls when a column's values change places, over repeats.

    A column changes places by joining rows' places in one order with those in a seeded other order.
    """
    rows = positions(df.dropna(subset=[*features, target]).select("rid", *features, F.col(target).cast("double").alias("label")), ["rid"])
    rows = cut(rows, "permutation")
    base = regression_metrics(model.transform(assembled(rows, features)), "label", "prediction").first()["r2"]
    got = []
    for repeat in range(repeats):
        turned = positions(rows.select(*features).withColumn("__h", F.xxhash64(F.lit(seed + repeat), *features)).withColumn("__t", F.rand(seed + repeat)), ["__h", "__t"]).drop("__h", "__t")
        for i, f in enumerate(features):
            other = turned.select("__pos", F.col(f).alias("__v"))
            mixed = rows.join(other, "__pos").withColumn(f, F.col("__v"))
            r2 = regression_metrics(model.transform(assembled(mixed, features)), "label", "prediction").first()["r2"]
            got.append((i, f, (base or 0.0) - (r2 or 0.0)))
    scores = df.sparkSession.createDataFrame(got, "i int, feature string, drop double")
    return scores.groupBy("feature").agg(F.avg("drop").alias("importance"), F.stddev_pop("drop").alias("sd"))


def gini_importances(model: Model, features: list[str], spark) -> DataFrame:
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, model.featureImportances.toArray(), strict=True)], "feature string, importance double")


def top_features(importances: DataFrame, n: int = 10) -> DataFrame:
    return importances.orderBy(F.desc("importance"), "feature").limit(n)


def cv_rmse(df: DataFrame, features: list[str], target: str, estimator, block_size: float) -> float:
    return regression_metrics(cross_validated(df, features, target, estimator, block_size)).first()["rmse"]


def tune_random(df: DataFrame, features: list[str], target: str, build: Callable[..., object], space: dict[str, list], n_iter: int = 10, block_size: float = 50, seed: int = 42) -> tuple[Model, DataFrame]:
    """(model, trials): n_iter random settings of the space, judged by the RMSE of the spatial cross-validation; the best refitted on all rows."""
    rng = np.random.RandomState(seed)
    trials = []
    for i in range(n_iter):
        params = {k: v[rng.randint(len(v))] for k, v in space.items()}
        trials.append((i, params, cv_rmse(df, features, target, build(**params), block_size)))
    return finish_trials(df, features, target, build, trials)


def finish_trials(df: DataFrame, features: list[str], target: str, build: Callable, trials: list) -> tuple[Model, DataFrame]:
    best = min(trials, key=lambda t: (t[2], t[0]))
    table = df.sparkSession.createDataFrame([(i, {k: str(v) for k, v in p.items()}, float(r), i == best[0]) for i, p, r in trials], "trial int, params map<string,string>, rmse double, best boolean")
    return build(**best[1]).fit(assembled(df, features, target)), table


#: Search spaces (fixed values): a range with a step, a logarithmic range, or choices.
SPACES = {
    "rf": {"trees": ("step", 100, 500, 50), "depth": ("step", 3, 30, 1), "minInstancesPerNode": ("step", 5, 15, 1), "featureSubsetStrategy": ("choice", ["sqrt", "log2", "0.33", "0.5", "0.75"])},
    "xgb": {"rounds": ("step", 50, 500, 50), "stepSize": ("log", 0.01, 0.5), "depth": ("step", 3, 15, 1), "subsamplingRate": ("real", 0.5, 0.9), "featureSubsetStrategy": ("choice", ["0.4", "0.6", "0.8", "1.0"])},
}


class ParzenSampler:
    """Draws settings near good trials rather than near bad ones (tree-structured Parzen estimator, seeded)."""

    def __init__(self, space: dict, seed: int = 42, startup: int = 10, candidates: int = 24, good: float = 0.25):
        self.space, self.rng = space, np.random.RandomState(seed)
        self.startup, self.candidates, self.good = startup, candidates, good

    def span(self, kind: tuple) -> tuple[float, float]:
        return (math.log(kind[1]), math.log(kind[2])) if kind[0] == "log" else (float(kind[1]), float(kind[2]))

    def value(self, kind: tuple, u: float):
        if kind[0] == "step":
            return int(round((u - kind[1]) / kind[3])) * kind[3] + kind[1]
        return math.exp(u) if kind[0] == "log" else u

    def draw(self, trials: list) -> dict:
        """trials: (settings as drawn, loss)."""
        out = {}
        ranked = sorted(trials, key=lambda t: t[1])
        n = max(1, math.ceil(self.good * len(ranked)))
        for name, kind in self.space.items():
            if kind[0] == "choice":
                weights = np.ones(len(kind[1]))
                if len(trials) >= self.startup:
                    for t, _ in ranked[:n]:
                        weights[kind[1].index(t[name])] += 1
                out[name] = kind[1][self.rng.choice(len(kind[1]), p=weights / weights.sum())]
                continue
            low, high = self.span(kind)
            if len(trials) < self.startup:
                out[name] = self.value(kind, self.rng.uniform(low, high))
                continue
            place = lambda t: math.log(t[name]) if kind[0] == "log" else float(t[name])  # noqa: E731, B023
            near, far = (np.array([place(t) for t, _ in part] or [(low + high) / 2]) for part in (ranked[:n], ranked[n:]))
            sd = max((high - low) / math.sqrt(len(trials) + 1), 1e-12)
            tries = np.clip(self.rng.choice(near, self.candidates) + self.rng.normal(0, sd, self.candidates), low, high)
            density = lambda c: np.exp(-0.5 * ((tries[:, None] - c) / sd) ** 2).mean(1) + 1e-300  # noqa: E731, B023
            out[name] = self.value(kind, float(tries[np.argmax(density(near) / density(far))]))
        return out


def tune_bayes(df: DataFrame, features: list[str], target: str, model_type: str = "xgb", n_trials: int = 30, block_size: float = 50, seed: int = 42, space: dict | None = None) -> tuple[Model, DataFrame]:
    """(model, trials): settings drawn by a Parzen sampler to lower the RMSE of the spatial cross-validation; the best refitted on all rows."""
    if model_type not in SPACES:
        raise ValueError(f"model_type must be rf or xgb, not {model_type!r}")
    rows = df.dropna(subset=[*features, target])
    sampler = ParzenSampler(space or SPACES[model_type], seed)
    build = forest if model_type == "rf" else boosted
    trials: list = []
    for i in range(n_trials):
        params = sampler.draw([(p, r) for _, p, r in trials])
        trials.append((i, params, cv_rmse(rows, features, target, build(**params), block_size)))
    return finish_trials(rows, features, target, build, trials)


def score_field(model: Model, df: DataFrame, features: list[str], target: str) -> DataFrame:
    """rid, x, y, y_true, y_pred, residual over the whole field."""
    out = model.transform(assembled(df, features, target))
    return out.select("rid", "x", "y", F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"), (F.col("label") - F.col("prediction")).alias("residual"))


def compare_models(results: list[Result]) -> DataFrame:
    """(model, fold, n, r2, rmse): a benchmark over the folds."""
    out = None
    for r in results:
        own = regression_metrics(r.oof, by=["fold"]).withColumn("model", F.lit(r.name)).select("model", "fold", "n", "r2", "rmse")
        out = own if out is None else out.unionByName(own)
    return out


def full_diagnostics(result: Result) -> dict[str, DataFrame]:
    """The frames of a model's report: parity and residuals, overall measures, both importances."""
    spark = result.oof.sparkSession
    return {
        "parity": result.oof.select("rid", "x", "y", "fold", "y_true", "y_pred", (F.col("y_true") - F.col("y_pred")).alias("residual")),
        "metrics": regression_metrics(result.oof),
        "permutation": result.importances,
        "gini": gini_importances(result.model, result.features, spark),
    }


def train_final(df: DataFrame, features: list[str], target: str, estimator) -> Model:
    """Fitted on all rows."""
    return estimator.fit(assembled(df, features, target))


def predictors(df: DataFrame, excluded: list[str]) -> list[str]:
    """The columns that are not on the list of those which are no features."""
    return [c for c in df.columns if c not in set(excluded)]
