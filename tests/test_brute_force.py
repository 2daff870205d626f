"""What SQL has no form for, against plain NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from furrow.operators import explain, geoforest, modelling, neighbours


@pytest.fixture(scope="module")
def field(spark):
    rng = np.random.default_rng(11)
    n = 160
    x, y = rng.uniform(0, 100, n), rng.uniform(0, 100, n)
    return pd.DataFrame({"rid": np.arange(n), "x": x, "y": y, "z": rng.normal(size=n), "t": np.sin(x / 20) + y / 50 + rng.normal(0, 0.1, n)})


def test_variogram(spark, field):
    got = modelling.variogram_bins(spark.createDataFrame(field), "t", bins=5, max_lag=50.0).orderBy("bin").collect()
    i, j = np.triu_indices(len(field), 1)
    d = np.hypot(field.x.values[i] - field.x.values[j], field.y.values[i] - field.y.values[j])
    g = (field.t.values[i] - field.t.values[j]) ** 2 / 2
    for r in got:
        inside = (d > 10 * r["bin"]) & (d <= 10 * (r["bin"] + 1))
        assert r["pairs"] == inside.sum() and r["gamma"] == pytest.approx(g[inside].mean()) and r["lag"] == 10 * (r["bin"] + 1)
    whole = modelling.variogram_bins(spark.createDataFrame(field), "t")
    assert whole.selectExpr("max(lag)").first()[0] == pytest.approx(np.median(d))


def test_moran(spark, field):
    ks = [3, 8]
    got = {r["bandwidth"]: r for r in geoforest.moran(spark.createDataFrame(field), "t", ks).collect()}
    xy, z = field[["x", "y"]].to_numpy(), field.t.to_numpy() - field.t.mean()
    n = len(field)
    d = ((xy[:, None] - xy) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    for k in ks:
        w = np.zeros((n, n))
        for i in range(n):
            w[i, np.lexsort((np.arange(n), d[i]))[:k]] = 1
        s0, s1, s2 = w.sum(), ((w + w.T) ** 2).sum() / 2, ((w.sum(0) + w.sum(1)) ** 2).sum()
        index, mean = n / s0 * (z @ w @ z) / (z @ z), -1 / (n - 1)
        variance = (n * n * s1 - n * s2 + 3 * s0 * s0) / ((n * n - 1) * s0 * s0) - mean**2
        assert got[k]["i"] == pytest.approx(index) and got[k]["z"] == pytest.approx((index - mean) / variance**0.5)


def test_partial_dependence(spark, field):
    df, names = spark.createDataFrame(field), ["x", "y", "z"]
    model = modelling.train_final(df, names, "t", modelling.forest(trees=3, depth=3))
    pdp, _ = explain.pdp_ice(model, df, names, names, 4)
    leaves = explain.leaves_of(model, spark)

    def predicted(x):
        phi, base = explain.tree_shap(leaves, x)
        return phi.sum(1) + base

    for r in pdp.collect():
        x = field[names].to_numpy().copy()
        x[:, names.index(r["feature"])] = r["value"]
        assert r["pdp"] == pytest.approx(predicted(x).mean())


def test_shapley_values_by_definition(spark, field):
    """Against the sum over all orders of features of a two-split tree's conditional means."""
    from itertools import permutations

    df, names = spark.createDataFrame(field), ["x", "y", "z"]
    leaves = explain.leaves_of(modelling.train_final(df, names, "t", modelling.forest(trees=2, depth=2)), spark)
    x = field[names].to_numpy()[:10]

    def value(row, known):
        return sum(leaf.value * np.prod([float(lo < row[f] <= hi) if f in known else share for f, lo, hi, share in zip(leaf.features, leaf.low, leaf.high, leaf.share, strict=True)]) for leaf in leaves)

    phi, _ = explain.tree_shap(leaves, x)
    for row, got in zip(x, phi, strict=True):
        want = np.zeros(3)
        for order in permutations(range(3)):
            known: set = set()
            for f in order:
                before = value(row, known)
                known.add(f)
                want[f] += (value(row, known) - before) / 6
        assert np.allclose(got, want)


def test_folds_by_hand(spark, field):
    rows = modelling.group_folds(spark.createDataFrame(field), 25).select("block_id", "fold").toPandas()
    sizes = rows.groupby("block_id").size().reset_index(name="n").sort_values(["n", "block_id"], ascending=[False, True])
    load, want = [0] * 5, {}
    for b, n in zip(sizes.block_id, sizes.n, strict=True):
        f = load.index(min(load))
        load[f] += n
        want[b] = f
    assert dict(zip(rows.block_id, rows.fold, strict=True)) == want


def test_permutation_importance_ranks(spark, field):
    df = spark.createDataFrame(field)
    model = modelling.train_final(df, ["x", "z"], "t", modelling.forest(trees=5, depth=4))
    got = {r["feature"]: r["importance"] for r in modelling.permutation_importance(model, df, ["x", "z"], "t", repeats=2).collect()}
    assert got["x"] > got["z"]


def test_neighbours_by_blocks(spark):
    """Against all distances: a dense and a sparse field far apart, equal places, and points at the edges that need wider margins."""
    rng = np.random.default_rng(4)
    xy = np.concatenate([rng.uniform(0, 30, (1500, 2)), rng.uniform(0, 30, (60, 2)) * 20 + 1e5, np.full((20, 2), 7.0), np.arange(40).repeat(2).reshape(40, 2) % 5])
    points = pd.DataFrame({"rid": rng.permutation(len(xy)), "x": xy[:, 0], "y": xy[:, 1]})
    asked = points.iloc[::7]

    def one(left, right, near, d2):
        ids = right["rid"].to_numpy()
        return pd.DataFrame({"rid": left["rid"].to_numpy(), "near": [list(map(int, ids[r])) for r in near], "far": d2[:, -1]})

    df = spark.createDataFrame(points)
    got = neighbours.nearest_by_blocks(df.where(F.col("rid").isin(asked["rid"].tolist())), df, 12, one, "rid long, near array<long>, far double").collect()
    assert len(got) == len(asked)
    rid, at = points["rid"].to_numpy(), {r: i for i, r in enumerate(points["rid"])}
    for r in got:
        d2 = ((xy - xy[at[r["rid"]]]) ** 2).sum(1)
        order = np.lexsort((rid, d2))[:12]
        assert r["near"] == rid[order].tolist() and r["far"] == d2[order[-1]]


def test_trees_that_grow_side_by_side():
    """Against one tree at a time, on one feature, which leaves no choice."""
    rng = np.random.default_rng(5)
    x, q = rng.integers(0, 25, (50, 30, 1)).astype(float), rng.uniform(0, 25, (50, 1))
    y, ids = np.sin(x[:, :, 0] / 4) + 1000, np.arange(50)
    counts = geoforest.resampled(rng.uniform(0.1, 1, (50, 30)), ids, 2, 5)
    assert (counts.sum(2) == 30).all()
    got, gains = geoforest.grow_side_by_side(x, y, q, counts[1], ids, 1)

    def plain(v, t, w, at, level):
        """(predictions, gain): every cut is tried."""
        mean, sse = np.average(t, weights=w), lambda m: (w[m] * (t[m] - np.average(t[m], weights=w[m])) ** 2).sum()
        best = (1e-12, None)
        for a, b in zip(np.unique(v)[:-1], np.unique(v)[1:], strict=True) if level < 8 else ():
            low = v <= a
            if low.sum() >= 3 and (~low).sum() >= 3:
                best = max(best, (sse(np.full(len(v), True)) - sse(low) - sse(~low), -(a + b) / 2), key=lambda o: o[0])
        if best[1] is None:
            return np.full(len(at), mean), 0.0
        low, out, gain = v <= -best[1], np.empty(len(at)), best[0]
        for rows, places in ((low, at <= -best[1]), (~low, at > -best[1])):
            out[places], more = plain(v[rows], t[rows], w[rows], at[places], level + 1)
            gain += more
        return out, gain

    for p in range(50):
        rows = counts[1, p] > 0
        want, gain = plain(x[p, rows, 0], y[p, rows], counts[1, p, rows], np.append(x[p, :, 0], q[p]), 0)
        assert np.allclose(got[p], want, rtol=0, atol=1e-9) and gains[p, 0] == pytest.approx(gain)


def test_local_forests_wait_until_asked(spark, field):
    """The training points' own forests are only grown for the maps."""
    asked = []
    out = geoforest.GeoForest(None, spark.createDataFrame(field), lambda: asked.append(1) or "maps", ["x"])
    assert not asked and out.local == "maps" == out.local and asked == [1]
