import json
import math
import struct
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from furrow.functions import geometry as geo
from furrow.operators import explain, filters, frames, geoforest, grid, lag, modelling, neighbours
from furrow.sources import layers
from furrow.sources.shapefile import read_shapefile


def layer(spark, rows, columns="rid long, x double, y double, v double"):
    return spark.createDataFrame(rows, columns)


def square(x, y, side):
    return [[{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y))]]


def polygons(spark, rows):
    """rows: (rid, multipolygon)."""
    return spark.createDataFrame(rows, f"rid long, geometry {geo.MULTIPOLYGON}")


# ---- geometry ----


def test_area_and_centroid_with_a_hole(spark):
    hole = square(2, 2, 2)[0][::-1]
    df = polygons(spark, [(1, [[square(0, 0, 10)[0], hole]]), (2, [square(0, 0, 2), square(10, 0, 2)])])
    cx, cy = geo.centroid("geometry")
    got = {r["rid"]: r for r in df.select("rid", F.expr(geo.area("geometry")).alias("a"), F.expr(cx).alias("x"), F.expr(cy).alias("y")).collect()}
    assert got[1]["a"] == 96 and got[1]["x"] == pytest.approx((100 * 5 - 4 * 3) / 96)
    assert (got[2]["a"], got[2]["x"], got[2]["y"]) == (8, 6, 1)


def test_covers_counts_edges(spark):
    df = polygons(spark, [(1, [square(0, 0, 10)])]).crossJoin(layer(spark, [(1, 0.0, 5.0, 0.0), (2, 5.0, 5.0, 0.0), (3, 10.0, 10.0, 0.0), (4, 10.1, 5.0, 0.0), (5, -3.0, -4.0, 0.0)]).drop("rid"))
    got = df.select("x", F.expr(geo.covers("x", "y", "geometry")).alias("in"), F.expr(geo.distance("x", "y", "geometry")).alias("d")).collect()
    assert {r["x"]: r["in"] for r in got} == {0.0: True, 5.0: True, 10.0: True, 10.1: False, -3.0: False}
    assert {r["x"]: round(r["d"], 9) for r in got}[-3.0] == 5


def test_clipping_matches_rectangles():
    rng = np.random.default_rng(1)
    for _ in range(200):
        x0, y0, w, h = *rng.uniform(-2, 2, 2), *rng.uniform(0.1, 3, 2)
        ring = np.array([(x0, y0), (x0 + w, y0), (x0 + w, y0 + h), (x0, y0 + h)])
        cell = np.array([(0, 0), (1, 0), (1, 1), (0, 1)], float)
        want = max(0, min(1, x0 + w) - max(0, x0)) * max(0, min(1, y0 + h) - max(0, y0))
        assert geo.flat_area(geo.clip_convex(ring, cell)) == pytest.approx(want, abs=1e-12)


def test_hull_area(spark):
    rows = [(i, *p, 0.0) for i, p in enumerate([(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0), (1.0, 1.0), (2.0, 2.0)])]
    assert geo.hull_area(layer(spark, rows).repartition(3)).first()[0] == 12


def test_transverse_mercator_known_place(spark):
    df = spark.createDataFrame([(1, 21.0, 0.0), (2, 18.5, -33.9)], "rid long, x double, y double")
    got = {r["rid"]: r for r in layers.reproject(df, 4326, 32734).collect()}
    assert (got[1]["x"], got[1]["y"]) == (pytest.approx(500000), pytest.approx(10000000))
    assert got[2]["x"] == pytest.approx(268830, abs=500) and 6.24e6 < got[2]["y"] < 6.25e6
    back = {r["rid"]: r for r in layers.reproject(layers.reproject(df, 4326, 32734), 32734, 4326).collect()}
    assert back[2]["x"] == pytest.approx(18.5, abs=1e-8) and back[2]["y"] == pytest.approx(-33.9, abs=1e-8)
    with pytest.raises(ValueError):
        layers.reproject(df, 4326, 2154)


# ---- filters and neighbourhoods ----


def test_filter_parameter(spark):
    df = layer(spark, [(1, 0.0, 0.0, 1.0), (2, 0.0, 0.0, 2.0), (3, 0.0, 0.0, 4.0), (4, 0.0, 0.0, None)])
    assert sorted(r["rid"] for r in filters.filter_parameter(df, "v", "v", "bounds", 2, 4).collect()) == [2, 3]
    assert sorted(r["rid"] for r in filters.filter_parameter(df, "v", "v", "percentile", 0.05, 1.0).collect()) == [2, 3]
    assert filters.filter_parameter(df, "v", "v", "SD", 1, 1).count() == 2
    with pytest.raises(ValueError):
        filters.filter_parameter(df, "v", "v", "other")


def test_bounds_reach_the_scan(spark, tmp_path):
    layer(spark, [(1, 0.0, 0.0, 1.0)]).write.parquet(str(tmp_path / "p"))
    df = filters.filter_parameter(spark.read.parquet(str(tmp_path / "p")), "v", "v", "bounds", 2, 4).select("rid")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(v,2" in plan and "ReadSchema: struct<rid:bigint,v:double>" in plan


def test_spike_goes_and_lone_point_stays(spark):
    rows = [(i * 3 + j, float(i), float(j), 100.0 if (i, j) == (1, 1) else 5.0) for i in range(3) for j in range(3)] + [(99, 500.0, 500.0, 7.0), (98, 0.5, 0.5, None)]
    clean, out = filters.remove_local_outliers(layer(spark, rows[:-1]), "v", "dist", 2.0, 1.0)
    assert 4 in {r["rid"] for r in out.collect()} and 99 in {r["rid"] for r in clean.collect()}
    _, out = filters.remove_local_outliers(layer(spark, rows), "v", "dist", 2.0, 1.0)
    assert {0, 4, 98} <= {r["rid"] for r in out.collect()}  # a null neighbour spoils its neighbours
    with pytest.raises(ValueError):
        filters.remove_local_outliers(layer(spark, rows), "v", "other")


def test_density_peel_ends_empty(spark):
    chain = layer(spark, [(i, float(i), 0.0, 0.0) for i in range(4)])
    assert filters.remove_spatial_outliers(chain, 1.0, 2).count() == 0
    assert filters.remove_spatial_outliers(chain, 1.0, 2, max_iters=1).count() == 2
    assert filters.remove_spatial_outliers(chain, 1.0, 1).count() == 4


def test_coincident_points_are_neighbours(spark):
    df = layer(spark, [(1, 0.0, 0.0, 1.0), (2, 0.0, 0.0, 2.0), (3, 5.0, 0.0, 3.0)])
    got = {(r["rid"], r["nid"]) for r in neighbours.nearest(df, df.select("rid", "x", "y"), 1, without_self=True).collect()}
    assert got == {(1, 2), (2, 1), (3, 1)}
    with pytest.raises(ValueError):
        neighbours.nearest(df, df, 3, without_self=True)


def test_nearest_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    xy = np.concatenate([rng.uniform(0, 100, (150, 2)), rng.normal(50, 0.5, (100, 2)), [[1000.0, 1000.0]]])
    df = layer(spark, [(i, float(x), float(y), 0.0) for i, (x, y) in enumerate(xy)])
    got = {(r["rid"], r["rank"]): r["nid"] for r in neighbours.nearest(df, df.select("rid", "x", "y"), 5, without_self=True).collect()}
    d = ((xy[:, None] - xy) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = {(i, k + 1): int(j) for i in range(len(xy)) for k, j in enumerate(np.lexsort((np.arange(len(xy)), d[i]))[:5])}
    assert got == want


def test_tilted_plane_and_flat_ground(spark):
    rows = [(i * 5 + j, float(i), float(j), 0.1 * i) for i in range(5) for j in range(5)]
    df = spark.createDataFrame(rows, "rid long, x double, y double, z double")
    for crit, s in (("dist", 2.0), ("neighbours", 9)):
        got = {r["rid"]: r for r in neighbours.terrain(df, crit, s).collect()}[12]
        assert got["slope_deg"] == pytest.approx(math.degrees(math.atan(0.1))) and got["aspect_deg"] == pytest.approx(270)
    flat = neighbours.terrain(df.withColumn("z", F.lit(1.0)), "dist", 2.0).first()
    assert (flat["slope_deg"], flat["aspect_deg"]) == (0, 180)
    two = neighbours.terrain(df.where("rid < 2"), "dist", 2.0).first()
    assert two["slope_deg"] is None and two["aspect_deg"] is None


def test_boundary(spark):
    trial = polygons(spark, [(1, [square(0, 0, 100)])])
    df = layer(spark, [(1, 50.0, 50.0, 0.0), (2, 100.9, 50.0, 0.0), (3, 101.2, 50.0, 0.0), (4, 85.0, 50.0, 0.0), (5, 80.0, 50.0, 0.0), (6, None, 1.0, 0.0)])
    kept, removed = filters.remove_boundary_data(df, trial)
    assert {r["rid"] for r in kept.collect()} == {1, 2, 4, 5} and {r["rid"] for r in removed.collect()} == {3, 6}
    kept, _ = filters.remove_boundary_data(df, trial, 20)
    assert {r["rid"] for r in kept.collect()} == {1, 5}
    # plots less than two metres apart grow together
    pair = polygons(spark, [(1, [square(0, 0, 50)]), (2, [square(51, 0, 50)])])
    assert {r["rid"] for r in filters.remove_boundary_data(layer(spark, [(1, 50.5, 25.0, 0.0)]), pair, 10)[0].collect()} == {1}


def test_largest_polygon_goes(spark):
    df = polygons(spark, [(1, [square(0, 0, 5)]), (2, [square(0, 0, 9)]), (3, [square(20, 20, 9)])])
    assert {r["rid"] for r in filters.trial_boundaries(df).collect()} == {1, 3}


def test_one_hot(spark):
    df = spark.createDataFrame([(1, "b", "x"), (2, "a", "x"), (3, None, "y"), (4, "c", "y")], "rid long, p string, q string")
    out, names = filters.text_encoder(df, ["p", "q"])
    assert names == ["p_b", "p_c", "q_y"] and {tuple(r) for r in out.collect()} == {(1, 1.0, 0.0, 0.0), (2, 0.0, 0.0, 0.0), (4, 0.0, 1.0, 1.0)}


# ---- order, lag ----


def serpentine(spark, lag_rows=8, passes=20, length=100, seed=0):
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for p in range(passes):
        line = np.arange(length) * 2.0
        xs += list(line if p % 2 == 0 else line[::-1])
        ys += [p * 6.0] * length
    x, y = np.array(xs), np.array(ys)
    waves = rng.uniform(-0.06, 0.06, (12, 2))
    v = sum(np.sin(a * x + b * y + i) for i, (a, b) in enumerate(waves)) + 10
    return spark.createDataFrame(pd.DataFrame({"rid": range(len(x)), "seq": range(len(x)), "x": x, "y": y, "v": np.roll(v, lag_rows)}))


def test_positions_and_shifts(spark):
    df = spark.createDataFrame([(i, (i * 37) % 101) for i in range(101)], "rid long, k long")
    got = lag.positions(df, ["k"]).collect()
    assert all(r["__pos"] == r["k"] for r in got)
    moved = {r["k"]: r["rid_next"] for r in lag.shifted(df, ["k"], 2, ["rid"], suffix="_next").collect()}
    by = {k: i for i, k in df.collect()}
    assert all(moved[k] == by.get(k + 2) for k in range(101))


def test_lag_search_finds_a_planted_lag(spark):
    _, best = lag.robust_pcdi(serpentine(spark), 6.0, delay_min=0, delay_max=16, iterations=3)
    got = best.first()
    assert abs(got["best_delay"] - 8) <= 3 and got["sd_best"] is not None


def test_literal_lag_search_says_nothing(spark):
    scores = lag.pcdi(serpentine(spark, passes=8), 6.0, 0, 3, 1, literal=True).toPandas()
    assert scores["rsc"].abs().max() < 1e-9


@pytest.mark.parametrize("n, span, literal", [(64, 20, False), (64, 64, False), (32, 1, False), (64, 20, True)])
def test_lag_scores_equal_those_of_whole_images(n, span, literal, monkeypatch):
    monkeypatch.setattr(lag, "HELD", span * 12)  # so that the field's lines take several rounds
    monkeypatch.setattr(lag, "BLOCK", n * 4)
    rng = np.random.default_rng(1)
    i, j = (c[order] for c in np.nonzero(rng.random((span, n)) < 0.7) for order in [np.random.default_rng(2).permutation(len(c))])
    v, noise = rng.normal(50, 9, len(i)), lag.Noise(n, span, 50.0, 9.0, 0, 3)
    fields = []
    for image in (0, 1):
        beyond = np.concatenate([noise.beyond(k, min(k + 4, n // 2 + 1), image) for k in range(0, n // 2 + 1, 4)])
        fields.append(np.concatenate([[noise.line(k, image) for k in range(span)], np.fft.irfft(beyond.T, n) if n > span else np.empty((0, n))]))
    grid_, mask = np.zeros((n, n)), np.zeros((n, n), bool)
    grid_[i, j], mask[i, j] = v, True
    coupled = mask & np.roll(mask, (1, 1), (0, 1))
    first = np.where(coupled, grid_, fields[0])
    second = np.roll(first, (1, 1), (0, 1)) if literal else np.where(coupled, np.roll(grid_, (1, 1), (0, 1)), fields[1])
    assert lag.field_phase_consistency(i, j, v, noise, literal) == pytest.approx(lag.phase_consistency(first, second), abs=1e-12)
    assert fields[0].mean() == pytest.approx(50, abs=1) and fields[1].std() == pytest.approx(9, abs=1) and abs(np.corrcoef(fields[0].ravel(), fields[1].ravel())[0, 1]) < 0.1


def test_lag_search_holds_no_whole_image():
    """A strip of 4,096 pixels: one image would take 134 MB."""
    i, j = np.divmod(np.arange(20 * 4096), 4096)
    tracemalloc.start()
    lag.field_phase_consistency(i, j, np.sin(i + j / 7.0), lag.Noise(4096, 20, 0.0, 1.0, 0, 0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6


def test_lag_search_on_either_axis(spark):
    """Turning the field by its diagonal changes neither pixels nor couplings."""
    df = serpentine(spark, passes=8)
    turned = df.select("rid", "seq", F.col("y").alias("x"), F.col("x").alias("y"), "v")
    one, two = ({(r["iter"], r["delay"]): r["rsc"] for r in lag.pcdi(d, 6.0, 6, 9, 3).collect()} for d in (df, turned))
    assert one == pytest.approx(two) and len(one) == 12


def test_lag_scores_of_several_delays_equal_those_of_each_alone(spark):
    """Rows without yield or coordinates and steps beyond the rows' ends included."""
    rng = np.random.default_rng(5)
    rows = [(k, None if k % 11 == 0 else float(k % 20 * 3), float(k // 20 * 3 % 61), None if k % 7 == 0 else float(v)) for k, v in enumerate(rng.normal(30, 4, 400))]
    df = spark.createDataFrame(rows, "seq long, x double, y double, v double")
    got = {(r["iter"], r["delay"]): r["rsc"] for r in lag.pcdi(df, 6.0, -5, 5, 2).collect()}
    layer, n, span, mean, sd = lag.pixels(df, 6.0, "v")
    layer = layer.toPandas().sort_values("pos")
    for (run, delay), rsc in got.items():
        moved = layer.assign(v=layer["v"].shift(-delay)).dropna()
        means = moved.groupby("cell")["v"].mean()
        i, j = np.divmod(means.index.to_numpy().astype(np.int64), n)
        assert rsc == pytest.approx(lag.field_phase_consistency(i, j, means.to_numpy(), lag.Noise(n, span, mean, sd, 0, run)), abs=1e-12)
    assert len(got) == 22


@pytest.mark.parametrize("name", ["pcdi_curve", "lag_summary"])
def test_lag_queries_search_all_delays(spark, name, monkeypatch):
    """The operator's own range and runs: 65 delays, 10 runs."""
    from furrow import queries

    asked, whole = [], lag.pcdi
    monkeypatch.setattr(lag, "pcdi", lambda *a, **how: asked.append(whole(*a, **how)) or asked[0])
    rows = queries.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert asked[0].groupBy("delay").count().where("count = 10").count() == 65
    assert sorted(r["delay"] for r in rows) == list(range(-32, 33)) if name == "pcdi_curve" else len(rows) == 1


def test_manual_lag(spark):
    df = spark.createDataFrame([(i, float(i), 0.0, f"2024-01-01 00:00:{i // 2:02d}", float(i)) for i in range(20)], "rid long, x double, y double, t string, v double")
    got = {r["rid"]: r["v"] for r in lag.manual_lag_correction(df, "t", 2, 1).collect()}
    assert got == {i: float(i + 4) for i in range(16)}


# ---- grids ----


def test_cells_and_mass(spark):
    df = layer(spark, [(1, 0.0, 0.0, 1.0), (2, 9.5, 5.0, 3.0), (3, 15.0, 5.0, 5.0)])
    g = grid.create_spatial_grid(df, 10)
    assert (g.x0, g.y0, g.nx, g.ny) == (-20, -20, 6, 5)
    assert grid.points_on_cells(df.where("rid = 2"), g).count() == 2 and grid.points_on_cells(df, g, 0).count() == 3
    assert grid.mass_report(df, g, "v", tolerance=0).first()["equal"]
    got = {(r["ix"], r["iy"]): r["v"] for r in grid.aggregate_points(df, g, masses=["v"], tolerance=0).collect()}
    assert got[(2, 2)] == 4 and got[(3, 2)] == 5 and got[(0, 0)] is None
    with pytest.raises(ValueError):
        grid.create_spatial_grid(df, 10, shape="hexagon")


def test_rotated_grid_holds_its_points(spark):
    rng = np.random.default_rng(3)
    df = layer(spark, [(i, *map(float, p), 1.0) for i, p in enumerate(rng.uniform(0, 100, (200, 2)))])
    g = grid.create_spatial_grid(df, 7, angle=30)
    on = grid.points_on_cells(df, g, 0)
    assert on.count() == 200
    cells = g.cells(spark).select("ix", "iy", F.col("x").alias("mx"), F.col("y").alias("my"))
    assert on.join(cells, ["ix", "iy"]).selectExpr("max(hypot(x - mx, y - my))").first()[0] <= 7 * math.sqrt(0.5) + 1e-9


def test_polygons_on_cells(spark):
    df = layer(spark, [(1, 0.0, 0.0, 0.0), (2, 30.0, 30.0, 0.0)])
    g = grid.create_spatial_grid(df, 10)
    part = [[{"x": float(a), "y": float(b)} for a, b in ((0, 0), (4, 0), (4, 10), (0, 10), (0, 0))]]
    got = {(r["ix"], r["iy"]): r for r in grid.assign_polygons(polygons(spark, [(1, [part])]).withColumn("k", F.lit(50.0)), g, "k").collect()}
    assert (got[(2, 2)]["k_weighted"], got[(2, 2)]["k"]) == (20.0, 50.0)
    assert (got[(1, 2)]["k_weighted"], got[(1, 2)]["k"]) == (0.0, 50.0)  # touches
    assert got[(5, 5)]["k"] is None
    assert grid.clip_grid(g, spark, polygons(spark, [(1, [part])])).count() == 1


def test_alignment_edges(spark):
    cells = layer(spark, [(1, 0.0, 0.0, 0.0), (2, 100.0, 0.0, 0.0)]).drop("v")
    src = layer(spark, [(1, 0.0, 0.0, 5.0), (2, 3.0, 0.0, 9.0), (3, 1.0, 0.0, None)])
    for method in ("nearest", "idw"):
        assert {r["rid"]: r["v"] for r in grid.align_to_grid(cells, src, "v", method).collect()} == {1: 5.0, 2: None}
    assert {r["rid"]: r["v"] for r in grid.align_to_grid(cells, src.where("rid = 3"), "v", "idw").collect()} == {1: None, 2: None}
    with pytest.raises(ValueError):
        grid.align_to_grid(cells, src, "v", "spline")


def test_imputation(spark):
    cells = spark.createDataFrame([(i * 4 + j, i, j, float(i), float(j), None if (i, j) == (1, 1) else float(i * 4 + j)) for i in range(4) for j in range(4)], "grid_id long, ix long, iy long, x double, y double, v double")
    for method, want in (("rook", (1 + 4 + 6 + 9) / 4), ("queen", sum((0, 1, 2, 4, 6, 8, 9, 10)) / 8)):
        assert {r["grid_id"]: r["v"] for r in grid.impute_spatial_mean(cells, ["v"], method).collect()}[5] == want
    with pytest.raises(ValueError):
        grid.impute_spatial_mean(cells, ["v"], "bishop")


# ---- models ----


def field(spark, n=400):
    rng = np.random.default_rng(5)
    x, y = rng.uniform(0, 200, n), rng.uniform(0, 200, n)
    return spark.createDataFrame(pd.DataFrame({"rid": range(n), "x": x, "y": y, "z": rng.normal(size=n), "t": x / 20 + np.sin(y / 30) + rng.normal(0, 0.1, n)}))


def test_no_block_is_on_both_sides(spark):
    df = modelling.group_folds(field(spark), 40)
    assert df.groupBy("block_id").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    sizes = [r["count"] for r in df.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) < 60
    split = modelling.block_split(field(spark), 40)
    assert split.groupBy("block_id").agg(F.countDistinct("is_test").alias("n")).where("n > 1").count() == 0


def test_spatial_models(spark):
    df = field(spark)
    r = modelling.rf_predict_spatial(df, ["x", "y", "z"], "t", 40, params={"trees": 10, "depth": 6}, repeats=1)
    assert modelling.regression_metrics(r.oof).first()["r2"] > 0.5 and r.oof.count() == 400
    assert modelling.top_features(r.importances, 1).first()["feature"] == "x"
    assert modelling.xgb_predict_spatial(df, ["x"], "t", params={"rounds": 2}, cv=False).oof is None
    assert explain.comparative_residuals([r]).count() == 400 and modelling.compare_models([r]).count() == 5
    assert set(modelling.full_diagnostics(r)) == {"parity", "metrics", "permutation", "gini"}
    with pytest.raises(ValueError):
        modelling.tune_bayes(df, ["x"], "t", "svm")
    with pytest.raises(ValueError):
        explain.pdp_ice(r.model, df, ["x", "y", "z"], ["x"])


def test_shapley_values_add_up(spark):
    df = field(spark, 120)
    for estimator in (modelling.forest(trees=4, depth=4), modelling.boosted(rounds=3, depth=3)):
        model = modelling.train_final(df, ["x", "y", "z"], "t", estimator)
        phi = explain.shap_values(model, df, ["x", "y", "z"]).groupBy("rid").agg((F.sum("phi") + F.first("base")).alias("p"))
        both = modelling.score_field(model, df, ["x", "y", "z"], "t").join(phi, "rid")
        assert both.selectExpr("max(abs(p - y_pred))").first()[0] < 1e-8
        pairs = explain.shap_interactions(model, df, ["x", "y", "z"]).groupBy("rid", "feature_1").agg(F.sum("phi").alias("s"))
        single = explain.shap_values(model, df, ["x", "y", "z"]).withColumnRenamed("feature", "feature_1")
        assert pairs.join(single, ["rid", "feature_1"]).selectExpr("max(abs(s - phi))").first()[0] < 1e-8


def test_geographical_forest(spark):
    df = modelling.random_split(field(spark, 150))
    assert df.where("is_test").count() == 45
    out = geoforest.train_grf(df, ["x", "y", "z"], "t", 25, 0.5, trees=10, local_trees=5, centres=10)
    assert geoforest.grf_metrics(out).first()["r2"] > 0.5 and out.local.count() == 10
    residuals, local, top = geoforest.prep_results(out)
    assert residuals.count() == 45 and top.count() == 3 and geoforest.local_importance_summary(out).count() == 3
    assert frames.importance_maps(local, ["x", "y"]).count() == 20 and frames.triptych(out.predictions, 0, 10).count() == 135
    bandwidth, weight = geoforest.spatial_parameters(field(spark, 150).select("rid", "x", "y", "t"), "t", 5, 30, 5)
    assert bandwidth in range(5, 31, 5) and 0 < weight <= 1


def test_spherical_fit_and_block_size(spark):
    h = np.linspace(5, 100, 20)
    reach, sill = modelling.fit_spherical(h, 3 * modelling.spherical(h, 60))
    assert reach == pytest.approx(60, rel=0.02) and sill == pytest.approx(3, rel=0.02)
    assert modelling.optimal_block_size(field(spark, 200), "t") % 10 == 0


# ---- sources ----


def test_fuzzy_names():
    schema = {"yield_mass_dry": ["Yld_Mass_D", "DRYMATTER"], "speed_km_h": ["Speed_km_h", "VEHICLSPEED", "Speed"], "elevation": ["Elevation_", "Elev"]}
    assert all(layers.weighted_ratio(a, a) == 100 for v in schema.values() for a in v)
    assert layers.column_matches(["Yld_Mass_D", "Elevation_", "other", "rid"], schema, exclude=["RID"]) == {"Yld_Mass_D": "yield_mass_dry", "Elevation_": "elevation"}
    assert layers.column_matches(["elevation", "Elev"], schema) == {}  # the standard name is taken
    assert layers.column_matches(["Speed", "VEHICLSPEED"], schema) == {"Speed": "speed_km_h"}  # the first of equals


def test_nan_is_null_and_layers_have_systems(spark):
    df = layers.clean(spark.createDataFrame([(float("nan"), 1.0), (2.0, 3.0)], "x double, y double"))
    assert df.where("x is null").count() == 1 and df.select("rid").distinct().count() == 2
    got = layers.cast_to_crs({"a": df, "b": layers.with_srid(spark.createDataFrame([(21.0, -33.0)], "x double, y double"), 4326)})
    assert layers.srid_of(got["a"]) == 32734 and got["b"].first()["x"] == pytest.approx(500000)


def write_shapefile(stem, kind, shapes, names):
    """Points or polygons with one text column, by hand."""
    records, offsets, at = b"", [], 50
    for i, s in enumerate(shapes, 1):
        if kind == 1:
            body = struct.pack("<idd", 1, *s)
        else:
            xy = np.array([p for r in s for p in r], "<f8")
            first = np.cumsum([0, *(len(r) for r in s[:-1])]).astype("<i4")
            body = struct.pack("<i4d2i", 5, *xy.min(0), *xy.max(0), len(s), len(xy)) + first.tobytes() + xy.tobytes()
        records += struct.pack(">ii", i, len(body) // 2) + body
        offsets.append((at, len(body) // 2))
        at += 4 + len(body) // 2
    head = lambda words: struct.pack(">i5ii", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<ii8d", 1000, kind, *[0.0] * 8)
    stem.with_suffix(".shp").write_bytes(head(50 + len(records) // 2) + records)
    stem.with_suffix(".shx").write_bytes(head(50 + 4 * len(offsets)) + b"".join(struct.pack(">ii", *o) for o in offsets))
    fields = b"NAME".ljust(11, b"\0") + b"C" + bytes(4) + bytes([10, 0]) + bytes(14) + b"N".ljust(11, b"\0") + b"N" + bytes(4) + bytes([8, 2]) + bytes(14)
    rows = b"".join(b" " + n.encode().ljust(10) + f"{i + 0.5:8.2f}".encode() for i, n in enumerate(names))
    stem.with_suffix(".dbf").write_bytes(bytes([3, 124, 1, 1]) + struct.pack("<IHH", len(names), 32 + 64 + 1, 19) + bytes(20) + fields + b"\r" + rows)


def test_shapefiles(spark, tmp_path):
    write_shapefile(tmp_path / "points", 1, [(1.0, 2.0), (3.0, 4.0)], ["a", ""])
    (tmp_path / "deep").mkdir()
    ring = [(0, 0), (0, 10), (10, 10), (10, 0), (0, 0)]
    write_shapefile(tmp_path / "deep" / "plots", 5, [[ring, [(2, 2), (4, 2), (4, 4), (2, 4), (2, 2)]]], ["p"])
    (tmp_path / "broken.shp").write_bytes(b"nothing")
    found, names = layers.files_to_dict(spark, f"file://{tmp_path}")
    assert sorted(names) == ["broken", "plots", "points"] and "broken" not in found
    assert [tuple(r) for r in found["points"].orderBy("rid").collect()] == [(0, 1.0, 2.0, "a", 0.5), (1, 3.0, 4.0, None, 1.5)]
    assert found["plots"].select(F.expr(geo.area("geometry"))).first()[0] == 96
    assert read_shapefile(spark, f"file://{tmp_path}/points.shp", columns="N").columns == ["rid", "x", "y", "N"]
    with pytest.raises(FileNotFoundError):
        layers.files_to_dict(spark, f"file://{tmp_path}/none")


def test_schema_file(tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"a": ["b"]}))
    assert layers.load_schema(str(tmp_path / "s.json")) == {"a": ["b"]}


# ---- the whole field, and a stream ----


def test_field_plan(spark):
    from furrow.plans import field as plan

    rng = np.random.default_rng(8)
    rows = [(i, i, float(i % 40) * 3, float(i // 40) * 3, float(rng.normal(2.5, 0.2)), float(i % 40) * 0.1, 5.0) for i in range(1600)]
    yields = spark.createDataFrame(rows, "rid long, seq long, x double, y double, v double, z double, speed double")
    trial = polygons(spark, [(1, [square(-5, -5, 130)])])
    s = plan.Settings(clip_zone=5, terrain_radius=7, outliers=(7, 3), cell_size=9, impute_k=4)
    clean = plan.clean_yield(yields, trial, "v", "speed", s)
    assert 1200 < clean.count() <= 1600
    soil = polygons(spark, [(1, [square(-50, -50, 300)])]).withColumn("clay", F.lit(12.0))
    _, cells = plan.gridded(plan.with_terrain(clean, s), "v", ["slope_deg", "aspect_north"], {"clay": soil}, s)
    assert cells.count() > 100 and cells.where("clay is null").count() == 0
    out = plan.model_grid(cells, "v", ["slope_deg", "clay"], trees=3, repeats=1, block_size=40)
    assert out.oof.count() == cells.count()


def test_stream_alignment(spark, tmp_path):
    from furrow.streaming.lag_buffer import aligned

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "machine string, seq long, x double, y double, v double"
    rows = [("m", i, float(i), 0.0, float(i)) for i in range(20)]
    spark.createDataFrame(rows[:12], schema).coalesce(1).write.parquet(src)
    spark.createDataFrame(rows[12:], schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = aligned(stream, 3).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["seq"], r["v"]) for r in spark.read.parquet(out).collect()} == {(i, float(i + 3)) for i in range(17)}
    with pytest.raises(ValueError):
        aligned(stream, -1)
