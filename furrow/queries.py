"""The field-data queries by name, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions import geometry as geo
from furrow.operators import explain, filters, frames, geoforest, grid, lag, modelling, neighbours
from furrow.sources import layers
from furrow.views import PLOTS, POINTS, plots, points, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Common table expressions of the oracles.
WITH = f"WITH pts AS ({POINTS}), plots AS ({PLOTS})"


def query(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle.replace("WITH pts", WITH, 1)
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many digits, -0 as 0: what sums in another order differ by."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def r6(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0e0 AS {name}"


# ---- filters ----


@query("WITH pts SELECT rid, v FROM pts, (SELECT quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM pts) WHERE v BETWEEN lo AND hi")
def filter_percentile(spark, d):
    return filters.filter_parameter(points(spark, d), "v", "v", "percentile", 0.05, 0.95).select("rid", "v")


@query("SELECT count(*) AS n, sum(CAST(l_quantity AS DOUBLE)) AS quantity FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.06")
def filter_bounds(spark, d):
    return filters.filter_parameter(table(spark, d, "lineitem"), "l_quantity", "l_discount", "bounds", 0.02, 0.06).agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("double")).alias("quantity"))


@query("WITH pts SELECT rid, v FROM pts, (SELECT avg(v) AS m, stddev_samp(v) AS s FROM pts) WHERE v BETWEEN m - 1.5e0 * s AND m + 1.5e0 * s")
def filter_sd(spark, d):
    return filters.filter_parameter(points(spark, d), "v", "v", "SD", 1.5, 1.5).select("rid", "v")


@query("WITH pts SELECT count(*) AS before, count(*) FILTER (v BETWEEN 10 AND 60) AS after, round(100e0 * count(*) FILTER (v BETWEEN 10 AND 60) / count(*), 6) AS retained_pct FROM pts")
def retained_report(spark, d):
    p = points(spark, d)
    return rounded(filters.retained_report(p, filters.filter_parameter(p, "v", "v", "bounds", 10, 60)))


@query("WITH pts SELECT rid, CAST(w * h AS DOUBLE) AS area FROM (SELECT rid, w + rid % 7 AS w, h, row_number() OVER (ORDER BY (w + rid % 7) * h DESC, rid) AS n FROM plots) WHERE n > 1")
def drop_largest_polygon(spark, d):
    sized = plots(spark, d).withColumn("geometry", F.expr(geo.box("x0", "y0", "(w + rid % 7)", "h")))
    return filters.trial_boundaries(sized).select("rid", F.expr(geo.area("geometry")).alias("area"))


NEAR = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"
LOCAL = f"""WITH pts, n AS (SELECT a.rid, avg(b.v) AS m, stddev_pop(b.v) AS s, count(*) AS n FROM pts a JOIN pts b ON a.rid <> b.rid AND b.x BETWEEN a.x - 8 AND a.x + 8 AND b.y BETWEEN a.y - 8 AND a.y + 8 AND {NEAR} <= 64e0 GROUP BY a.rid)
"""


@query(LOCAL + "SELECT p.rid, p.v, coalesce(p.v BETWEEN m - 2e0 * s AND m + 2e0 * s, n IS NULL) AS kept FROM pts p LEFT JOIN n USING (rid)")
def local_outliers_radius(spark, d):
    clean, out = filters.remove_local_outliers(points(spark, d), "v", "dist", 8, 2.0)
    return clean.select("rid", "v", F.lit(True).alias("kept")).unionByName(out.select("rid", "v", F.lit(False).alias("kept")))


@query(LOCAL + "SELECT rid, " + r6("m", "mean") + ", " + r6("s", "sd") + ", n, n AS known FROM n")
def local_statistics(spark, d):
    return rounded(filters.local_statistics(points(spark, d), "v", "dist", 8))


KNN = f"""WITH pts, p AS (SELECT * FROM pts),
k AS (SELECT * FROM (SELECT a.rid, b.rid AS nid, b.v, {NEAR} AS d2, row_number() OVER (PARTITION BY a.rid ORDER BY {NEAR}, b.rid) AS r FROM p a JOIN p b ON a.rid <> b.rid AND b.x BETWEEN a.x - 60 AND a.x + 60 AND b.y BETWEEN a.y - 60 AND a.y + 60) WHERE r <= 6)
"""


@query(KNN + "SELECT rid, nid, CAST(r AS INTEGER) AS rank, " + r6("d2", "d2") + " FROM k")
def nearest_neighbours(spark, d):
    p = points(spark, d)
    return rounded(neighbours.nearest(p, p.select("rid", "x", "y"), 6, without_self=True).select("rid", "nid", "rank", "d2"))


@query(KNN + "SELECT p.rid, v BETWEEN m - 2e0 * s AND m + 2e0 * s AS kept FROM p JOIN (SELECT rid, avg(v) AS m, stddev_pop(v) AS s FROM k GROUP BY rid) USING (rid)")
def local_outliers_knn(spark, d):
    return filters.local_verdicts(points(spark, d), "v", "neighbours", 6, 2.0).select("rid", F.col("__ok").alias("kept"))


PEEL = f"e AS (SELECT a.rid, b.rid AS nid FROM pts a JOIN pts b ON a.rid <> b.rid AND b.x BETWEEN a.x - 4 AND a.x + 4 AND b.y BETWEEN a.y - 4 AND a.y + 4 AND {NEAR} <= 16e0)"


def peel_sql(rounds: int) -> str:
    steps = ["s0 AS (SELECT rid FROM pts)"]
    for i in range(1, rounds + 1):
        steps.append(f"s{i} AS (SELECT e.rid FROM e JOIN s{i - 1} a ON e.rid = a.rid JOIN s{i - 1} b ON e.nid = b.rid GROUP BY e.rid HAVING count(*) >= 4)")
    return f"WITH pts, {PEEL}, {', '.join(steps)} SELECT rid FROM s{rounds}"


@query(peel_sql(3))
def density_peel(spark, d):
    return filters.remove_spatial_outliers(points(spark, d), 4, 4, max_iters=3).select("rid")


@query("WITH pts, " + PEEL + " SELECT rid, count(*) AS n, min(nid) AS first_id, max(nid) AS last_id FROM e GROUP BY rid")
def neighbour_lists(spark, d):
    return filters.neighbour_lists(points(spark, d), 4).select("rid", F.size("neighbours").cast("long").alias("n"), F.expr("neighbours[0]").alias("first_id"), F.expr("element_at(neighbours, -1)").alias("last_id"))


@query("WITH pts SELECT p.rid, EXISTS (SELECT 1 FROM plots q WHERE greatest(q.x0 - p.x, p.x - q.x0 - q.w, 0) ** 2 + greatest(q.y0 - p.y, p.y - q.y0 - q.h, 0) ** 2 <= 1e0) AS kept FROM pts p")
def clip_to_boundary(spark, d):
    p = points(spark, d).select("rid", "x", "y")
    kept, removed = filters.remove_boundary_data(p, plots(spark, d))
    return kept.select("rid", F.lit(True).alias("kept")).unionByName(removed.select("rid", F.lit(False).alias("kept")))


CATEGORIES = "SELECT DISTINCT o_orderpriority FROM orders ORDER BY 1"


@query("SELECT o_orderkey, " + ", ".join(f"CASE WHEN o_orderpriority = '{v}' THEN 1e0 ELSE 0e0 END AS \"o_orderpriority_{v}\"" for v in ("2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " FROM orders WHERE o_orderpriority IS NOT NULL")
def one_hot(spark, d):
    return filters.text_encoder(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"])[0]


@query("""WITH pts, b AS (SELECT min(v) AS lo, max(v) AS hi FROM pts), h AS (SELECT CAST(least(floor((v - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS bin, count(*) AS n FROM pts, b GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin, round(lo + i * ((hi - lo) / 50), 6) + 0e0 AS lower, round(lo + (i + 1) * ((hi - lo) / 50), 6) + 0e0 AS upper, coalesce(n, 0) AS n FROM range(50) r(i), b LEFT JOIN h ON h.bin = i""")
def histogram(spark, d):
    return rounded(filters.histogram(points(spark, d), "v", 50))


# ---- terrain ----

TERRAIN = f"""WITH pts, m AS (SELECT a.rid, count(*) AS n, var_pop(b.x - a.x) AS xx, var_pop(b.y - a.y) AS yy, covar_pop(b.x - a.x, b.y - a.y) AS xy, covar_pop(b.x - a.x, b.z) AS xz, covar_pop(b.y - a.y, b.z) AS yz
 FROM pts a JOIN pts b ON b.x BETWEEN a.x - 12 AND a.x + 12 AND b.y BETWEEN a.y - 12 AND a.y + 12 AND {NEAR} <= 144e0 GROUP BY a.rid),
f AS (SELECT rid, n, (xz * yy - yz * xy) / (xx * yy - xy * xy) AS a, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS b FROM m)
SELECT rid, CASE WHEN n >= 3 THEN round(degrees(atan(sqrt(a * a + b * b))), 6) + 0e0 END AS slope_deg,
 CASE WHEN n >= 3 THEN round(degrees(atan2(-a, -b)) - floor(degrees(atan2(-a, -b)) / 360e0) * 360e0, 3) + 0e0 END AS aspect_deg FROM f"""


@query(TERRAIN)
def terrain_radius(spark, d):
    out = neighbours.terrain(points(spark, d), "dist", 12).select("rid", "slope_deg", "aspect_deg")
    return out.select("rid", (F.round("slope_deg", 6) + F.lit(0.0)).alias("slope_deg"), (F.round("aspect_deg", 3) + F.lit(0.0)).alias("aspect_deg"))


@query("WITH pts SELECT rid, " + r6("cos(radians(z))", "north") + ", " + r6("sin(radians(z))", "east") + " FROM pts")
def aspect_parts(spark, d):
    north, east = geo.north_east(F.col("z"))
    return rounded(points(spark, d).select("rid", north.alias("north"), east.alias("east")))


# ---- order and lag ----


@query("WITH pts SELECT * FROM (SELECT rid, x, y, lead(v, 8) OVER (ORDER BY seq) AS v FROM pts) WHERE v IS NOT NULL")
def lag_shift(spark, d):
    return lag.prepare_shifted_data(points(spark, d).select("rid", "seq", "x", "y", "v"), 8, "v").select("rid", "x", "y", "v")


@query("""WITH pts, s AS (SELECT CAST(3 * CAST(floor(CAST(count(*) AS DOUBLE) / count(DISTINCT t)) AS BIGINT) AS BIGINT) AS k FROM pts),
o AS (SELECT rid, x, y, v, t, row_number() OVER (ORDER BY t, rid) AS n FROM pts)
SELECT a.rid, a.x, a.y, b.v, b.t FROM o a, s JOIN o b ON b.n = a.n + s.k""".replace("FROM o a, s JOIN o b ON b.n = a.n + s.k", "FROM o a CROSS JOIN s JOIN o b ON b.n = a.n + s.k"))
def lag_manual(spark, d):
    return lag.manual_lag_correction(points(spark, d).select("rid", "x", "y", "v", "t"), "t", 6, 2).select("rid", "x", "y", "v", "t")


HEADING = """WITH pts, s AS (SELECT x - lag(x) OVER (ORDER BY seq) AS dx, y - lag(y) OVER (ORDER BY seq) AS dy FROM pts),
h AS (SELECT CAST(least(floor(degrees(atan2(dy, dx)) - floor(degrees(atan2(dy, dx)) / 180e0) * 180e0), 179) AS INTEGER) AS bin, count(*) AS n FROM s WHERE dx IS NOT NULL GROUP BY 1)
"""


@query(HEADING + "SELECT bin, n FROM h")
def heading_bins(spark, d):
    return grid.heading_bins(points(spark, d))


@query(HEADING + "SELECT CAST(bin AS DOUBLE) AS heading FROM h ORDER BY n DESC, bin LIMIT 1")
def dominant_heading(spark, d):
    return grid.dominant_heading(points(spark, d))


@query("WITH pts SELECT * FROM (SELECT 'unshifted' AS stage, x, y, v AS \"value\" FROM pts UNION ALL SELECT 'shifted', x, y, lead(v, 5) OVER (ORDER BY seq) FROM pts) m, (SELECT round(quantile_cont(v, 0.05), 6) AS low, round(quantile_cont(v, 0.95), 6) AS high FROM pts) e WHERE \"value\" IS NOT NULL")
def shift_maps(spark, d):
    return rounded(frames.shift_maps(points(spark, d), "v", 5))


@query()
def pcdi_curve(spark, d):
    p = points(spark, d).select("rid", "seq", "x", "y", (F.col("v") + 10 * F.sin(F.col("x") / 30)).alias("v"))
    return rounded(lag.robust_pcdi(p, 6.0)[0])


# ---- grids ----


def square(spark, d) -> grid.Grid:
    return grid.create_spatial_grid(points(spark, d), 10)


BOUNDS = "b AS (SELECT min(x) - 20 AS x0, min(y) - 20 AS y0, CAST(ceil((max(x) + 20 - (min(x) - 20)) / 10) AS BIGINT) AS nx, CAST(ceil((max(y) + 20 - (min(y) - 20)) / 10) AS BIGINT) AS ny FROM pts)"
CELLS = BOUNDS + ", cells AS (SELECT i AS grid_id, i // ny AS ix, i % ny AS iy, x0 + (i // ny) * 10e0 AS cx, y0 + (i % ny) * 10e0 AS cy FROM b, range(1000000) r(i) WHERE i < nx * ny)"


@query("WITH pts, " + CELLS + " SELECT grid_id, ix, iy, " + r6("cx", "cx") + ", " + r6("cy", "cy") + ", " + r6("cx + 5", "x") + ", " + r6("cy + 5", "y") + " FROM cells")
def grid_square(spark, d):
    return rounded(square(spark, d).cells(spark))


@query("""WITH pts, m AS (SELECT round_even(avg(2 + v / 50e0), 2) AS len, round_even(avg(6 + CAST(rid % 5 AS DOUBLE)), 2) AS wid FROM pts),
b AS (SELECT len, wid, min(x) - 2 * len AS x0, min(y) - 2 * wid AS y0, ceil((max(x) + 2 * len - (min(x) - 2 * len)) / len) AS nx, ceil((max(y) + 2 * wid - (min(y) - 2 * wid)) / wid) AS ny FROM pts, m GROUP BY len, wid)
SELECT round(len, 6) AS length, round(wid, 6) AS width, round(x0, 6) AS x0, round(y0, 6) AS y0, CAST(nx AS BIGINT) AS nx, CAST(ny AS BIGINT) AS ny FROM b""")
def grid_rectangle(spark, d):
    p = points(spark, d).withColumn("len", F.expr("2 + v / 50d")).withColumn("wid", F.expr("6 + double(rid % 5)"))
    g = grid.create_spatial_grid(p, length_column="len", width_column="wid", shape="rectangle")
    return rounded(spark.createDataFrame([(g.length, g.width, g.x0, g.y0, g.nx, g.ny)], "length double, width double, x0 double, y0 double, nx long, ny long"))


@query("""WITH pts, c AS (SELECT avg(x) AS px, avg(y) AS py FROM (SELECT DISTINCT x, y FROM pts)),
q AS (SELECT px, py, px + (x - px) * cos(radians(-30)) - (y - py) * sin(radians(-30)) AS u, py + (x - px) * sin(radians(-30)) + (y - py) * cos(radians(-30)) AS w FROM pts, c),
b AS (SELECT px, py, min(u) - 20 AS x0, min(w) - 20 AS y0, CAST(ceil((max(u) + 20 - (min(u) - 20)) / 10) AS BIGINT) AS nx, CAST(ceil((max(w) + 20 - (min(w) - 20)) / 10) AS BIGINT) AS ny FROM q GROUP BY px, py),
g AS (SELECT i AS grid_id, px, py, x0 + (i // ny) * 10e0 + 5 AS u, y0 + (i % ny) * 10e0 + 5 AS w FROM b, range(1000000) r(i) WHERE i < nx * ny)
SELECT grid_id, round(px + (u - px) * cos(radians(30)) - (w - py) * sin(radians(30)), 4) + 0e0 AS x, round(py + (u - px) * sin(radians(30)) + (w - py) * cos(radians(30)), 4) + 0e0 AS y FROM g""")
def grid_rotated(spark, d):
    return rounded(grid.create_spatial_grid(points(spark, d), 10, angle=30).cells(spark).select("grid_id", "x", "y"), 4)


ON = CELLS + ", m AS (SELECT ix, iy, grid_id, rid, v FROM cells JOIN pts ON x BETWEEN cx - 0.75 AND cx + 10.75 AND y BETWEEN cy - 0.75 AND cy + 10.75 AND greatest(cx - x, x - cx - 10, 0) ** 2 + greatest(cy - y, y - cy - 10, 0) ** 2 <= 0.5625e0)"


@query("WITH pts, " + ON + " SELECT c.grid_id, " + r6("avg(v)", "v") + ", " + r6("sum(v)", "mass") + " FROM cells c LEFT JOIN m USING (grid_id) GROUP BY c.grid_id")
def points_to_grid(spark, d):
    p = points(spark, d).withColumn("mass", F.col("v"))
    return rounded(grid.aggregate_points(p, square(spark, d), ["v"], ["mass"]).select("grid_id", "v", "mass"))


@query("WITH pts, " + ON + " SELECT round(t, 4) AS points_total, round(g, 4) AS grid_total, round_even(t, 2) = round_even(g, 2) AS equal FROM (SELECT sum(v) AS t FROM pts), (SELECT sum(v) AS g FROM m)")
def mass_report(spark, d):
    return rounded(grid.mass_report(points(spark, d), square(spark, d), "v"), 4)


@query("WITH pts, " + CELLS + ", m AS (SELECT floor((x - x0) / 10) AS i, floor((y - y0) / 10) AS j, v FROM pts, b) SELECT round(t, 4) AS points_total, round(g, 4) AS grid_total, true AS equal FROM (SELECT sum(v) AS t FROM pts), (SELECT sum(v) AS g FROM m)")
def mass_exact(spark, d):
    return rounded(grid.mass_report(points(spark, d), square(spark, d), "v", tolerance=0), 4)


OVER = CELLS + """, o AS (SELECT grid_id, target, greatest(least(cx + 10, q.x0 + w) - greatest(cx, q.x0), 0) * greatest(least(cy + 10, q.y0 + h) - greatest(cy, q.y0), 0) AS area
 FROM cells JOIN plots q ON q.x0 <= cx + 10 AND q.x0 + w >= cx AND q.y0 <= cy + 10 AND q.y0 + h >= cy)"""


@query("WITH pts, " + OVER + " SELECT c.grid_id, round(sum(CAST(target AS DOUBLE) * area / 100e0), 4) + 0e0 AS target_weighted, round(avg(CAST(target AS DOUBLE)), 4) + 0e0 AS target FROM cells c LEFT JOIN o USING (grid_id) GROUP BY c.grid_id")
def polygon_to_grid(spark, d):
    return rounded(grid.assign_polygons(plots(spark, d).withColumn("target", F.col("target").cast("double")), square(spark, d), "target").select("grid_id", "target_weighted", "target"), 4)


SOURCES = "src AS (SELECT * FROM pts WHERE v IS NOT NULL)"


@query("WITH pts, " + CELLS + ", " + SOURCES + f""", a AS (SELECT grid_id, cx + 5 AS x, cy + 5 AS y FROM cells), n AS (SELECT a.grid_id, b.v, row_number() OVER (PARTITION BY grid_id ORDER BY {NEAR}, b.rid) AS r FROM a JOIN src b ON b.x BETWEEN a.x - 10 AND a.x + 10 AND b.y BETWEEN a.y - 10 AND a.y + 10 AND {NEAR} <= 100e0)
SELECT a.grid_id AS rid, round(n.v, 6) AS v FROM a LEFT JOIN n ON n.grid_id = a.grid_id AND r = 1""")
def align_nearest(spark, d):
    cells = square(spark, d).cells(spark).select(F.col("grid_id").alias("rid"), "x", "y")
    return rounded(grid.align_to_grid(cells, points(spark, d), "v", "nearest", 10))


@query("WITH pts, " + CELLS + ", " + SOURCES + f""", a AS (SELECT grid_id, cx + 5 AS x, cy + 5 AS y FROM cells), n AS (SELECT a.grid_id, b.v, sqrt({NEAR}) AS d, row_number() OVER (PARTITION BY grid_id ORDER BY {NEAR}, b.rid) AS r FROM a JOIN src b ON b.x BETWEEN a.x - 60 AND a.x + 60 AND b.y BETWEEN a.y - 60 AND a.y + 60),
k AS (SELECT * FROM n WHERE r <= 5), s AS (SELECT grid_id, sum(v * CASE WHEN d < 1e-5 THEN 1 ELSE 0 END) AS ev, sum(CASE WHEN d < 1e-5 THEN 1 ELSE 0 END) AS e, sum(v / (d * d + 1e-12)) AS wv, sum(1 / (d * d + 1e-12)) AS w, min(d) AS near FROM k GROUP BY grid_id)
SELECT a.grid_id AS rid, round(CASE WHEN near <= 10 THEN CASE WHEN e > 0 THEN ev / e ELSE wv / w END END, 6) + 0e0 AS v FROM a LEFT JOIN s USING (grid_id)""")
def align_idw(spark, d):
    cells = square(spark, d).cells(spark).select(F.col("grid_id").alias("rid"), "x", "y")
    return rounded(grid.align_to_grid(cells, points(spark, d), "v", "idw", 10, 2, 5))


def gappy(spark, d) -> DataFrame:
    """Cells without points, as around the field's edge, have gaps."""
    return grid.aggregate_points(points(spark, d), square(spark, d), ["v"], tolerance=0)


GAPPY = CELLS + ", w AS (SELECT floor((x - x0) / 10) AS ix, floor((y - y0) / 10) AS iy, avg(v) AS v FROM pts, b GROUP BY ALL), g AS (SELECT c.grid_id, c.ix, c.iy, c.cx + 5 AS x, c.cy + 5 AS y, w.v FROM cells c LEFT JOIN w ON w.ix = c.ix AND w.iy = c.iy)"


def impute_sql(test: str) -> str:
    return f"WITH pts, {GAPPY}, n AS (SELECT a.grid_id, avg(b.v) AS m FROM g a JOIN g b ON {test} WHERE a.v IS NULL GROUP BY a.grid_id) SELECT g.grid_id, round(coalesce(v, m), 9) + 0e0 AS v FROM g LEFT JOIN n USING (grid_id)"


@query(impute_sql("abs(a.ix - b.ix) + abs(a.iy - b.iy) = 1"))
def impute_rook(spark, d):
    return rounded(grid.impute_spatial_mean(gappy(spark, d), ["v"], "rook").select("grid_id", "v"), 9)


@query(impute_sql("greatest(abs(a.ix - b.ix), abs(a.iy - b.iy)) = 1"))
def impute_queen(spark, d):
    return rounded(grid.impute_spatial_mean(gappy(spark, d), ["v"], "queen").select("grid_id", "v"), 9)


@query(f"""WITH pts, {GAPPY}, k AS (SELECT a.grid_id, b.v, row_number() OVER (PARTITION BY a.grid_id ORDER BY (a.ix - b.ix) * (a.ix - b.ix) + (a.iy - b.iy) * (a.iy - b.iy), b.grid_id) AS r FROM g a JOIN g b ON a.grid_id <> b.grid_id AND abs(a.ix - b.ix) <= 6 AND abs(a.iy - b.iy) <= 6 WHERE a.v IS NULL),
n AS (SELECT grid_id, avg(v) AS m FROM k WHERE r <= 8 GROUP BY grid_id) SELECT g.grid_id, round(coalesce(v, m), 9) + 0e0 AS v FROM g LEFT JOIN n USING (grid_id)""")
def impute_knn(spark, d):
    # whole-number places, so that equal distances are equal
    cells = gappy(spark, d).withColumn("x", F.col("ix").cast("double")).withColumn("y", F.col("iy").cast("double"))
    return rounded(grid.impute_spatial_mean(cells, ["v"], "knn", 8).select("grid_id", "v"), 9)


@query("WITH pts SELECT p.rid, q.rid AS plot, CAST(q.target AS DOUBLE) AS target FROM pts p LEFT JOIN plots q ON p.x BETWEEN q.x0 AND q.x0 + q.w AND p.y BETWEEN q.y0 AND q.y0 + q.h")
def points_in_polygons(spark, d):
    layer = plots(spark, d).select(F.col("rid").alias("plot"), F.col("target").cast("double").alias("target"), "geometry")
    return grid.join_polygons(points(spark, d).select("rid", "x", "y"), layer).select("rid", "plot", "target")


@query("WITH pts SELECT a.rid, b.rid AS nid FROM plots a JOIN plots b ON a.rid <> b.rid AND ((a.x0 = b.x0 AND abs(a.y0 - b.y0) = 40) OR (a.y0 = b.y0 AND abs(a.x0 - b.x0) = 40))")
def polygon_contiguity(spark, d):
    touching = plots(spark, d).withColumn("geometry", F.expr(geo.box("x0", "y0", "40d", "40d")))
    return grid.polygon_contiguity(touching, "rook")


@query("WITH pts SELECT rid, w * h AS area, x0 + w / 2 AS cx, y0 + h / 2 AS cy, x0 AS minx, x0 + w AS maxx FROM plots")
def geometry_measures(spark, d):
    cx, cy = geo.centroid("geometry")
    b = geo.bounds("geometry")
    return rounded(plots(spark, d).select("rid", F.expr(geo.area("geometry")).alias("area"), F.expr(cx).alias("cx"), F.expr(cy).alias("cy"), F.expr(b["minx"]).alias("minx"), F.expr(b["maxx"]).alias("maxx")))


@query()
def hull_area(spark, d):
    return rounded(geo.hull_area(plots(spark, d).selectExpr("explode(geometry[0][0]) as v").select("v.*")))


@query("WITH pts SELECT round(min(abs(x - lon)), 6) + 0e0 AS dx, count(*) AS n FROM (SELECT x, x AS lon FROM pts)")
def reproject_round_trip(spark, d):
    p = points(spark, d).select("rid", (19 + F.col("x") / 1000).alias("x"), (-33 - F.col("y") / 10000).alias("y"))
    back = layers.reproject(layers.reproject(p, 4326, 32734), 32734, 4326).select("rid", F.col("x").alias("lon"))
    return rounded(p.join(back, "rid").agg(F.max(F.abs(F.col("x") - F.col("lon"))).alias("dx"), F.count("*").alias("n")))


# ---- blocks, splits, measures ----


@query("WITH pts SELECT rid, CAST(floor((x - x0) / 50e0) AS BIGINT) AS block_x, CAST(floor((y - y0) / 50e0) AS BIGINT) AS block_y, CAST(floor((x - x0) / 50e0) AS BIGINT) || '_' || CAST(floor((y - y0) / 50e0) AS BIGINT) AS block_id FROM pts, (SELECT min(x) AS x0, min(y) AS y0 FROM pts)")
def block_key(spark, d):
    return grid.block_key(points(spark, d), 50).select("rid", "block_x", "block_y", "block_id")


@query()
def block_split(spark, d):
    return frames.split_map(modelling.block_split(points(spark, d), 50))


@query()
def group_folds(spark, d):
    return modelling.group_folds(points(spark, d), 50).select("rid", "block_id", "fold")


@query("WITH pts, p AS (SELECT crop_type, v AS y_true, v + CAST(rid % 9 AS DOUBLE) - 4 AS y_pred FROM pts) SELECT crop_type, count(*) AS n, round(1 - sum((y_true - y_pred) ** 2) / (var_pop(y_true) * count(*)), 6) AS r2, round(sqrt(sum((y_true - y_pred) ** 2) / count(*)), 6) AS rmse FROM p GROUP BY crop_type")
def metrics_by_group(spark, d):
    p = points(spark, d).select("crop_type", F.col("v").alias("y_true"), F.expr("v + double(rid % 9) - 4").alias("y_pred"))
    return rounded(modelling.regression_metrics(p, by=["crop_type"]))


def type_importances(spark, d, column: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.col("p_type").alias("feature")).agg(F.avg(F.col(column).cast("double")).alias("importance"))


@query("""WITH pts, a AS (SELECT p_type AS feature, avg(CAST(p_size AS DOUBLE)) AS one FROM part GROUP BY 1), b AS (SELECT p_type AS feature, avg(CAST(p_retailprice AS DOUBLE)) AS two FROM part WHERE p_size > 25 GROUP BY 1 HAVING p_type <> (SELECT min(p_type) FROM part))
SELECT feature, round(one, 6) AS one, round(two, 6) AS two, round((coalesce(one, 0) + coalesce(two, 0)) / ((one IS NOT NULL)::INT + (two IS NOT NULL)::INT), 6) AS mean_importance FROM a FULL JOIN b USING (feature) ORDER BY mean_importance DESC, feature LIMIT 4""")
def comparative_importances(spark, d):
    part = table(spark, d, "part")
    one = type_importances(spark, d, "p_size")
    first = part.agg(F.min("p_type").alias("f"))
    two = part.where("p_size > 25").join(F.broadcast(first), F.col("p_type") != F.col("f")).groupBy(F.col("p_type").alias("feature")).agg(F.avg(F.col("p_retailprice").cast("double")).alias("importance"))
    return rounded(explain.comparative_importances({"one": one, "two": two}, 4))


@query("SELECT feature, round(importance, 6) AS importance FROM (SELECT p_type AS feature, avg(CAST(p_size AS DOUBLE)) AS importance FROM part GROUP BY 1) ORDER BY importance DESC, feature LIMIT 3")
def top_features(spark, d):
    return rounded(modelling.top_features(type_importances(spark, d, "p_size"), 3))


@query("SELECT feature, importance, CAST(rank AS INTEGER) AS rank FROM (SELECT *, rank() OVER (ORDER BY importance DESC) AS rank FROM (SELECT p_brand AS feature, CAST(count(*) // 20 AS BIGINT) AS importance FROM part GROUP BY 1)) WHERE rank <= 3")
def top_with_ties(spark, d):
    counts = table(spark, d, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.expr("count(*) div 20").alias("importance"))
    return geoforest.top_with_ties(counts, 3)


@query()
def variogram_bins(spark, d):
    """On a sample of at most 5,000 points, as the operator has it."""
    return rounded(modelling.variogram_bins(points(spark, d), "v", max_lag=100.0))


@query(f"""WITH pts, p AS (SELECT rid, x, y, v FROM pts), z AS (SELECT rid, x, y, v - (SELECT avg(v) FROM p) AS z FROM p),
k AS (SELECT a.rid, a.z AS zi, b.z AS zj, row_number() OVER (PARTITION BY a.rid ORDER BY {NEAR}, b.rid) AS r FROM z a JOIN z b ON a.rid <> b.rid AND b.x BETWEEN a.x - 60 AND a.x + 60 AND b.y BETWEEN a.y - 60 AND a.y + 60)
SELECT CAST(w AS INTEGER) AS bandwidth, round((SELECT count(*) FROM z) / (w * (SELECT count(*) FROM z)) * sum(zi * zj) / (SELECT sum(z * z) FROM z), 6) + 0e0 AS i FROM k, (VALUES (4), (8), (12)) t(w) WHERE r <= w GROUP BY w""")
def moran_i(spark, d):
    return rounded(geoforest.moran(points(spark, d), "v", [4, 8, 12]).select("bandwidth", "i"))


# ---- models (measures and values that SQL has no form for) ----


def field(spark, d) -> DataFrame:
    """Points with a target that depends on place and height."""
    return points(spark, d).select("rid", "x", "y", "z", "v", (F.col("z") + 5 * F.sin(F.col("x") / 40) + F.col("v") / 100).alias("target"))


FEATURES = ["x", "y", "z"]


@query()
def rf_cv(spark, d):
    oof = modelling.cross_validated(field(spark, d), FEATURES, "target", modelling.forest(trees=10, depth=6), 40)
    return rounded(modelling.regression_metrics(oof, by=["fold"]))


@query()
def gbt_cv(spark, d):
    oof = modelling.cross_validated(field(spark, d), FEATURES, "target", modelling.boosted(rounds=5, depth=4), 40)
    return rounded(modelling.regression_metrics(oof))


@query()
def tuned_forest(spark, d):
    space = {"trees": ("step", 5, 15, 5), "depth": ("step", 3, 6, 1), "featureSubsetStrategy": ("choice", ["sqrt", "0.5"])}
    return rounded(modelling.tune_bayes(field(spark, d), FEATURES, "target", "rf", 3, 80, space=space)[1])


def fitted(spark, d):
    df = field(spark, d)
    return df, modelling.train_final(df, FEATURES, "target", modelling.forest(trees=8, depth=5))


@query()
def permutation_importance(spark, d):
    df, model = fitted(spark, d)
    return rounded(modelling.permutation_importance(model, df, FEATURES, "target", repeats=2))


@query()
def partial_dependence(spark, d):
    df, model = fitted(spark, d)
    return rounded(explain.pdp_ice(model, df, FEATURES, FEATURES, 10)[0])


@query()
def partial_dependence_2d(spark, d):
    df, model = fitted(spark, d)
    return rounded(explain.pdp_2d(model, df, FEATURES, [("x", "z")], 6))


@query()
def shap_summary(spark, d):
    df, model = fitted(spark, d)
    return rounded(explain.shap_summary(explain.shap_values(model, df, FEATURES)))


@query()
def geographical_forest(spark, d):
    df = modelling.random_split(field(spark, d))
    return rounded(geoforest.grf_metrics(geoforest.train_grf(df, FEATURES, "target", 30, 0.5, trees=10, local_trees=3)))


@query()
def field_scores(spark, d):
    df, model = fitted(spark, d)
    return rounded(modelling.score_field(model, df, FEATURES, "target"))


@query()
def variogram_curve(spark, d):
    return rounded(modelling.variogram_curve(points(spark, d), "v"))


@query()
def boosted_scores(spark, d):
    df = field(spark, d)
    model = modelling.xgb_predict_spatial(df, FEATURES, "target", params={"rounds": 5, "depth": 3}, cv=False).model
    return rounded(modelling.score_field(model, df, FEATURES, "target"))


@query()
def random_search(spark, d):
    return rounded(modelling.tune_random(field(spark, d), FEATURES, "target", modelling.forest, {"trees": [4, 8], "depth": [3, 5]}, 2, 80)[1])


@query()
def spatial_bandwidth(spark, d):
    return rounded(geoforest.moran(points(spark, d), "z", [5, 10, 20, 40]))


@query()
def shap_interactions(spark, d):
    df, model = fitted(spark, d)
    return rounded(explain.shap_interactions(model, df, FEATURES, ["x", "z"]))


@query()
def partial_dependence_compared(spark, d):
    df, model = fitted(spark, d)
    other = modelling.train_final(df, FEATURES, "target", modelling.forest(trees=4, depth=3))
    return rounded(explain.compare_pdp_2d({"one": model, "two": other}, df, FEATURES, [("x", "z")], 5))


@query()
def lag_summary(spark, d):
    p = points(spark, d).select("rid", "seq", "x", "y", (F.col("v") + 10 * F.sin(F.col("x") / 30)).alias("v"))
    return rounded(lag.robust_pcdi(p, 6.0)[1])


@query("WITH pts SELECT rid, x, y, CASE WHEN v BETWEEN 10 AND 60 THEN 'kept' ELSE 'removed' END AS status FROM pts")
def status_map(spark, d):
    p = points(spark, d)
    return frames.status_map(*filters.split_by(p, filters.filter_parameter(p, "v", "v", "bounds", 10, 60).select("rid")), ["rid", "x", "y"])


@query("""WITH pts, q AS (SELECT 'before' AS stage, v FROM pts UNION ALL SELECT 'after', v FROM pts WHERE v BETWEEN 10 AND 60), b AS (SELECT stage, min(v) AS lo, max(v) AS hi FROM q GROUP BY stage),
h AS (SELECT stage, CAST(least(floor((v - lo) / ((hi - lo) / 10)), 9) AS INTEGER) AS bin, count(*) AS n FROM q JOIN b USING (stage) GROUP BY ALL)
SELECT stage, 'v' AS "column", CAST(i AS INTEGER) AS bin, round(lo + i * ((hi - lo) / 10), 6) + 0e0 AS lower, round(lo + (i + 1) * ((hi - lo) / 10), 6) + 0e0 AS upper, coalesce(n, 0) AS n FROM b CROSS JOIN range(10) r(i) LEFT JOIN h USING (stage) WHERE h.bin = i OR h.bin IS NULL""".replace("LEFT JOIN h USING (stage) WHERE h.bin = i OR h.bin IS NULL", "LEFT JOIN h ON h.stage = b.stage AND h.bin = i").replace("SELECT stage, 'v'", "SELECT b.stage, 'v'"))
def before_after_histograms(spark, d):
    p = points(spark, d)
    return rounded(frames.before_after_histograms(p, filters.filter_parameter(p, "v", "v", "bounds", 10, 60), ["v"], 10))


@query("""WITH pts, n AS (SELECT a.rid, avg(b.v) AS m, stddev_pop(b.v) AS s FROM pts a JOIN pts b ON a.rid <> b.rid AND b.x BETWEEN a.x - 8 AND a.x + 8 AND b.y BETWEEN a.y - 8 AND a.y + 8 AND """ + NEAR + """ <= 64e0 GROUP BY a.rid),
o AS (SELECT p.rid, x, y FROM pts p JOIN n USING (rid) WHERE NOT v BETWEEN m - 2e0 * s AND m + 2e0 * s ORDER BY rid LIMIT 1)
SELECT a.rid, b.rid AS nid, b.v FROM o a JOIN pts b ON a.rid <> b.rid AND """ + NEAR + """ <= 64e0""")
def example_outlier(spark, d):
    p = points(spark, d)
    return filters.example_outlier(p, "v", filters.remove_local_outliers(p, "v", "dist", 8, 2.0)[1], 8)


@query("WITH pts SELECT rid, v AS y_true, v + CAST(rid % 9 AS DOUBLE) - 4 AS y_pred, round(v - (v + CAST(rid % 9 AS DOUBLE) - 4), 6) + 0e0 AS residual FROM pts")
def parity_residuals(spark, d):
    return rounded(frames.parity_residuals(points(spark, d).select("rid", F.col("v").alias("y_true"), F.expr("v + double(rid % 9) - 4").alias("y_pred"))))


@query("WITH pts SELECT rid, x, y, yield_mass_dry, elevation FROM (SELECT rid, x, y, v AS yield_mass_dry, z AS elevation FROM pts)")
def fuzzy_rename(spark, d):
    raw = points(spark, d).select("rid", "x", "y", F.col("v").alias("Yld_Mass_D"), F.col("z").alias("Elevation_"))
    return layers.rename_columns_fuzzy(raw, {"yield_mass_dry": ["Yld_Mass_D", "YldMassDry"], "elevation": ["Elevation_", "Elev"]}, exclude=["rid", "x", "y"])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points through the percentile and local filters onto a square grid along the main heading."""
    p = filters.filter_parameter(points(spark, sf_dir), "v", "v", "percentile", 0.05, 0.95)
    clean, _ = filters.remove_local_outliers(p, "v", "dist", 8, 2.0)
    angle = grid.dominant_heading(clean).first()["heading"]
    return grid.aggregate_points(clean, grid.create_spatial_grid(clean, 10, angle=angle), ["v"]).select("grid_id", "x", "y", "v")
