"""Grids, and what brings points and polygons onto them.

A cell is its pair (ix, iy) in the grid's own frame, in which it is an upright rectangle; a rotated grid
is met by turning the points, so every join onto a grid is an equi-join on cell numbers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions import geometry as geo
from furrow.operators.lag import shifted
from furrow.operators.neighbours import nearest, radius_pairs


def heading_bins(points: DataFrame, order: str = "seq", drop_stationary: bool = False) -> DataFrame:
    """(bin, n): directions between consecutive points, modulo 180 degrees, in bins of one degree. Points that stand still count at 0 unless dropped."""
    steps = shifted(points.select(order, "x", "y"), [order], -1, ["x", "y"], suffix="_before").where("x_before is not null and y_before is not null")
    steps = steps.withColumn("dx", F.expr("x - x_before")).withColumn("dy", F.expr("y - y_before"))
    if drop_stationary:
        steps = steps.where("dx <> 0 or dy <> 0")
    angle = "pmod(degrees(atan2(dy, dx)), 180d)"
    return steps.select(F.expr(f"cast(least(floor({angle}), 179) as int)").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def dominant_heading(points: DataFrame, order: str = "seq", drop_stationary: bool = False) -> DataFrame:
    """One row (heading): the fullest bin's lower edge, of equals the lowest."""
    best = heading_bins(points, order, drop_stationary).agg(F.max(F.struct("n", (-F.col("bin")).alias("b"))).alias("m"))
    return best.select((-F.col("m.b")).cast("double").alias("heading"))


@dataclass(frozen=True)
class Grid:
    """Cells of length by width from (x0, y0) in a frame turned by angle around the pivot."""

    x0: float
    y0: float
    length: float
    width: float
    nx: int
    ny: int
    angle: float = 0.0
    pivot: tuple[float, float] = (0.0, 0.0)

    def own(self, x: str = "x", y: str = "y") -> tuple[str, str]:
        """SQL for a point's place in the grid's frame."""
        return geo.rotate(x, y, -self.angle, *self.pivot) if self.angle else (x, y)

    def world(self, x: str, y: str) -> tuple[str, str]:
        return geo.rotate(x, y, self.angle, *self.pivot) if self.angle else (x, y)

    def corner(self, i: str = "ix", j: str = "iy") -> tuple[str, str]:
        return f"({self.x0!r}d + {i} * {self.length!r}d)", f"({self.y0!r}d + {j} * {self.width!r}d)"

    def cells(self, spark: SparkSession) -> DataFrame:
        """grid_id, ix, iy, the lower corner (cx, cy) in the grid's frame, the centre (x, y) in the world. Numbers run along iy first."""
        ids = spark.range(self.nx * self.ny).select(F.col("id").alias("grid_id"), F.expr(f"id div {self.ny}").alias("ix"), F.expr(f"id % {self.ny}").alias("iy"))
        cx, cy = self.corner()
        x, y = self.world(f"(cx + {self.length / 2!r}d)", f"(cy + {self.width / 2!r}d)")
        return ids.withColumn("cx", F.expr(cx)).withColumn("cy", F.expr(cy)).withColumn("x", F.expr(x)).withColumn("y", F.expr(y))

    def outline(self) -> str:
        """SQL for a cell's four corners in the world, counter-clockwise."""
        ends = [("cx", "cy"), (f"cx + {self.length!r}d", "cy"), (f"cx + {self.length!r}d", f"cy + {self.width!r}d"), ("cx", f"cy + {self.width!r}d")]
        return f"array({', '.join('struct({} as x, {} as y)'.format(*self.world(f'({a})', f'({b})')) for a, b in ends)})"


def round_half_even(v: float, digits: int = 2) -> float:
    return round(v * 10**digits) / 10**digits


def create_spatial_grid(
    points: DataFrame, cell_size: float | None = None, length_column: str | None = None, width_column: str | None = None, shape: str = "square", angle: float = 0.0
) -> Grid:
    """A grid over the points, two cells wider on each side. A rectangle's sides are two columns' means, rounded to cents."""
    if shape == "square":
        if cell_size is None:
            raise ValueError("a square grid needs cell_size")
        length = width = float(cell_size)
    elif shape == "rectangle":
        if not length_column or not width_column:
            raise ValueError("a rectangular grid needs length_column and width_column")
        length, width = (round_half_even(v) for v in points.agg(F.avg(length_column), F.avg(width_column)).first())
    else:
        raise ValueError(f"shape must be square or rectangle, not {shape!r}")
    pivot = (0.0, 0.0)
    if angle:
        pivot = tuple(points.where("x is not null and y is not null").select("x", "y").distinct().agg(F.avg("x"), F.avg("y")).first())
        x, y = geo.rotate("x", "y", -angle, *pivot)
        points = points.select(F.expr(x).alias("x"), F.expr(y).alias("y"))
    x0, y0, x1, y1 = geo.total_bounds(points)
    nx = math.ceil((x1 + 2 * length - (x0 - 2 * length)) / length)
    ny = math.ceil((y1 + 2 * width - (y0 - 2 * width)) / width)
    return Grid(x0 - 2 * length, y0 - 2 * width, length, width, nx, ny, angle, pivot)


def clip_grid(grid: Grid, spark: SparkSession, boundary: DataFrame, buffer: float = 0.0) -> DataFrame:
    """The cells that reach the boundary's polygons grown by buffer, with the share of each cell inside where buffer is 0. Numbers keep their gaps."""
    cells = grid.cells(spark)
    met = polygon_cells(boundary, grid, buffer).join(cells, ["ix", "iy"])
    part = geo.overlap("geometry", F.expr(grid.outline()))
    if buffer:
        half = math.hypot(grid.length, grid.width) / 2
        near = met.where(F.expr(geo.distance("x", "y", "geometry")) <= buffer + half).select("grid_id").distinct()
        return cells.join(near, "grid_id", "left_semi").withColumn("inside", F.lit(None).cast("double"))
    inside = met.withColumn("o", part).where("o.area > 0").groupBy("grid_id").agg(F.least(F.sum("o.area") / (grid.length * grid.width), F.lit(1.0)).alias("inside"))
    return cells.join(inside, "grid_id")


def points_on_cells(points: DataFrame, grid: Grid, tolerance: float = 0.75) -> DataFrame:
    """points with ix and iy of each cell at most `tolerance` away (one cell, half-open, at 0)."""
    gx, gy = grid.own()
    placed = points.where("x is not null and y is not null").withColumn("gx", F.expr(gx)).withColumn("gy", F.expr(gy))
    if not tolerance:
        placed = placed.withColumn("ix", F.expr(f"cast(floor((gx - {grid.x0!r}d) / {grid.length!r}d) as bigint)")).withColumn("iy", F.expr(f"cast(floor((gy - {grid.y0!r}d) / {grid.width!r}d) as bigint)"))
    else:
        reach = lambda v, o, s: F.explode(F.expr(f"sequence(cast(ceil(({v} - {o!r}d - {tolerance!r}d) / {s!r}d) as bigint) - 1, cast(floor(({v} - {o!r}d + {tolerance!r}d) / {s!r}d) as bigint))"))
        placed = placed.withColumn("ix", reach("gx", grid.x0, grid.length)).withColumn("iy", reach("gy", grid.y0, grid.width))
        cx, cy = grid.corner()
        off = lambda v, c, s: f"greatest({c} - {v}, {v} - {c} - {s!r}d, 0d)"
        dx, dy = off("gx", cx, grid.length), off("gy", cy, grid.width)
        placed = placed.where(F.expr(f"{dx} * {dx} + {dy} * {dy}") <= tolerance * tolerance)
    return placed.where(f"ix >= 0 and ix < {grid.nx} and iy >= 0 and iy < {grid.ny}").drop("gx", "gy")


def aggregate_points(points: DataFrame, grid: Grid, rates: list[str] = (), masses: list[str] = (), tolerance: float = 0.75, cells: DataFrame | None = None) -> DataFrame:
    """The grid's cells with the mean of each rate and the sum of each mass of the points on them, all in one pass; null where none is."""
    sums = [F.avg(c).alias(c) for c in rates] + [F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in masses]
    met = points_on_cells(points, grid, tolerance).groupBy("ix", "iy").agg(*sums)
    cells = grid.cells(points.sparkSession) if cells is None else cells
    return cells.drop(*rates, *masses).join(met, ["ix", "iy"], "left")


def mass_report(points: DataFrame, grid: Grid, column: str, rate: bool = False, tolerance: float = 0.75) -> DataFrame:
    """One row: what the points hold, what the grid holds, and how they differ."""
    on = points_on_cells(points, grid, tolerance)
    area = grid.length * grid.width
    if rate:
        cells = on.groupBy("ix", "iy").agg(F.avg(column).alias("v"))
        got = cells.agg((F.sum("v") * area).alias("grid_total"), F.count("v").alias("cells")).crossJoin(on.agg(F.avg(column).alias("mean")))
        return got.select((F.col("mean") * F.col("cells") * area).alias("points_total"), "grid_total").withColumn("diff_pct", F.expr("100 * (grid_total - points_total) / points_total"))
    total = points.agg(F.sum(column).alias("points_total")).crossJoin(on.agg(F.sum(column).alias("grid_total")))
    return total.withColumn("equal", F.expr("bround(points_total, 2) = bround(grid_total, 2)"))


def polygon_cells(polygons: DataFrame, grid: Grid, margin: float = 0.0, geometry: str = "geometry") -> DataFrame:
    """polygons with ix and iy of each cell that their bounds reach, touching included."""
    box = geo.bounds(geometry)
    if grid.angle:
        corners = [geo.rotate("v.x", "v.y", -grid.angle, *grid.pivot)]
        turned = f"transform(flatten(flatten({geometry})), v -> struct({corners[0][0]} as x, {corners[0][1]} as y))"
        box = {f"{f}{c}": f"array_{f}(transform({turned}, v -> v.{c}))" for f in ("min", "max") for c in ("x", "y")}
    reach = lambda c, o, s, n: F.explode(F.expr(f"sequence(greatest(0L, cast(ceil(({box['min' + c]} - {margin!r}d - {o!r}d) / {s!r}d) as bigint) - 1), greatest(-1L, least({n - 1}L, cast(floor(({box['max' + c]} + {margin!r}d - {o!r}d) / {s!r}d) as bigint))))"))
    on = f"{box['maxx']} + {margin!r}d >= {grid.x0!r}d and {box['minx']} - {margin!r}d <= {grid.x0 + grid.nx * grid.length!r}d and {box['maxy']} + {margin!r}d >= {grid.y0!r}d and {box['miny']} - {margin!r}d <= {grid.y0 + grid.ny * grid.width!r}d"
    on = f"{geometry} is not null and size(flatten(flatten({geometry}))) > 0 and {on}"
    return polygons.where(on).select("*", reach("x", grid.x0, grid.length, grid.nx).alias("ix")).select("*", reach("y", grid.y0, grid.width, grid.ny).alias("iy"))


def assign_polygons(polygons: DataFrame, grid: Grid, value: str, geometry: str = "geometry", cells: DataFrame | None = None) -> DataFrame:
    """The grid's cells with <value>_weighted, the sum of value times the share of the cell that a polygon covers (0 where polygons only touch), and <value>, the plain mean over polygons that meet the cell."""
    cells = grid.cells(polygons.sparkSession) if cells is None else cells
    cx, cy = grid.corner()
    box = geo.bounds("geometry")
    layer = polygons.select(F.col(value).alias("__v"), F.col(geometry).alias("geometry"))
    layer = layer.selectExpr("*", *(f"{box[k]} as {k}" for k in box), f"size(flatten(geometry)) = 1 and size(flatten(flatten(geometry))) = 5 and {geo.area('geometry')} = ({box['maxx']} - {box['minx']}) * ({box['maxy']} - {box['miny']}) as upright")
    met = polygon_cells(layer, grid).withColumn("cx", F.expr(cx)).withColumn("cy", F.expr(cy))
    # upright rectangles on an upright grid overlap by arithmetic, others by clipping
    plain = f"upright and {'false' if grid.angle else 'true'}"
    side = lambda c, s, lo, hi: f"greatest(0d, least({c} + {s!r}d, {hi}) - greatest({c}, {lo}))"
    native = met.where(plain).withColumn("o", F.expr(f"named_struct('touches', true, 'area', {side('cx', grid.length, 'minx', 'maxx')} * {side('cy', grid.width, 'miny', 'maxy')})"))
    native = native.where(f"minx <= cx + {grid.length!r}d and maxx >= cx and miny <= cy + {grid.width!r}d and maxy >= cy")
    clipped = met.where(f"not ({plain})").withColumn("o", geo.overlap("geometry", F.expr(grid.outline()))).where("o.touches")
    met = native.select("ix", "iy", "__v", "o").unionByName(clipped.select("ix", "iy", "__v", "o"))
    sums = met.groupBy("ix", "iy").agg(F.coalesce(F.sum(F.col("__v") * F.col("o.area") / (grid.length * grid.width)), F.lit(0.0)).alias(f"{value}_weighted"), F.avg("__v").alias(value))
    return cells.join(sums, ["ix", "iy"], "left")


def align_to_grid(cells: DataFrame, points: DataFrame, column: str, method: str = "nearest", search_radius: float | None = 10.0, p: float = 2, k: int = 5) -> DataFrame:
    """(rid, <column>) for each cell (rid, x, y): the nearest point's value, or the mean of the k nearest weighted by distance to the -p; null beyond the radius of the nearest one.

    A point within 1e-5 decides alone (several share). Points without a value don't count.
    """
    known = points.where(F.col(column).isNotNull()).select("rid", "x", "y", F.col(column).alias("v"))
    if method not in ("nearest", "idw"):
        if known.limit(1).count():
            raise ValueError(f"method must be nearest or idw, not {method!r}")
        return cells.select("rid", F.lit(None).cast("double").alias(column))
    if method == "nearest" and search_radius is not None:
        pairs = radius_pairs(cells, known, search_radius)
        got = pairs.groupBy("rid").agg(F.min_by("v", F.struct("d2", "nid")).alias(column))
        return cells.select("rid").join(got, "rid", "left")
    n = known.count()
    if not n:
        return cells.select("rid", F.lit(None).cast("double").alias(column))
    pairs = nearest(cells, known, 1 if method == "nearest" else min(k, n)).withColumn("d", F.sqrt("d2"))
    weight = F.expr(f"1 / (pow(d, {float(p)!r}d) + 1e-12)")
    exact = F.expr("if(d < 1e-5, 1d, 0d)")
    sums = pairs.groupBy("rid").agg(F.sum(exact * F.col("v")).alias("ev"), F.sum(exact).alias("e"), F.sum(weight * F.col("v")).alias("wv"), F.sum(weight).alias("w"), F.min("d").alias("near"))
    value = F.expr("if(e > 0, ev / e, wv / w)")
    if search_radius is not None:
        value = F.when(F.col("near") <= float(search_radius), value)
    return cells.select("rid").join(sums.select("rid", value.alias(column)), "rid", "left")


STEPS = {"rook": [(1, 0), (-1, 0), (0, 1), (0, -1)]}
STEPS["queen"] = [*STEPS["rook"], (1, 1), (1, -1), (-1, 1), (-1, -1)]


def contiguity(cells: DataFrame, method: str) -> DataFrame:
    """(grid_id, ix, iy, jx, jy): the places of a cell's neighbours by edge (rook) or by corner too (queen)."""
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in STEPS[method])))
    return cells.select("grid_id", "ix", "iy", steps.alias("s")).select("grid_id", "ix", "iy", (F.col("ix") + F.col("s.a")).alias("jx"), (F.col("iy") + F.col("s.b")).alias("jy"))


def polygon_contiguity(polygons: DataFrame, method: str, geometry: str = "geometry", digits: int = 6) -> DataFrame:
    """(rid, nid) of polygons with a common edge (rook) or vertex (queen)."""
    at = f"concat(round(r[i].x, {digits}), ' ', round(r[i].y, {digits}))"
    to = f"concat(round(r[i + 1].x, {digits}), ' ', round(r[i + 1].y, {digits}))"
    key = at if method == "queen" else f"if({at} < {to}, concat({at}, ' ', {to}), concat({to}, ' ', {at}))"
    keys = polygons.select("rid", F.explode(F.expr(f"array_distinct(flatten(transform(flatten({geometry}), r -> transform(sequence(0, size(r) - 2), i -> {key}))))")).alias("key"))
    return keys.join(keys.withColumnRenamed("rid", "nid"), "key").where("rid <> nid").select("rid", "nid").distinct()


def impute_spatial_mean(cells: DataFrame, columns: list[str], method: str = "rook", k: int = 4) -> DataFrame:
    """cells (grid_id, ix, iy, x, y, …) with nulls of the columns replaced by the mean of the neighbours' values as they were; all columns in one pass."""
    values = cells.select("grid_id", "ix", "iy", *columns)
    if method in STEPS:
        right = values.select(F.col("ix").alias("jx"), F.col("iy").alias("jy"), *(F.col(c).alias(f"__{c}") for c in columns))
        open_cells = cells.where(" or ".join(f"`{c}` is null" for c in columns))
        means = contiguity(open_cells, method).join(right, ["jx", "jy"])
    elif method == "knn":
        open_cells = cells.where(" or ".join(f"`{c}` is null" for c in columns)).select(F.col("grid_id").alias("rid"), "x", "y")
        right = cells.select(F.col("grid_id").alias("rid"), "x", "y", *(F.col(c).alias(f"__{c}") for c in columns))
        means = nearest(open_cells, right, k, without_self=True).withColumnRenamed("rid", "grid_id")
    else:
        raise ValueError(f"method must be rook, queen or knn, not {method!r}")
    means = means.groupBy("grid_id").agg(*(F.avg(f"__{c}").alias(f"__{c}") for c in columns))
    return cells.join(means, "grid_id", "left").withColumns({c: F.coalesce(F.col(c), F.col(f"__{c}")) for c in columns}).drop(*(f"__{c}" for c in columns))


def tiled(polygons: DataFrame, tile: float, margin: float = 0.0, geometry: str = "geometry") -> DataFrame:
    """polygons copied to the tiles (__px, __py) that their bounds, wider by margin, reach, with the bounds as __x0, __y0, __x1, __y1."""
    box = geo.bounds(geometry)
    bounded = polygons.where(f"size(flatten(flatten({geometry}))) > 0").selectExpr("*", *(f"{box[k]} {'-' if k[1] == 'i' else '+'} {float(margin)!r}d as {v}" for k, v in (("minx", "__x0"), ("miny", "__y0"), ("maxx", "__x1"), ("maxy", "__y1"))))
    reach = lambda a, b: F.explode(F.expr(f"sequence(cast(floor({a} / {tile!r}d) as bigint), cast(floor({b} / {tile!r}d) as bigint))"))
    return bounded.select("*", reach("__x0", "__x1").alias("__px")).select("*", reach("__y0", "__y1").alias("__py"))


def on_tiles(points: DataFrame, tile: float) -> DataFrame:
    return points.withColumns({f"__t{c}": F.expr(f"cast(floor({c} / {tile!r}d) as bigint)") for c in "xy"})


#: A point's tile is a polygon's, and it lies in its bounds: what is cheap to ask comes before the exact test.
SAME_TILE = "__tx = __px and __ty = __py and x between __x0 and __x1 and y between __y0 and __y1"


def join_polygons(points: DataFrame, polygons: DataFrame, geometry: str = "geometry", tile: float = 100.0) -> DataFrame:
    """points with the attributes of each polygon that holds them, edges included; points in none stay with nulls, points in several repeat.

    Polygons are copied to the tiles that their bounds reach, points have one tile, and the exact test is the join's residual.
    """
    on = F.expr(f"{SAME_TILE} and {geo.covers('x', 'y', geometry)}")
    out = on_tiles(points, tile).join(tiled(polygons, tile, geometry=geometry), on, "left")
    return out.drop("__tx", "__ty", "__px", "__py", "__x0", "__y0", "__x1", "__y1", geometry)


def block_key(points: DataFrame, size: float) -> DataFrame:
    """points with block_x, block_y and block_id counted from the layer's lower left corner."""
    low = points.agg(F.min("x").alias("__x0"), F.min("y").alias("__y0"))
    out = points.crossJoin(F.broadcast(low))
    out = out.withColumn("block_x", F.expr(f"cast(floor((x - __x0) / {float(size)!r}d) as bigint)")).withColumn("block_y", F.expr(f"cast(floor((y - __y0) / {float(size)!r}d) as bigint)"))
    return out.withColumn("block_id", F.concat_ws("_", "block_x", "block_y")).drop("__x0", "__y0")
