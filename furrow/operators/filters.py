"""Filters over field layers. NaN counts as null throughout: read layers through sources.layers.clean()."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions import geometry as geo
from furrow.operators.neighbours import radius_pairs
from furrow.scratch import cut


def limits(df: DataFrame, column: str, method: str, lower: float, upper: float) -> tuple[float | None, float | None]:
    """The bounds that a method sets: one aggregate, one row."""
    if method == "bounds":
        return lower, upper
    if method == "percentile":
        return tuple(df.agg(F.percentile(column, F.lit(float(lower))), F.percentile(column, F.lit(float(upper)))).first())
    if method == "SD":
        mean, sd = df.agg(F.avg(column), F.stddev_samp(column)).first()
        return (None, None) if sd is None else (mean - lower * sd, mean + upper * sd)
    raise ValueError(f"method must be percentile, bounds or SD, not {method!r}")


def filter_parameter(df: DataFrame, seed_column: str, column: str, method: str, lower: float = 0.10, upper: float = 0.90) -> DataFrame:
    """Rows with both columns whose value lies within the method's bounds, which count as inside.

    percentile: interpolated quantiles; bounds: the numbers themselves (pushed down to the scan); SD: so
    many sample deviations below and above the mean. Bounds are one row, so the filter is narrow.
    """
    rows = df.dropna(subset=list({seed_column, column}))
    if method == "bounds":
        return rows.where(F.col(column).between(lower, upper))
    if method not in ("percentile", "SD"):
        raise ValueError(f"method must be percentile, bounds or SD, not {method!r}")
    if method == "percentile":
        got = rows.agg(F.percentile(column, F.lit(float(lower))).alias("__low"), F.percentile(column, F.lit(float(upper))).alias("__high"))
    else:
        got = rows.agg((F.avg(column) - lower * F.stddev_samp(column)).alias("__low"), (F.avg(column) + upper * F.stddev_samp(column)).alias("__high"))
    return rows.crossJoin(F.broadcast(got)).where(F.col(column).between(F.col("__low"), F.col("__high"))).drop("__low", "__high")


def trial_boundaries(polygons: DataFrame, geometry: str = "geometry") -> DataFrame:
    """All polygons but the one of the largest area, of equals the first by rid."""
    sized = polygons.withColumn("__area", F.expr(geo.area(geometry)))
    largest = sized.agg(F.max(F.struct("__area", (-F.col("rid")).alias("r"))).alias("m")).select((-F.col("m.r")).alias("rid"))
    return polygons.join(F.broadcast(largest), "rid", "left_anti")


def split_by(df: DataFrame, inside: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) by rid."""
    return df.join(inside, "rid", "left_semi"), df.join(inside, "rid", "left_anti")


def region_pieces(parts: list, grow: float, step: float = 0.25, quadrant: int = 16) -> np.ndarray:
    """Short segments (x0, y0, x1, y1) along the edge of the union of polygons, each grown by `grow`.

    parts: polygons as lists of rings. Edges are moved out, corners rounded by `quadrant` facets, both cut
    into short pieces, and pieces that lie inside another part's growth dropped.
    """
    segments, pieces = [], []
    for rings in parts:
        for k, ring in enumerate(rings):
            r = np.array(ring, float)
            turn = ((r[:-1, 0] - r[0, 0]) * (r[1:, 1] - r[0, 1]) - (r[1:, 0] - r[0, 0]) * (r[:-1, 1] - r[0, 1])).sum()
            if (turn < 0) != (k > 0):  # shells counter-clockwise, holes clockwise: the outside is on the right
                r = r[::-1]
            for a, b in zip(r[:-1], r[1:], strict=True):
                d = b - a
                n = np.hypot(*d)
                if n == 0:
                    continue
                segments.append((*a, *b))
                out = np.array([d[1], -d[0]]) / n * grow
                cuts = np.linspace(0, 1, max(2, int(np.ceil(n / step)) + 1))
                line = a + out + cuts[:, None] * d
                pieces += [(*p, *q) for p, q in zip(line[:-1], line[1:], strict=True)]
                if grow:
                    angle = np.linspace(0, 2 * np.pi, 4 * quadrant + 1)
                    arc = b + grow * np.stack([np.cos(angle), np.sin(angle)], 1)
                    pieces += [(*p, *q) for p, q in zip(arc[:-1], arc[1:], strict=True)]
    pieces = np.array(pieces, float).reshape(-1, 4)
    if not grow or not len(pieces):
        return pieces
    middle = (pieces[:, :2] + pieces[:, 2:]) / 2
    far = distance_to(middle, np.array(segments)) >= grow * np.cos(np.pi / (4 * quadrant)) - 1e-9
    outside = ~np.any([inside_polygon(middle, rings) for rings in parts], axis=0)
    return pieces[far & outside]


def distance_to(points: np.ndarray, segments: np.ndarray, block: int = 2048) -> np.ndarray:
    """Distance of each point to the nearest of the segments (x0, y0, x1, y1)."""
    a, d = segments[:, :2], segments[:, 2:] - segments[:, :2]
    length = np.maximum((d**2).sum(1), 1e-300)
    out = np.empty(len(points))
    for i in range(0, len(points), block):
        p = points[i : i + block, None] - a
        t = np.clip((p * d).sum(2) / length, 0, 1)
        out[i : i + block] = np.sqrt(((p - t[..., None] * d) ** 2).sum(2).min(1))
    return out


def inside_polygon(points: np.ndarray, rings: list) -> np.ndarray:
    odd = np.zeros(len(points), bool)
    for ring in rings:
        r = np.array(ring, float)
        for (x0, y0), (x1, y1) in zip(r[:-1], r[1:], strict=True):
            if y0 != y1:
                odd ^= ((y0 > points[:, 1]) != (y1 > points[:, 1])) & (points[:, 0] < (x1 - x0) * (points[:, 1] - y0) / (y1 - y0) + x0)
    return odd


#: Vertices that a boundary layer may have: it is collected and sent to all tasks.
BOUNDARY_VERTICES = 200_000


def boundary_parts(polygons: DataFrame, geometry: str = "geometry") -> list:
    """A boundary layer's polygons as lists of rings; refused if it is not a small layer."""
    size = polygons.agg(F.sum(F.expr(f"size(flatten(flatten({geometry})))"))).first()[0] or 0
    if size > BOUNDARY_VERTICES:
        raise ValueError(f"a boundary layer may have {BOUNDARY_VERTICES} vertices, this one has {size}")
    return [[[(v["x"], v["y"]) for v in ring] for ring in part] for row in polygons.select(geometry).collect() for part in row[0]]


def remove_boundary_data(points: DataFrame, trial: DataFrame, zone: float = 0.0, grow: float = 1.0, geometry: str = "geometry", tile: float = 100.0) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): points within the union of the polygons grown by `grow` and then shrunk by `zone`; the edge is inside.

    A point lies in the grown union if a polygon is at most `grow` away, and stays if no piece of the
    union's edge is nearer than `zone`. Both are joins by tiles; only the edge, with a zone, is worked out
    on the driver, from a (small) boundary layer.
    """
    from furrow.operators.grid import SAME_TILE, on_tiles, tiled

    grown = tiled(trial.select(geometry), tile, grow, geometry)
    placed = on_tiles(points.where("x is not null and y is not null").select("rid", "x", "y"), tile)
    inside = placed.join(grown, F.expr(f"{SAME_TILE} and {geo.distance('x', 'y', geometry)} <= {float(grow)!r}d"), "left_semi")
    if zone:
        pieces = region_pieces(boundary_parts(trial, geometry), grow)
        edge = points.sparkSession.createDataFrame(pd.DataFrame(pieces, columns=["ax", "ay", "bx", "by"]), "ax double, ay double, bx double, by double")
        reach = lambda a, b: F.explode(F.expr(f"sequence(cast(floor((least({a}, {b}) - {float(zone)!r}d) / {tile!r}d) as bigint), cast(floor((greatest({a}, {b}) + {float(zone)!r}d) / {tile!r}d) as bigint))"))
        edge = edge.select("*", reach("ax", "bx").alias("__px")).select("*", reach("ay", "by").alias("__py"))
        near = geo.segment_distance2("x", "y", "struct(ax as x, ay as y)", "struct(bx as x, by as y)")
        inside = inside.join(edge, F.expr(f"__tx = __px and __ty = __py and {near} < {float(zone) ** 2!r}d"), "left_anti")
    return split_by(points, inside.select("rid"))


def remove_local_outliers(points: DataFrame, value: str, crit: str = "dist", s: float = 15, sd_threshold: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(clean, outliers): a value must lie within so many population deviations of the mean of its neighbours, itself left out.

    crit "dist": all within s, none means kept; "neighbours": the s nearest. A null value, or a null among
    the neighbours, makes an outlier.
    """
    judged = local_verdicts(points, value, crit, s, sd_threshold)
    return judged.where("__ok").drop("__ok"), judged.where("not __ok").drop("__ok")


def local_statistics(points: DataFrame, value: str, crit: str, s: float) -> DataFrame:
    """rid, mean, sd, n, known for points with neighbours."""
    from furrow.operators.neighbours import nearest

    if crit == "dist":
        pairs = radius_pairs(points, points.select("rid", "x", "y", F.col(value).alias("v")), s, without_self=True)
    elif crit == "neighbours":
        pairs = nearest(points, points.select("rid", "x", "y", F.col(value).alias("v")), int(s), without_self=True)
    else:
        raise ValueError(f"crit must be dist or neighbours, not {crit!r}")
    return pairs.groupBy("rid").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.count("*").alias("n"), F.count("v").alias("known"))


def local_verdicts(points: DataFrame, value: str, crit: str, s: float, sd_threshold: float) -> DataFrame:
    """points with __ok."""
    stats = local_statistics(points, value, crit, s).select("rid", *(F.col(c).alias(f"__{c}") for c in ("mean", "sd", "n", "known")))
    v, band = F.col(value), sd_threshold * F.col("__sd")
    ok = F.when(F.col("__n").isNull(), v.isNotNull()).when(F.col("__n") != F.col("__known"), False).otherwise(v.between(F.col("__mean") - band, F.col("__mean") + band))
    return points.join(stats, "rid", "left").withColumn("__ok", F.coalesce(ok, F.lit(False))).drop("__mean", "__sd", "__n", "__known")


def remove_spatial_outliers(points: DataFrame, dist: float, n: int, max_iters: int = 10) -> DataFrame:
    """Points that keep at least n others within dist, over and over until none falls or max_iters rounds are done.

    Neighbour pairs are found once; each round counts among the survivors.
    """
    edges = cut(radius_pairs(points, points.select("rid", "x", "y"), dist, without_self=True).select("rid", "nid"), "density-edges")
    alive, size = points.select("rid"), None
    for _ in range(max_iters):
        live = alive if size is None else alive
        both = edges.join(live, "rid", "left_semi").join(live.withColumnRenamed("rid", "nid"), "nid", "left_semi")
        counts = both.groupBy("rid").agg(F.count("*").alias("k")).where(F.col("k") >= n).select("rid")
        alive = cut(live.join(counts, "rid", "left_semi") if n > 0 else live, "density-alive")
        now = alive.count()
        if now == size:
            break
        size = now
    return points.join(alive, "rid", "left_semi")


def text_encoder(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """(df, names): each category but the first, in order, becomes a column <column>_<value> of 0 and 1; rows with a null in any column leave, the columns too.

    The categories are few by nature; they are what is collected.
    """
    rows = df.dropna(subset=columns)
    names, exprs = [], []
    for c in columns:
        for (v,) in rows.select(c).distinct().orderBy(c).collect()[1:]:
            names.append(f"{c}_{v}")
            exprs.append(F.when(F.col(c) == v, 1.0).otherwise(0.0).alias(names[-1]))
    return rows.select(*(c for c in df.columns if c not in columns), *exprs), names


def retained_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows before and after, and the share retained in percent."""
    return before.agg(F.count("*").alias("before")).crossJoin(after.agg(F.count("*").alias("after"))).withColumn("retained_pct", F.expr("if(before = 0, null, 100d * after / before)"))


def histogram(df: DataFrame, column: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """(bin, lower, upper, n) for equal bins from the least to the greatest value; the last one holds its upper edge."""
    if low is None or high is None:
        low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, lower double, upper double, n long")
    low, high = (low - 0.5, high + 0.5) if low == high else (low, high)
    width = (high - low) / bins
    place = F.least(F.floor((F.col(column) - low) / width).cast("int"), F.lit(bins - 1))
    counts = df.where(F.col(column).between(low, high)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), (F.lit(float(low)) + F.col("id") * width).alias("lower"), (F.lit(float(low)) + (F.col("id") + 1) * width).alias("upper"))
    return every.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def example_outlier(points: DataFrame, value: str, outliers: DataFrame, s: float) -> DataFrame:
    """The first outlier's neighbours and their values."""
    first = outliers.orderBy("rid").limit(1)
    return radius_pairs(first, points.select("rid", "x", "y", F.col(value).alias("v")), s, without_self=True).select("rid", "nid", "v")


def neighbour_lists(points: DataFrame, s: float) -> DataFrame:
    """rid, neighbours: ids within s, sorted."""
    return radius_pairs(points, points.select("rid", "x", "y"), s, without_self=True).groupBy("rid").agg(F.sort_array(F.collect_list("nid")).alias("neighbours"))
