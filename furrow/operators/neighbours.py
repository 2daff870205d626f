"""Neighbourhoods as tile-binned equi-joins.

A radius join bins the left side into square tiles as wide as the radius and copies the right side into the
nine tiles around each point, so pairs meet in a plain equi-join on the tile, which Spark may split where a
tile is crowded; each pair meets once, as a left row lies in one tile.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.scratch import cut


def around(column: str, r: float):
    return F.explode(F.expr(f"sequence(cast(floor({column} / {r!r}d) as bigint) - 1, cast(floor({column} / {r!r}d) as bigint) + 1)"))


def radius_pairs(left: DataFrame, right: DataFrame, r: float, without_self: bool = False) -> DataFrame:
    """(rid, bx, by, nid, d2, and right's other columns): pairs of points at most r apart; x and y of left as lx, ly. Points without coordinates take no part."""
    r = float(r)
    a = left.where("x is not null and y is not null").select(F.col("rid"), F.col("x").alias("lx"), F.col("y").alias("ly"), *(F.expr(f"cast(floor({c} / {r!r}d) as bigint)").alias(f"b{c}") for c in "xy"))
    rest = [c for c in right.columns if c not in ("rid", "x", "y")]
    b = right.where("x is not null and y is not null").select(F.col("rid").alias("nid"), F.col("x").alias("rx"), F.col("y").alias("ry"), *rest, around("x", r).alias("bx")).select("*", around("ry", r).alias("by"))
    near = (F.col("lx") - F.col("rx")) * (F.col("lx") - F.col("rx")) + (F.col("ly") - F.col("ry")) * (F.col("ly") - F.col("ry"))
    pairs = a.join(b, ["bx", "by"]).withColumn("d2", near).where(F.col("d2") <= r * r)
    return pairs.where("rid <> nid") if without_self else pairs


def typical_spacing(points: DataFrame, k: int) -> float:
    """A tile width at which three by three tiles hold a few times k points where they are spread evenly."""
    n, x0, x1, y0, y1 = points.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if not n:
        return 1.0
    area = max(x1 - x0, 1e-9) * max(y1 - y0, 1e-9)
    return max(math.sqrt(area * max(k, 1) / n), max(x1 - x0, y1 - y0) / 1e6, 1e-9)


def nearest(left: DataFrame, right: DataFrame, k: int, without_self: bool = False, radius: float | None = None) -> DataFrame:
    """(rid, nid, d2, rank, and right's other columns): each left point's k nearest right points, equal distances by nid; none beyond radius.

    Tiles grow until each left point has k neighbours nearer than the tile's width, which proves them;
    only points without go into the next round.
    """
    right = right.where("x is not null and y is not null")
    left = left.where("x is not null and y is not null").select("rid", "x", "y")
    extent = right.unionByName(left, allowMissingColumns=True).agg(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.count("*")).first()
    n_right = right.count()
    rest = [c for c in right.columns if c not in ("rid", "x", "y")]
    order = Window.partitionBy("rid").orderBy("d2", "nid")
    if without_self and k > n_right - 1 and radius is None or k > n_right and radius is None:
        raise ValueError(f"{k} neighbours are asked of {n_right} points")
    reach = math.hypot(extent[0] or 0.0, extent[1] or 0.0) + 1.0
    width = float(radius) if radius is not None else min(typical_spacing(right, k), reach)
    done, open_points = None, left
    while True:
        pairs = radius_pairs(open_points, right, width, without_self).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("rid", "nid", "d2", "rank", *rest)
        if radius is not None:
            return pairs
        pairs = cut(pairs, "nearest")
        done = pairs if done is None else done.unionByName(pairs)
        if width >= reach:
            return done
        full = pairs.where(F.col("rank") == k).select("rid")
        open_points = cut(open_points.join(full, "rid", "left_anti"), "nearest-open")
        if not open_points.count():
            return done
        # what the unfinished points have found so far doesn't count
        done = done.join(open_points.select("rid"), "rid", "left_anti")
        width = min(width * 2, reach)


#: Points that a block holds, about; distances that are worked out at once.
BLOCK_POINTS, DISTANCES = 1000, 1 << 20


def dense_spacing(points: DataFrame, k: int) -> float:
    """typical_spacing(), narrowed until tiles that hold points hold few times k of them on average, so that empty land between fields doesn't count."""
    width = typical_spacing(points, k)
    for _ in range(24):
        tiles = points.groupBy(*(F.expr(f"cast(floor({c} / {width!r}d) as bigint)") for c in "xy")).count().agg(F.avg("count"), F.max("count")).first()
        if tiles[0] is None or tiles[0] <= 4 * max(k, 1):
            break
        width /= 2
    return width


def k_nearest(left: np.ndarray, right: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, squared distances) of each left point's k nearest right points, equal distances by id; left and right are (points, 2)."""
    by = np.argsort(ids, kind="stable")
    right = right[by]
    places, d2s = np.empty((len(left), k), np.int64), np.empty((len(left), k))
    step = max(1, DISTANCES // len(right))
    for i in range(0, len(left), step):
        dx, dy = left[i : i + step, :1] - right[:, 0], left[i : i + step, 1:] - right[:, 1]
        d2 = dx * dx + dy * dy
        limit = np.partition(d2, k - 1, axis=1)[:, k - 1 : k]
        r, c = np.nonzero(d2 <= limit)
        v = d2[r, c]
        order = np.lexsort((c, v, r))  # by distance, then by id, as the columns are in the order of ids
        first = np.searchsorted(r, np.arange(len(dx)))
        take = order[first[:, None] + np.arange(k)]
        places[i : i + step], d2s[i : i + step] = by[c[take]], v[take]
    return places, d2s


def nearest_by_blocks(left: DataFrame, right: DataFrame, k: int, one: Callable[[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """What `one` makes of left points and their k nearest right points, as nearest() finds them: one(left rows, right rows, places of the neighbours in right, squared distances) gives a row of the schema, rid first, for each left row.

    Right points are copied to the blocks that lie within a margin. A left point is done when its k-th neighbour
    is nearer than the margin, which proves its list; the others go on with twice the margin. A block is one task's.
    """
    # read several times, and of one layer perhaps
    left, right = (cut(d.where("x is not null and y is not null"), "blocks-in") for d in (left, right))
    n_right = right.count()
    if k > n_right:
        raise ValueError(f"{k} neighbours are asked of {n_right} points")
    extent = right.select("x", "y").unionByName(left.select("x", "y")).agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    reach = math.hypot(extent[0] or 0.0, extent[1] or 0.0) + 1.0
    margin = min(dense_spacing(right, k), reach)
    side = margin * max(1.0, math.sqrt(BLOCK_POINTS / k))
    names, done, open_points = left.columns, None, left
    while True:
        side, last = max(side, margin), margin >= reach
        block = lambda v, s=side: f"cast(floor(({v}) / {s!r}d) as bigint)"
        a = open_points.withColumns({"__bx": F.expr(block("x")), "__by": F.expr(block("y"))})
        b = right
        for c in "xy":
            far = margin * (1 + 1e-6)
            b = b.select("*", F.explode(F.expr(f"sequence({block(f'{c} - {far!r}d')}, {block(f'{c} + {far!r}d')})")).alias(f"__b{c}"))
        if done is not None:
            b = b.join(a.select("__bx", "__by").distinct(), ["__bx", "__by"], "left_semi")

        def work(rows: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:  # runs within this round
            out, proven = None, np.zeros(len(rows), bool)
            if len(rows) and len(others) >= k:
                places, d2 = k_nearest(rows[["x", "y"]].to_numpy(float), others[["x", "y"]].to_numpy(float), others["rid"].to_numpy(), k)
                proven = (d2[:, -1] <= margin * margin) | last  # noqa: B023
                if proven.any():
                    out = one(rows[proven][names], others, places[proven], d2[proven])
                    out["__done"] = True
            rest = pd.DataFrame({"rid": rows["rid"][~proven], "__done": False}).reindex(columns=fields).astype({f: object for f in fields[1:-1]})
            rest[fields[1:-1]] = None
            return rest if out is None else pd.concat([out, rest]) if len(rest) else out

        whole = f"{schema}, __done boolean"
        fields = [f.name for f in T.StructType.fromDDL(whole)]
        got = cut(a.groupBy("__bx", "__by").cogroup(b.groupBy("__bx", "__by")).applyInPandas(work, whole), "blocks")
        found = got.where("__done").drop("__done")
        done = found if done is None else done.unionByName(found)
        if last:
            return done
        open_points = cut(left.join(got.where("not __done").select("rid"), "rid", "left_semi"), "blocks-open")
        if not open_points.limit(1).count():
            return done
        margin = min(margin * 2, reach)


def plane(pairs: DataFrame) -> DataFrame:
    """rid, slope_deg, aspect_deg of the least-squares plane through each neighbourhood: pairs (rid, lx, ly, rx, ry, z).

    Moments about the point itself, so large coordinates don't drown them. Fewer than three heights: null.
    Points on a line take the plane of least slope; a flat one faces 180.
    """
    rows = pairs.where("z is not null").withColumn("dx", F.expr("rx - lx")).withColumn("dy", F.expr("ry - ly"))
    m = rows.groupBy("bx", "by", "rid").agg(
        F.count("*").alias("n"), F.var_pop("dx").alias("xx"), F.var_pop("dy").alias("yy"), F.covar_pop("dx", "dy").alias("xy"), F.covar_pop("dx", "z").alias("xz"), F.covar_pop("dy", "z").alias("yz")
    )
    m = m.withColumn("det", F.expr("xx * yy - xy * xy")).withColumn("t", F.expr("xx + yy"))
    m = m.withColumn("line", F.expr("det <= 1e-12 * t * t"))
    m = m.withColumn("a", F.expr("case when t = 0 then 0d when line then (xx * xz + xy * yz) / (t * t) else (xz * yy - yz * xy) / det end"))
    m = m.withColumn("b", F.expr("case when t = 0 then 0d when line then (xy * xz + yy * yz) / (t * t) else (yz * xx - xz * xy) / det end"))
    aspect = F.expr("case when a = 0 and b = 0 then 180d else pmod(degrees(atan2(-a, -b)), 360d) end")
    known = F.col("n") >= 3
    return m.select("rid", F.when(known, F.degrees(F.atan(F.sqrt(F.expr("a * a + b * b"))))).alias("slope_deg"), F.when(known, aspect).alias("aspect_deg"))


def terrain(points: DataFrame, crit: str = "dist", s: float = 30) -> DataFrame:
    """points (rid, x, y, z) with slope_deg and aspect_deg of their neighbourhoods, themselves included: all within s, or the s nearest."""
    others = points.select("rid", "x", "y", "z")
    if crit == "dist":
        pairs = radius_pairs(points, others, s)
    elif crit == "neighbours":
        own = points.select("rid", F.col("x").alias("lx"), F.col("y").alias("ly"))
        found = nearest(points, others.withColumn("ox", F.col("x")).withColumn("oy", F.col("y")), int(s)).withColumnsRenamed({"ox": "rx", "oy": "ry"})
        pairs = found.join(own, "rid").withColumn("bx", F.lit(0)).withColumn("by", F.lit(0))
    else:
        raise ValueError(f"crit must be dist or neighbours, not {crit!r}")
    return points.join(plane(pairs), "rid", "left")
