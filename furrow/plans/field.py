"""A field's whole analysis: layers in, a grid of variables out, and models on it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions.geometry import north_east
from furrow.operators import filters, grid, modelling, neighbours
from furrow.scratch import cut


@dataclass
class Settings:
    """Distances in metres; counts; bounds of the yield in its own unit."""

    clip_zone: float = 20.0
    terrain_radius: float = 30.0
    density: tuple[float, int] = (15.0, 5)
    yield_bounds: tuple[float, float] = (0.0, 5.0)
    yield_sd: float = 5.0
    speed_most: float = 10.0
    outliers: tuple[float, float] = (20.0, 3.0)
    cell_size: float | None = None
    impute_k: int = 25


def clean_inputs(points: DataFrame, trial: DataFrame, rate: str, s: Settings) -> DataFrame:
    """An applicator's log: the middle 90 percent of rates, within the trial, not alone."""
    rows = filters.filter_parameter(points, rate, rate, "percentile", 0.05, 0.95)
    kept, _ = filters.remove_boundary_data(rows, filters.trial_boundaries(trial), s.clip_zone)
    return filters.remove_spatial_outliers(cut(kept, "inputs"), *s.density)


def clean_yield(points: DataFrame, trial: DataFrame, value: str, speed: str | None, s: Settings) -> DataFrame:
    """A harvester's log: within the trial, plausible speeds and yields (each filter on the last one's rows), no local outliers."""
    rows, _ = filters.remove_boundary_data(points, trial, s.clip_zone)
    if speed:
        rows = rows.where((F.col(speed) < s.speed_most) & (F.col(speed) > 0))
    rows = filters.filter_parameter(rows, value, value, "bounds", *s.yield_bounds)
    rows = filters.filter_parameter(rows, value, value, "SD", s.yield_sd, s.yield_sd)
    return filters.remove_local_outliers(cut(rows, "yield"), value, "dist", *s.outliers)[0]


def with_terrain(points: DataFrame, s: Settings) -> DataFrame:
    """points (with z) with slope, aspect, and the aspect's northern and eastern parts."""
    out = neighbours.terrain(points, "dist", s.terrain_radius)
    north, east = north_east(F.col("aspect_deg"))
    return out.withColumn("aspect_north", north).withColumn("aspect_east", east)


def gridded(yields: DataFrame, value: str, rates: list[str], polygons: dict[str, DataFrame], s: Settings, length_column: str | None = None, width_column: str | None = None) -> tuple[grid.Grid, DataFrame]:
    """The grid along the main heading with the mean of each rate and each polygon layer's weighted values; gaps filled from neighbours, cells with gaps left out."""
    angle = grid.dominant_heading(yields).first()["heading"]
    if s.cell_size:
        g = grid.create_spatial_grid(yields, s.cell_size, angle=angle)
    else:
        g = grid.create_spatial_grid(yields, length_column=length_column, width_column=width_column, shape="rectangle", angle=angle)
    cells = grid.aggregate_points(yields, g, [value, *rates])
    for column, layer in polygons.items():
        cells = grid.assign_polygons(layer, g, column, cells=cells)
    cells = cut(cells, "grid")
    columns = [c for c in cells.columns if c not in ("grid_id", "ix", "iy", "cx", "cy", "x", "y", value)]
    cells = grid.impute_spatial_mean(cells, columns, "knn", s.impute_k) if columns else cells
    return g, cut(cells.dropna(subset=[value, *columns]), "training-grid")


def model_grid(cells: DataFrame, value: str, features: list[str], trees: int = 150, repeats: int = 10, block_size: float | None = None) -> modelling.Result:
    """A forest under spatial cross-validation; blocks as long as the variogram's range unless given."""
    rows = cells.withColumnRenamed("grid_id", "rid")
    size = block_size or modelling.optimal_block_size(rows, value) or 50
    return modelling.rf_predict_spatial(rows, features, value, size, params={"trees": trees}, repeats=repeats)
