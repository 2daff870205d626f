"""The data behind maps and charts: frames that a plotting tool draws as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.operators.filters import histogram
from furrow.operators.lag import shifted


def status_map(kept: DataFrame, removed: DataFrame, columns: list[str]) -> DataFrame:
    """Rows before and after a filter with status kept or removed."""
    return kept.select(*columns, F.lit("kept").alias("status")).unionByName(removed.select(*columns, F.lit("removed").alias("status")))


def before_after_histograms(before: DataFrame, after: DataFrame, columns: list[str], bins: int = 50) -> DataFrame:
    """(stage, column, bin, lower, upper, n) of each column before and after a filter."""
    out = None
    for stage, df in (("before", before), ("after", after)):
        for c in columns:
            own = histogram(df, c, bins).withColumn("stage", F.lit(stage)).withColumn("column", F.lit(c))
            out = own if out is None else out.unionByName(own)
    return out.select("stage", "column", "bin", "lower", "upper", "n")


def split_map(marked: DataFrame) -> DataFrame:
    """(rid, x, y, block_id, part) of a block split."""
    return marked.select("rid", "x", "y", "block_id", F.when(F.col("is_test"), "test").otherwise("train").alias("part"))


def shift_maps(df: DataFrame, value: str, delay: int, order: str = "seq", low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(stage, x, y, value, low, high): the layer as it is and shifted, with colour limits from its percentiles."""
    moved = shifted(df.select(order, "x", "y", value), [order], delay, [value])
    both = df.select(F.lit("unshifted").alias("stage"), "x", "y", value).unionByName(moved.select(F.lit("shifted").alias("stage"), "x", "y", value)).dropna(subset=[value])
    edge = df.agg(F.percentile(value, F.lit(low)).alias("low"), F.percentile(value, F.lit(high)).alias("high"))
    return both.withColumnRenamed(value, "value").crossJoin(F.broadcast(edge))


def triptych(scored: DataFrame, low: float, high: float, residual: float = 1.5) -> DataFrame:
    """(panel, rid, x, y, value, low, high) of truth, prediction and residual with fixed colour limits."""
    n = "stack(3, 'true', y_true, 'predicted', y_pred, 'residual', y_true - y_pred) as (panel, value)"
    rows = scored.selectExpr("rid", "x", "y", n)
    edge = lambda a, b: F.when(F.col("panel") == "residual", F.lit(b)).otherwise(F.lit(a))
    return rows.withColumn("low", edge(float(low), -float(residual))).withColumn("high", edge(float(high), float(residual)))


def importance_maps(local: DataFrame, features: list[str]) -> DataFrame:
    """(feature, rid, x, y, importance) for maps of local importances; two features at least."""
    if len(features) < 2:
        raise ValueError("maps need two features at least")
    pairs = ", ".join(f"'{f}', `imp_{f}`" for f in features)
    return local.selectExpr("rid", "x", "y", f"stack({len(features)}, {pairs}) as (feature, importance)")


def parity_residuals(predictions: DataFrame) -> DataFrame:
    """(rid, y_true, y_pred, residual)."""
    return predictions.select("rid", "y_true", "y_pred", (F.col("y_true") - F.col("y_pred")).alias("residual"))
