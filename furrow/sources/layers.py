"""Layers by name: files, coordinate systems, schemas."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions import geometry as geo
from furrow.scratch import cut

DEFAULT_SRID = 32734


def clean(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """NaN becomes null, and each row gets a number rid (in the given order, else as read) if it has none."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    df = df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})
    if "rid" in df.columns:
        return df
    if order:
        from furrow.operators.lag import positions

        return positions(df, order, "rid")
    return cut(df.withColumn("rid", F.monotonically_increasing_id()), "layer")


def list_files(spark: SparkSession, path: str, suffix: str) -> list[str]:
    """All files below path with that suffix, through Spark's file systems, in order."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        raise FileNotFoundError(path)
    found, files = [], fs.listFiles(root, True)
    while files.hasNext():
        name = files.next().getPath().toString()
        if name.lower().endswith(suffix):
            found.append(name)
    return sorted(found)


def files_to_dict(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], list[str]]:
    """(layers by base name, all names found): shapefiles below path. Of equal names the last one stays; a file that can't be read is told and left out of the layers, not of the names."""
    layers, names = {}, []
    for file in list_files(spark, path, ".shp"):
        name = re.sub(r"\.shp$", "", file.rsplit("/", 1)[-1], flags=re.I)
        names.append(name)
        try:
            from furrow.sources.shapefile import read_shapefile

            layers[name] = read_shapefile(spark, file)
        except Exception as e:  # one broken file must not stop the others
            print(f"{file}: {e}")
    return layers, names


def read_wkb_points(df: DataFrame, column: str) -> DataFrame:
    """Little-endian WKB points as x and y, by the JVM."""
    number = lambda at: f"java_method('java.lang.Double', 'longBitsToDouble', conv(hex(reverse(substring({column}, {at}, 8))), 16, -10))"
    return df.withColumn("x", F.expr(f"double({number(6)})")).withColumn("y", F.expr(f"double({number(14)})")).drop(column)


def srid_of(df: DataFrame, column: str = "x") -> int | None:
    meta = df.schema[column].metadata if column in df.columns else {}
    return meta.get("srid")


def with_srid(df: DataFrame, srid: int) -> DataFrame:
    for c in ("x", "y", "geometry"):
        if c in df.columns:
            df = df.withMetadata(c, {"srid": srid})
    return df


def utm_zone(srid: int) -> tuple[int, bool] | None:
    """(zone, southern) of a WGS 84 UTM code."""
    if 32601 <= srid <= 32660:
        return srid - 32600, False
    if 32701 <= srid <= 32760:
        return srid - 32700, True
    return None


def reproject(df: DataFrame, source: int, target: int) -> DataFrame:
    """Points (x, y) between WGS 84 degrees (4326) and its UTM zones."""
    if source == target:
        return with_srid(df, target)
    x, y = F.col("x"), F.col("y")
    if source != 4326:
        if utm_zone(source) is None:
            raise ValueError(f"coordinate system {source} is not known")
        x, y = geo.utm_to_lonlat(x, y, *utm_zone(source))
    if target != 4326:
        if utm_zone(target) is None:
            raise ValueError(f"coordinate system {target} is not known")
        x, y = geo.lonlat_to_utm(x, y, *utm_zone(target))
    return with_srid(df.withColumns({"x": x, "y": y}), target)


def cast_to_crs(layers: dict[str, DataFrame], srid: int | None = None) -> dict[str, DataFrame]:
    """Each layer in one coordinate system: those without one are taken to be in it, others are brought to it."""
    srid = DEFAULT_SRID if srid is None else srid
    for name, df in layers.items():
        own = srid_of(df) or srid_of(df, "geometry")
        layers[name] = with_srid(df, srid) if own is None else reproject(df, own, srid)
    return layers


def reconciled(df: DataFrame, other: DataFrame) -> DataFrame:
    """df in the other layer's coordinate system; layers of which one has none are taken to agree."""
    own, wanted = (srid_of(d) or srid_of(d, "geometry") for d in (df, other))
    return df if own is None or wanted is None or own == wanted else reproject(df, own, wanted)


def load_schema(path: str) -> dict[str, list[str]]:
    """{standard name: [aliases]} from a JSON file."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def indel(a: str, b: str) -> float:
    """Similarity in percent by insertions and deletions: twice the longest common subsequence over both lengths."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for c in a:
        before = 0
        for j, d in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if c == d else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


def partial(a: str, b: str) -> float:
    """The best similarity of the shorter text to a window of the longer one."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0
    return max(indel(short, long[max(0, i) : i + len(short)]) for i in range(1 - len(short), len(long)))


def token_ratio(a: str, b: str, ratio) -> float:
    """Of words in order, and of common words against each side's words."""
    x, y = sorted(a.split()), sorted(b.split())
    common = sorted(set(x) & set(y))
    if common and (set(x) <= set(y) or set(y) <= set(x)):
        return 100.0
    both = " ".join(common)
    left, right = (" ".join([*common, *sorted(set(t) - set(common))]) for t in (x, y))
    return max(ratio(" ".join(x), " ".join(y)), ratio(both, left) if both else 0.0, ratio(both, right) if both else 0.0, ratio(left, right))


def weighted_ratio(a: str, b: str) -> float:
    """The best of plain, word-wise and partial similarity, the latter two at a discount. Case counts."""
    if not a or not b:
        return 0.0
    best = indel(a, b)
    longer = max(len(a), len(b)) / min(len(a), len(b))
    if longer < 1.5:
        return max(best, 0.95 * token_ratio(a, b, indel))
    scale = 0.9 if longer <= 8 else 0.6
    return max(best, scale * partial(a, b), 0.95 * scale * token_ratio(a, b, partial))


def column_matches(columns: list[str], schema: dict[str, list[str]], threshold: float = 80, exclude: list[str] | None = None) -> dict[str, str]:
    """{column: standard name}: each column's best entry from the threshold on, the first of equals; each entry's best column, the first of equals. Columns that already have a standard name keep it to themselves."""
    left_out = {c.lower() for c in exclude or []}
    winners: dict[str, tuple[float, str]] = {c: (101.0, c) for c in columns if c in schema and c.lower() not in left_out}
    for c in columns:
        if c.lower() in left_out or c in schema:
            continue
        best, name = 0.0, None
        for standard, aliases in schema.items():
            got = max(weighted_ratio(c, a) for a in [standard, *aliases])
            if got >= threshold and got > best:
                best, name = got, standard
        if name is not None and best > winners.get(name, (0.0, ""))[0]:
            winners[name] = (best, c)
    return {c: name for name, (_, c) in winners.items() if c != name}


def rename_columns_fuzzy(df: DataFrame, schema: dict[str, list[str]], threshold: float = 80, exclude: list[str] | None = None) -> DataFrame:
    """Columns renamed to their standard names; no job runs, only names are compared."""
    return df.withColumnsRenamed(column_matches(df.columns, schema, threshold, exclude))


def categorical_columns(df: DataFrame, without: list[str] = ()) -> list[str]:
    """The text columns, less some that must exist."""
    names = [c for c, t in df.dtypes if t == "string"]
    for c in without:
        names.remove(c)
    return names
