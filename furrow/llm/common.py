"""Helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.scratch import cut, drop, fresh_path, shared_dir

__all__ = ["UPPER", "ascii_lower", "crc_mod", "cut", "drop", "fresh_path", "shared_dir", "smallest", "table", "whole"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(docs: DataFrame) -> Column:
    """A struct of all columns of docs: beside it an operator's own columns clash with none."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. All-ASCII texts take the faster built-in, which then does the same."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; a null counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def smallest(rows: DataFrame, most: int, *key: str) -> DataFrame:
    """At most `most` rows, those whose keys have the smallest hashes. Counts of the hashes' leading bits, 4096 at a time, give the limit; no rows are sorted or gathered. Rows with equal keys come together or not at all."""
    h = F.shiftrightunsigned(F.xxhash64(*key), 1)
    low, bits, room, near = 0, 63, most, F.lit(True)
    while bits > 0:
        bits -= min(12, bits)
        for r in rows.where(near).groupBy(F.shiftright(h, bits).alias("b")).count().orderBy("b").collect():
            if r["count"] > room:
                low, near = r["b"] << bits, F.shiftright(h, bits) == r["b"]
                break
            room -= r["count"]
        else:
            return rows.where((h < low) | near)
    return rows.where(h < low)
