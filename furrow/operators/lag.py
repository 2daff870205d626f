"""Order: positions, shifts, and the search for a sensor's lag.

Layers have no order of their own, so each operator names its order columns. A shift joins positions with
positions plus the shift, which needs no window over the whole layer.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as dataset
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.scratch import cut


def positions(df: DataFrame, order: list[str], name: str = "__pos") -> DataFrame:
    """df with each row's place from 0 in the given order (ties by all that order names).

    Rows are dealt by ranges and sorted within them; a row's place is its place within its range plus the
    sizes of the ranges before, of which there are as many as tasks.
    """
    parts = df.sparkSession.sparkContext.defaultParallelism * 2
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = cut(dealt.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "positions")
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("n")).orderBy("__part").collect()
    base, rows = 0, []
    for r in sizes:
        rows.append((r["__part"], base))
        base += r["n"]
    if not rows:
        return df.withColumn(name, F.lit(0).cast("long"))
    bases = df.sparkSession.createDataFrame(rows, "__part int, __base long")
    return dealt.join(F.broadcast(bases), "__part").withColumn(name, F.col("__at") + F.col("__base")).drop("__part", "__at", "__base")


def shifted(df: DataFrame, order: list[str], steps: int, columns: list[str], suffix: str = "") -> DataFrame:
    """df with columns (renamed by the suffix) taken from the row `steps` places later in the order; null where there is none."""
    placed = positions(df, order)
    later = placed.select((F.col("__pos") - steps).alias("__pos"), *(F.col(c).alias(f"__later_{i}") for i, c in enumerate(columns)))
    keep = placed if suffix else placed.drop(*columns)
    out = keep.join(later, "__pos", "left")
    for i, c in enumerate(columns):
        out = out.withColumnRenamed(f"__later_{i}", c + suffix)
    names = df.columns + ([c + suffix for c in columns] if suffix else [])
    return out.select(*names)


def manual_lag_correction(df: DataFrame, time: str, lag: float, interval: float, tie: str = "rid", fixed: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Every column but the fixed ones taken from the row `lag` later in time; rows that run out of time leave.

    A step in time may have several rows: int(rows / distinct times) each.
    """
    rows = df.withColumn(time, F.to_timestamp(time))
    n, times = rows.agg(F.count("*"), F.countDistinct(time)).first()
    steps = int(round(lag / interval)) * (int(n / times) if times else 1)
    moved = [c for c in rows.columns if c not in (*fixed, tie)]
    return shifted(rows, [time, tie], steps, moved).where(F.col(time).isNotNull())


def prepare_shifted_data(df: DataFrame, delay: float, yield_column: str, order: str = "seq", polling_rate: float = 1.0, tie: str = "rid") -> DataFrame:
    """The yield column alone taken from `delay` later; rows without yield or coordinates leave."""
    steps = int(round(delay / polling_rate))
    keys = [order] if order == tie or tie not in df.columns else [order, tie]
    return shifted(df, keys, steps, [yield_column]).dropna(subset=[c for c in (yield_column, "x", "y") if c in df.columns])


def pixels(df: DataFrame, width: float, yield_column: str, order: str = "seq") -> tuple[DataFrame, int, int, float, float]:
    """((pos, cell, v), n, lines, mean, sd): each row's place in the order, its pixel's number on n by n (null without coordinates) and its yield.

    Pixels are numbered line by line; lines run along the field's longer side, so that it reaches few of them.
    """
    x0, y0, x1, y1, mean, sd = df.where("x is not null and y is not null").agg(F.min("x"), F.min("y"), F.max("x"), F.max("y"), F.avg(yield_column), F.stddev_samp(yield_column)).first()
    pixel = width * 0.7
    n = int(2 ** np.ceil(np.log2(max(x1 - x0, y1 - y0) / pixel)))
    at = lambda c, o: f"cast(least(greatest(cast(({c} - {o!r}d) / {pixel!r}d as int), 0), {n - 1}) as bigint)"
    spans = (min(int((x1 - x0) / pixel), n - 1) + 1, min(int((y1 - y0) / pixel), n - 1) + 1)
    line, place = (at("x", x0), at("y", y0)) if spans[0] <= spans[1] else (at("y", y0), at("x", x0))
    placed = positions(df.select(order, "x", "y", F.col(yield_column).cast("double").alias("v")), [order])
    cell = F.expr(f"if(x is null or y is null or isnan(x) or isnan(y), null, {line} * {n} + {place})")
    return placed.select(F.col("__pos").cast("long").alias("pos"), cell.alias("cell"), "v"), n, min(spans), mean, sd


def phase_consistency(first: np.ndarray, second: np.ndarray) -> float:
    """The normalised cross-power spectrum's inverse at no shift, which is its mean."""
    cross = np.fft.fft2(first) * np.conj(np.fft.fft2(second))
    return float(np.real(np.fft.ifft2(cross / (np.abs(cross) + 1e-12)))[0, 0])


#: Numbers of a block of spectra, of the field's lines, and of the part of a block that is compared, that a search holds at once.
BLOCK, HELD, FEW = 1 << 19, 1 << 22, 1 << 16


@dataclass(frozen=True)
class Noise:
    """White noise of a run on n by n pixels, the same for all delays.

    The `span` lines that the field reaches are drawn as they are. Those beyond hold nothing but noise, and the
    transform of a line of white noise is white noise again, so they are drawn as their transforms.
    """

    n: int
    span: int
    mean: float
    sd: float
    seed: int
    run: int

    def line(self, i: int, image: int) -> np.ndarray:
        return np.random.default_rng([self.seed, self.run, image, i]).normal(self.mean, self.sd, self.n)

    def beyond(self, low: int, high: int, image: int) -> np.ndarray:
        """The transforms at the frequencies low to high - 1 along the lines (rows) of all lines beyond the field."""
        n, rng = self.n, np.random.default_rng([self.seed, self.run, image, self.n, low])
        out = rng.standard_normal((high - low, 2 * (n - self.span))).view(complex)
        out *= self.sd * np.sqrt(n / 2)
        for k in {0, n // 2} & set(range(low, high)):  # these two are real
            out[k - low] = out[k - low].real * np.sqrt(2) + (n * self.mean if k == 0 else 0.0)
        return out


class Pixels:
    """Pixels of an n by n image by their sorted numbers, and the one before each along the diagonal."""

    def __init__(self, keys: np.ndarray, n: int, span: int):
        self.span = span
        self.i, self.j = (keys // n).astype(np.int32), (keys % n).astype(np.int32)
        before = keys - (n + 1)
        before[self.i == 0] += n * n
        before[self.j == 0] += n
        at = np.searchsorted(keys, before)
        np.minimum(at, max(len(keys) - 1, 0), out=at)
        self.has, self.at = keys[at] == before, at.astype(np.int32)

    def coupled(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """(each line's first, places, (values, values of the ones before)) of the pixels that couple; v is NaN where a pixel has none."""
        there = ~np.isnan(v)
        own = np.flatnonzero(self.has & there & there[self.at])
        return np.searchsorted(self.i[own], np.arange(self.span + 1)), self.j[own], (v[own], v[self.at[own]])


class Track:
    """A layer's rows in order (pixel number or -1, yield or NaN): its image for any shift, which is the mean yield of each pixel."""

    def __init__(self, cell: np.ndarray, v: np.ndarray, n: int, span: int):
        self.v, placed = v, cell >= 0
        keys, of = np.unique(cell[placed], return_inverse=True)
        self.rows, self.of, self.pixels = np.flatnonzero(placed).astype(np.int32), of.astype(np.int32), Pixels(keys, n, span)

    def coupled(self, steps: int) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        first, last = np.searchsorted(self.rows, [max(-steps, 0), max(len(self.v) - max(steps, 0), 0)])
        sums, counts = np.zeros(len(self.pixels.i)), np.zeros(len(self.pixels.i))
        for a in range(first, last, BLOCK):
            v = self.v[self.rows[a : min(a + BLOCK, last)] + steps]
            has = np.flatnonzero(~np.isnan(v))
            of = self.of[a:last][has].astype(np.int64)
            np.add.at(sums, of, v[has])
            np.add.at(counts, of, 1.0)
        with np.errstate(invalid="ignore"):
            return self.pixels.coupled(np.divide(sums, counts, out=sums))


def field_phase_consistency(i: np.ndarray, j: np.ndarray, v: np.ndarray, noise: Noise, literal: bool = False) -> float:
    """phase_consistency() of the images of pixels (line i, place j, v) in noise, without the images."""
    keys = i.astype(np.int64) * noise.n + j
    order = np.argsort(keys)
    field = Pixels(keys[order], noise.n, noise.span).coupled(v[order])
    return field_phase_consistencies([lambda: field], noise, literal)[0]


def field_phase_consistencies(fields: list[Callable], noise: Noise, literal: bool = False) -> list[float]:
    """The same for several fields in the same noise; each gives its coupled pixels when asked, once for each range of frequencies.

    Images are real, so half of the frequencies along the lines say all. The field's lines are transformed along
    themselves first (again for each range of frequencies where they are too many to be held), then come blocks
    of frequencies across all lines. There the noise beyond the field is the same for all fields: it is drawn and
    transformed once. To it come the field's own lines; as they are few, theirs is a transform of `m` places for
    each of the n / m remainders of a frequency.
    """
    n, span, images = noise.n, noise.span, 1 if literal else 2
    reach = min(span + 1, n) if literal else span
    m = min(n, 1 << (reach - 1).bit_length())
    q = n // m
    turn = np.exp(-2j * np.pi / n * np.outer(np.arange(q), np.arange(reach)))
    half, totals = n // 2 + 1, [0.0] * len(fields)
    held, block, few = max(1, HELD // (span * images * max(1, len(fields)))), max(1, BLOCK // n), max(1, FEW // n)
    held = max(block, held // block * block)
    by_remainder = lambda s: np.ascontiguousarray(s.reshape(len(s), m, q).transpose(0, 2, 1))
    moved = lambda s, low: np.roll(s, 1, 1) * np.exp(-2j * np.pi * np.arange(low, low + len(s)) / n)[:, None]
    for start in range(0, half, held):
        stop = min(start + held, half)
        lines = np.empty((len(fields), images, span, stop - start), complex)
        for one, field in zip(lines, fields, strict=True):
            starts, j, values = field()
            for image in range(images):
                for k in range(span):
                    row, own = noise.line(k, image), slice(starts[k], starts[k + 1])
                    row[j[own]] = values[image][own]
                    one[image, k] = np.fft.rfft(row)[start:stop]
        for low in range(start, stop, block):
            high = min(low + block, stop)
            around = []
            for image in range(images):
                s = np.zeros((high - low, n), complex)
                s[:, span:] = noise.beyond(low, high, image)
                around += [s, moved(s, low)] if literal else [s]
            around = [by_remainder(np.fft.fft(s)) for s in around]
            for a in range(low, high, few):
                b = min(a + few, high)
                part, size = np.zeros((b - a, q, m), complex), np.empty((b - a, q, m))
                both = [np.empty_like(part) for _ in around]
                for f in range(len(fields)):
                    own = np.zeros((images, b - a, reach), complex)
                    own[:, :, :span] = lines[f, :, :, a - start : b - start].transpose(0, 2, 1)
                    for to, s, noisy in zip(both, (own[0], moved(own[0], a)) if literal else own, around, strict=True):
                        np.multiply(s[:, None, :], turn, out=part[:, :, :reach])
                        np.fft.fft(part, out=to)
                        to += noisy[a - low : b - low]
                    first, second = both
                    np.multiply(first, np.conjugate(second, out=second), out=first)
                    np.abs(first, out=size)
                    size += 1e-12
                    sums = np.divide(first.real, size, out=size).sum((1, 2))
                    # the other half mirrors all but these two
                    totals[f] += sum(s * (1 if k in (0, n // 2) else 2) for k, s in enumerate(sums.tolist(), a))
    return [t / n**2 for t in totals]


def pcdi(df: DataFrame, header_width: float, delay_min: int = -32, delay_max: int = 32, iterations: int = 10, yield_column: str = "v", order: str = "seq", polling_rate: float = 1.0, seed: int = 0, literal: bool = False) -> DataFrame:
    """(iter, delay, rsc): how consistent neighbouring passes are when yields are shifted by each delay, by phase correlation.

    Pixels that don't couple with the next one along the diagonal hold noise. The second image is the
    raster moved by one pixel both ways with noise of its own; with `literal` it is the first image moved,
    noise and all, whose correlation at no shift is nothing but rounding, whatever the delay. A task has one run
    and some of the delays, which share its noise; it reads all rows' pixels and yields, and never holds a whole image.
    """
    delays = list(range(delay_min, delay_max + 1))
    steps = [int(round(d / polling_rate)) for d in delays]
    different = sorted(set(steps))
    layer, n, span, mean, sd = pixels(df, header_width, yield_column, order)
    layer = cut(layer, "pcdi-pixels")
    path, rows = layer.cut_path, layer.count()
    spark = df.sparkSession
    # more delays in a task share more noise, but then fewer frequencies of their lines can be held
    many = min(max(1, int((HELD / 2) ** 0.5 / span)), -(-len(different) * iterations // (2 * spark.sparkContext.defaultParallelism)), len(different))
    chunks = [c.tolist() for c in np.array_split(different, -(-len(different) // max(1, many)))]

    def one(frames):
        for frame in frames:
            for run, chunk in zip(frame["iter"].tolist(), frame["chunk"].tolist(), strict=True):
                cell, v = np.full(rows, -1, np.int64), np.full(rows, np.nan)
                fs, folder = pafs.FileSystem.from_uri(path)
                for batch in dataset.dataset(folder, filesystem=fs, format="parquet").to_batches(columns=["pos", "cell", "v"], use_threads=False, batch_readahead=1, fragment_readahead=1, memory_pool=pa.system_memory_pool()):
                    at = batch.column("pos").to_numpy()
                    cell[at] = batch.column("cell").fill_null(-1).to_numpy()
                    v[at] = batch.column("v").to_numpy(zero_copy_only=False)
                track = Track(cell, v, n, span)
                del cell
                scores = field_phase_consistencies([partial(track.coupled, s) for s in chunks[chunk]], Noise(n, span, mean, sd, seed, run), literal)
                yield pd.DataFrame({"iter": run, "step": chunks[chunk], "rsc": scores})

    tasks = spark.createDataFrame([(it * len(chunks) + c, it, c) for it in range(iterations) for c in range(len(chunks))], "task int, iter int, chunk int")
    scores = tasks.repartitionById(iterations * len(chunks), "task").select("iter", "chunk").mapInPandas(one, "iter int, step int, rsc double")
    asked = spark.createDataFrame(list(zip(delays, steps, strict=True)), "delay int, step int")
    return scores.join(F.broadcast(asked), "step").select("iter", "delay", "rsc")


def best_delay(curve: DataFrame) -> DataFrame:
    """One row (best_delay): the delay of the highest score, of equals the first."""
    return curve.agg(F.max(F.struct("rsc", (-F.col("delay")).alias("d"))).alias("m")).select((-F.col("m.d")).alias("best_delay"))


#: Spread of the runs' best delays from which the result is doubtful.
DOUBTFUL = 3.0


def robust_pcdi(df: DataFrame, header_width: float, **how) -> tuple[DataFrame, DataFrame]:
    """((delay, avg_rsc), one row (best_delay, sd_best, doubtful)): the mean curve over runs and how far the runs' bests spread."""
    scores = cut(pcdi(df, header_width, **how), "pcdi")
    curve = scores.groupBy("delay").agg(F.avg("rsc").alias("avg_rsc"))
    bests = scores.groupBy("iter").agg(F.max(F.struct("rsc", (-F.col("delay")).alias("d"))).alias("m")).agg(F.stddev_pop(-F.col("m.d")).alias("sd_best"))
    summary = best_delay(curve.withColumnRenamed("avg_rsc", "rsc")).crossJoin(bests).withColumn("doubtful", F.col("sd_best") > DOUBTFUL)
    return curve, summary
