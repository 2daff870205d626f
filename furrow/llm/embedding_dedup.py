"""Near-duplicate vectors by NN-descent.

Equal vectors are one class with a multiplicity. A neighbour graph over the classes starts from a few
tables of random hyperplanes (buckets cut into chunks of bounded size, neighbours within a chunk), and is
refined: what two vectors have in common as a neighbour is compared, and each list keeps the best. A list
whose members all reach the threshold is saturated and gets twice the room. When lists hardly change any
more, edges at the threshold join classes into components. A list that ends up saturated says nothing
of what lies beyond it, and a link between two vectors may be in neither list when both are saturated. So
components with saturated lists are compared exactly with each other, by those of their tiles that
centroids and radii don't rule out. Links run within components, so the last
step compares each component's members by tiles and counts, in double precision: lists bound what the
search finds, not what is counted, and no pairs leave a tile.

audit() measures recall: chosen queries against all vectors by brute force in blocks.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components have no links and
are their own component; vectors of different lengths never link; repeated rows are copies that link with
each other; rows with a null id take part, a component's id is its least id that isn't null; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.common import cut
from furrow.llm.graph import components

THRESHOLD = 0.95
#: Neighbours in a list at first and at most, tables of hyperplanes, rounds after which a search that goes on is an error, and candidates a vector gets from one meeting.
LIST, LONGEST, TABLES, ROUNDS, OFFERS = 8, 64, 6, 40, 3
#: Vectors of a bucket's chunk, and of a tile of a component.
CHUNK, TILE = 384, 1024
#: Share of list entries that change from which another round is worth it.
STIR = 0.002

VALID = "embedding is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(embedding, x -> x <> 0)"
EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("s", pa.float64())])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=-1, keepdims=True)
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def lists(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An array column of structs (c, x) as class numbers, unit vectors and each row's first place."""
    first = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.slice(first[0], first[-1] - first[0])
    x = flat.field("x")
    offset, count = x.offsets[0].as_py() if len(x) else 0, len(x)
    values = x.values.to_numpy(zero_copy_only=False)[offset : offset + count * dim].reshape(count, dim)
    return flat.field("c").to_numpy(), unit(values) if count else np.zeros((0, dim)), first - first[0]


def hyperplanes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng(20).standard_normal((tables, bits, dim))


def bucket_batches(dim: int, bits: int):
    planes = hyperplanes(dim, bits, TABLES)
    weight = 1 << np.arange(bits, dtype=np.int64)
    schema = pa.schema([("c", pa.int64()), ("buckets", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), np.float64).reshape(batch.num_rows, dim)
            signs = np.einsum("tbd,nd->ntb", planes, unit(x)) > 0 if len(x) else np.zeros((0, TABLES, bits), bool)
            yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array((signs @ weight).tolist(), pa.list_(pa.int64()))], schema=schema)

    return run, "c long, buckets array<long>"


def best_of(c: np.ndarray, sims: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of a similarity matrix its `most` largest entries off the diagonal."""
    np.fill_diagonal(sims, -2)
    most = min(most, len(c) - 1)
    top = np.argpartition(-sims, most - 1, axis=1)[:, :most]
    return np.repeat(c, most), c[top].ravel(), np.take_along_axis(sims, top, 1).ravel()


def meeting_batches(dim: int, most: int):
    """Rows hold vectors that meet; each is offered its `most` nearest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, x, first = lists(batch.column("met"), dim)
            parts = [[], [], []]
            held = 0
            for a, b in zip(first[:-1], first[1:], strict=True):
                if b - a > 1:
                    for part, got in zip(parts, best_of(c[a:b], x[a:b] @ x[a:b].T, most), strict=True):
                        part.append(got)
                    held += (b - a) * most
                if held > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in parts], schema=EDGES)
                    parts, held = [[], [], []], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in parts], schema=EDGES)

    return run, "u long, v long, s double"


def classes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, classes): vec_id with two digests (null where the vector can't link), and each different vector x with its number c, length and multiplicity m."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.expr(f"if({VALID}, embedding, null)").alias("x"))
    keyed = rows.withColumn("k1", F.when(F.col("x").isNotNull(), F.xxhash64("x"))).withColumn("k2", F.when(F.col("x").isNotNull(), F.xxhash64(F.lit(7), "x")))
    found = keyed.where("x is not null").groupBy("k1", "k2").agg(F.first("x").alias("x"), F.count("*").alias("m"))
    found = cut(found.withColumn("c", F.monotonically_increasing_id()).withColumn("dim", F.size("x")), "vector-classes")
    members = keyed.drop("x").join(found.select("k1", "k2", "c"), ["k1", "k2"], "left").select("vec_id", "c")
    return cut(members, "vector-members"), found


def topped(edges: DataFrame, room: DataFrame | None) -> DataFrame:
    """Each list's best entries as far as its room goes (LIST where room has no row), with the room."""
    edges = edges.groupBy("u", "v").agg(F.max("s").alias("s"))
    edges = edges.withColumn("room", F.lit(LIST)) if room is None else edges.join(room, "u", "left").withColumn("room", F.coalesce("room", F.lit(LIST)))
    order = Window.partitionBy("u").orderBy(F.desc("s"), "v")
    return edges.withColumn("at", F.row_number().over(order)).where(f"at <= {LONGEST}").where("at <= room").drop("at")


def neighbour_graph(classes: DataFrame, dim: int, n: int, threshold: float) -> DataFrame:
    """Lists (u, v, s, room) over the classes of one length."""
    x = classes.select("c", "x")
    bits = max(1, min(62, math.ceil(math.log2(max(2, n / 256)))))
    run, schema = bucket_batches(dim, bits)
    buckets = x.mapInArrow(run, schema).select("c", F.posexplode("buckets").alias("t", "bucket"))
    counts = buckets.groupBy("t", "bucket").agg(F.count("*").alias("size"))
    chunked = buckets.join(counts, ["t", "bucket"]).select("c", "t", "bucket", F.expr(f"pmod(xxhash64(c, t), cast(ceil(size / {CHUNK}) as long))").alias("chunk"))
    met = chunked.join(x, "c").groupBy("t", "bucket", "chunk").agg(F.collect_list(F.struct("c", "x")).alias("met"))
    run, schema = meeting_batches(dim, LIST)
    graph = cut(topped(met.select("met").mapInArrow(run, schema), None), "vector-graph")
    run, schema = meeting_batches(dim, OFFERS)
    for _ in range(ROUNDS):
        # a full list whose last entry reaches the threshold is saturated
        full = graph.groupBy("u").agg(F.count("*").alias("k"), F.min("s").alias("s"), F.max("room").alias("room"))
        room = full.where(f"room > {LIST} or (k >= room and s >= {threshold})").select("u", F.expr(f"if(k >= room and s >= {threshold}, least(room * 2, {LONGEST}), room)").cast("int").alias("room"))
        # both directions; of those that list a vector, the nearest as many as a list holds at first
        back = Window.partitionBy("v").orderBy(F.desc("s"), "u")
        listed = graph.withColumn("at", F.row_number().over(back)).where(f"at <= {LIST}").select(F.col("v").alias("u"), F.col("u").alias("v"))
        both = graph.select("u", "v").unionByName(listed).distinct()
        met = both.join(x.withColumnRenamed("c", "v"), "v").groupBy("u").agg(F.collect_list(F.struct(F.col("v").alias("c"), "x")).alias("met"))
        offers = met.select("met").mapInArrow(run, schema)
        new = cut(topped(graph.select("u", "v", "s").unionByName(offers), room), "vector-graph")
        changed, total = new.join(graph.select("u", "v"), ["u", "v"], "left_anti").count(), new.count()
        graph = new
        if changed <= STIR * total:
            return graph
    raise RuntimeError("the neighbour graph has not settled")


def tile_batches(dim: int, threshold: float):
    """Rows (t1, t2) hold the vectors of two tiles; each vector of the first gets the multiplicity of those of the second at the threshold."""
    schema = pa.schema([("c", pa.int64()), ("links", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                ca, xa, _ = lists(pa.ListArray.from_arrays([0, len(a.values)], a.values), dim)
                _, xb, _ = lists(pa.ListArray.from_arrays([0, len(b.values)], b.values), dim)
                m = b.values.field("m").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(ca), pa.array(((xa @ xb.T) >= threshold) @ m)], schema=schema)

    return run, "c long, links long"


def link_counts(labelled: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(c, links): for each class of labelled (comp, c, x, m) the rows of its component at the threshold, its own included."""
    sizes = labelled.groupBy("comp").agg(F.count("*").alias("size"))
    tiled = labelled.join(sizes, "comp").withColumn("tiles", F.expr(f"cast(ceil(size / {TILE}) as long)")).withColumn("tile", F.expr("pmod(xxhash64(c), tiles)"))
    # dealt by tiles, not by components, of which one may hold a third of all vectors
    tiles = cut(tiled.repartition("comp", "tile").groupBy("comp", "tile").agg(F.collect_list(F.struct("c", "x", "m")).alias("v"), F.first("tiles").alias("tiles")), "vector-tiles")
    left = tiles.select("comp", F.col("v").alias("a"), F.explode(F.expr("sequence(cast(0 as bigint), tiles - 1)")).alias("tile"))
    met = left.join(tiles.select("comp", "tile", F.col("v").alias("b")), ["comp", "tile"])
    run, schema = tile_batches(dim, threshold)
    return met.select("a", "b").mapInArrow(run, schema).groupBy("c").agg(F.sum("links").alias("links"))


def centroid_batches(dim: int):
    """(comp, tile, centre, radius): each tile's middle and the widest angle of its vectors from it."""
    schema = pa.schema([("comp", pa.int64()), ("tile", pa.int64()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x, first = lists(batch.column("v"), dim)
            centres, radii = [], []
            for a, b in zip(first[:-1], first[1:], strict=True):
                middle = x[a:b].sum(0)
                size = np.linalg.norm(middle)
                middle = middle / size if size > 1e-6 else x[a]
                centres.append(middle.tolist())
                radii.append(float(np.arccos(np.clip(x[a:b] @ middle, -1, 1)).max()))
            yield pa.RecordBatch.from_arrays([batch.column("comp"), batch.column("tile"), pa.array(centres, pa.list_(pa.float64())), pa.array(radii, pa.float64())], schema=schema)

    return run, "comp long, tile long, centre array<double>, radius double"


def reach_batches(threshold: float):
    """Rows hold two blocks of tiles (comp, tile, centre, radius): the pairs of tiles of different components that may hold linked vectors, each pair once."""
    schema = pa.schema([(n, pa.int64()) for n in ("comp", "tile", "other", "other_tile")])
    most = float(np.arccos(threshold)) + 1e-6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                (ca, ta, xa, ra), (cb, tb, xb, rb) = ([np.array([r[n] for r in v]) for n in ("comp", "tile", "centre", "radius")] for v in (a, b))
                i, j = np.nonzero((np.arccos(np.clip(xa @ xb.T, -1, 1)) <= ra[:, None] + rb + most) & (ca[:, None] < cb))
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (ca[i], ta[i], cb[j], tb[j])], schema=schema)

    return run, "comp long, tile long, other long, other_tile long"


def cross_batches(dim: int, threshold: float):
    """Rows hold two tiles a and b of components comp and other: the components of tiles where any vectors link."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, comp, other in zip(batch.column("a"), batch.column("b"), batch.column("comp").to_pylist(), batch.column("other").to_pylist(), strict=True):
                (_, xa, _), (_, xb, _) = (lists(pa.ListArray.from_arrays([0, len(v.values)], v.values), dim) for v in (a, b))
                if (xa @ xb.T >= threshold).any():
                    yield pa.RecordBatch.from_arrays([pa.array([comp]), pa.array([other])], schema=schema)

    return run, "u long, v long"


def settled(own: DataFrame, graph: DataFrame, found: DataFrame, dim: int, threshold: float) -> DataFrame:
    """found (node, component) with components joined that full lists may have kept apart."""
    full = graph.groupBy("u").agg(F.count("*").alias("k"), F.min("s").alias("s")).where(f"k >= {LIST} and s >= {threshold}")
    hot = full.join(found, full.u == found.node).select(F.col("component").alias("comp")).distinct()
    crowded = found.withColumnRenamed("component", "comp").join(hot, "comp").join(own, F.col("node") == F.col("c")).select("comp", "c", "x")
    crowded = cut(crowded, "vector-all")
    sizes = crowded.groupBy("comp").agg(F.count("*").alias("size"))
    tiles = crowded.join(sizes, "comp").withColumn("tile", F.expr(f"pmod(xxhash64(c), cast(ceil(size / {TILE}) as long))"))
    tiles = cut(tiles.repartition("comp", "tile").groupBy("comp", "tile").agg(F.collect_list(F.struct("c", "x")).alias("v")), "vector-crowded")
    if not tiles.take(1):
        return found
    run, schema = centroid_batches(dim)
    centres = cut(tiles.mapInArrow(run, schema), "vector-centres")
    # the tiles' middles meet in blocks, each pair of blocks in a task of its own
    many = -(-centres.count() // TILE)
    blocks = cut(centres.groupBy(F.expr(f"pmod(xxhash64(comp, tile), {many})").alias("block")).agg(F.collect_list(F.struct("comp", "tile", "centre", "radius")).alias("v")), "vector-blocks")
    asked = blocks.select(F.col("v").alias("a"), F.explode(F.expr(f"sequence(cast(0 as bigint), cast({many - 1} as bigint))")).alias("block")).join(blocks.withColumnRenamed("v", "b"), "block")
    run, schema = reach_batches(threshold)
    asked = cut(asked.select("a", "b").mapInArrow(run, schema), "vector-asked")
    run, schema = cross_batches(dim, threshold)
    left, right = tiles.withColumnRenamed("v", "a"), tiles.toDF("other", "other_tile", "b")
    links = cut(asked.join(left, ["comp", "tile"]).join(right, ["other", "other_tile"]).select("a", "b", "comp", "other").mapInArrow(run, schema).distinct(), "vector-cross")
    if not links.take(1):
        return found
    joined = components(links).select(F.col("node").alias("comp"), F.col("component").alias("whole"))
    return cut(found.join(joined, found.component == joined.comp, "left").select("node", F.coalesce("whole", "component").alias("component")), "vector-settled")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors."""
    members, classes = classes_of(vectors)
    comps = counts = None
    for dim, n in [(r["dim"], r["n"]) for r in classes.groupBy("dim").agg(F.count("*").alias("n")).orderBy("dim").collect()]:
        own = classes.where(F.col("dim") == dim)
        graph = neighbour_graph(own, dim, n, threshold)
        found = settled(own, graph, components(graph.where(f"s >= {threshold}").select("u", "v")), dim, threshold)
        labelled = own.join(found, own.c == found.node).select(F.col("component").alias("comp"), "c", "x", "m")
        linked = link_counts(labelled, dim, threshold)
        comps = found if comps is None else comps.unionByName(found)
        counts = linked if counts is None else counts.unionByName(linked)
    if comps is None:
        return members.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    rows = members.join(classes.select("c", "m"), "c", "left").join(comps, F.col("c") == comps.node, "left").drop("node").join(counts, "c", "left")
    rows = rows.select("vec_id", F.coalesce("component", "c").alias("comp"), (F.coalesce("links", "m", F.lit(1)) - 1).cast("long").alias("n_links"))
    least = rows.where("comp is not null").groupBy("comp").agg(F.min("vec_id").alias("least"))
    rows = rows.join(least, "comp", "left").withColumn("component_id", F.when(F.col("comp").isNull(), F.col("vec_id")).otherwise(F.col("least")))
    return rows.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def audit(vectors: DataFrame, found: DataFrame, threshold: float = THRESHOLD, every: int = 20) -> DataFrame:
    """One row (queries, links, found_links, recall): ids divisible by `every` against all rows in blocks, compared with n_links of found.

    The queries travel to the tasks in blocks of at most TILE vectors, so each task holds one block and one batch.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.expr(f"if({VALID}, embedding, null)").alias("x")).where("x is not null").withColumn("dim", F.size("x"))
    asked = rows.where(f"vec_id % {every} = 0")
    blocks = asked.groupBy("dim", F.expr(f"vec_id div {every * TILE}").alias("block")).agg(F.collect_list(F.struct(F.col("vec_id").alias("c"), "x")).alias("a"))
    chunks = rows.groupBy("dim", F.expr(f"pmod(xxhash64(vec_id), {64})").alias("part")).agg(F.collect_list(F.struct(F.col("vec_id").alias("c"), "x", F.lit(1).cast("long").alias("m"))).alias("b"))
    met = blocks.join(chunks, "dim")
    true = None
    for dim in [r[0] for r in rows.select("dim").distinct().collect()]:
        run, schema = tile_batches(dim, threshold)
        own = met.where(F.col("dim") == dim).select("a", "b").mapInArrow(run, schema).groupBy("c").agg(F.sum("links").alias("links"))
        true = own if true is None else true.unionByName(own)
    both = true.select(F.col("c").alias("vec_id"), (F.col("links") - 1).alias("links")).join(found, "vec_id")
    return both.agg(F.count("*").alias("queries"), F.sum("links").alias("links"), F.sum("n_links").alias("found_links")).withColumn("recall", F.expr("if(links = 0, 1d, found_links / links)"))
