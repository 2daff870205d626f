"""Similarity join of shingle sets (Jaccard) by universe partitioning and the pigeonhole principle.

Sets r and s with Jaccard similarity t or more differ in at most (1 - t) / (1 + t) * (|r| + |s|) members.
Sizes fall into bands. A band cuts the universe of shingles by hash into segments, and each set so into
subsets; a segment is indexed either by its subset alone (equal subsets meet: budget 1) or also by all of
the subset's one-deletion neighbours (subsets that differ in one member meet: budget 2). When the budgets
of a set's segments exceed the difference that a partner may have, the partner must agree in a segment.
An empty subset, which would meet everywhere, is never indexed and adds no budget; nor does the second
unit of a subset of one member, whose neighbour is empty. For each band a cost model picks the number of
segments and how many get neighbours: the fewest index rows for which nearly all sets have budget enough.
A set that has not (it is known at once) also indexes its prefix by the prefix-filter principle, so a pair
of two such sets meets there. Nothing is lost by chance.

Candidates come from groups of equal signatures, never as all pairs of a group: first each member meets
a few leaders of the group; links found so merge classes into components; groups within one component are
settled. What remains open meets pairwise across components, and there each set leaves out its most
crowded groups as far as its spare budget goes, and a parity sketch (whose distance never exceeds the
true difference) ends hopeless pairs within the join. Every candidate is verified on whole sets.

Equal sets are one class; classes, not copies, take part.

Edge cases: null and empty texts have no shingles, no links, and are their own component; repeated rows
are copies; rows with a null id link like others and a component's least id ignores nulls (a component of
null ids alone has a null id); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.common import cut, drop, whole
from furrow.llm.graph import components
from furrow.llm.shingles import BASE, mix, pieces, set_keys, shingles

K = 5
#: The threshold as a fraction, so that all bounds are in whole numbers.
SIMILARITY = (3, 4)
#: Words of the parity sketch.
SKETCH = 16
#: Rounds in which members of a group meet its leaders before open pairs are joined, and leaders of a round.
STAR_ROUNDS, LEADERS = 4, 4
#: Candidate texts up to which their digests are broadcast (8 bytes each) to pick texts; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class Band:
    """Sizes in (low, high]; segments, the first `wide` of which are indexed with one-deletion neighbours."""

    number: int
    low: int
    high: int
    segments: int
    wide: int


def most_different(a, b, t: tuple[int, int] = SIMILARITY):
    """The largest symmetric difference of linked sets of sizes a and b."""
    return (a + b) * (t[1] - t[0]) // (t[1] + t[0])


def budget_needed(n, high, t: tuple[int, int] = SIMILARITY):
    """One more than the largest difference to any partner of at most `high` members."""
    return most_different(n, np.minimum(high, n * t[1] // t[0]), t) + 1


def cost(n: int, segments: int, wide: int) -> tuple[float, float, float]:
    """Expected index rows of a set of n members, and its expected budget and its deviation (members fall as in a Poisson process)."""
    x = n / segments
    e = math.exp(-x)
    some, two = 1 - e, 1 - e - x * e
    rows = segments * some + wide * (x - x * e)
    budget = segments * some + wide * two
    spread = segments * some * e + wide * (two * (1 - two) + 2 * two * (1 - some))
    return rows, budget, math.sqrt(max(spread, 0.0) * max(0.1, 1 - min(1.0, 1 / (x + 1))))


@lru_cache(maxsize=512)
def band(number: int, t: tuple[int, int] = SIMILARITY) -> Band:
    """Band 0 holds sizes up to 6; the others double."""
    low, high = (0, 6) if number == 0 else (6 << (number - 1), 6 << number)
    if number == 0 and budget_needed(6, 6, t) <= 2:
        return Band(0, 0, 6, 1, 1)
    best = None
    smallest = max(2, low * t[0] // t[1])
    checked = sorted({smallest, max(2, low + 1), (low + high) // 2, high})
    need = {n: int(budget_needed(n, high, t)) for n in checked}
    top = max(need.values())
    for share in (0.0, 0.25, 0.5, 1.0):
        segments = max(1, math.ceil(top / (1 + share)))
        while segments < 4 * high + 4:
            wide = round(segments * share)
            figures = [cost(n, segments, wide) for n in checked]
            # sizes that other bands would not hold must be safe; so must most of the smaller ones, whose partners are here
            if all(b - 2.5 * d >= need[n] or n < low for n, (_, b, d) in zip(checked, figures, strict=True)):
                rows = sum(r for r, _, _ in figures)
                if best is None or rows < best[0]:
                    best = (rows, segments, wide)
                break
            segments += max(1, segments // 50)
    _, segments, wide = best or (0, 2 * top, 2 * top)
    return Band(number, low, high, segments, wide)


def band_numbers(n: np.ndarray, t: tuple[int, int] = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """For each size its band, and the next one if a larger partner can lie there, else -1."""
    tops = 6 << np.arange(40, dtype=np.int64)
    own = np.searchsorted(tops, n)
    return own, np.where(n * t[1] // t[0] > tops[own], own + 1, -1)


def signatures(grams: np.ndarray, first: np.ndarray, t: tuple[int, int] = SIMILARITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, owners, spare) of the sets that grams[first[i]:first[i + 1]] are.

    spare is how many signatures a set shares with no partner at most: it shares more with each partner
    that it has. It is the least over the set's bands, and 0 where one has neighbours or the prefix had to
    help, as signatures then stand for different budgets.
    """
    n = np.diff(first)
    out, owners = [], []
    spare, lacking = np.full(len(n), 1 << 30, np.int64), np.zeros(len(n), bool)
    able = most_different(n, n * t[1] // t[0], t) >= 1  # others have no partners
    for numbers in band_numbers(n, t):
        docs = np.flatnonzero(able & (numbers >= 0))
        if not len(docs):
            continue
        kinds = {k: band(int(k), t) for k in np.unique(numbers[docs])}
        size = n[docs]
        m, wide, high, salt = (np.array([f(kinds[k]) for k in numbers[docs]], d) for f, d in ((lambda b: b.segments, np.int64), (lambda b: b.wide, np.int64), (lambda b: b.high, np.int64), (lambda b: (b.number + 1) * int(BASE) % (1 << 64), np.uint64)))
        of = np.repeat(np.arange(len(docs)), size)
        member = np.arange(len(of)) + np.repeat(first[docs] - (np.cumsum(size) - size), size)
        spread = mix(grams[member] ^ salt[of])
        start = np.cumsum(m) - m
        segment = (((spread >> np.uint64(32)) * m[of].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        cell = start[of] + segment
        cells = int(m.sum())
        sizes = np.bincount(cell, minlength=cells)
        # sums modulo 2^64 of halves that doubles hold exactly
        low = np.bincount(cell, weights=(spread & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=cells)
        top = np.bincount(cell, weights=(spread >> np.uint64(32)).astype(np.float64), minlength=cells)
        sums = low.astype(np.uint64) + (top.astype(np.uint64) << np.uint64(32))
        used = np.flatnonzero(sizes)
        whose = np.searchsorted(start, used, "right") - 1
        tag = lambda own, seg: mix((seg.astype(np.uint64) + np.uint64(1)) * BASE + salt[own])
        out.append(mix(sums[used] + tag(whose, used - start[whose])))
        owners.append(docs[whose])
        budget = np.bincount(whose, minlength=len(docs))
        if wide.any():
            inner = np.flatnonzero((segment < wide[of]) & (sizes[cell] > 1))
            out.append(mix(sums[cell[inner]] - spread[inner] + tag(of[inner], segment[inner])))
            owners.append(docs[of[inner]])
            two = used[(used - start[whose] < wide[whose]) & (sizes[used] > 1)]
            budget += np.bincount(np.searchsorted(start, two, "right") - 1, minlength=len(docs))
        left = budget - budget_needed(size, high, t)
        lacking[docs] |= left < 0
        spare[docs] = np.minimum(spare[docs], np.where(wide > 0, 0, left))
    for i in np.flatnonzero(lacking):
        own = grams[first[i] : first[i + 1]]
        prefix = np.sort(mix(own))[: len(own) - -(-len(own) * t[0] // t[1]) + 1]
        out.append(mix(prefix ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
        owners.append(np.full(len(prefix), i))
    spare[lacking | ~able] = 0
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), spare
    return np.concatenate(out), np.concatenate(owners), spare


def sketch(grams: np.ndarray) -> np.ndarray:
    """Parities of a set's members over 64 * SKETCH cells: two sketches differ in no more cells than the sets in members."""
    cells = np.bincount((mix(grams ^ np.uint64(0x452821E638D01377)) % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(cells.astype(np.uint8)).view(np.int64)


def class_batches(k: int, t: tuple[int, int]):
    schema = pa.schema([("doc_id", pa.int64()), ("r1", pa.int64()), ("r2", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("spare", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                grams, first = shingles(piece.column("text"), k)
                k1, k2 = set_keys(grams, first)
                _, _, spare = signatures(grams, first, t)
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in ("doc_id", "r1", "r2", "t1", "t2")), *(pa.array(v) for v in (np.diff(first), k1, k2, spare))], schema=schema)

    return run, "doc_id long, r1 long, r2 long, t1 long, t2 long, n long, k1 long, k2 long, spare long"


def signature_batches(k: int, t: tuple[int, int]):
    schema = pa.schema([("sig", pa.int64()), ("k1", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = np.zeros(0, np.int64)  # copies within a batch index once
            for piece in pieces(batch):
                grams, first = shingles(piece.column("text"), k)
                keys, _ = set_keys(grams, first)
                sigs, owners, _ = signatures(grams, first, t)
                new = np.zeros(len(keys), bool)
                new[np.unique(keys, return_index=True)[1]] = True
                new &= ~np.isin(keys, done)
                done = np.concatenate([done, keys[new]])
                mine = new[owners]
                yield pa.RecordBatch.from_arrays([pa.array(sigs[mine].view(np.int64)), pa.array(keys[owners[mine]])], schema=schema)

    return run, "sig long, k1 long"


def set_batches(k: int):
    schema = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("sketch", pa.list_(pa.int64())), ("members", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                grams, first = shingles(piece.column("text"), k)
                k1, k2 = set_keys(grams, first)
                sketches = [sketch(grams[first[i] : first[i + 1]]) for i in range(piece.num_rows)]
                members = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(grams.view(np.int64)))
                yield pa.RecordBatch.from_arrays([piece.column("t1"), piece.column("t2"), pa.array(k1), pa.array(k2), pa.array(sketches, pa.list_(pa.int64())), members], schema=schema)

    return run, "t1 long, t2 long, k1 long, k2 long, sketch array<long>, members array<long>"


def shared_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (sig, k1) in order, without repeats, those whose signature several classes share. Only one row is carried from batch to batch, however many share a signature."""
    schema = pa.schema([("sig", pa.int64()), ("k1", pa.int64())])
    held: tuple[int, int] | None = None  # the last row so far, and whether it was given out
    given = False
    for batch in batches:
        sig, k1 = batch.column("sig").to_numpy(), batch.column("k1").to_numpy()
        if not len(sig):
            continue
        if held:
            sig, k1 = np.insert(sig, 0, held[0]), np.insert(k1, 0, held[1])
        new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (k1[1:] != k1[:-1])])
        sig, k1 = sig[new], k1[new]
        same = sig[1:] == sig[:-1]
        several = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        out = several.copy()
        out[0] &= not given
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(sig[out]), pa.array(k1[out])], schema=schema)
        held, given = (sig[-1], k1[-1]), bool(several[-1]) or (len(sig) == 1 and given)


def collapsed(rows: DataFrame) -> DataFrame:
    """rows (sig, c, …) of one signature for each different set of classes, with w, how many signatures it stands for.

    Near copies share many signatures among the same classes; one such group says what all of them do. Sets are told apart by two hashes.
    """
    groups = rows.groupBy("sig").agg(F.min("c").alias("least"), F.max("c").alias("most"), F.count("*").alias("size"), F.expr("bit_xor(xxhash64(c))").alias("h1"), F.expr("bit_xor(xxhash64(c, 5))").alias("h2"))
    kept = groups.where("least <> most").groupBy("size", "least", "most", "h1", "h2").agg(F.min("sig").alias("sig"), F.count("*").alias("w")).select("sig", "w")
    kept = cut(kept, "jaccard-groups")
    if kept.count() <= BROADCAST_ROWS:
        kept = F.broadcast(kept)
    return rows.join(kept, "sig")


def only(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """The sets of the wanted classes (one column). While these are few their numbers are broadcast, and other sets never leave their files."""
    wanted = wanted.toDF("c").distinct()
    return sets.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, "c", "left_semi")


def verified(pairs: DataFrame, sets: DataFrame, t: tuple[int, int]) -> DataFrame:
    """Of the pairs (a, b), class numbers in a table, those that link."""
    a = only(sets, pairs.select("a")).select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("members").alias("ma"))
    b = only(sets, pairs.select("b")).select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("members").alias("mb"))
    both = pairs.join(a, "a").join(b, "b").withColumn("both", F.size(F.array_intersect("ma", "mb")).cast("long"))
    return both.where(f"{t[1]} * both >= {t[0]} * (na + nb - both)").select("a", "b")


def sketch_distance(a: str, b: str) -> str:
    return " + ".join(f"bit_count({a}[{i}] ^ {b}[{i}])" for i in range(SKETCH))


def labels_of(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return rows.withColumn("comp", F.col("c"))
    return rows.join(comps, rows.c == comps.node, "left").select(*rows.columns, F.coalesce("component", "c").alias("comp"))


def links(docs: DataFrame, k: int = K, t: tuple[int, int] = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(members, edges). members: doc_id, r1, r2 (two hashes of the row), n_shingles, k1, k2 (digests of the set), and c, the class's number, where it may have links; edges: links (u, v) between classes that join up all linked classes."""
    texts = keyed(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "r1", "r2", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(11), "text").alias("t2"))
    run, schema = class_batches(k, t)
    members = cut(texts.mapInArrow(run, schema), "jaccard-members")
    run, schema = signature_batches(k, t)
    sigs = docs.select("text").where("text is not null").mapInArrow(run, schema).repartition("sig").sortWithinPartitions("sig", "k1")
    shared = cut(sigs.mapInArrow(shared_batches, schema), "jaccard-shared")
    # a set shares more than `spare` signatures with each partner, so one with no more shared at all has none
    held = shared.groupBy("k1").agg(F.count("*").alias("held"))
    classes = members.where("n > 0").groupBy("k1", "k2").agg(F.min(F.struct("t1", "t2")).alias("t"), F.first("n").alias("n"), F.min("spare").alias("spare"))
    classes = cut(classes.join(held, "k1").where("held > spare").select("k1", "k2", "t.t1", "t.t2", "n", "spare").withColumn("c", F.monotonically_increasing_id()), "jaccard-classes")
    few = classes.count() <= BROADCAST_ROWS
    alive = classes.select("k1", "c", "spare")
    every = cut(shared.join(F.broadcast(alive) if few else alive, "k1").select("sig", "c", "spare"), "jaccard-rows")
    drop(shared)
    rows = cut(collapsed(every), "jaccard-rows")
    drop(every)
    held, classes = classes, cut(classes.join(rows.select("c").distinct(), "c", "left_semi"), "jaccard-classes")
    drop(held)
    # the sets that are left, from one text for each
    wanted = cut(classes.select("t1", "t2").distinct(), "jaccard-texts")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    picked = texts.where("text is not null").join(wanted, ["t1", "t2"], "left_semi").groupBy("t1", "t2").agg(F.first("text").alias("text"))
    run, schema = set_batches(k)
    # a class has one text, so each class gets one row
    names = classes.select("t1", "t2", "k1", "k2", "c", "n")
    sets = cut(picked.mapInArrow(run, schema).join(F.broadcast(names) if few else names, ["t1", "t2", "k1", "k2"]).drop("t1", "t2", "k1", "k2"), "jaccard-sets")

    found, comps, tried = None, None, None
    weight = rows.groupBy("c").agg(F.sum("w").alias("held"))
    narrow = cut(rows.select("sig", "c", "w").join(weight, "c"), "jaccard-narrow")
    for turn in range(STAR_ROUNDS):
        labelled = labels_of(narrow, comps)
        # a group's leaders: the member that shares most of all (copies of one text gather around it), and some by hash
        orders = [F.col("held") if j == 0 else F.xxhash64("c", F.lit(turn), F.lit(j)) for j in range(LEADERS)]
        leaders = labelled.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("top"), *(F.max(F.struct(o.alias("o"), "c", "comp")).alias(f"l{j}") for j, o in enumerate(orders)))
        leaders = leaders.where("low <> top").select("sig", F.posexplode(F.array(*(F.struct(F.col(f"l{j}.c").alias("c"), F.col(f"l{j}.comp").alias("comp")) for j in range(LEADERS)))).alias("j", "l")).select("sig", "j", "l.*")
        x, y = labelled.alias("x"), leaders.alias("y")
        pairs = x.join(y, F.expr("x.sig = y.sig and x.comp <> y.comp")).select(F.col("x.c").alias("a"), F.col("y.c").alias("b"), "j", F.col("x.w").alias("m"))
        # of its leaders of each kind a class meets the one with which it shares most
        pairs = pairs.groupBy("a", "j", "b").agg(F.sum("m").alias("m")).groupBy("a", "j").agg(F.max(F.struct("m", "b")).alias("best")).select("a", F.col("best.b").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = cut(pairs, "jaccard-star")
        new = cut(verified(sketched(pairs, sets, t), sets, t), "jaccard-links")
        tried = pairs if tried is None else tried.unionByName(pairs)
        if not new.count():
            break
        found = new if found is None else found.unionByName(new)
        comps = cut(components(found.select(F.col("a").alias("u"), F.col("b").alias("v"))), "jaccard-components")
    # what is still open: groups across components, pairwise, without each set's most crowded groups
    labelled = labels_of(rows, comps)
    crowd = labelled.groupBy("sig").agg(F.count("*").alias("g"), F.min("comp").alias("l"), F.max("comp").alias("h")).where("l <> h").select("sig", "g")
    left = labelled.join(crowd, "sig")
    order = Window.partitionBy("c").orderBy(F.desc("g"), "sig").rowsBetween(Window.unboundedPreceding, 0)
    left = cut(left.withColumn("at", F.sum("w").over(order)).join(sets.select("c", "n", "sketch"), "c"), "jaccard-open")
    x, y = left.where("at > spare").alias("x"), left.alias("y")
    pairs = x.join(y, F.expr(f"x.sig = y.sig and x.comp <> y.comp and {possible('x.n', 'y.n', 'x.sketch', 'y.sketch', t)}")).select(F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b")).distinct()
    if tried is not None:
        pairs = pairs.join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    new = cut(verified(cut(pairs, "jaccard-open-pairs"), sets, t), "jaccard-links")
    found = new if found is None else found.unionByName(new)
    members = members.join(classes.select("k1", "k2", "c"), ["k1", "k2"], "left").select("doc_id", "r1", "r2", F.col("n").alias("n_shingles"), "k1", "k2", "c")
    return members, found.select(F.col("a").alias("u"), F.col("b").alias("v"))


def possible(na: str, nb: str, a: str, b: str, t: tuple[int, int]) -> str:
    """SQL for what every linked pair meets: close sizes, and sketches that differ in no more cells than linked sets may in members."""
    return f"({na} + {nb}) * {t[1] - t[0]} >= {t[1] + t[0]} * ({sketch_distance(a, b)}) and least({na}, {nb}) * {t[1]} >= greatest({na}, {nb}) * {t[0]}"


def sketched(pairs: DataFrame, sets: DataFrame, t: tuple[int, int]) -> DataFrame:
    """The pairs whose sizes and sketches allow a link."""
    a = sets.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    b = sets.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    return cut(pairs.join(a, "a").join(b, "b").where(possible("na", "nb", "sa", "sb", t)).select("a", "b"), "jaccard-sketched")


def grouped(docs: DataFrame, k: int, t: tuple[int, int]) -> DataFrame:
    """members of links() with the group that links and equal sets make: g0, g1, g2, null without words."""
    members, edges = links(docs, k, t)
    comps = components(edges)
    rows = members.join(comps, members.c == comps.node, "left")
    own = F.col("n_shingles") > 0
    return rows.select(
        "doc_id", "r1", "r2", "n_shingles",
        F.when(own, F.col("component").isNotNull()).alias("g0"), F.when(own, F.coalesce("component", "k1")).alias("g1"), F.when(own, F.when(F.col("component").isNull(), F.col("k2")).otherwise(0)).alias("g2"),
    )


def linked_components(docs: DataFrame, k: int = K, t: tuple[int, int] = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    rows = cut(grouped(docs, k, t), "jaccard-groups")
    group = ["g0", "g1", "g2"]
    least = rows.where("g1 is not null").groupBy(*group).agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows"))
    # most documents are alone: only groups with more than one row meet their rows again, as a table of their own, so that Spark can split a crowded group
    out = rows.join(cut(least.where("rows > 1").drop("rows"), "jaccard-least"), group, "left")
    alone = F.col("component_id").isNull() & F.col("doc_id").isNotNull()
    return out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keyed(docs: DataFrame) -> DataFrame:
    """docs with r1 and r2, two hashes of id and text."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64(F.lit(3), "text", "doc_id").alias("r2"))


def keep_first(docs: DataFrame, k: int = K, t: tuple[int, int] = SIMILARITY) -> DataFrame:
    """docs with one row of each group of linked documents, all columns kept: the row of the least doc_id (null last). Rows without words stay. Of several rows with that id and text, one stays."""
    rows = cut(grouped(docs, k, t), "jaccard-groups")
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "r1", "r2")
    group = ["g0", "g1", "g2"]
    first = rows.where("g1 is not null").groupBy(*group).agg(F.min(order).alias("o"), F.count("*").alias("rows")).where("rows > 1").select(*group, "o.r1", "o.r2")
    first = cut(first, "jaccard-first")
    kept = first.select("r1", "r2", F.lit(True).alias("kept"))
    several = rows.join(first.select(*group), group, "left_semi").groupBy("r1", "r2").agg(F.count("*").alias("rows"))
    several = cut(several.join(kept, ["r1", "r2"], "left"), "jaccard-decided")
    dropped, repeated = several.where("kept is null").select("r1", "r2"), several.where("kept and rows > 1").select("r1", "r2")
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    row = ["r1", "r2"]
    out = docs.select(whole(docs).alias("doc"), F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64(F.lit(3), "text", "doc_id").alias("r2")).join(dropped, row, "left_anti")
    if repeated.count():
        again = out.join(repeated, row, "left_semi").groupBy(row).agg(F.first("doc").alias("doc")).select("doc", *row)
        out = out.join(repeated, row, "left_anti").unionByName(again)
    return out.select("doc.*")
