"""Quality by hierarchical empirical Bayes.

A logistic model over features of a whole text gives each document its own evidence. Grouped aggregates
of that evidence give each host, and each path within a host, a mean; beta priors, whose strength comes
from how much the means differ beyond chance, shrink sparse paths toward their host and sparse hosts
toward the corpus. A document's score joins its own evidence with what the others on its path say (it is
left out of its own path's mean).

The model is fitted on one row for each of at most FIT_ROWS labelled ids, those with the smallest hashes;
everything else covers all rows.

Edge cases: null and empty texts have features of zero and a score like others; rows with a null source
or language share the host or path ""; repeated rows each count and get equal scores; labels that are null
or for unknown ids are ignored, of several for one id the largest holds; without any label, or with labels
of one kind alone, the prior decides (the documents' evidence is even); an empty table gives an empty
result; other columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm.common import cut, smallest, whole
from furrow.llm.shingles import pieces, words

FIT_ROWS = 20_000
#: Bytes of text that are worked on at once.
PIECE = 1 << 20
RIDGE = 1.0
KEEP = 0.5

#: Kinds of bytes that are counted.
KINDS = ("upper", "lower", "digit", "space", "line", "stop", "mark", "symbol", "bar", "high")
NAMES = (*KINDS, "length", "word_length", "repeats", "variety", "few")


def byte_kinds() -> np.ndarray:
    kind = np.full(256, KINDS.index("symbol"), np.int32)
    for name, members in (("space", b" \t\r\x0b\x0c"), ("line", b"\n"), ("stop", b".,;:'\"()-"), ("mark", b"!?"), ("bar", b"|"), ("digit", b"0123456789")):
        kind[list(members)] = KINDS.index(name)
    kind[65:91], kind[97:123], kind[128:] = KINDS.index("upper"), KINDS.index("lower"), KINDS.index("high")
    return kind


BYTE_KINDS = byte_kinds()


def features(texts: pa.Array) -> np.ndarray:
    """A row of NAMES for each text."""
    texts = pc.fill_null(texts, "")
    raw = texts.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    held = raw.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held else np.zeros(0, np.uint8)
    n, size = len(raw), np.diff(offsets)
    counts = np.zeros((n, len(KINDS)))
    if n:
        cell = np.repeat(np.arange(n, dtype=np.int32) * np.int32(len(KINDS)), size) + BYTE_KINDS[data]
        counts += np.bincount(cell, minlength=n * len(KINDS)).reshape(n, len(KINDS))
    hashes, first = words(texts)
    many = np.diff(first)
    of = np.repeat(np.arange(n), many)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((hashes, of))
    h, o = hashes[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    different = np.bincount(o[new], minlength=n)
    out = np.zeros((n, len(NAMES)))
    out[:, : len(KINDS)] = counts / np.maximum(size, 1)[:, None]
    letters = counts[:, 0] + counts[:, 1] + counts[:, -1]
    out[:, 10] = np.log1p(size)
    out[:, 11] = np.log1p(letters / np.maximum(many, 1))
    out[:, 12] = np.bincount(of, weights=again, minlength=n)[:n] / np.maximum(many, 1)
    out[:, 13] = different / np.maximum(many, 1) ** 0.8
    out[:, 14] = many < 5
    return out


def feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All columns of the rows but the text, which comes first, and x, the text's features."""
    for batch in batches:
        for piece in pieces(batch, most=PIECE):
            x = features(piece.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(NAMES), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*piece.columns[1:], lists], names=[*piece.schema.names[1:], "x"])


def featured(docs: DataFrame, host: str = "source", path: str = "lang", keep: bool = False) -> DataFrame:
    """rid, doc_id, host, path, x, and with `keep` doc, a struct of the row's own columns, for every row of docs."""
    rows = docs.select(
        "text", F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), *([whole(docs).alias("doc")] if keep else []),
    )
    schema = T.StructType([*rows.schema.fields[1:], T.StructField("x", T.ArrayType(T.DoubleType()))])
    return cut(rows.mapInArrow(feature_batches, schema), "quality-features")


def fit(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic model, by Newton steps on standardised features."""
    if len(set(y.tolist())) < 2:
        return np.zeros(x.shape[1]), 0.0
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum())


def train(rows: DataFrame, labels: DataFrame, label: str = "quality", most: int = FIT_ROWS) -> tuple[np.ndarray, float]:
    """The model from one row for each of at most `most` labelled ids, those with the smallest hashes."""
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label)).cast("double").alias("y"))
    told = rows.select("doc_id", "x").join(known, "doc_id").groupBy("doc_id", "y").agg(F.min_by("x", F.xxhash64("x")).alias("x"))
    some = smallest(cut(told, "quality-labelled"), most, "doc_id").select("doc_id", "x", "y").collect()
    if not some:
        return np.zeros(len(NAMES)), 0.0
    some.sort(key=lambda r: r["doc_id"])  # sums in one order, whatever the partitions
    return fit(np.array([r["x"] for r in some], float), np.array([r["y"] for r in some], float))


def prior_strength(groups: DataFrame, toward: str) -> float:
    """How many documents a prior counts for, by moments: what groups' means (total / n) differ from `toward` beyond the spread of their documents."""
    got = groups.where("n > 1").agg(
        F.sum(F.expr(f"n * pow(total / n - {toward}, 2)")).alias("between"), F.sum(F.expr("greatest(squares - total * total / n, 0d)")).alias("within"), F.sum("n").alias("n"), F.count("*").alias("k"),
        F.sum(F.expr("n * n")).alias("nn"),
    ).first()
    if not got["k"] or got["k"] < 2 or got["n"] <= got["k"]:
        return 10.0
    within = max(got["within"] / (got["n"] - got["k"]), 1e-9)
    spread = (got["between"] - got["k"] * within) / max(got["n"] - got["nn"] / got["n"], 1e-9)
    return float(min(max(within / spread if spread > 0 else 1e6, 1.0), 1e6))


def sites(own: DataFrame) -> tuple[DataFrame, float, float]:
    """(paths, prior, strength) from each document's host, path and p: paths (host, path, n, total, host_posterior), the corpus's mean, and the strength of a host's mean as a path's prior."""
    sums = [F.count("*").alias("n"), F.sum("p").alias("total"), F.sum(F.col("p") * F.col("p")).alias("squares")]
    paths = cut(own.groupBy("host", "path").agg(*sums), "quality-paths")
    hosts = paths.groupBy("host").agg(*(F.sum(c).alias(c) for c in ("n", "total", "squares")))
    whole = paths.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    prior = whole["total"] / whole["n"] if whole["n"] else 0.5
    prior = min(max(prior, 1e-6), 1 - 1e-6)
    strong = prior_strength(hosts, f"{prior!r}d")
    hosts = hosts.select("host", F.expr(f"(total + {strong!r}d * {prior!r}d) / (n + {strong!r}d)").alias("host_posterior"))
    paths = paths.join(hosts, "host")
    stronger = prior_strength(paths, "host_posterior")
    return cut(paths.select("host", "path", "n", "total", "host_posterior"), "quality-sites"), prior, stronger


def evidence(x: str, model: tuple[np.ndarray, float]) -> Column:
    """The model's logit of a document with features x."""
    weights, offset = model
    terms = " + ".join(f"{x}[{i}] * {w!r}d" for i, w in enumerate(weights.tolist()))
    return F.expr(f"greatest(-30d, least(30d, {offset!r}d + {terms}))")


def chance(logit: str) -> Column:
    return F.expr(f"1 / (1 + exp(-{logit}))")


def path_posterior(p: str, strength: float) -> Column:
    """What the others on its path say of a document with chance p."""
    return F.expr(f"greatest(1e-6d, least(1 - 1e-6d, (total - {p} + {strength!r}d * host_posterior) / (n - 1 + {strength!r}d)))")


def joint(logit: str, path: str, prior: float) -> Column:
    return F.expr(f"1 / (1 + exp(-({logit} + ln({path} / (1 - {path})) - {float(np.log(prior / (1 - prior)))!r}d)))")


def scores(rows: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """rid, doc_id, evidence, host_posterior, path_posterior, score for what featured() gives."""
    own = rows.select("rid", "doc_id", "host", "path", evidence("x", model).alias("evidence")).withColumn("p", chance("evidence"))
    paths, prior, strength = sites(own)
    joined = own.join(paths, ["host", "path"]).withColumn("path_posterior", path_posterior("p", strength)).withColumn("score", joint("evidence", "path_posterior", prior))
    return joined.select("rid", "doc_id", "evidence", "host_posterior", "path_posterior", "score")


def classify(docs: DataFrame, labels: DataFrame, keep: float = KEEP, host: str = "source", path: str = "lang", most: int = FIT_ROWS) -> DataFrame:
    rows = featured(docs, host, path)
    return scores(rows, train(rows, labels, most=most)).drop("rid").withColumn("predicted", (F.col("score") >= keep).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, keep: float = KEEP, host: str = "source", path: str = "lang", most: int = FIT_ROWS) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with all their columns.

    Rows are written once beside their features, so no text is read twice or shuffled to meet its score.
    """
    rows = featured(docs, host, path, keep=True)
    model = train(rows, labels, most=most)
    own = rows.withColumn("e", evidence("x", model)).withColumn("p", chance("e"))
    paths, prior, strength = sites(own.select("host", "path", "p"))
    out = own.select("doc", "host", "path", "e", "p").join(paths, ["host", "path"]).withColumn("posterior", path_posterior("p", strength))
    return out.where(joint("e", "posterior", prior) >= keep).select("doc.*")
