"""Toxicity by the nearest labelled examples.

A text's terms are the stems of its words. All terms of the examples make up the
vocabulary, without selection, and examples and texts are TF-IDF vectors over it; a term that occurs more
in toxic examples weighs 1 + z times as much, z being the z-score of its log odds. For each text the examples with the highest cosine are found exactly by a
block-max inverted index: entries are put in order of what they have in common, so that a block of them
shares its terms; the largest weight of each term in each block bounds what a block can reach, blocks are
opened from the highest bound down, and those whose bound is below the k-th best cosine so far stay shut.
Many texts open a block together: its commonest terms are a dense matrix, all others come from postings.
The neighbours vote with weights that grow as distance falls, and a logistic curve fitted on the examples
(each without itself) turns votes into probabilities. Neighbours' ids are the evidence.

Examples are one row for each of at most EXAMPLES labelled ids, those with the smallest hashes; only so
much is collected or broadcast, whatever the corpus. Texts are scored whole, each on its own.

Edge cases: null and empty texts, and texts without a word of any example, get the share of toxic rows
among the examples without words; equal vectors are one entry of the index with all their votes; ties at
the k-th place go to the entry that comes first; labels that are null are ignored, of several for one id
the largest holds, of several rows with one id the text with the least hash; without labels every score is
0.5 - just below it, so nothing is flagged; repeated rows get equal scores; an empty table gives an empty
result; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import crc_mod, cut, smallest
from furrow.llm.quality import fit
from furrow.llm.shingles import hash_words, pieces, spans

EXAMPLES = 24_000
NEIGHBOURS = 15
#: Entries of a block, and so many of a block's commonest words are columns of its dense matrix.
BLOCK, COMMON = 1024, 768
#: A word counts as its stem, its first bytes.
STEM = 4
#: Groups of entries that are alike, rounds of grouping, and so many of the commonest words that it looks at.
GROUPS, ROUNDS, SHARED = 8, 6, 512
#: Texts whose blocks are bounded together, postings that are added up at once.
TOGETHER, POSTINGS = 1024, 1 << 20
#: Labels of ids with this remainder are held out.
FOLDS, HELD_OUT = 5, 0

LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words' stems in the texts, and which text each is of."""
    data, starts, ends, first = spans(pc.fill_null(texts, ""), LETTERS)
    return hash_words(data, starts, np.minimum(ends, starts + STEM)), np.repeat(np.arange(len(texts)), np.diff(first))


def term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, y, terms, counts) of each text."""
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int64()), ("terms", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32()))])
    for batch in batches:
        for piece in pieces(batch):
            hashes, of = terms(piece.column("text"))
            order = np.lexsort((hashes, of))
            h, o = hashes[order], of[order]
            new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])])) if len(h) else np.zeros(0, np.int64)
            counts = np.diff(np.concatenate([new, [len(h)]]))
            first = np.searchsorted(o[new], np.arange(piece.num_rows + 1))
            lists = [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(v)) for v in (h[new].view(np.int64), counts.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("y"), *lists], schema=schema)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, y, text), one row for each of at most `most` labelled ids that aren't held out, those with the smallest hashes."""
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label)).cast("long").alias("y"))
    known = cut(known.where(crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT), "toxic-labels")
    chosen = F.broadcast(smallest(known, most, "doc_id"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for lengths[i] places each, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths - starts, lengths)


@dataclass
class Index:
    """Block-max inverted index over entries (different example vectors, in order of likeness)."""

    vocabulary: np.ndarray  # sorted word hashes
    idf: np.ndarray
    runs: np.ndarray  # where each block's runs of postings start, one more at the end
    words: np.ndarray  # each run's term and length
    lengths: np.ndarray
    entries: np.ndarray  # postings by block, term and entry: the entry's place in the block, how often it has the term
    counts: np.ndarray
    toxic: np.ndarray  # votes of each entry
    votes: np.ndarray
    evidence: np.ndarray  # an example's id for each entry
    keys: np.ndarray  # digests of the entries
    prior: float
    blank: float  # probability of a text without words
    curve: tuple[float, float] = (1.0, 0.0)

    def weigh(self) -> "Index":
        """What tasks work out for themselves, once: weights, dense matrices and bounds of each block."""
        if hasattr(self, "weights"):
            return self
        v = len(self.vocabulary)
        self.blocks = len(self.runs) - 1
        self.weights = np.empty(len(self.entries), np.float32)
        self.starts = np.empty((self.blocks, v + 1), np.int32)
        self.bound, self.columns, self.dense = np.zeros((v, self.blocks), np.float32), np.full((self.blocks, v), -1, np.int16), []
        end = 0
        for b in range(self.blocks):
            words, length = (x[self.runs[b] : self.runs[b + 1]] for x in (self.words, self.lengths))
            begin, end = end, end + int(length.sum(dtype=np.int64))
            entry = self.entries[begin:end]
            w = weights_of(self.idf, np.repeat(words, length), self.counts[begin:end], entry, BLOCK).astype(np.float32)
            self.weights[begin:end] = w
            each = np.zeros(v, np.int32)
            each[words] = length
            self.starts[b, 0], self.starts[b, 1:] = begin, begin + np.cumsum(each)
            self.bound[words, b] = np.maximum.reduceat(w, np.cumsum(length, dtype=np.int64) - length)
            often = np.argsort(-length, kind="stable")[:COMMON]
            self.columns[b, words[often]] = np.arange(len(often))
            column = np.repeat(self.columns[b, words], length)
            dense = np.zeros((len(often), BLOCK), np.float32)
            dense[column[column >= 0], entry[column >= 0]] = w[column >= 0]
            self.dense.append(dense)
        return self

    def __getstate__(self) -> dict:
        return {c: self.__dict__[c] for c in self.__dataclass_fields__}

    def opened(self, b: int, first: np.ndarray, t: np.ndarray, w: np.ndarray, rows: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, entry, cosine) of what may be among the k best in block b of the texts `rows`, whose k-th best so far are `least`."""
        size = first[rows + 1] - first[rows]
        at, row = ragged(first[rows], size), np.repeat(np.arange(len(rows)), size)
        column = self.columns[b, t[at]]
        common = column >= 0
        asked = np.zeros((len(rows), len(self.dense[b])), np.float32)
        asked[row[common], column[common]] = w[at[common]]
        cell = t[at[~common]]
        begin = self.starts[b, cell].astype(np.int64)
        length = self.starts[b, cell + 1] - begin
        has = length > 0
        begin, length, scale, row = begin[has], length[has], w[at[~common]][has], row[~common][has]
        post = ragged(begin, length)
        part = np.bincount(np.repeat(row * BLOCK, length) + self.entries[post], weights=self.weights[post] * np.repeat(scale, length), minlength=len(rows) * BLOCK).reshape(len(rows), BLOCK)
        total = asked @ self.dense[b]
        total += part
        # sums are in single precision: what may be equal is kept
        least = np.maximum(least, np.partition(total, BLOCK - k, axis=1)[:, BLOCK - k]) if k <= BLOCK else least
        r, e = np.nonzero((total >= least[:, None] - 1e-5) & (total > 0))
        return rows[r], b * BLOCK + e, total[r, e].astype(float)

    def nearest(self, first: np.ndarray, t: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, entry, cosine) of the k entries nearest to each text, in order of texts and nearness; text i has the words t and weights w from first[i] to first[i + 1]."""
        n = len(first) - 1
        found = [], [], []
        for a in range(0, n, TOGETHER):
            own = first[a : min(n, a + TOGETHER) + 1]
            got = self.nearest_some(own - own[0], t[own[0] : own[-1]], w[own[0] : own[-1]], k)
            for part, x in zip(found, (got[0] + a, got[1], got[2]), strict=True):
                part.append(x)
        return tuple(np.concatenate(x) if x else np.zeros(0, kind) for x, kind in zip(found, (np.int64, np.int64, float), strict=True))

    def nearest_some(self, first: np.ndarray, t: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(first) - 1
        reach = np.zeros((n, self.blocks), np.float32)
        has = np.flatnonzero(np.diff(first))
        for i in range(0, len(has), 32):
            some = has[i : i + 32]
            own = slice(first[some[0]], first[some[-1] + 1])
            reach[some] = np.add.reduceat(self.bound[t[own]] * w[own, None].astype(np.float32), first[some] - first[some[0]], axis=0)
        order = np.argsort(-reach, axis=1, kind="stable")
        ranked = np.take_along_axis(reach, order, 1)
        row, entry, cosine = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        least = np.zeros(n, np.float32)
        rank, step = 0, 1
        while rank < self.blocks:
            to = min(self.blocks, rank + step)
            r, j = np.nonzero((ranked[:, rank:to] > 0) & (ranked[:, rank:to] >= least[:, None] - 1e-5))
            if not len(r):
                break  # later blocks reach no further
            blocks = order[r, rank + j]
            parts = [(row, entry, cosine)]
            for b in np.unique(blocks):
                rows = r[blocks == b]
                chunk = max(1, int(POSTINGS // (1 + (first[rows + 1] - first[rows]).mean() * 8)))
                parts += [self.opened(int(b), first, t, w, rows[x : x + chunk], least[rows[x : x + chunk]], k) for x in range(0, len(rows), chunk)]
            row, entry, cosine = (np.concatenate(x) for x in zip(*parts, strict=True))
            best = np.lexsort((entry, -np.round(cosine, 6), row))
            row, entry, cosine = row[best], entry[best], cosine[best]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            least[row[place == k - 1]] = cosine[place == k - 1]
            row, entry, cosine = row[place < k], entry[place < k], cosine[place < k]
            rank, step = to, step * 2
        return row, entry, cosine

    def vote(self, row: np.ndarray, entry: np.ndarray, cosine: np.ndarray, n: int, own: np.ndarray | None = None, y: np.ndarray | None = None) -> np.ndarray:
        """For each of n texts the toxic share among neighbours by weight of nearness, as a logit; own and y: entries and labels that don't count once."""
        toxic, votes = self.toxic[entry].astype(float), self.votes[entry].astype(float)
        if own is not None:
            self_vote = entry == own[row]
            toxic -= self_vote * y[row]
            votes -= self_vote
        near = cosine**2 / (1.05 - np.minimum(cosine, 1.0))
        # a vector that many examples share counts as one neighbour with their common share
        sure = near * np.log1p(votes)
        share = (toxic + self.prior) / (votes + 1.0)
        p = (np.bincount(row, weights=sure * share, minlength=n) + 0.05 * self.prior) / (np.bincount(row, weights=sure, minlength=n) + 0.05)
        return np.log(p / (1 - p))

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * logit + self.curve[1], -30, 30)))


def weights_of(idf: np.ndarray, t: np.ndarray, counts: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """TF-IDF weights of n vectors, each scaled to length one."""
    w = (1 + np.log(counts.astype(float))) * idf[t]
    return w / np.sqrt(np.bincount(of, weights=w * w, minlength=n))[of]


def alike(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """An order of vectors that puts those side by side that share common terms (x; a few rounds of spherical k-means from evenly spaced vectors) and have about as many, and so weights of a size. It only decides how many blocks stay shut."""
    m = len(x)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    k = min(GROUPS, m)
    centres, group = x[np.linspace(0, m - 1, k).astype(int)], np.zeros(m, int)
    for _ in range(ROUNDS):
        group = (x @ centres.T).argmax(1)
        for g in range(k):
            if (group == g).any():
                centres[g] = x[group == g].sum(0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    return np.lexsort((np.arange(m), size, group))


def build(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = EXAMPLES, k: int = NEIGHBOURS) -> Index | None:
    """The index of the examples. What comes to the driver is bounded by `most` vectors."""
    # equal texts with equal labels are one example: copies don't make a word common
    texts = training_rows(docs, labels, label, most).groupBy(F.xxhash64("text").alias("h"), F.xxhash64(F.lit(3), "text").alias("h2"), "y").agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"))
    rows = texts.select("doc_id", "y", "text").mapInArrow(term_rows, "doc_id long, y long, terms array<long>, counts array<int>")
    rows = cut(rows.withColumn("key", F.xxhash64("terms", "counts")), "toxic-examples")
    got = rows.agg(F.count("*").alias("n"), F.sum("y").alias("toxic")).first()
    n, n1 = got["n"], got["toxic"] or 0
    if not n or not n1 or n1 == n:
        return None
    blank = rows.where("size(terms) = 0").agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("toxic")).first()
    # one task puts the bounded examples in order; the driver only hands on what it makes
    run = index_task(n, n1, n1 / n, (blank["toxic"] + n1 / n) / (blank["n"] + 1))
    made = cut(rows.where("size(terms) > 0").repartition(1).mapInArrow(run, "at long, data binary"), "toxic-index").collect()
    if not made:
        return None
    index = pickle.loads(b"".join(bytes(r["data"]) for r in sorted(made, key=lambda r: r["at"])))
    del made
    # calibration on the examples, each without its own vote
    shared = docs.sparkSession.sparkContext.broadcast(index)
    told = rows.where("size(terms) > 0").mapInArrow(votes_of(shared, k), "doc_id long, y long, logit double").toArrow().sort_by("doc_id")
    shared.destroy()
    if told.num_rows:
        slope, offset = fit(told.column("logit").to_numpy()[:, None], told.column("y").to_numpy().astype(float))
        if slope[0] <= 0:
            raise RuntimeError("the neighbours' votes don't follow the labels: no calibration")
        index.curve = (float(slope[0]), offset)
    return index


def index_of(batches: list[pa.RecordBatch], n: int, n1: int, prior: float, blank: float) -> Index:
    """The index of examples (key, y, doc_id, terms, counts); equal vectors, which have equal keys, are one entry. n, n1: examples and toxic ones in all. Postings are worked on a batch or block at a time."""
    key, y, doc_id = (np.concatenate([b.column(c).to_numpy() for b in batches]) for c in ("key", "y", "doc_id"))
    keys, once, place = np.unique(key, return_index=True, return_inverse=True)
    m, votes = len(keys), np.bincount(place)
    toxic = np.bincount(place, weights=y).astype(np.int64)
    ids = np.full(m, np.iinfo(np.int64).max)
    np.minimum.at(ids, place, doc_id)
    hashes = lambda b: b.column("terms").flatten().to_numpy().view(np.uint64)
    vocabulary = np.zeros(0, np.uint64)
    for b in batches:
        vocabulary = np.union1d(vocabulary, hashes(b))
    v, t, counts, lengths = len(vocabulary), [], [], []
    while batches:
        b = batches.pop(0)
        t.append(np.searchsorted(vocabulary, hashes(b)).astype(np.int32))
        c = b.column("counts").flatten().to_numpy()
        counts.append(c.astype(np.min_scalar_type(int(c.max(initial=1)))))
        lengths.append(b.column("terms").value_lengths().to_numpy())
        del b, c
    t, counts, lengths = np.concatenate(t), np.concatenate(counts), np.concatenate(lengths)
    # of rows with equal keys the first one stands for all
    size, begin = lengths[once].astype(np.int64), (np.cumsum(lengths, dtype=np.int64) - lengths)[once]
    d, d1 = np.zeros(v), np.zeros(v)
    for a in range(0, m, BLOCK):
        own = slice(a, a + BLOCK)
        at = ragged(begin[own], size[own])
        d += np.bincount(t[at], weights=np.repeat(votes[own], size[own]), minlength=v)
        d1 += np.bincount(t[at], weights=np.repeat(toxic[own], size[own]), minlength=v)
    d0 = d - d1
    odds = np.log((d1 + 0.5) / (n1 - d1 + 0.5)) - np.log((d0 + 0.5) / (n - n1 - d0 + 0.5))
    marks = 1 + np.maximum(0, odds / np.sqrt(1 / (d1 + 0.5) + 1 / (d0 + 0.5)))
    idf = (np.log((n + 1) / (d + 1)) + 1) * marks
    often = np.argsort(-d, kind="stable")[:SHARED]
    column = np.full(v, -1)
    column[often] = np.arange(len(often))
    x = np.zeros((m, len(often)), np.float32)
    for a in range(0, m, BLOCK):
        at = ragged(begin[a : a + BLOCK], size[a : a + BLOCK])
        of, col = np.repeat(np.arange(len(size[a : a + BLOCK])), size[a : a + BLOCK]), column[t[at]]
        x[a + of[col >= 0], col[col >= 0]] = weights_of(idf, t[at], counts[at], of, BLOCK)[col >= 0]
    order = alike(x, size)
    del x
    runs, parts = [0], []
    for a in range(0, m, BLOCK):
        own = order[a : a + BLOCK]
        at, entry = ragged(begin[own], size[own]), np.repeat(np.arange(len(own)), size[own])
        by = np.lexsort((entry, t[at]))
        at, entry = at[by], entry[by]
        new = np.flatnonzero(np.concatenate([[True], t[at[1:]] != t[at[:-1]]])) if len(at) else np.zeros(0, np.int64)
        parts.append((t[at[new]], np.diff(np.append(new, len(at))).astype(np.int16), entry.astype(np.int16), counts[at]))
        runs.append(runs[-1] + len(new))
    words, length, entries, counts = (np.concatenate(p) for p in zip(*parts, strict=True))
    return Index(vocabulary, idf, np.array(runs), words, length, entries, counts, toxic[order], votes[order], ids[order], keys[order], prior, blank)


def index_task(*figures):
    """All examples of one task's rows as an index, in pieces; see index_of()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if parts:
            data = pickle.dumps(index_of(parts, *figures), protocol=5)
            for a in range(0, len(data), 1 << 23):
                yield pa.RecordBatch.from_pydict({"at": [a], "data": [data[a : a + (1 << 23)]]}, schema=pa.schema([("at", pa.int64()), ("data", pa.binary())]))

    return run


def vectors(index: Index, n: int, of: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, terms, weights) of n texts: their known words, weights scaled to length one. of, hashes: each text's different words, in order of texts."""
    at = np.minimum(np.searchsorted(index.vocabulary, hashes), max(0, len(index.vocabulary) - 1))
    known = index.vocabulary[at] == hashes if len(index.vocabulary) else np.zeros(len(hashes), bool)
    t, of = at[known], of[known]
    return np.searchsorted(of, np.arange(n + 1)), t, weights_of(index.idf, t, counts[known], of, n)


def votes_of(index, k: int):
    """(doc_id, y, logit) of each example by its neighbours, its own vote left out."""
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int64()), ("logit", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = index.value.weigh()
        place = np.argsort(x.keys)
        for batch in batches:
            y, own = batch.column("y").to_numpy(), place[np.searchsorted(x.keys[place], batch.column("key").to_numpy())]
            of = np.repeat(np.arange(len(y)), batch.column("terms").value_lengths().to_numpy())
            hashes, counts = (batch.column(c).flatten().to_numpy() for c in ("terms", "counts"))
            found = x.nearest(*vectors(x, len(y), of, hashes.view(np.uint64), counts), k)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(x.vote(*found, len(y), own, y))], schema=schema)

    return run


def scored(index: Index, texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores, first, evidence): evidence of text i from first[i] to first[i + 1]."""
    n = len(texts)
    hashes, of = terms(texts)
    different, number = np.unique(hashes, return_inverse=True)
    cells, counts = np.unique(of * max(1, len(different)) + number, return_counts=True)
    rows, number = np.divmod(cells, max(1, len(different)))
    row, entry, cosine = index.nearest(*vectors(index, n, rows, different[number], counts), k)
    first = np.searchsorted(row, np.arange(n + 1))
    return np.where(np.diff(first) > 0, index.probability(index.vote(row, entry, cosine, n)), index.blank), first, index.evidence[entry]


def score(docs: DataFrame, index: Index | None, k: int = NEIGHBOURS) -> DataFrame:
    """doc_id, score, evidence (ids of the nearest examples, at most k) for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by EXAMPLES
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("evidence", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value and shared.value.weigh()
        for batch in batches:
            for piece in pieces(batch):
                n = piece.num_rows
                scores, first, evidence = (np.full(n, 0.4999), np.zeros(n + 1, int), np.zeros(0, np.int64)) if index is None else scored(index, piece.column("text"), k)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(scores), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(evidence))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, evidence array<long>")


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = EXAMPLES, k: int = NEIGHBOURS) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence for every row of docs."""
    found = score(docs, build(docs, labels, label, most, k), k)
    return found.select("doc_id", (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
