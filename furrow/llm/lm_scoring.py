"""Scoring texts by online logistic context mixing over bits.

A token (a word, or the end of the text) is written in bits: known tokens by a Huffman code over the
frequent vocabulary, others by an escape and their bytes. Each bit is predicted in several contexts, each
hashed into a table of counts of zeros and ones that was gathered from all training texts; the logits are
mixed by weights, of which gates (how much each context has seen) choose a set; weights start equal in
every text and learn online as its bits go by, and a last stage corrects the mixed probability by how well
its level has done so far in this text.

Bits see contexts of a fixed number. What the whole corpus holds comes in by phrases: tokens whose hash
with the one before says so end a phrase, so equal passages fall into equal phrases, and every phrase of
every training text is counted. A phrase's probability mixes its discounted share of all phrases with the
product over its bits; the weight is a logit for each of two gates (was the phrase before a known one?),
and learns online as phrases go by. The probability of a text is the product over its phrases, so it is
a proper distribution over texts, and bits per byte follow.

Texts go through NumPy many at once: weights are fixed within a step of STEP bits of each text.

Tables have a fixed number of slots. Tasks send the slots they touched, in blocks, and blocks are summed up
in parallel; the finished tables (two bytes a slot) and the frequent vocabulary are what is broadcast.
Counts of all other tokens and of all phrases grow with the corpus and never leave the cluster: texts'
rare tokens and phrases meet them in joins.

Tokens and phrases are told apart by 64-bit hashes.

Edge cases: null and empty texts are the end alone; very long texts go through in windows; without training
texts every token is unknown; a null id counts as the empty text for the split; repeated rows train and are
scored each; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import crc_mod, cut, drop
from furrow.llm.shingles import BASE, SPACE, Powers, hash_words, mix, pieces, spans

FOLDS, HELD_OUT = 7, 2
#: Tokens of the frequent vocabulary at most, and those that serve as contexts.
VOCABULARY, COMMON, PAIRED = 1 << 18, 256, 48
#: Slots of the tables (powers of two), and of a block.
SLOTS = (1 << 19, 1 << 20, 1 << 20)
BLOCK = 4096
#: Bits of a text between updates of its weights, tokens of a window, bytes of text that are split into tokens at once, and that are scored together.
STEP, WINDOW, PIECE, SORTED = 128, 1 << 16, 1 << 19, 1 << 21
#: Salt of a known token's context hash in the first table, times 2 and 3 in the others.
FREE = 0x1000193
#: Texts that are mixed side by side, and bits that are laid out at once.
TOGETHER, LAID = 256, 1 << 18
RATE, LEVEL_RATE, LEVELS = 2.0, 0.5, 24
END = np.uint64(0x454E44)
#: One token in so many ends a phrase (a power of two); the chance of a known phrase after a known one at first; and how fast such chances learn.
PHRASE, GOES_ON, PHRASE_RATE = 8, 0.9, 0.5
TOP = 20
GATES = 32


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, starts, ends, hashes, first): all tokens of the texts in order; the end has a place of no bytes."""
    data, starts, ends, first = spans(pc.fill_null(texts, ""), ~SPACE)
    hashes = hash_words(data, starts, ends)
    n = len(texts)
    at = first[1:]
    starts, ends, hashes = np.insert(starts, at, 0), np.insert(ends, at, 0), np.insert(hashes, at, END)
    return data, starts, ends, hashes, first + np.arange(n + 1)


def phrases(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, ends, first): each phrase's hash and the token after its last one, in order, and each text's first phrase's number."""
    n = len(hashes)
    before = np.concatenate([np.zeros(min(1, n), np.uint64), hashes[:-1]])
    before[first[:-1]] = 0
    last = (mix(hashes + before * np.uint64(3)) & np.uint64(PHRASE - 1)) == 0
    last[first[1:] - 1] = True
    ends = np.flatnonzero(last) + 1
    starts = np.concatenate([[0], ends[:-1]])[: len(ends)]
    up, down = Powers.reach(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[:n], dtype=np.uint64)])
    return mix(mix((sums[ends] - sums[starts]) * down[starts]) + (ends - starts).astype(np.uint64) * BASE), ends, np.searchsorted(ends, first[:-1], "right") if n else np.zeros(0, np.int64)


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often tokens (kind 0) and phrases (kind 1) occur."""
    schema = pa.schema([("kind", pa.int32()), ("h", pa.int64()), ("c", pa.int64())])

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        h, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        different, inverse = np.unique(h, return_inverse=True)
        return different, np.bincount(inverse, weights=c).astype(np.int64)

    def rows(kind: int, parts: list) -> pa.RecordBatch:
        h, c = parts[0] if len(parts) == 1 else merged(parts)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int32)), pa.array(h.view(np.int64)), pa.array(c)], schema=schema)

    held, size = [[], []], [0, 0]
    for batch in batches:
        for piece in pieces(batch):
            _, _, _, hashes, first = tokens(piece.column("text"))
            for kind, found in enumerate((hashes, phrases(hashes, first)[0])):
                held[kind].append(np.unique(found, return_counts=True))
                size[kind] += len(held[kind][-1][0])
                if size[kind] > 1_000_000:
                    held[kind] = [merged(held[kind])]
                    size[kind] = len(held[kind][0][0])
                    if size[kind] > 700_000:  # mostly different: the rest is Spark's
                        yield rows(kind, held[kind])
                        held[kind], size[kind] = [], 0
    for kind in (0, 1):
        if held[kind]:
            yield rows(kind, held[kind])


@dataclass
class Code:
    """The frequent vocabulary: sorted hashes, their counts and ranks, and Huffman paths of all units.

    Units are the vocabulary's tokens, the escape (number len(hashes)), and the 256 bytes after it.
    """

    hashes: np.ndarray
    buckets: np.ndarray  # where the hashes with each value of the first TOP bits begin
    counts: np.ndarray
    rank: np.ndarray
    offsets: np.ndarray
    nodes: np.ndarray  # numbers of the nodes that a path meets, spread over 32 bits
    bits: np.ndarray
    lengths: np.ndarray


def huffman(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, nodes, bits) of the paths from the root to each symbol."""
    n = len(weights)
    heap = [(int(w), i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    up = np.zeros(2 * n, np.int64)
    side = np.zeros(2 * n, np.uint8)
    new = n
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        up[a[1]] = up[b[1]] = new
        side[b[1]] = 1
        heapq.heappush(heap, (a[0] + b[0], new))
        new += 1
    root = new - 1
    at, levels = np.arange(n), []
    alive = at != root
    while alive.any():
        levels.append((np.where(alive, up[at], -1), np.where(alive, side[at], 0)))
        at = np.where(alive, up[at], at)
        alive = at != root
    if not levels:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
    nodes = np.array([x[0] for x in levels[::-1]], np.int32).T
    bits = np.array([x[1] for x in levels[::-1]], np.uint8).T
    has = nodes >= 0
    return np.concatenate([[0], np.cumsum(has.sum(1))]), nodes[has] - n + 1, bits[has].astype(np.uint8)


def byte_weights() -> np.ndarray:
    """Rough frequencies that shape the bytes' code (the predictions are learnt; this only sets how many bits are asked)."""
    w = np.ones(256)
    w[33:127] = 6
    w[128:192] = 8
    w[192:200] = 10
    w[195] = 60
    w[32] = 350  # the end of a word
    for i, c in enumerate(b"etaoinshrdlucmgwfpybvkzjxq"):  # fixed values: letters by frequency
        w[c] = 1500 / (i + 4)
    return w


def make_code(hashes: np.ndarray, counts: np.ndarray, rare: int) -> Code:
    """hashes in any order; rare: how often the training texts need the escape."""
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    rank = np.empty(len(hashes), np.int64)
    rank[np.lexsort((hashes, -counts))] = np.arange(len(hashes))
    offsets, nodes, bits = huffman(np.append(counts, max(rare, 1)))
    more, byte_nodes, byte_bits = huffman(byte_weights())
    nodes = np.concatenate([nodes, byte_nodes + len(hashes) + 1]).astype(np.uint32) * np.uint32(0x85EBCA77)
    offsets = np.concatenate([offsets, offsets[-1] + more[1:]])
    buckets = np.searchsorted(hashes, np.arange(1 << TOP, dtype=np.uint64) << np.uint64(64 - TOP))
    return Code(hashes, buckets, counts, rank, offsets, nodes, np.concatenate([bits, byte_bits]), np.diff(offsets))


@dataclass
class Bits:
    """All bits of some texts in order: values, a slot in each table, whether they spell bytes, and each text's and each token's first bit."""

    values: np.ndarray
    slots: list
    spelt: np.ndarray
    first: np.ndarray
    tokens: np.ndarray

    def lay(self, tables: list, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list, np.ndarray, np.ndarray, np.ndarray]:
        """The bits of ranges one after the other: (values, what each table has, whether they spell bytes), and for each run of bits that belong together its number and its first bit's place."""
        at = ragged(starts, lengths)
        return self.values.take(at), [t.take(s.take(at)) for t, s in zip(tables, self.slots, strict=True)], self.spelt.take(at), at, np.arange(len(at))


@dataclass
class Units:
    """The same of texts whose bits are laid out when they are asked for: units, whether they spell bytes, their contexts' hashes for each table, where their bits begin, each text's first bit and each token's first unit.

    marks: for each place of a path what the first table has where no context counts, and in the lowest bit the path's bit.
    """

    code: Code
    marks: np.ndarray
    units: np.ndarray
    spelt: np.ndarray
    held: list
    bounds: np.ndarray
    first: np.ndarray
    tokens: np.ndarray

    def lay(self, tables: list, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list, np.ndarray, np.ndarray, np.ndarray]:
        """As Bits.lay; a run is what a range has of a unit."""
        ends = starts + lengths
        low = np.searchsorted(self.bounds, starts, "right") - 1
        many = np.searchsorted(self.bounds, ends, "left") - low
        own = ragged(low, many)
        skipped = np.maximum(np.repeat(starts, many) - self.bounds[own], 0)
        path = np.minimum(self.bounds[own + 1], np.repeat(ends, many)) - self.bounds[own] - skipped
        if not path.all():  # where nothing is known, the escape has no bits
            own, skipped, path = own[path > 0], skipped[path > 0], path[path > 0]
        of = ragged(self.code.offsets[self.units[own]] + skipped, path)
        nodes = self.code.nodes.take(of, mode="clip")  # spares a pass for bounds
        seen = [self.marks.take(of, mode="clip")]
        values = seen[0] & 1
        spelt = np.repeat(self.spelt[own], path)
        letters, of_letters = np.flatnonzero(spelt), np.flatnonzero(self.spelt[own])
        for i, held in enumerate(self.held):
            slot = np.repeat(held[own if i else own[of_letters]], path if i else path[of_letters])
            slot += nodes if i else nodes[letters]
            slot >>= np.uint32(33 - SLOTS[i].bit_length())
            if i:
                seen.append(tables[i].take(slot, mode="clip"))
            else:
                seen[0][letters] = tables[0].take(slot, mode="clip")
        return values, seen, spelt, own, np.cumsum(path) - path


def path_marks(code: Code, table: np.ndarray) -> np.ndarray:
    """The marks of all paths, from the first table; its two lowest bits are not asked for."""
    marks = np.empty(len(code.nodes), np.int16)
    for a in range(0, len(marks), LAID):  # in parts, which spares memory
        own = slice(a, a + LAID)
        marks[own] = (table[(spread(np.zeros(1, np.uint32), FREE) + code.nodes[own]) >> np.uint32(33 - SLOTS[0].bit_length())] & ~3) | code.bits[own]
    return marks


def lookup(code: Code, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, known) of tokens."""
    if not len(code.hashes):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    # hashes are even, so a bucket holds few: step from its begin
    last = len(code.hashes) - 1
    at = np.minimum(code.buckets[(hashes >> np.uint64(64 - TOP)).astype(np.int64)], last)
    behind = np.flatnonzero((code.hashes[at] < hashes) & (at < last))
    while len(behind):
        at[behind] += 1
        behind = behind[(code.hashes[at[behind]] < hashes[behind]) & (at[behind] < last)]
    known = code.hashes[at] == hashes
    return np.where(known, at, len(code.hashes)), known


def contexts(code: Code, symbols: np.ndarray, known: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token two context numbers: the last common token before it in its text, and the last two of the most common."""
    n = len(symbols)
    rank = np.where(known, code.rank[np.minimum(symbols, max(0, len(code.rank) - 1))] if len(code.rank) else 0, 1 << 40)
    begins = np.repeat(first[:-1], np.diff(first))
    at = np.arange(n)

    def last(limit: int) -> np.ndarray:
        """The place of the last token before each one with a rank below limit, or -1."""
        seen = np.maximum.accumulate(np.where(rank < limit, at, -1)) if n else at
        before = np.concatenate([[-1], seen[:-1]]) if n else at
        return np.where(before >= begins, before, -1)

    one = last(COMMON)
    a = last(PAIRED)
    b = np.where(a >= 0, a, 0)
    b = np.where(a >= 0, last(PAIRED)[b], -1) if n else a
    name = lambda place: np.where(place >= 0, rank[np.maximum(place, 0)] + 1, 0)
    return name(one).astype(np.uint32), (name(a) * 1024 + name(b)).astype(np.uint32)


def spread(context: np.ndarray, salt: int) -> np.ndarray:
    """32-bit hashes of context numbers."""
    x = context + np.uint32(salt)
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def ragged(offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """offsets[i], offsets[i] + 1, ... for lengths[i] places each, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths - offsets, lengths)


def units_of(code: Code, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, symbols: np.ndarray, known: np.ndarray, ctx: tuple) -> tuple[np.ndarray, np.ndarray, list, np.ndarray]:
    """(units, whether they spell bytes, their contexts' hashes for each table, each token's first): each token's unit, and after an escape the units of its bytes and of the word's end."""
    letters = np.where(known, 0, ends - starts + 1)
    begin = np.cumsum(letters + 1) - letters - 1
    n = int(begin[-1] + letters[-1] + 1) if len(letters) else 0
    units, spelt, held = np.empty(n, np.int64), np.ones(n, bool), [np.empty(n, np.uint32) for _ in SLOTS]
    units[begin], spelt[begin] = symbols, False
    for i, context in enumerate((np.zeros(len(symbols), np.uint32), *ctx)):
        held[i][begin] = spread(context, FREE * (i + 1))
    rare = np.flatnonzero(~known)
    if len(rare):
        size = letters[rare]
        place = ragged(starts[rare], size)
        inside = ragged(np.zeros(len(rare), np.int64), size)
        byte = (data[np.minimum(place, len(data) - 1)] if len(data) else np.zeros(len(place), np.uint8)).astype(np.uint32)
        byte[np.cumsum(size) - 1] = 32
        byte += np.uint32(32) * ((byte >= 65) & (byte <= 90))
        to = ragged(begin[rare] + 1, size)
        units[to] = byte + len(code.hashes) + 1
        context = np.full(len(byte), 1 << 30, np.uint32)
        for j, i in ((1, None), (2, 0), (3, 1), (4, 2)):  # two, three and four bytes back
            back = np.concatenate([np.zeros(min(j, len(byte)), np.uint32), byte[:-j]])[: len(byte)]
            context = context * np.uint32(0x01000193) + np.where(inside >= j, back + np.uint32(1), np.uint32(0))
            if i is not None:
                held[i][to] = spread(context, 0x9E3779B1 * j % (1 << 32))
    return units, spelt, held, begin


def laid_by_units(code: Code, marks: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, symbols: np.ndarray, known: np.ndarray, ctx: tuple, first: np.ndarray) -> Units:
    """Tokens as units whose bits are still to be laid out; first: each text's first token."""
    units, spelt, held, begin = units_of(code, data, starts, ends, symbols, known, ctx)
    bounds = np.concatenate([[0], np.cumsum(code.lengths[units])])
    begin = np.append(begin, len(units))
    return Units(code, marks, units.astype(np.int32), spelt, held, bounds, bounds[begin[first]], begin)


def joined(parts: list[Units]) -> Units:
    """The texts of all parts, one after the other."""

    def on(places: list) -> np.ndarray:
        base = np.cumsum([0, *(p[-1] for p in places)])
        return np.concatenate([*(p[:-1] + b for p, b in zip(places, base[:-1], strict=True)), base[-1:]])

    each = lambda name: [getattr(p, name) for p in parts]
    return Units(parts[0].code, parts[0].marks, np.concatenate(each("units")), np.concatenate(each("spelt")), [np.concatenate(h) for h in zip(*each("held"), strict=True)], on(each("bounds")), on(each("first")), on(each("tokens")))


def bits_of(code: Code, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, symbols: np.ndarray, known: np.ndarray, ctx: tuple, first: np.ndarray) -> Bits:
    """The bits of tokens, those of their units one after the other."""
    units, spelt, held, begin = units_of(code, data, starts, ends, symbols, known, ctx)
    n = len(units)
    path = code.lengths[units]
    of = ragged(code.offsets[units], path)
    nodes = code.nodes[of]
    slots = [(np.repeat(held[i], path) + nodes) >> np.uint32(33 - SLOTS[i].bit_length()) for i in range(3)]
    bounds = np.concatenate([[0], np.cumsum(path)])
    return Bits(code.bits[of], slots, np.repeat(spelt, path), bounds[np.append(begin, n)[first]], bounds[np.append(begin, n)])


def counted(code: Code, i: int, contexts: np.ndarray, units: np.ndarray, to: np.ndarray | None = None) -> np.ndarray:
    """How many zeros and ones the units' bits bring to each slot of table i, added to what is there. Equal units in equal contexts have equal bits, so these are laid out once."""
    pairs, times = np.unique((contexts.astype(np.uint64) << np.uint64(32)) | units.astype(np.uint64), return_counts=True)
    units = (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
    path = code.lengths[units]
    of = ragged(code.offsets[units], path)
    slots = np.repeat((pairs >> np.uint64(32)).astype(np.uint32), path)
    slots += code.nodes.take(of, mode="clip")
    slots >>= np.uint32(33 - SLOTS[i].bit_length())
    slots <<= np.uint32(1)
    slots |= code.bits.take(of, mode="clip")
    to = np.zeros(2 * SLOTS[i], np.uint32) if to is None else to
    np.add.at(to, slots.astype(np.int64), np.repeat(times.astype(np.uint32), path))
    return to


def table_batches(code):
    """Counts of zeros and ones in each slot that a task touched, by blocks."""
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("slots", pa.binary()), ("zeros", pa.binary()), ("ones", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for piece in pieces(batch, most=4 * PIECE):  # adding up whole tables pays for larger pieces
                data, starts, ends, hashes, first = tokens(piece.column("text"))
                symbols, known = lookup(code.value, hashes)
                ctx = contexts(code.value, symbols, known, first)
                held = held or [np.zeros(2 * s, np.uint32) for s in SLOTS]
                once = np.flatnonzero(known)
                once = once[code.value.counts[symbols[once]] == 1]
                escape, unknown = np.full(len(once), len(code.value.hashes)), np.zeros(len(once), bool)
                runs = [slice(a, a + 5 * WINDOW) for a in range(0, len(hashes), 5 * WINDOW)]
                for own, code_of, is_known in [*((r, symbols[r], known[r]) for r in runs), (once, escape, unknown)]:
                    units, _, named, _ = units_of(code.value, data, starts[own], ends[own], code_of, is_known, (ctx[0][own], ctx[1][own]))
                    for i in range(3):
                        counted(code.value, i, named[i], units, held[i])
        for i, counts in enumerate(held or []):
            rows = []
            pairs = counts.reshape(-1, 2)
            touched = np.flatnonzero(pairs.any(1))
            for block, own in zip(*group(touched // BLOCK, touched), strict=True):
                rows.append({"part": i, "block": int(block), "slots": (own % BLOCK).astype("<u2").tobytes(), "zeros": pairs[own, 0].astype("<u4").tobytes(), "ones": pairs[own, 1].astype("<u4").tobytes()})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run, "part int, block int, slots binary, zeros binary, ones binary"


def group(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list]:
    """Values by key; keys are sorted."""
    different, first = np.unique(keys, return_index=True)
    return different, np.split(values, first[1:]) if len(different) else []


def sum_blocks(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block's counts from all tasks, packed."""
    counts = np.zeros((2, BLOCK))
    for batch in batches:
        for slots, zeros, ones in zip(*(batch.column(c).to_pylist() for c in ("slots", "zeros", "ones")), strict=True):
            own = np.frombuffer(slots, "<u2")
            counts[0, own] += np.frombuffer(zeros, "<u4")
            counts[1, own] += np.frombuffer(ones, "<u4")
    yield pa.RecordBatch.from_pydict({"part": [key[0].as_py()], "block": [key[1].as_py()], "slots": [packed(counts).tobytes()]}, schema=pa.schema([("part", pa.int32()), ("block", pa.int32()), ("slots", pa.binary())]))


def packed(counts: np.ndarray) -> np.ndarray:
    """Counts of zeros and ones as a logit in steps of 1/256, and in the lowest two bits how much was seen."""
    logit = np.clip(np.round(np.log((counts[1] + 0.4) / (counts[0] + 0.4)) * 256), -8000, 8000).astype(np.int16)
    return ((logit << 2) | np.digitize(counts.sum(0), [1, 4, 32]).astype(np.int16)).astype("<i2")


def first_weights() -> np.ndarray:
    """Weights of each gate to start with: the finest context that has seen enough leads."""
    w = np.zeros((GATES, 4), np.float32)
    for g in range(GATES):
        one, two = g % 4, g // 4 % 4
        lead = 2 if two >= 2 else 1 if one >= 2 else 0
        w[g, :3] = [0.25, 0.25 * (one > 0), 0.25 * (two > 0)]
        w[g, lead] += 0.5
        w[g, :3] /= w[g, :3].sum()
    return w


def mixed(bits: Bits | Units, tables: list, weights: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The log probability of each token; weights (text, gate, input) and levels (text, level) go on learning."""
    # the longest texts first, and TOGETHER of them side by side, so that those still active are a prefix and their numbers stay in the cache
    order = np.argsort(-np.diff(bits.first), kind="stable")
    sums = np.zeros(int(bits.tokens[-1]) + 1)
    for a in range(0, len(order), TOGETHER):
        own = order[a : a + TOGETHER]
        weights[own], levels[own] = side_by_side(bits, tables, bits.first[own], np.diff(bits.first)[own], weights[own], levels[own], sums[1:])
    return np.diff(np.cumsum(sums, out=sums)[bits.tokens])


def side_by_side(bits: Bits | Units, tables: list, first: np.ndarray, size: np.ndarray, weights: np.ndarray, levels: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adds the log probabilities of bits to sums, by the numbers of their runs; what weights and levels have become. size goes down.

    Inputs go in pairs as complex numbers, the second with its sign turned: the real part of such a pair times two weights is their share of the logit, and one fetch or sum serves two.
    """
    turns = -(-size // STEP)
    active = np.searchsorted(-turns, -np.arange(int(turns.max())), "left")
    begin = np.concatenate([[0], np.cumsum(active)])
    pairs = [np.ascontiguousarray(weights[:, :, i : i + 2]).view(np.complex64).ravel() for i in (0, 2)]
    biases = levels.ravel()
    most = len(size) * STEP
    logit, scaled, chance, late = (np.empty(most, np.float32) for _ in range(4))
    one, two, off = (np.empty(most, np.complex64) for _ in range(3))
    wrong, spots = np.zeros(most, np.complex64), np.empty(most, np.int64)
    step = 0
    while step < len(active):  # as many steps as are laid out at once
        last = max(step + 1, int(np.searchsorted(begin, begin[step] + LAID // STEP, "right")) - 1)
        many = active[step:last]
        text, of = ragged(np.zeros(len(many), np.int64), many), np.repeat(np.arange(step, last), many)
        lengths = np.minimum(size[text] - of * STEP, STEP)
        values, seen, spelt, runs, places = bits.lay(tables, first[text] + of * STEP, lengths)
        edge = np.concatenate([[0], np.cumsum(lengths)])[begin[step : last + 1] - begin[step]]
        gates = seen[2] & 3
        gates <<= 2
        gates += seen[1] & 3
        gates += spelt.view(np.int8) << np.int8(4)
        x = [np.empty(len(values), np.complex64) for _ in range(2)]
        for to, cell, unit in ((x[0].real, seen[0], 1 / 256), (x[0].imag, seen[1], -1 / 256), (x[1].real, seen[2], 1 / 256)):
            cell >>= 2
            np.multiply(cell, np.float32(unit), out=to)
        x[1].imag = -0.3
        cells, ground = np.repeat(text * GATES, lengths), np.repeat(text * LEVELS, lengths)
        cells += gates
        ys, p = values.astype(np.float32), np.empty(len(values), np.float32)
        for turn in range(step, last):
            own = slice(edge[turn - step], edge[turn - step + 1])
            n, w, bias = own.stop - own.start, [v[: active[turn] * GATES] for v in pairs], biases[: active[turn] * LEVELS]
            cell, y, xs = cells[own], ys[own], [v[own] for v in x]
            z, spot, p1, p2, both = logit[:n], spots[:n], chance[:n], late[:n], (one[:n], two[:n])
            for i in range(2):
                w[i].take(cell, out=both[i], mode="clip")
                np.multiply(both[i], xs[i], out=both[i])
            np.add(*both, out=both[0])
            np.clip(both[0].real, np.float32(-13), np.float32(13), out=z)
            level = np.add(z, np.float32(12), out=scaled[:n])
            level *= np.float32(LEVELS / 24)
            np.clip(level, np.float32(0), np.float32(LEVELS - 1), out=level)
            spot[:] = level
            spot += ground[own]
            e = np.exp(np.negative(z, out=z), out=z)
            np.divide(np.float32(1), np.add(e, np.float32(1), out=p1), out=p1)
            np.exp(-bias).take(spot, out=p2, mode="clip")
            p2 *= e
            p2 += np.float32(1)
            np.divide(np.float32(1), p2, out=p2)
            np.add(p1, p2, out=p[own])
            miss = wrong[:n]
            np.subtract(y, p1, out=miss.real)
            rate = np.float32(RATE) / (np.bincount(cell, minlength=len(w[0])) + 200).astype(np.float32)
            for i in range(2):
                slope = np.zeros(len(rate), np.complex64)
                np.add.at(slope, cell, np.multiply(xs[i], miss, out=both[i]))
                w[i] += rate * np.conj(slope, out=slope)
            missed = off[:n]
            np.subtract(y, p2, out=missed.real)
            np.multiply(p2, np.subtract(np.float32(1), p2, out=p1), out=missed.imag)
            slope = np.zeros(len(bias), np.complex64)
            np.add.at(slope, spot, missed)
            bias += np.float32(LEVEL_RATE) * slope.real / (slope.imag + np.float32(8))
            np.clip(bias, np.float32(-3), np.float32(3), out=bias)
        p *= np.float32(0.5)
        np.clip(p, 2**-18, 1 - 2**-18, out=p)
        p -= np.float32(1) - ys  # the chance of a one, or less that of a zero
        np.log(np.abs(p, out=p), out=p)
        np.add.at(sums, runs, p if len(runs) == len(p) else np.add.reduceat(p, places, dtype=np.float64))
        step = last
    return np.stack([v.view(np.float32).reshape(len(size), GATES, 2) for v in pairs], 2).reshape(weights.shape), biases.reshape(levels.shape)


def phrase_mix(logs: np.ndarray, shares: np.ndarray, first: np.ndarray, start: float) -> np.ndarray:
    """The log probability of each text: phrase by phrase its share of all phrases (0: unknown) and the product over its bits (logs), mixed by a logit for each gate that learns online. Phrases of text i go from first[i] to first[i + 1]; start: the chance of a known phrase after an unknown one."""
    n, size = len(first) - 1, np.diff(first)
    state = np.tile(np.log([start / (1 - start), GOES_ON / (1 - GOES_ON)]), (n, 1))
    gate, total = np.zeros(n, np.int64), np.zeros(n)
    order = np.argsort(-size, kind="stable")
    for step in range(int(size.max()) if n else 0):
        active = order[: int(np.searchsorted(-size[order], -step, "left"))]
        at = first[active] + step
        weight = 1 / (1 + np.exp(-state[active, gate[active]]))
        with np.errstate(divide="ignore"):
            known = np.log(weight) + np.log(shares[at])
        both = np.logaddexp(known, np.log1p(-weight) + logs[at])
        total[active] += both
        was = np.exp(known - both)
        state[active, gate[active]] = np.clip(state[active, gate[active]] + PHRASE_RATE * (was - weight), -12, 12)
        gate[active] = was > 0.5
    return total


def phrase_batches(most: int, discount: float, start: float):
    """Rows with logs of all phrases and (seq, c) of the known ones: the score of each text, in log10."""
    schema = pa.schema([("rid", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs, known = batch.column("logs"), batch.column("known")
            first = np.concatenate([[0], np.cumsum(logs.value_lengths().to_numpy())])
            shares, flat = np.zeros(first[-1]), known.flatten()
            of = np.repeat(np.arange(batch.num_rows), pc.fill_null(known.value_lengths(), 0).to_numpy())
            shares[first[of] + flat.field("seq").to_numpy()] = np.maximum(flat.field("c").to_numpy() - discount, 0) / max(most, 1)
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(phrase_mix(logs.flatten().to_numpy(), shares, first, start) / np.log(10))], schema=schema)

    return run, "rid long, score double"


def scored_rows(piece: pa.RecordBatch, hashes: np.ndarray, first: np.ndarray, symbols: np.ndarray, known: np.ndarray, logs: np.ndarray, logs_of: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    """A row for each text; logs: of the vocabulary's counts; logs_of: the tokens' log probabilities."""
    n, size = piece.num_rows, np.diff(first)
    of = np.repeat(np.arange(n), size)
    named, ends, lead = phrases(hashes, first)
    sums = np.concatenate([[0.0], np.cumsum(logs_of)])
    lead = pa.array(np.append(lead, len(named)), pa.int32())
    rare = np.flatnonzero(~known)
    o = np.lexsort((hashes[rare], of[rare]))
    h, w = hashes[rare][o], of[rare][o]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])])) if len(h) else np.zeros(0, np.int64)
    tail_first = pa.array(np.searchsorted(w[new], np.arange(n + 1)), pa.int32())
    return pa.RecordBatch.from_arrays(
        [
            piece.column("rid"), piece.column("doc_id"), piece.column("held_out"), pa.array(size), pa.array(np.bincount(of, weights=known, minlength=n).astype(np.int64)),
            pa.array(np.bincount(of, weights=logs[symbols] * known, minlength=n)), pc.binary_length(pc.fill_null(piece.column("text"), "")).cast(pa.int64()),
            pa.ListArray.from_arrays(tail_first, pa.array(h[new].view(np.int64))), pa.ListArray.from_arrays(tail_first, pa.array(np.diff(np.concatenate([new, [len(h)]])).astype(np.int64))),
            pa.ListArray.from_arrays(lead, pa.array(named.view(np.int64))), pa.ListArray.from_arrays(lead, pa.array(np.diff(sums[np.concatenate([[0], ends])]))),
        ],
        schema=schema,
    )


def score_batches(code, tables):
    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_head", pa.int64()), ("head", pa.float64()), ("n_bytes", pa.int64()), ("tail", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())), ("phrases", pa.list_(pa.int64())), ("logs", pa.list_(pa.float64()))])
    start = first_weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, t = code.value, tables.value
        logs, marks = np.append(np.log10(c.counts + 1.0), 0.0), path_marks(c, t[0])
        for batch in batches:
            # texts of like lengths go through together: their steps are shared by many
            batch = batch.take(pa.array(np.argsort(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), kind="stable")))
            for group in pieces(batch, most=SORTED):
                split, many = [], []
                for piece in pieces(group, most=PIECE):
                    data, starts, ends, hashes, first = tokens(piece.column("text"))
                    symbols, known = lookup(c, hashes)
                    split.append((piece, data, starts, ends, hashes, first, symbols, known, contexts(c, symbols, known, first), np.zeros(len(hashes))))
                    many.append(int(np.diff(first).max()))
                weights, levels = np.repeat(start[None], group.num_rows, 0), np.zeros((group.num_rows, LEVELS), np.float32)
                for a in range(0, max(1, max(many)), WINDOW):  # windows of each text's tokens
                    laid, owns = [], []
                    for _, data, starts, ends, _, first, symbols, known, ctx, _ in split:
                        lengths = np.clip(np.diff(first) - a, 0, WINDOW)
                        owns.append(ragged(first[:-1] + a, lengths))
                        bounds = np.concatenate([[0], np.cumsum(lengths)])
                        laid.append(laid_by_units(c, marks, data, starts[owns[-1]], ends[owns[-1]], symbols[owns[-1]], known[owns[-1]], (ctx[0][owns[-1]], ctx[1][owns[-1]]), bounds))
                    got = mixed(joined(laid), t, weights, levels)
                    for own, part, x in zip(owns, np.split(got, np.cumsum([len(o) for o in owns])[:-1]), split, strict=True):
                        x[-1][own] = part
                for piece, _, _, _, hashes, first, symbols, known, _, logs_of in split:
                    yield scored_rows(piece, hashes, first, symbols, known, logs, logs_of, schema)

    return run, "rid long, doc_id long, held_out boolean, n_tokens long, n_head long, head double, n_bytes long, tail array<long>, times array<long>, phrases array<long>, logs array<double>"


def frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of the highest counts, at most `most` of them: all from a limit on, which a histogram of counts gives."""
    level = F.floor(F.log2(F.col("c").cast("double")) * 16).cast("int")
    histogram = counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect()  # 16 rows for each doubling
    limit, total = None, 0
    for r in histogram:
        total += r["n"]
        if total > most:
            break
        limit = r["level"]
    if limit is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    got = counts.where(level >= limit).toArrow()
    return got.column("h").to_numpy().view(np.uint64), got.column("c").to_numpy()


def train(docs: DataFrame) -> tuple[DataFrame, DataFrame, tuple[int, int], Code, list]:
    """From texts (text) to learn from: all tokens' and all phrases' counts (h, c), the tokens' sum and number, the code, and the tables."""
    every = cut(docs.mapInArrow(count_batches, "kind int, h long, c long").groupBy("kind", "h").agg(F.sum("c").alias("c")), "lm-counts")
    counts, told = every.where("kind = 0").select("h", "c"), every.where("kind = 1").select("h", "c")
    got = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = got["n"] or 0, got["v"]
    hashes, c = frequent(counts, VOCABULARY)
    # tokens seen once stand for the unknown: they teach the escape and the spelling besides their own codes
    code = make_code(hashes, c, n - int(c.sum()) + int((c == 1).sum()))
    shared = docs.sparkSession.sparkContext.broadcast(code)
    run, schema = table_batches(shared)
    # as a table, so that the shuffle files of all tasks' blocks go now and not with the session
    blocks = cut(docs.mapInArrow(run, schema).groupBy("part", "block").applyInArrow(sum_blocks, "part int, block int, slots binary"), "lm-tables")
    tables = [packed(np.zeros((2, s))) for s in SLOTS]
    for r in blocks.toArrow().to_pylist():  # at most the tables themselves
        tables[r["part"]][r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["slots"], "<i2")
    drop(blocks)
    return counts, told, (n, v), code, tables


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte (null where there are no bytes) for every row of docs."""
    held_out = crc_mod(F.col("doc_id").cast("long"), FOLDS) == HELD_OUT
    context = docs.sparkSession.sparkContext
    counts, told, (n, v), code, tables = train(docs.where(~held_out).select("text"))
    run, schema = score_batches(context.broadcast(code), context.broadcast(tables))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    scored = cut(rows.mapInArrow(run, schema), "lm-scored")
    tail = scored.select("rid", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("rid", F.col("x.tail").alias("h"), F.col("x.times").alias("m"))
    tail = tail.join(counts, "h").groupBy("rid").agg(F.sum("m").alias("n_tail"), F.sum(F.col("m") * F.log10(F.col("c") + 1.0)).alias("logs"))
    # all phrases of the training texts: how many there are, and how much of a count is chance (by those seen once and twice)
    got = told.agg(F.sum("c").alias("n"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).first()
    most, discount = got["n"] or 0, min(0.999, got["once"] / max(1, got["once"] + 2 * got["twice"]))
    start = min(0.5, max(1e-4, 1 - got["once"] / max(1, most)))
    known = scored.select("rid", F.posexplode("phrases").alias("seq", "h")).join(told, "h").groupBy("rid").agg(F.collect_list(F.struct("seq", "c")).alias("known"))
    run, schema = phrase_batches(most, discount, start)
    mixed_in = scored.select("rid", "logs").join(known, "rid", "left").select("rid", "logs", "known").mapInArrow(run, schema)
    out = scored.drop("tail", "times", "phrases", "logs").join(tail, "rid", "left").join(mixed_in, "rid")
    base = F.col("head") + F.coalesce("logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score", "n_bytes", F.expr("if(n_bytes > 0, -score / log10(2d) / n_bytes, null)").alias("bits_per_byte"))
