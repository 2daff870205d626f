"""PII by bootstrapped contextual extraction.

Strict recognisers give seed entities. Every seed and every other identifier-like token goes into a
pattern-instance graph: a pattern is what stands around a slot (the two words before it, or the word
before and the word after), an instance is what fills it. Scores pass between the two sides for a few
rounds: a pattern is as good as the instances it holds, an instance as likely as the patterns that hold
it. Patterns that are good enough then mark instances which the recognisers don't know.

Edge cases: a null text counts as empty; a text without identifiers has no spans and the digest of the
empty string; repeated rows each get their own equal row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm.common import cut, whole

KINDS = ("email", "ip", "card", "phone")

LOCAL_PART = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where no digit stands before it: the lookbehind keeps long digit runs linear.
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?<![0-9][0-9])(?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LIKELY = re.compile(r"[0-9@]")
TOKEN_REST = re.compile(r"[0-9@]\S*")
NOT_DIGIT = re.compile(r"[^0-9]")
NOT_LETTER = re.compile(r"[\W\d_]+")
OPENING, CLOSING = "([{<\"'`*#$%&|", ".,;:!?)]}>\"'`*#$%&|"

#: Texts with added spans up to which these are broadcast to mask them; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Code points around a slot in which its pattern's words are looked for.
CONTEXT = 96
#: Identifiers that the patterns may discover have so many code points.
SHORTEST, LONGEST = 6, 64

SCHEMA = pa.schema(
    [
        ("rid", pa.int64()),
        ("doc_id", pa.int64()),
        *[(f"n_{k}", pa.int64()) for k in KINDS],
        ("base_sha256", pa.string()),
        ("base", pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))),
        ("slots", pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()), ("pattern", pa.string())]))),
    ]
)
SCHEMA_SQL = (
    "rid long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
    "base array<struct<start:long,kind:int,end:long>>, slots array<struct<kind:int,start:long,end:long,instance:string,pattern:string>>"
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As one pattern, local part @ domain, would match from left to right, but in linear time."""
    end, at = 0, text.find("@")
    before = 0  # no local part reaches back beyond the last @
    while at >= 0:
        left = text[max(end, before) : at]
        before = at + 1
        start = at - (len(left) - len(left.rstrip(LOCAL_PART)))
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the strict recognisers accept, in order."""
    found = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def patterns(text: str, start: int, end: int) -> list[str]:
    """What stands around a slot: the two words before it, and the words on both sides."""
    left = [NOT_LETTER.sub("", w).lower()[:32] for w in text[max(0, start - CONTEXT) : start].split()[-2:]]
    after = text[end : end + CONTEXT].split(maxsplit=2)
    after = [w for w in (NOT_LETTER.sub("", w).lower()[:32] for w in after[:2]) if w]
    out = [f"l2 {left[0]} {left[1]}"] if len(left) == 2 and all(left) else []
    return out + ([f"lr {left[-1]} {after[0]}"] if left and left[-1] and after else [])


def surface(value: str) -> str:
    return value.lower()


def candidates(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Tokens with a digit or an @ that touch no span which is taken."""
    by_end = sorted((e, s) for s, _, e in taken)
    furthest: list[int] = []  # least start among the spans from here on
    for _, s in reversed(by_end):
        furthest.append(min(s, furthest[-1]) if furthest else s)
    furthest.reverse()
    done, pos = 0, 0
    while m := TOKEN_REST.search(text, pos):
        begin = m.start()
        while begin > done and begin - m.start() > -LONGEST and not text[begin - 1].isspace():
            begin -= 1
        token = text[begin : m.end()]
        done = pos = m.end()
        inner = token.lstrip(OPENING)
        start = begin + len(token) - len(inner)
        inner = inner.rstrip(CLOSING)
        end = start + len(inner)
        if SHORTEST <= len(inner) <= LONGEST:
            i = bisect_left(by_end, (start + 1, -1))
            if i == len(by_end) or furthest[i] >= end:
                yield start, end


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, str, str]]]:
    """Base spans, and (kind or -1, start, end, instance, pattern) of all slots."""
    if not LIKELY.search(text):
        return [], []
    base = base_spans(text)
    slots = [(k, s, e, surface(text[s:e]), p) for s, k, e in base for p in patterns(text, s, e)]
    slots += [(-1, s, e, surface(text[s:e]), p) for s, e in candidates(text, base) for p in patterns(text, s, e)]
    return base, slots


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nothing = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        rows: dict[str, list] = {f.name: [] for f in SCHEMA}
        for rid, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            base, slots = scan(text or "")
            rows["rid"].append(rid)
            rows["doc_id"].append(doc_id)
            kinds = [k for _, k, _ in base]
            for i, k in enumerate(KINDS):
                rows[f"n_{k}"].append(kinds.count(i))
            rows["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest() if base else nothing)
            rows["base"].append([{"start": s, "kind": k, "end": e} for s, k, e in base])
            rows["slots"].append([{"kind": k, "start": s, "end": e, "instance": i, "pattern": p} for k, s, e, i, p in slots])
        yield pa.RecordBatch.from_pydict(rows, schema=SCHEMA)


def good_patterns(edges: DataFrame, rounds: int, support: int, accept: float) -> DataFrame:
    """(pattern, kind, confidence) from edges (pattern, instance, kind or -1, n).

    A pattern's confidence in a kind is the mean score of what fills its slot; an unknown instance's
    score is the chance that one of its patterns is right (noisy or), counting good patterns alone.
    """
    seeds = edges.where("kind >= 0").groupBy("pattern", "kind").agg(F.sum("n").alias("known"), F.countDistinct("instance").alias("support"))
    seeds = seeds.where(F.col("support") >= support)
    filled = edges.join(seeds.select("pattern").distinct(), "pattern", "left_semi").groupBy("pattern").agg(F.sum("n").alias("n"))
    seeds = cut(seeds.join(filled, "pattern"), "pii-patterns")
    scores = seeds.select("pattern", "kind", (F.col("known") / F.col("n")).alias("confidence"))
    unknown = edges.where("kind < 0").select("pattern", "instance", F.col("n").alias("m"))
    for _ in range(rounds):
        held = unknown.join(scores.where(F.col("confidence") >= accept), "pattern")
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))
        likely = held.groupBy("instance", "kind").agg((1 - doubt).alias("score"))
        gained = unknown.join(likely, "instance").groupBy("pattern", "kind").agg(F.sum(F.col("m") * F.col("score")).alias("gained"))
        scores = seeds.join(gained, ["pattern", "kind"], "left").select("pattern", "kind", ((F.col("known") + F.coalesce("gained", F.lit(0.0))) / F.col("n")).alias("confidence"))
        scores = cut(scores, "pii-scores")
    return scores.where(F.col("confidence") >= accept)


def extract(docs: DataFrame, rounds: int = 3, support: int = 5, accept: float = 0.9) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans (array of start, kind, end, added), one row per row of docs.

    support: distinct seeds that a pattern needs; accept: the confidence from which it discovers others.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), F.col("text"))
    scanned = cut(rows.mapInArrow(scan_batches, SCHEMA_SQL), "pii-scan")
    slots = scanned.where(F.size("slots") > 0).select("rid", F.explode("slots").alias("s")).select("rid", "s.*")
    edges = slots.groupBy("pattern", "instance", "kind").agg(F.count("*").alias("n"))
    good = good_patterns(edges, rounds, support, accept)
    best = F.max(F.struct("confidence", (-F.col("k")).alias("k"))).alias("best")
    unknown = slots.where("kind < 0").join(good.withColumnRenamed("kind", "k"), "pattern")
    added = unknown.groupBy("rid", "start", "end").agg(best).select("rid", F.struct("start", (-F.col("best.k")).cast("int").alias("kind"), "end").alias("span"))
    added = added.groupBy("rid").agg(F.collect_list("span").alias("added"))
    return scanned.drop("slots").join(added, "rid", "left").drop("rid").withColumn("added", F.coalesce("added", F.expr("cast(array() as array<struct<start:long,kind:int,end:long>>)")))


def span_text(spans: str) -> str:
    """SQL for an array of spans as kind:start:end, by start and then kind."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"concat_ws(',', transform(array_sort({spans}), s -> concat(element_at(array({names}), s.kind + 1), ':', s.start, ':', s.end)))"


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", F.expr(span_text("concat(base, added)")).alias("spans"), F.size("added").cast("long").alias("n_added"))


def redact(docs: DataFrame, **how) -> DataFrame:
    """docs with every span that extract() finds replaced by its kind in brackets; all columns and rows stay. A null text stays null.

    Base spans are found again beside the texts; only what the patterns added must meet its text, by a hash of it.
    """
    found = extract(docs.select(F.xxhash64("text").alias("doc_id"), "text"), **how)
    added = cut(found.where(F.size("added") > 0).groupBy(F.col("doc_id").alias("key")).agg(F.first("added").alias("added")), "pii-added")
    if added.count() <= BROADCAST_ROWS:
        added = F.broadcast(added)
    out = docs.select(F.xxhash64("text").alias("key"), "text", whole(docs).alias("doc")).join(added, "key", "left").select("text", "added", "doc")
    place = docs.columns.index("text")
    schema = T.StructType([T.StructField("doc", T.StructType(docs.schema.fields))])
    return out.mapInArrow(masking(place), schema).select("doc.*")


def masked(text: str | None, added: list[dict] | None) -> str | None:
    """The text with a mark for every span, from left to right; of spans that overlap the first one's mark stands."""
    if text is None:
        return None
    spans = base_spans(text) if LIKELY.search(text) else []
    if added:
        spans = sorted([*spans, *((s["start"], s["kind"], s["end"]) for s in added)])
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def masking(place: int):
    """Rows (text, added, doc) as doc alone, its field at `place` masked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, doc = batch.column("text"), batch.column("doc")
            new = pa.array([masked(t, a) for t, a in zip(text.to_pylist(), batch.column("added").to_pylist(), strict=True)], text.type)
            fields = doc.flatten()
            fields[place] = new
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(fields, fields=list(doc.type))], names=["doc"])

    return run
