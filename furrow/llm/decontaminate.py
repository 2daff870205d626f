"""Benchmark decontamination by winnowing, in DataFrame and SQL functions alone.

A passage of `window` words holds window - k + 1 k-grams; the smallest of their hashes is its fingerprint.
Equal passages have equal fingerprints, so each shared span of `window` words or more shares one: this is
winnowing's guarantee. Few different fingerprints remain of a text (neighbouring windows mostly share the
smallest hash), and these alone meet the benchmark's. Where they do, the hit is extended: every window of
the document with that fingerprint is compared with the items' windows word for word.

Items shorter than a window are one window of their own length; their hash over all their words is the
fingerprint (no k-gram is left out), the rest is the same.

Edge cases: null and empty texts have no words, and so neither hits nor windows; repeated rows and equal
texts each get the same result; null ids stay null; items without words don't
count, those with a null id count as hits but are in no list of ids; an empty benchmark hits nothing; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import ascii_lower, cut, whole

WINDOW, K = 10, 5
#: Everything below 0x80 but digits and letters parts words.
PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows up to which the benchmark's fingerprints, and the digests of texts that were hit, are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), PARTS), "")


def let(value: str, name: str, body: str) -> str:
    """SQL for body with name bound to value, which is worked out once for each row."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def fingerprints(words: str, window: int, k: int) -> str:
    """SQL for the array of the fingerprints of all windows, in order; empty where there are fewer words than a window."""
    grams = ", ".join(f"w[i + {j}]" if j else "w[i]" for j in range(k))
    least = ", ".join(f"g[i + {j}]" if j else "g[i]" for j in range(window - k + 1))
    least = f"least({least})" if window > k else least
    hashes = f"transform(sequence(0, size(w) - {k}), i -> xxhash64({grams}))"
    body = let(hashes, "g", f"transform(sequence(0, size(w) - {window}), i -> {least})")
    return f"if(size({words}) < {window}, cast(array() as array<bigint>), {let(f'transform({words}, x -> xxhash64(x))', 'w', body)})"


def windows_at(hits: str, prints: str, words: str, window: int) -> str:
    """SQL for (place, text) of the windows whose fingerprint is among hits."""
    places = f"filter(transform({prints}, (v, i) -> if(array_contains({hits}, v), i, null)), i -> i is not null)"
    return f"transform({places}, i -> struct(i as place, concat_ws(' ', slice({words}, i + 1, {window})) as passage))"


def item_windows(items: DataFrame, window: int, k: int) -> DataFrame:
    """(item_id, length, fingerprint, passage): each different window of each item."""
    rows = items.select("item_id", words_of(F.col("text")).alias("words")).where("size(words) > 0")
    long = rows.where(f"size(words) >= {window}").select(
        "item_id",
        F.lit(window).alias("length"),
        F.explode(F.expr(f"transform({fingerprints('words', window, k)}, (v, i) -> struct(v as fingerprint, concat_ws(' ', slice(words, i + 1, {window})) as passage))")).alias("w"),
    )
    short = rows.where(f"size(words) < {window}").select(
        "item_id",
        F.size("words").alias("length"),
        F.expr("struct(aggregate(transform(words, x -> xxhash64(x)), cast(0 as bigint), (a, x) -> xxhash64(a, x)) as fingerprint, concat_ws(' ', words) as passage)").alias("w"),
    )
    return long.unionByName(short).select("item_id", "length", "w.*").distinct()


def short_fingerprints(words: str, length: int) -> str:
    """As item_windows() hashes an item of that length."""
    body = f"transform(sequence(0, size(w) - {length}), i -> aggregate(slice(w, i + 1, {length}), cast(0 as bigint), (a, x) -> xxhash64(a, x)))"
    return f"if(size({words}) < {length}, cast(array() as array<bigint>), {let(f'transform({words}, x -> xxhash64(x))', 'w', body)})"


def overlaps(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """(key, n_hit, item_ids) for each different text of docs (text) with hits; key is the text's digest."""
    tests = cut(item_windows(items, window, k), "benchmark-windows")
    known = tests.select("length", "fingerprint").distinct()
    lengths = [r[0] for r in tests.select("length").distinct().collect()]  # at most as many as a window has words
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    texts = docs.where("text is not null").select(F.md5(F.col("text").cast("binary")).alias("key"), words_of(F.col("text")).alias("words"))
    prints = {n: fingerprints("words", window, k) if n == window else short_fingerprints("words", n) for n in lengths}
    if not lengths:
        return texts.where("false").select("key", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("item_ids"))
    # each text's different fingerprints meet the benchmark's
    hits = None
    for n, v in prints.items():
        own = texts.select("key", F.lit(n).alias("length"), F.explode(F.expr(f"array_distinct({v})")).alias("fingerprint"))
        own = own.join(known, ["length", "fingerprint"], "left_semi")
        hits = own if hits is None else hits.unionByName(own)
    hits = hits.groupBy("key", "length").agg(F.collect_set("fingerprint").alias("hits"))
    hits = cut(hits, "benchmark-hits")
    # of the texts that were hit, the windows in question, compared word for word
    asked = hits.select(F.xxhash64("key").alias("short")).distinct()
    if asked.count() <= BROADCAST_ROWS:
        asked = F.broadcast(asked)
    again = docs.where("text is not null").select(F.md5(F.col("text").cast("binary")).alias("key"), "text")
    again = again.join(asked, F.xxhash64("key") == F.col("short"), "left_semi").groupBy("key").agg(F.first("text").alias("text")).select("key", words_of(F.col("text")).alias("words"))
    again = again.join(hits, "key")
    found = None
    for n, v in prints.items():
        own = again.where(F.col("length") == n).select("key", "length", F.explode(F.expr(windows_at("hits", v, "words", n))).alias("w")).select("key", "length", "w.*")
        found = own if found is None else found.unionByName(own)
    passages = tests.groupBy("length", "passage").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    found = found.join(passages, ["length", "passage"])
    found = found.groupBy("key").agg(
        F.expr("size(array_distinct(flatten(collect_list(sequence(place, place + length - 1)))))").cast("long").alias("n_hit"),
        F.expr("array_sort(array_distinct(flatten(collect_set(items))))").alias("item_ids"),
    )
    return cut(found, "benchmark-overlaps")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids for every row of docs."""
    found = overlaps(docs, items, window, k)
    rows = docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("key"), F.coalesce(F.size(words_of(F.col("text"))), F.lit(0)).cast("long").alias("n_words"))
    rows = rows.withColumn("n_words", F.greatest("n_words", F.lit(0)).cast("long"))
    return rows.join(found, "key", "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", F.expr("cast(array() as array<string>)")).alias("item_ids"))


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def clean(docs: DataFrame, items: DataFrame, most: float = 0.0, window: int = WINDOW, k: int = K) -> DataFrame:
    """The rows of docs of whose words at most that share is hit, with all their columns."""
    found = overlaps(docs, items, window, k)
    found = found.select("key", "n_hit")
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    named = docs.select(whole(docs).alias("doc"), F.md5(F.col("text").cast("binary")).alias("key")).join(found, "key", "left")
    # words are counted only where there are hits
    return named.where(F.when(F.col("n_hit").isNull(), True).otherwise(F.col("n_hit") <= F.size(words_of(F.col("doc.text"))) * F.lit(most))).select("doc.*")
