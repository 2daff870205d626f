import hashlib
import random
import re
from collections import Counter, defaultdict
from math import log10
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from furrow.llm import decontaminate, graph, jaccard_join, lm_scoring, pii, quality, shingles, token_counts, toxicity

# ---- personal data ----

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0


def plain_spans(t):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans_match_the_plain_patterns():
    r = random.Random(1)
    for _ in range(20_000):
        t = "".join(r.choice("0123456789.@-+ (ab)é\n") for _ in range(r.randint(0, 60)))
        assert pii.base_spans(t) == plain_spans(t), t


def test_long_runs_take_linear_time():
    for t in ("1" * 300_000, "a" * 300_000, "1." * 150_000, "a@" * 150_000, "+1 " * 100_000, "1 " * 150_000):
        pii.scan(t)


def test_patterns_discover_and_base_spans_stay(docs):
    cards = ["4539 1488 0343 6467", "4716461583322103", "4024007103939509", "6011000990139424", "5555555555554444", "378282246310005", "4111111111111111"]
    texts = [f"please charge card {c} today" for c in cards for _ in range(2)] + ["please charge card 1234-5678-9012-3456 today", "nothing of 1234567 here"]
    got = {r["doc_id"]: r for r in pii.digest(pii.extract(docs(texts))).collect()}
    assert got[14]["n_card"] == 0 and got[14]["n_added"] == 1 and got[14]["spans"] == "card:19:38"
    assert got[15]["spans"] == "" and got[0]["spans"] == "card:19:38"
    for i, t in enumerate(texts):
        base = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in plain_spans(t))
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    masked = {r["doc_id"]: r["text"] for r in pii.redact(docs(texts)).collect()}
    assert masked[14] == "please charge card [card] today" and masked[15] == texts[15]


def test_pii_odd_tables(odd, nothing):
    assert pii.digest(pii.extract(odd)).count() == 9 and pii.extract(nothing).count() == 0
    out = pii.redact(odd)
    assert out.columns == odd.columns and out.count() == 9 and out.where("text like '%[email]%'").count() == 1


# ---- n-gram Jaccard join ----


def plain_shingles(t):
    w = re.findall(r"[^ \t-\r]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_components(texts):
    sets = [plain_shingles(t) for t in texts]
    up = list(range(len(sets)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return [find(i) for i in range(len(sets))], [len(s) for s in sets]


def near_copies(r, words, edits):
    out = list(words)
    for _ in range(edits):
        at = r.randrange(len(out))
        out[at] = f"new{r.randrange(10**6)}"
    return " ".join(out)


def test_join_matches_brute_force(docs):
    r = random.Random(4)
    texts = []
    for n in (3, 5, 6, 7, 9, 12, 14, 20, 30, 60, 150, 400):
        for _ in range(3):
            words = [f"w{r.randrange(3000)}" for _ in range(n)]
            texts += [near_copies(r, words, r.randrange(0, max(1, n // 12) + 1)) for _ in range(5)] + [" ".join(words).upper()]
    passage = " ".join(f"shared{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"own{r.randrange(10**6)}" for _ in range(r.randrange(5, 120))) for _ in range(40)]
    r.shuffle(texts)
    comp, n = plain_components(texts)
    got = {x["doc_id"]: x for x in jaccard_join.linked_components(docs(texts)).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == n
    assert [got[i]["component_id"] for i in range(len(texts))] == comp
    kept = {x["doc_id"] for x in jaccard_join.keep_first(docs(texts)).collect()}
    assert kept == set(comp)


def test_components_of_few_links_take_few_jobs(spark, monkeypatch):
    r = random.Random(6)
    chain = r.sample(range(2000, 3000), 300)
    pairs = [*zip(chain, chain[1:], strict=False), *((r.randrange(1500), r.randrange(1500)) for _ in range(700)), (5, 5), (7, 1 << 40)]
    up = {}

    def find(a):
        while up.setdefault(a, a) != a:
            a = up[a]
        return a

    for a, b in pairs:
        if a != b:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    edges = spark.createDataFrame(pairs + pairs[:50], "u long, v long")
    spark.sparkContext.setJobGroup("few-links", "")
    got = graph.components(edges).collect()
    spark.sparkContext.setJobGroup("others", "")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-links")) <= 6
    assert sorted(map(tuple, got)) == sorted((a, find(a)) for a in up)
    monkeypatch.setattr(graph, "FEW", 0)
    assert sorted(map(tuple, graph.components(edges).collect())) == sorted(map(tuple, got))
    assert graph.components(edges.where("u < 0")).count() == 0


def test_every_linked_pair_shares_more_signatures_than_its_spare_ones():
    rng = np.random.default_rng(5)
    pairs = 0
    for _ in range(60):
        sets = []
        for _ in range(30):
            n = int(rng.integers(2, 200))
            base = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
            drop, add = rng.integers(0, n // 3 + 1, 2)
            sets += [np.sort(base[:n]), np.sort(np.concatenate([base[drop:n], base[n : n + add]]))]
        first = np.cumsum([0, *map(len, sets)])
        sigs, owner, spare = jaccard_join.signatures(np.concatenate(sets), first)
        own = [set(sigs[owner == i].tolist()) for i in range(len(sets))]
        for i in range(0, len(sets), 2):
            a, b = set(sets[i].tolist()), set(sets[i + 1].tolist())
            if a != b and 4 * len(a & b) >= 3 * len(a | b):
                pairs += 1
                assert len(own[i] & own[i + 1]) > max(spare[i], spare[i + 1])
    assert pairs > 300


def test_a_run_of_equal_signatures_may_cross_batches():
    rng = np.random.default_rng(6)
    for _ in range(500):
        n = int(rng.integers(1, 30))
        rows = sorted(zip(rng.integers(0, 12, n).tolist(), rng.integers(0, 4, n).tolist(), strict=True))
        cuts = sorted(rng.integers(0, n + 1, 4).tolist())
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, n], strict=True)]
        batches = [pa.RecordBatch.from_pydict({"sig": pa.array([s for s, _ in p], pa.int64()), "k1": pa.array([k for _, k in p], pa.int64())}) for p in parts]
        got = sorted(x for b in jaccard_join.shared_batches(iter(batches)) for x in zip(*(b.column(i).to_pylist() for i in range(2)), strict=True))
        assert got == sorted(x for x in set(rows) if len({k for s, k in rows if s == x[0]}) > 1)


def test_join_odd_tables(odd, nothing):
    got = jaccard_join.linked_components(odd)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == 9 and (2, 1, 2) in rows and (1, 0, 1) in rows and (4, 0, 4) in rows and (None, 0, None) in rows
    assert jaccard_join.linked_components(nothing).count() == 0
    kept = jaccard_join.keep_first(odd)
    assert kept.columns == odd.columns and kept.count() == 7  # repeated rows leave one, rows without words stay


# ---- benchmark decontamination ----


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_hits(text, items):
    w, hit, found = plain_words(text), set(), set()
    for i, t in items:
        v = plain_words(t)
        n = min(10, len(v))
        for s in range(len(v) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[s : s + n]:
                    hit |= set(range(p, p + n))
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


def test_decontamination_matches_brute_force(docs, items, spark):
    r = random.Random(7)
    known = [(x["item_id"], x["text"]) for x in items.collect() if x["item_id"] is not None] + [(5, "the " * 30)]
    table = spark.createDataFrame(known, "item_id long, text string")
    long = known[0][1].split()
    texts = ["", None, "Short ITEM!", "short, and item", "the " * 12, " ".join(long), " ".join(long[:9]), " ".join(long[1:11]).upper(), "x " * 5 + ", ".join(long[2:]) + " y", " ".join(long[:10] + long[2:])]
    for _ in range(40):
        w = [f"v{r.randrange(50)}" for _ in range(r.randrange(0, 80))]
        at = r.randrange(len(w) + 1)
        a = r.randrange(3)
        texts.append(" ".join(w[:at] + long[a : a + r.randrange(6, 13)] + w[at:]))
    got = {x["doc_id"]: x for x in decontaminate.contamination(docs(texts), table).collect()}
    for i, t in enumerate(texts):
        assert (got[i]["n_words"], got[i]["n_hit"], sorted(got[i]["item_ids"])) == plain_hits(t, known), t
    clean = {x["doc_id"] for x in decontaminate.clean(docs(texts), table).collect()}
    assert clean == {i for i in got if not got[i]["n_hit"]}


def test_items_without_an_id_hit(docs, items):
    got = decontaminate.contamination(docs(["so no number here is clean", "nothing of it"]), items).orderBy("doc_id").collect()
    assert [(x["n_hit"], x["item_ids"]) for x in got] == [(3, []), (0, [])]


def test_decontamination_is_native(docs, items):
    plan = decontaminate.contamination(docs(["a b c"]), items)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_decontamination_odd_tables(odd, nothing, items, spark):
    assert decontaminate.digest(decontaminate.contamination(odd, items)).count() == 9
    assert decontaminate.contamination(nothing, items).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(odd, none).where("n_hit > 0").count() == 0
    assert decontaminate.clean(odd, items).columns == odd.columns and decontaminate.clean(odd, items).count() == 9


# ---- language model ----


def test_base_scores_match_brute_force(docs):
    r = random.Random(9)
    texts = [" ".join(r.choice(["The", "cat", "sat", "on", f"rare{r.randrange(400)}"]) for _ in range(r.randrange(0, 60))) for _ in range(120)] + [None, ""]
    counts, total = Counter(), 0
    toks = [[*re.findall(r"[^ \t-\r]+", (t or "").lower()), None] for t in texts]
    for i, w in enumerate(toks):
        if crc32(str(i).encode()) % 7 != 2:
            counts.update(w)
            total += len(w)
    got = {x["doc_id"]: x for x in lm_scoring.score(docs(texts)).collect()}
    for i, w in enumerate(toks):
        g = got[i]
        assert g["held_out"] == (crc32(str(i).encode()) % 7 == 2) and g["train_tokens"] == total
        assert (g["n_tokens"], g["n_known"]) == (len(w), sum(counts[x] > 0 for x in w))
        assert g["base_score"] == pytest.approx(sum(log10((counts[x] + 1) / (total + len(counts) + 1)) for x in w), abs=1e-9)
        assert g["score"] <= 0


def test_lm_tables_leave_no_shuffle_files(docs, monkeypatch):
    """The blocks of all tasks' tables are a table of their own, which is dropped."""
    written, dropped = {}, []
    keep = lm_scoring.cut
    monkeypatch.setattr(lm_scoring, "cut", lambda df, what: written.setdefault(what, keep(df, what)))
    monkeypatch.setattr(lm_scoring, "drop", lambda *tables: dropped.extend(tables), raising=False)
    tables = lm_scoring.train(docs(["the cat sat on the mat"] * 20).select("text"))[-1]
    blocks = written["lm-tables"]
    assert dropped == [blocks] and {r["part"] for r in blocks.select("part").distinct().collect()} <= set(range(len(tables))) and all(t.any() for t in tables)


def test_probabilities_add_up_and_order_matters(docs):
    """All one-word texts over a tiny alphabet hold less than 1, and text like the training's is likelier than shuffled letters."""
    text = "the cat sat on the mat and the dog sat on the log "
    scores = {x["doc_id"]: x["score"] for x in lm_scoring.score(docs([text * 20] * 30 + ["the cat sat on the log", "teh tac tas no eht gol"])).collect()}
    assert scores[30] > scores[31] and scores[30] > -40


def test_long_texts_go_on_learning():
    """Bits that the tables predict wrongly: each of 240,000 bits costs little once the weights have learnt."""
    n = 240_000
    tables = [np.full(1, (-256 << 2) | 3, "<i2") for _ in range(3)]
    values = np.concatenate([np.zeros(n // 2, np.uint8), np.ones(n // 2, np.uint8)])
    bits = lm_scoring.Bits(values, [np.zeros(n, np.int64) for _ in range(3)], np.zeros(n, bool), np.array([0, n]), np.array([0, n]))
    score = lm_scoring.mixed(bits, tables, lm_scoring.first_weights()[None].copy(), np.zeros((1, lm_scoring.LEVELS), np.float32))
    assert score[0] > -4600


def test_mixing_matches_a_plain_loop():
    """Texts of several lengths, one empty here, go on with their weights from one window to the next. No bit lies on a level's edge, where single precision would decide."""
    rng = np.random.default_rng(4)
    tables = [lm_scoring.packed(rng.integers(0, 40, (2, 64)).astype(float)) for _ in range(3)]
    start = lm_scoring.first_weights()
    sizes = [[300, 0, 128, 700, 5], [90, 0, 0, 257, 0]]
    n = len(sizes[0])
    weights, levels = np.repeat(start[None], n, 0), np.zeros((n, lm_scoring.LEVELS), np.float32)
    own, bias = [start.astype(float) for _ in range(n)], np.zeros((n, lm_scoring.LEVELS))
    for size in sizes:
        first = np.concatenate([[0], np.cumsum(size)])
        total = int(first[-1])
        bits = lm_scoring.Bits(rng.integers(0, 2, total).astype(np.uint8), [rng.integers(0, 64, total).astype(np.uint32) for _ in range(3)], rng.random(total) < 0.3, first, np.arange(total + 1))
        got = lm_scoring.mixed(bits, tables, weights, levels)
        for t in range(n):
            for a in range(first[t], first[t + 1], lm_scoring.STEP):
                slope, seen, off, room = np.zeros((lm_scoring.GATES, 4)), np.zeros(lm_scoring.GATES), np.zeros(lm_scoring.LEVELS), np.full(lm_scoring.LEVELS, 8.0)
                for b in range(a, min(a + lm_scoring.STEP, first[t + 1])):
                    cell = [int(tables[i][bits.slots[i][b]]) for i in range(3)]
                    x = np.array([*((v >> 2) / 256 for v in cell), 0.3])
                    gate = (cell[1] & 3) + 4 * (cell[2] & 3) + 16 * int(bits.spelt[b])
                    y, z = int(bits.values[b]), min(13.0, max(-13.0, float(x @ own[t][gate])))
                    assert abs(z - round(z)) > 1e-6
                    level = min(lm_scoring.LEVELS - 1, max(0, int((z + 12) * lm_scoring.LEVELS / 24)))
                    p1, p2 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-z - bias[t, level]))
                    p = (p1 + p2) / 2
                    assert abs(got[b] - np.log(p if y else 1 - p)) < 1e-4
                    slope[gate] += (y - p1) * x
                    seen[gate] += 1
                    off[level] += y - p2
                    room[level] += p2 * (1 - p2)
                own[t] = own[t] + lm_scoring.RATE / (seen + 200)[:, None] * slope
                bias[t] = np.clip(bias[t] + lm_scoring.LEVEL_RATE * off / room, -3, 3)
    assert np.abs(weights - np.array(own)).max() < 1e-4 and np.abs(levels - bias).max() < 1e-4


def test_phrases_follow_the_content():
    """Equal passages fall into equal phrases, whatever stands around them."""
    r = random.Random(8)
    passage = " ".join(f"p{r.randrange(999)}" for _ in range(200))
    texts = [passage, " ".join(f"q{r.randrange(999)}" for _ in range(37)) + " " + passage + " more", "", "one"]
    _, _, _, hashes, first = lm_scoring.tokens(pa.array(texts))
    named, ends, lead = lm_scoring.phrases(hashes, first)
    lead = [*lead, len(named)]
    sets = [set(named[a:b].tolist()) for a, b in zip(lead[:-1], lead[1:], strict=True)]
    assert len(sets[0] - sets[1]) <= 3 and len(sets[0]) > 10 and len(sets[2]) == 1 and len(sets[3]) >= 1
    assert ends[-1] == len(hashes) and set(first[1:].tolist()) <= set(ends.tolist())


def test_phrases_mix_as_worked_out_by_hand():
    rng = np.random.default_rng(3)
    size = [0, 1, 7, 40]
    first = np.concatenate([[0], np.cumsum(size)])
    logs, shares = -rng.random(first[-1]) * 30, rng.random(first[-1]) * (rng.random(first[-1]) < 0.5) * 1e-3
    got = lm_scoring.phrase_mix(logs, shares, first, 0.05)
    for i in range(len(size)):
        state, gate, want = [np.log(0.05 / 0.95), np.log(9.0)], 0, 0.0
        for j in range(first[i], first[i + 1]):
            w = 1 / (1 + np.exp(-state[gate]))
            p = w * shares[j] + (1 - w) * np.exp(logs[j])
            was = w * shares[j] / p
            want += np.log(p)
            state[gate] += lm_scoring.PHRASE_RATE * (was - w)
            gate = int(was > 0.5)
        assert got[i] == pytest.approx(want, abs=1e-9)


def test_a_copy_of_a_training_text_is_likelier(docs):
    """Held-out copies of what occurs once in training stand apart from fresh texts of the same kind."""
    r = random.Random(11)
    fresh = lambda: " ".join(f"w{r.randrange(300)}" for _ in range(120))
    held = [i for i in range(400) if crc32(str(i).encode()) % 7 == 2]
    texts = [fresh() for _ in range(400)]
    for k, i in enumerate(held[:20]):
        texts[i] = texts[next(j for j in range(i + 1, 400) if j not in held) if k % 2 else next(j for j in range(i - 1, -1, -1) if j not in held)]
    got = {x["doc_id"]: x["score"] / x["n_tokens"] for x in lm_scoring.score(docs(texts)).collect()}
    assert min(got[i] for i in held[:20]) > max(got[i] for i in held[20:])


def test_huffman_is_a_prefix_code():
    offsets, nodes, bits = lm_scoring.huffman(np.array([5, 9, 1, 1, 30, 2]))
    codes = ["".join(map(str, bits[a:b])) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert sum(2.0 ** -len(c) for c in codes) == 1 and not any(a != b and b.startswith(a) for a in codes for b in codes)


def test_bits_per_byte(docs):
    texts = ["the cat", "", None, "Éa b"]
    got = {x["doc_id"]: x for x in lm_scoring.score(docs(texts)).collect()}
    assert [got[i]["n_bytes"] for i in range(4)] == [7, 0, 0, 5]
    assert got[1]["bits_per_byte"] is None and got[0]["bits_per_byte"] == pytest.approx(-got[0]["score"] / log10(2) / 7)


def test_lm_odd_tables(odd, nothing):
    assert lm_scoring.score(odd).where("score is null or score > 0").count() == 0 and lm_scoring.score(odd).count() == 9
    assert lm_scoring.score(nothing).count() == 0


# ---- token counts ----


def test_counts_match_the_tokenizer(docs, odd, nothing):
    texts = ["", None, "hello world", "<|endoftext|>", "é" * 50, " ".join(f"w{i}" for i in range(5000))] * 7
    encode = token_counts.encoder(token_counts.load_ranks())
    for block in (64, 1 << 20):
        got = {x["doc_id"]: x["n_tokens"] for x in token_counts.count_tokens(docs(texts).repartition(3), block=block).collect()}
        assert got == {i: len(encode(t or "")) for i, t in enumerate(texts)}
    assert token_counts.count_tokens(odd).count() == 9 and token_counts.count_tokens(nothing).count() == 0


def test_separators_are_stitched(spark, tmp_path):
    ids = [9, 1, 1, 9, 9, 2, 2, 2, 2, 2, 2, 2, 9, 3, 3]
    name = str(tmp_path / "a.ids")
    np.array(ids, "<u2").tofile(name)
    files = spark.createDataFrame([(name, len(ids))], "file string, ids long")
    for block in (2, 4, 6, 100):
        got = token_counts.stitch(token_counts.scan_blocks(files, f"file://{tmp_path}", 9, block)).orderBy("ordinal").collect()
        assert [(r["n_tokens"], r["terminated"]) for r in got] == [(0, True), (2, True), (0, True), (7, True), (2, False)]


# ---- quality and toxicity ----


def test_quality_learns_and_sites_shrink(docs, spark, odd, nothing, labels):
    r = random.Random(3)
    words = ["river", "stone", "garden", "light", "quiet", "letter", "morning", "window"]
    good = lambda: " ".join(r.choice(words) for _ in range(60)).capitalize() + "."
    bad = lambda: " ".join(r.choice(words).upper() + "!!" for _ in range(60))
    texts = [bad() if i % 4 == 0 else good() for i in range(300)]
    got = {x["doc_id"]: x for x in quality.classify(docs(texts), labels).collect()}
    held = range(200, 300)
    assert np.mean([got[i]["predicted"] == (i % 4 != 0) for i in held]) == 1
    assert len({round(x["host_posterior"], 9) for x in got.values()}) == 3
    kept = {x["doc_id"] for x in quality.accepted(docs(texts), labels).collect()}
    assert kept == {i for i in got if got[i]["predicted"]}
    assert quality.classify(odd, labels).count() == 9 and quality.classify(nothing, labels).count() == 0
    assert quality.accepted(odd, labels).columns == odd.columns
    assert quality.classify(odd, labels.limit(0)).count() == 9


def example_rows(x, y):
    rows = [{"key": i, "y": int(y[i]), "doc_id": i, "terms": np.flatnonzero(v).tolist(), "counts": v[v > 0].tolist()} for i, v in enumerate(x)]
    return pa.Table.from_pylist(rows, pa.schema([*((c, pa.int64()) for c in ("key", "y", "doc_id")), ("terms", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32()))]))


@pytest.mark.parametrize(("block", "common", "m"), [(16, 20, 300), (64, 0, 300), (512, 768, 700), (8, 5, 5)])
def test_index_is_exact(monkeypatch, block, common, m):
    """Neighbours, votes and cosines as by a plain matrix product, whatever the blocks."""
    monkeypatch.setattr(toxicity, "BLOCK", block)
    monkeypatch.setattr(toxicity, "COMMON", common)
    monkeypatch.setattr(toxicity, "TOGETHER", 37)
    rng = np.random.default_rng(m + block)
    terms, k, asked = 900, 7, 100
    x = rng.integers(1, 9, (m, terms)) * (rng.random((m, terms)) < 0.05)
    x[1] = x[0] if m > 1 else x[1]  # a tie
    y = rng.random(m) < 0.4
    y[:2] = True, False
    n1 = int(y.sum())
    index = toxicity.index_of(example_rows(x, y).to_batches(max_chunksize=50), m, n1, n1 / m, 0.5)
    index.weigh()
    q = np.concatenate([x[: asked // 2], rng.integers(0, 3, (asked // 2, terms)) * (rng.random((asked // 2, terms)) < 0.03)])
    q[-1] = 0
    of, t = np.nonzero(q)
    row, entry, cosine = index.nearest(*toxicity.vectors(index, len(q), of, t.astype(np.uint64), q[q > 0]), k)
    idf = np.zeros(terms)
    idf[index.vocabulary.astype(int)] = index.idf
    full = [np.where(v > 0, (1 + np.log(np.maximum(v, 1))) * idf, 0) for v in (x, q)]
    full = [v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) for v in full]
    sims = full[1] @ full[0].T
    for i in range(len(q)):
        got, own = index.evidence[entry[row == i]], cosine[row == i]
        best = np.sort(sims[i][sims[i] > 0])[::-1][:k]
        assert np.allclose(own, best, atol=1e-5) and np.allclose(sims[i][got], own, atol=1e-5) and len(set(got)) == len(got)
    logits = index.vote(row, entry, cosine, len(q))
    for i in range(len(q)):
        e, c = entry[row == i], cosine[row == i]
        up = sum(v**2 / (1.05 - min(v, 1)) * np.log(2) * (y[index.evidence[j]] + n1 / m) / 2 for j, v in zip(e, c, strict=True)) + 0.05 * n1 / m
        down = sum(v**2 / (1.05 - min(v, 1)) * np.log(2) for v in c) + 0.05
        assert logits[i] == pytest.approx(np.log(up / (down - up)))


def test_toxicity_finds_marks_and_leaves_clean_texts(docs, spark, odd, nothing, labels):
    r = random.Random(5)
    words = [f"w{i}x" for i in range(200)]
    plain = lambda: [r.choice(words) for _ in range(40)]
    texts = [" ".join([*plain(), *(["vile", "scumbag"] if i % 5 == 0 else [])]) for i in range(300)]
    got = {x["doc_id"]: x for x in toxicity.classify(docs(texts), labels).collect()}
    assert all(got[i]["predicted"] == (i % 5 == 0) for i in range(300))
    assert all(0 <= x["score"] <= 1 and x["held_out"] == (crc32(str(i).encode()) % 5 == 0) for i, x in got.items())
    assert len(got[5]["evidence"]) > 0
    # labels of held-out rows change nothing
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {x["doc_id"]: x["score"] for x in toxicity.classify(docs(texts), turned).collect()} == {i: x["score"] for i, x in got.items()}
    assert toxicity.classify(odd, labels).count() == 9 and toxicity.classify(nothing, labels).count() == 0
    assert toxicity.classify(odd, labels.limit(0)).where("predicted = 1").count() == 0


def test_rare_insults_and_clean_examples_are_neighbours(docs, labels):
    r = random.Random(6)
    words = ["".join(r.choices("abcdefghij", k=6)) for _ in range(60)]
    insults = ["".join(r.choices("uvwxyz", k=4)) for _ in range(10)]  # each in four toxic examples at most
    texts = [" ".join([*r.choices(words, k=12), *([insults[i // 5 % 10]] * 3 if i % 5 == 0 else [])]) for i in range(300)]
    got = {x["doc_id"]: x for x in toxicity.classify(docs(texts), labels).collect()}
    assert all(len(got[i]["evidence"]) == toxicity.NEIGHBOURS for i in got)
    for i in range(200, 300, 5):
        assert insults[i // 5 % 10] in texts[got[i]["evidence"][0]]
    assert np.mean([got[i]["predicted"] == (i % 5 == 0) for i in range(200, 300)]) > 0.9


def test_word_hashes_follow_the_words():
    texts = ["A b\tc  É", "", "a B", " x ", " ", "É"]
    h, first = shingles.words(pa.array(texts))
    names = defaultdict(set)
    for i, t in enumerate(texts):
        words = re.findall(r"[^ \t-\r]+", t.translate({c: c + 32 for c in range(65, 91)}))
        assert len(words) == first[i + 1] - first[i]
        for w, x in zip(words, h[first[i] : first[i + 1]], strict=True):
            names[w].add(int(x))
    assert all(len(v) == 1 for v in names.values()) and len({next(iter(v)) for v in names.values()}) == len(names)


def test_equal_units_in_equal_contexts_are_laid_out_once(monkeypatch):
    r = random.Random(8)
    words = [f"Word{i}" for i in range(60)]
    text = " ".join(r.choice(words[:40]) if r.random() < 0.9 else r.choice(words) for _ in range(400))
    data, starts, ends, hashes, first = lm_scoring.tokens(pa.array([text + " " + text] * 20))
    common, times = np.unique(hashes, return_counts=True)
    code = lm_scoring.make_code(common[times > 400], times[times > 400], 50)
    symbols, known = lm_scoring.lookup(code, hashes)
    assert known.any() and not known.all()
    ctx = lm_scoring.contexts(code, symbols, known, first)
    units, _, held, _ = lm_scoring.units_of(code, data, starts, ends, symbols, known, ctx)
    bits = lm_scoring.bits_of(code, data, starts, ends, symbols, known, ctx, first)
    laid, ragged = [], lm_scoring.ragged
    monkeypatch.setattr(lm_scoring, "ragged", lambda offsets, lengths: laid.append(int(lengths.sum())) or ragged(offsets, lengths))
    for i in range(3):
        plain = np.bincount((bits.slots[i] << np.uint32(1)) | bits.values, minlength=2 * lm_scoring.SLOTS[i])
        assert (lm_scoring.counted(code, i, held[i], units) == plain).all()
    assert 0 < max(laid) < len(bits.values) / 20


def test_bits_laid_out_by_ranges_mix_as_all_at_once(monkeypatch):
    """Texts of several lengths, some spelt, from several parts: windows of few bits and few texts side by side give what all bits at once give, and learn the same."""
    r = random.Random(5)
    words = [f"Word{i}" for i in range(60)]
    texts = [" ".join(r.choice(words[:40]) if r.random() < 0.8 else r.choice(words) for _ in range(n)) for n in (400, 0, 3, 90, 1200, 40)]
    data, starts, ends, hashes, first = lm_scoring.tokens(pa.array(texts))
    common, times = np.unique(hashes, return_counts=True)
    rng = np.random.default_rng(2)
    tables = [lm_scoring.packed(rng.integers(0, 40, (2, s)).astype(float)) for s in lm_scoring.SLOTS]
    for code in (lm_scoring.make_code(common[times > 20], times[times > 20], 50), lm_scoring.make_code(common[:0], times[:0], 50)):
        marks = lm_scoring.path_marks(code, tables[0])
        learnt = lambda: (np.repeat(lm_scoring.first_weights()[None], len(texts), 0), np.zeros((len(texts), lm_scoring.LEVELS), np.float32))
        symbols, known = lm_scoring.lookup(code, hashes)
        want, got = learnt(), learnt()
        expected = lm_scoring.mixed(lm_scoring.bits_of(code, data, starts, ends, symbols, known, lm_scoring.contexts(code, symbols, known, first), first), tables, *want)
        parts = []
        for some in (texts[:3], texts[3:]):
            data_, starts_, ends_, hashes_, first_ = lm_scoring.tokens(pa.array(some))
            symbols_, known_ = lm_scoring.lookup(code, hashes_)
            parts.append(lm_scoring.laid_by_units(code, marks, data_, starts_, ends_, symbols_, known_, lm_scoring.contexts(code, symbols_, known_, first_), first_))
        with monkeypatch.context() as m:
            m.setattr(lm_scoring, "TOGETHER", 4)
            m.setattr(lm_scoring, "LAID", 1000)
            laid, ragged = [], lm_scoring.ragged
            m.setattr(lm_scoring, "ragged", lambda offsets, lengths: laid.append(int(lengths.sum())) or ragged(offsets, lengths))
            assert np.allclose(lm_scoring.mixed(lm_scoring.joined(parts), tables, *got), expected, atol=1e-3)
        assert max(laid) <= 1000 and all(np.allclose(a, b, atol=1e-3) for a, b in zip(got, want, strict=True))
