import base64
import hashlib
import io
import os
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.llm import embedding_dedup, mixing, queries, warc
from tests.oracle import DATA, connect, normal

PAGES = "page_id long, url string, html string"


# ---- WARC ----


def test_round_trip_and_revisits(spark, odd):
    big = "é" * 700_000
    rows = [(1, "http://a", "<p>x</p>"), (5, "http://b\r\nX: y", "<p>x</p>"), (3, None, "<p>x</p>"), (2, "http://c", big), (4, "http://d", None), (6, "http://e", ""), (None, "http://f", "only"), (5, "http://b\r\nX: y", "<p>x</p>")]
    df = spark.createDataFrame(rows, PAGES).withColumn("sha1", F.lit("clash"))
    got = sorted((tuple(r) for r in warc.records(df).collect()), key=str)
    first = {"<p>x</p>": 5, big: 2, "": 6, "only": None}
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        top = first[html or ""]
        want.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if page == top else "revisit", None if page == top else top))
    assert got == sorted(want, key=str)
    assert warc.records(df.limit(0)).count() == 0
    assert {r["record_type"] for r in warc.records(df, least=10**7).collect()} == {"response"}


def test_chunks_rebuild_payloads(spark):
    rows = [(i, f"http://p/{i}", "".join(random.Random(i).choices("abcdefghij", k=i * 5000))) for i in range(6)]
    path, files = warc.archive(spark.createDataFrame(rows, PAGES).coalesce(2))
    chunks = warc.read(spark, files, chunk=4096, shared=path).orderBy("page_id", "chunk_no").collect()
    by = defaultdict(list)
    for c in chunks:
        assert len(c["data"]) <= 4096
        by[c["page_id"]].append(c)
    for i, _, html in rows:
        data = b"".join(bytes(c["data"]) for c in by[i])
        assert data == html.encode() and by[i][-1]["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert [c["chunk_no"] for c in by[i]] == list(range(len(by[i])))
        assert by[i][0]["digest_so_far"] == base64.b32encode(hashlib.sha1(data[:4096]).digest()).decode()


def test_a_damaged_archive_is_told():
    import zlib

    head = warc.record_head(1, "http://a", "A" * 32, 3, None, False)
    gz = zlib.compressobj(1, zlib.DEFLATED, 31)
    data = gz.compress(head + b"abc" + warc.END) + gz.flush()
    with pytest.raises(ValueError):
        list(warc.read_file("x", io.BytesIO(data), 1 << 20, True))


# ---- vectors ----


def vectors(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, label int")


def plain_links(x, threshold=0.95):
    x = np.array(x, np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    c = x @ x.T >= threshold
    np.fill_diagonal(c, False)
    comp = np.arange(len(x))
    while True:
        new = np.minimum(comp, np.where(c, comp, len(x)).min(1))
        if (new == comp).all():
            return c.sum(1), comp
        comp = new


def test_links_match_brute_force(spark):
    rng = np.random.default_rng(1)
    x = [rng.normal(size=24) for _ in range(400)]
    for i in range(25):
        x += [x[i] + rng.normal(0, 0.06, 24) for _ in range(3)]
    hub = rng.normal(size=24)
    x += [hub + rng.normal(0, 0.03, 24) for _ in range(150)] + [hub] * 40 + [x[7] * 5]
    links, comp = plain_links(x)
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(vectors(spark, x)).collect()}
    assert [got[i]["component_id"] for i in range(len(x))] == comp.tolist()
    assert [got[i]["n_links"] for i in range(len(x))] == links.tolist()
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
    audit = embedding_dedup.audit(vectors(spark, x), embedding_dedup.near_duplicates(vectors(spark, x))).first()
    assert audit["queries"] == len(range(0, len(x), 20)) and audit["recall"] == 1


def test_full_lists_keep_no_clusters_apart(spark):
    """Two tight clusters that link with each other; each vector's list is full of its own cluster's."""
    rng = np.random.default_rng(4)
    a, b = np.eye(64)[:2]
    angle = np.arccos(0.965)
    x = np.concatenate([c + rng.normal(0, 0.0088, (300, 64)) for c in (a, np.cos(angle) * a + np.sin(angle) * b)])
    links, comp = plain_links(x)
    assert set(comp) == {0} and links.min() > 400
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(vectors(spark, x)).collect()}
    assert [got[i]["n_links"] for i in range(len(x))] == links.tolist()
    assert sum(r["kept"] for r in got.values()) == 1


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    df = vectors(spark, [None, [], [0, 0], [nan, 1], [inf, 1], [None, 1], [1, 0], [1, 0], [2, 0, 0], [1, 0], [3e38, 0]], [0, 1, 2, 3, 4, 5, 6, 7, 8, None, 10])
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df.withColumn("c", F.lit(1))).collect()}
    assert all(got[i] == (0, i, True) for i in (0, 1, 2, 3, 4, 5, 8))
    assert got[6] == (3, 6, True) and got[7] == (3, 6, False) and got[None] == (3, 6, False) and got[10] == (3, 6, False)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


# ---- mixing ----


def test_shortages_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "p", 10), ("a", "x", "q", 1000), ("a", "y", "r", 50), ("b", "x", "s", 1000)], "domain string, language string, origin string, tokens long")
    got = {r["origin"]: r["got"] for r in mixing.budgets(leaves, 400.0, 1, {}).collect()}
    # each domain 200; a: y holds 50 so x gets 150; of these p holds 10 so q gets 140; nothing leaves a
    assert {k: round(v, 6) for k, v in got.items()} == {"p": 10, "q": 140, "r": 50, "s": 200}
    got = {r["origin"]: r["got"] for r in mixing.budgets(leaves, 1200.0, 1, {"domain": {"a": 0.0}}).collect()}
    assert got == {"s": 1000}
    got = {r["origin"]: r["got"] for r in mixing.budgets(leaves, 5000.0, 2, {}).collect()}
    assert got == {"p": 20, "q": 2000, "r": 100, "s": 2000}


def test_prefixes_fit_and_are_the_longest(docs):
    r = random.Random(2)
    df = docs([" ".join("w" for _ in range(r.randrange(0, 40))) for _ in range(900)])
    rows, leaves = mixing.plan(df, share=0.5)
    plan = {(x["domain"], x["language"], x["origin"]): x for x in leaves.collect()}
    by = defaultdict(list)
    for x in rows.collect():
        by[(x["domain"], x["language"], x["origin"])].append(x)
    drawn = {x["doc_id"]: x["copies"] for x in mixing.mix(df, share=0.5).collect()}
    total = sum(x["n_tokens"] for v in by.values() for x in v)
    assert 0.4 * total < sum(drawn.get(x["doc_id"], 0) * x["n_tokens"] for v in by.values() for x in v) <= 0.5 * total
    for leaf, members in by.items():
        p = plan[leaf]
        order = sorted(members, key=lambda x: hashlib.md5(f"{mixing.SEED}:{p['times']}:{x['doc_id']}".encode()).hexdigest())
        picked = [drawn.get(x["doc_id"], 0) - p["times"] for x in order]
        assert picked == sorted(picked, reverse=True)  # a prefix
    again = {x["doc_id"]: x["copies"] for x in mixing.mix(df.repartition(7), share=0.5).collect()}
    assert again == drawn


def test_mixing_odd_tables(odd, nothing):
    assert mixing.mix(odd).where("copies <= 0").count() == 0 and mixing.mix(nothing).count() == 0
    assert mixing.select(odd).columns == [*odd.columns, "copies"]
    assert mixing.select(odd, share=1.0, epochs=1).count() == mixing.mix(odd, share=1.0, epochs=1).count()


def test_token_counts_of_words(spark):
    df = spark.createDataFrame([(t,) for t in ("", " ", "a", " a  b\t", None, "\n")], "t string")
    assert [r[0] for r in df.select(mixing.token_count(F.col("t"))).collect()] == [0, 0, 1, 2, 0, 0]


# ---- the registered queries ----


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, DATA)
    source = {"op7": "embeddings", "op10": "pages"}.get(name.split("_")[0], "documents")
    rows = spark.read.parquet(f"{DATA}/{source}.parquet").count()
    if not name.startswith("op4"):
        assert got.count() == rows
    if name in queries.ORACLES:
        assert normal(got.toPandas()) == normal(connect(DATA).execute(queries.ORACLES[name]).df())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
def test_pipeline(spark, odd):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, DATA)
        assert out.columns == docs.columns + (["copies"] if name == "mixing" else [])
        assert 0 < out.count() <= at.count()
        at = out.cache()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "mixing"]


CLASHES = ("__hit", "__key", "__r1", "__r2", "__text", "__added", "__times", "__limit", "__copies", "__doc", "doc", "e", "p", "posterior", "r1", "added", "limit", "times", "copies", "n_hit", "domain", "odd name.with`marks")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
def test_stages_with_odd_tables(spark, odd, nothing):
    """Columns of any name pass through, rows stay whole, and empty tables stay empty."""
    import corpus_pipeline

    clash = odd.withColumns({c: F.concat_ws(":", F.lit(c), "doc_id") for c in CLASHES})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, clash, DATA)
        assert sorted(out.columns) == sorted(clash.columns)
        rows = out.collect()
        assert 0 < len(rows) <= 9
        for r in rows:
            assert all(r[c] == ":".join([c, *([] if r["doc_id"] is None else [str(r["doc_id"])])]) for c in CLASHES if (name, c) != ("mixing", "copies"))
        assert stage(spark, nothing, DATA).count() == 0


def test_smallest_takes_rows_by_their_hashes(spark):
    from furrow.llm.common import smallest

    rows = spark.range(5000).withColumn("k", F.when(F.col("id") < 600, F.lit(-1)).otherwise(F.col("id")))
    for most in (0, 1, 37, 3000, 4400, 4401, 5000, 9000):
        got = {r["k"] for r in smallest(rows, most, "k").collect()}
        order = [r["k"] for r in rows.groupBy("k").count().orderBy(F.shiftrightunsigned(F.xxhash64("k"), 1)).collect()]
        n = len(got)
        assert got == set(order[:n])
        size = sum(600 if k == -1 else 1 for k in got)
        assert size <= most and (n == len(order) or size + (600 if order[n] == -1 else 1) > most)
