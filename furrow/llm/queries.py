"""The queries of this subpackage: one opN_<name> for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from furrow.llm import decontaminate, embedding_dedup, jaccard_join, lm_scoring, mixing, pii, quality, token_counts, toxicity, warc
from furrow.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.extract(table(spark, sf_dir, "documents")))


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.records(table(spark, sf_dir, "pages"))


#: Base32 digit i of a SHA-1 takes five bits from two neighbouring hexadecimal digits.
BASE32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
ORACLES["op10_warc"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, lower(sha1(coalesce(html, ''))) AS h FROM pages),
g AS (SELECT h, max(page_id) AS responder FROM p GROUP BY h)
SELECT p.page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr({BASE32}, 1 + CAST(((
    (instr('0123456789abcdef', substr(p.h, 1 + CAST((5 * i) // 4 AS INT), 1)) - 1) * 16
    + greatest(instr('0123456789abcdef', substr(p.h || '0', 2 + CAST((5 * i) // 4 AS INT), 1)) - 1, 0)) >> CAST(3 - (5 * i) % 4 AS INT)) & 31 AS INT), 1)), '') AS payload_digest,
  CASE WHEN p.page_id = responder THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id <> responder THEN responder END AS refers_to
FROM p JOIN g USING (h)
"""


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


ORACLES["op5_decontaminate"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS p
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT rid, s, n, array_to_string(w[s:s + n - 1], ' ') AS p FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, ns WHERE len(w) >= n)),
hit AS (SELECT dw.rid, dw.s, dw.n, iw.item_id FROM dw JOIN iw USING (n, p)),
pos AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS q FROM (SELECT DISTINCT rid, s, n FROM hit)) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS t FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""


@query
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked_components(table(spark, sf_dir, "documents"))


ORACLES["op2_jaccard_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = d.doc_id
"""


@query
def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLES["op7_embedding_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, CAST(m.c AS BIGINT) AS component_id, e.vec_id = m.c AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id JOIN m ON m.a = e.vec_id
"""


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def share_sql(name: str, nodes: str, parent: str) -> str:
    """One level of budgeting: nodes has parent's columns, name, weight, cap and amount."""
    over = f"PARTITION BY {parent}" if parent else ""
    return f"""
{name}_o AS (SELECT *, cap / weight AS f, coalesce(sum(cap) OVER ({over} ORDER BY cap / weight, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c0,
  sum(weight) OVER ({over} ORDER BY cap / weight, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w0 FROM ({nodes}) WHERE weight > 0),
{name}_f AS (SELECT *, c0 + f * w0 <= amount + 1e-6 AS isfull FROM {name}_o),
{name}_t AS (SELECT *, sum(CASE WHEN isfull THEN cap ELSE 0 END) OVER ({over}) AS taken, sum(CASE WHEN isfull THEN 0 ELSE weight END) OVER ({over}) AS rest FROM {name}_f),
{name} AS (SELECT *, CASE WHEN isfull THEN cap ELSE weight * (amount - taken) / rest END AS got FROM {name}_t)"""


ORACLES["op4_mixing"] = rf"""
WITH r AS (SELECT doc_id, 'domain' || coalesce(TRY_CAST(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS BIGINT) % 4, 0) AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS BIGINT) AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM r GROUP BY ALL),
total AS (SELECT floor(sum(tokens) * CAST(0.6 AS DOUBLE)) AS budget FROM leaf),
{share_sql("a", "SELECT domain, domain AS name, CAST(CASE domain WHEN 'domain0' THEN 4 WHEN 'domain1' THEN 3 WHEN 'domain2' THEN 2 WHEN 'domain3' THEN 1 ELSE 1 END AS DOUBLE) AS weight, sum(tokens) * 2 AS cap, any_value(budget) AS amount FROM leaf, total GROUP BY domain", "").strip()},
{share_sql("b", "SELECT leaf.domain, lang, lang AS name, CAST(1 AS DOUBLE) AS weight, sum(tokens) * 2 AS cap, any_value(a.got) AS amount FROM leaf JOIN a USING (domain) GROUP BY leaf.domain, lang", "domain").strip()},
{share_sql("c", "SELECT leaf.domain, leaf.lang, source, source AS name, CAST(1 AS DOUBLE) AS weight, sum(tokens) * 2 AS cap, any_value(b.got) AS amount FROM leaf JOIN b USING (domain, lang) GROUP BY leaf.domain, leaf.lang, source", "domain, lang").strip()},
g AS (SELECT leaf.*, CASE WHEN tokens = 0 THEN 1 ELSE CAST(floor((got + 1e-6) / tokens) AS BIGINT) END AS times, floor(got + 1e-6) AS whole FROM leaf JOIN c USING (domain, lang, source)),
o AS (SELECT r.*, g.times, CASE WHEN tokens = 0 THEN 0 ELSE whole - times * tokens END AS rest, md5('17:' || CAST(g.times AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM r JOIN g USING (domain, lang, source)),
p AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h) AS run FROM o)
SELECT doc_id, domain, lang, source, n_tokens, CAST(times + CASE WHEN rest > 0 AND run <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM p WHERE times + CASE WHEN rest > 0 AND run <= rest THEN 1 ELSE 0 END > 0
"""


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))
