"""Mixing sources to target weights by hierarchical budgeting.

Documents hang on a tree: domain, language, source. The token budget runs from the root to the leaves. A
node shares what it gets among its children by their weights; no child gets more than its leaves hold
(their tokens times the epochs that a leaf may be read), and what a child can't take goes to its siblings
in proportion to theirs. As a node's own limit is what its leaves hold together, a shortage passes to the
node's siblings only when all of its own children are full: siblings before ancestors.

A leaf reads whole epochs as often as its budget allows and then a prefix of one more, in an order that
hashes of seed, epoch and id give: the longest prefix of that order whose tokens fit (equal ids come
together or not at all). A prefix is all hashes below a limit; it is found by sums over hash buckets, two
levels of 256, and over the rows of one bucket at last, so no leaf passes through one task.

Edge cases: null texts have no tokens; a null language or source is ""; nodes without a weight weigh 1,
those with weight 0 get nothing; documents without tokens come with any prefix that reaches them; a leaf
without tokens is read once in whole, it costs nothing; repeated rows and null ids (as the id "") share a
hash; an empty table gives an empty result; other columns pass through select() whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.common import cut, whole

#: Target weights of the domains, and the share of the corpus's tokens to be drawn.
WEIGHTS = {"domain0": 4.0, "domain1": 3.0, "domain2": 2.0, "domain3": 1.0}
SHARE, EPOCHS, SEED = 0.6, 2, 17
LEVELS = ("domain", "language", "origin")
SPACES = r"[ \t\n\x0B\f\r]+"


def domain_of(source: Column) -> Column:
    """The default domain of a source: its number modulo four."""
    return F.concat(F.lit("domain"), F.coalesce(F.try_to_number(F.regexp_extract(source, "([0-9]{1,9})$", 1), F.lit("999999999")).cast("long") % 4, F.lit(0)).cast("string"))


def token_count(text: Column) -> Column:
    words = F.split(text, SPACES)
    return F.coalesce(F.size(words) - F.when(F.element_at(words, 1) == "", 1).otherwise(0) - F.when((F.size(words) > 1) & (F.element_at(words, -1) == ""), 1).otherwise(0), F.lit(0)).cast("long")


def leaves_of(docs: DataFrame) -> DataFrame:
    """docs' ids and leaves: (doc_id, domain, language, origin) and text."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", domain_of(source).alias("domain"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("language"), source.alias("origin"))


def weight_of(level: str, name: Column, weights: dict[str, dict[str, float]]) -> Column:
    out = F.lit(1.0)
    for k, v in weights.get(level, {}).items():
        out = F.when(name == k, F.lit(float(v))).otherwise(out)
    return out


def share_out(children: DataFrame, parent: list[str]) -> DataFrame:
    """children (…, weight, cap, amount of the parent) with `got`: the amount shared by weight, none above its cap.

    In the order of cap / weight the children that fill up come first, and prefix sums say which do.
    """
    order = Window.partitionBy(*parent).orderBy("full_at", "name") if parent else Window.partitionBy(F.lit(0)).orderBy("full_at", "name")
    whole = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    rows = children.where("weight > 0").withColumn("full_at", F.col("cap") / F.col("weight"))
    rows = rows.withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("full", F.expr("before + full_at * open <= amount + 1e-6"))
    rows = rows.withColumn("taken", F.sum(F.expr("if(full, cap, 0d)")).over(whole)).withColumn("rest", F.sum(F.expr("if(full, 0d, weight)")).over(whole))
    return rows.withColumn("got", F.expr("if(full, cap, weight * (amount - taken) / rest)")).drop("full_at", "before", "open", "full", "taken", "rest")


def budgets(leaves: DataFrame, budget: float, epochs: int, weights: dict[str, dict[str, float]]) -> DataFrame:
    """leaves (domain, language, origin, tokens) with `got`, the tokens each may draw."""
    capped = leaves
    for i in range(len(LEVELS)):
        own = weight_of(LEVELS[i], F.col(LEVELS[i]), weights)
        capped = capped.withColumn(f"w{i}", own)
    usable = capped.where(" and ".join(f"w{i} > 0" for i in range(len(LEVELS))))
    amounts = None
    for i, level in enumerate(LEVELS):
        parent, own = list(LEVELS[:i]), list(LEVELS[: i + 1])
        nodes = usable.groupBy(*own).agg((F.sum("tokens") * float(epochs)).alias("cap"), F.max(f"w{i}").alias("weight")).withColumn("name", F.col(level))
        nodes = nodes.withColumn("amount", F.lit(float(budget))) if amounts is None else nodes.join(amounts, parent)
        amounts = share_out(nodes, parent).select(*own, F.col("got").alias("amount"))
    return leaves.join(amounts.withColumnRenamed("amount", "got"), list(LEVELS))


def order_of(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def limits(rows: DataFrame) -> DataFrame:
    """For each leaf the limit of its prefix: rows (leaf, h, n_tokens, rest) with h below it fit.

    Each level sums up buckets of the next two hexadecimal digits and goes on in the first bucket that doesn't fit.
    """
    leaf = list(LEVELS)
    inside = rows
    for level in range(2):
        bucket = F.substring("h", 2 * level + 1, 2)
        sums = inside.groupBy(*leaf, bucket.alias("b")).agg(F.sum("n_tokens").alias("t"), F.max("rest").alias("rest"))
        run = F.sum("t").over(Window.partitionBy(*leaf).orderBy("b"))
        sums = sums.withColumn("run", run)
        over = sums.where("run > rest").groupBy(*leaf).agg(F.min(F.struct("b", (F.col("rest") - F.col("run") + F.col("t")).alias("left"))).alias("first")).select(*leaf, F.col("first.b").alias("b"), F.col("first.left").alias("left"))
        inside = cut(inside.join(over, leaf).where(bucket == F.col("b")).drop("b", "rest").withColumnRenamed("left", "rest"), "mix-bucket")
    run = F.sum("n_tokens").over(Window.partitionBy(*leaf, F.substring("h", 1, 4)).orderBy("h"))
    return inside.withColumn("run", run).where("run > rest").groupBy(*leaf).agg(F.min("h").alias("limit"))


def plan(docs: DataFrame, weights: dict[str, dict[str, float]] | None = None, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(rows, leaves): doc_id, leaf and n_tokens of each row of docs; and each leaf's whole epochs `times` and the `limit` below which hashes are read once more (null: all)."""
    weights = {"domain": WEIGHTS} if weights is None else weights
    rows = cut(leaves_of(docs).withColumn("n_tokens", token_count(F.col("text"))).drop("text"), "mix-rows")
    leaves = cut(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "mix-leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    got = budgets(leaves, float(int(total * share)), epochs, weights)
    got = got.withColumn("times", F.expr("if(tokens = 0, 1L, cast(floor((got + 1e-6) / tokens) as bigint))")).withColumn("rest", F.expr("if(tokens = 0, 0L, cast(floor(got + 1e-6) as bigint) - times * tokens)"))
    got = cut(got.select(*LEVELS, "tokens", "times", "rest"), "mix-budgets")
    drawn = rows.join(got.where("rest > 0"), list(LEVELS)).withColumn("h", order_of(seed, F.col("times"), F.col("doc_id"))).select(*LEVELS, "h", "n_tokens", "rest")
    got = got.join(limits(drawn), list(LEVELS), "left")
    return rows, cut(got.select(*LEVELS, "times", F.when(F.col("rest") > 0, F.coalesce("limit", F.lit("g"))).otherwise(F.lit("")).alias("limit")), "mix-plan")


def drawn_copies(seed: int) -> Column:
    return (F.col("times") + F.when(order_of(seed, F.col("times"), F.col("doc_id")) < F.col("limit"), 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, seed: int = SEED, **how) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, copies of the documents that are drawn; copies says how often."""
    rows, leaves = plan(docs, seed=seed, **how)
    out = rows.join(leaves, list(LEVELS)).withColumn("copies", drawn_copies(seed)).where("copies > 0")
    return out.select("doc_id", "domain", F.col("language").alias("lang"), F.col("origin").alias("source"), "n_tokens", "copies")


def select(docs: DataFrame, seed: int = SEED, copies: str = "copies", **how) -> DataFrame:
    """The rows of docs that are drawn, with all their columns but one named as `copies`, which now says how often each is drawn. The narrow plan meets them; texts aren't shuffled while it is small."""
    _, leaves = plan(docs, seed=seed, **how)
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    keys = {"domain": domain_of(source), "language": F.coalesce(F.col("lang").cast("string"), F.lit("")), "origin": source}
    named = docs.select(whole(docs.drop(copies)).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), *(v.alias(k) for k, v in keys.items()))
    out = named.join(leaves, list(keys)).withColumn(copies, drawn_copies(seed)).where(F.col(copies) > 0)
    return out.select("doc.*", copies)
