"""Operator 4: mixing sources to target weights (DataFrame functions only).

Documents hang in a tree of domain, language and source. A token budget comes down
from the root: each node's children share its budget in proportion to their
weights, a child that has less than its share (its tokens times the epochs
allowed) gives what it can, and its siblings share the shortage before anything
goes back to the level above. In closed form that is one sorted window a level:
children in order of capacity over weight are full up to some point, the rest get
the rest by weight. A leaf then takes whole seeded epochs and a token-prefix of
the next: rows are ordered by a seeded hash; buckets of that hash are summed, so
only the bucket on the border is ordered row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.llm.common import WORD_PATTERN, checkpointed, table

LEVELS = ("domain", "lang", "source")
#: Fixed defaults of the query: weights of nodes by level; any other node weighs 1.
WEIGHTS = {"domain": {"d0": 3, "d1": 2, "d2": 1, "d3": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 2}}
#: The order of a row is 60 bits of md5; the first 12 are its bucket.
ORDER_DIGITS, BUCKET_SHIFT = 15, 48


def token_count(text: Column) -> Column:
    """Words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def default_domain(source: Column) -> Column:
    """A source's domain: d and its number modulo 4; sources without a number are in d0."""
    return F.concat(F.lit("d"), (F.coalesce(F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("long"), F.lit(0)) % 4).cast("string"))


def seeded_order(seed: int, key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, ORDER_DIGITS), 16, 10).cast("long")


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(int(w))).otherwise(out)
    return out.cast("long")


def leaf_budgets(sizes: DataFrame, total: Column, weights: dict[str, dict[str, int]], epochs: int, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """levels, tokens, budget for each leaf of sizes (levels, tokens): the root's budget is the lesser of total and all capacity.

    Shares are rounded down to whole tokens, so that a level loses less than one
    token a child. A node of weight 0 gets nothing. Null names are nodes as well.
    """
    names = [F.coalesce(F.col(x), F.lit("")).alias(x) for x in levels]
    leaves = sizes.select(*names, "tokens").groupBy(*levels).agg(F.sum("tokens").alias("tokens"))
    capacity = F.sum(F.col("tokens") * epochs).cast("double")
    node = leaves.agg(F.least(total.cast("double"), F.coalesce(capacity, F.lit(0.0))).alias("budget"))
    for depth, level in enumerate(levels):
        above = list(levels[:depth])
        weighed = leaves.withColumn("w", _weight(level, weights).cast("double"))
        children = weighed.groupBy(*levels[: depth + 1]).agg(F.first("w").alias("w"), F.sum(F.when(F.col("tokens").isNotNull(), F.col("tokens") * epochs)).cast("double").alias("cap"))
        children = children.withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(0.0))
        # The root has one row, every other level is met by its own names.
        children = children.join(node, above) if above else children.withColumn("budget", _only(node))
        order = [F.when(F.col("w") > 0, F.col("cap") / F.col("w")), F.col(level)]
        span = W.partitionBy(*above) if above else W.partitionBy(F.lit(0))
        before = F.coalesce(F.sum("cap").over(span.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
        onward = F.sum("w").over(span.orderBy(*order).rowsBetween(W.currentRow, W.unboundedFollowing))
        children = children.withColumn("left", F.col("budget") - before).withColumn("onward", onward)
        share = F.col("left") * F.col("w") / F.col("onward")
        # Once a child is not full, none after it is; what is left and the weights as of there set the common rate.
        children = children.withColumn("full", (F.col("w") == 0) | (F.col("cap") <= share))
        first = F.min(F.when(~F.col("full"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col("left"), F.col("onward")))).over(span)
        rate = first["left"] / first["onward"]
        children = children.withColumn("got", F.when(F.col("full"), F.col("cap")).otherwise(F.floor(F.col("w") * rate + F.lit(1e-6)).cast("double")))
        node = children.select(*levels[: depth + 1], F.col("got").alias("budget"))
    return leaves.join(node, list(levels)).select(*levels, "tokens", F.col("budget").cast("long").alias("budget"))


def _only(node: DataFrame) -> Column:
    return node.select("budget").scalar()


def mix_sources(
    docs: DataFrame,
    share: float = 0.5,
    epochs: int = 2,
    seed: int = 17,
    weights: dict[str, dict[str, int]] | None = None,
    domain: Column | None = None,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """Add domain, n_tokens and copies (how many epochs take the row, at least 1) to the rows chosen; other rows go.

    The budget is share of all words. In each leaf whole epochs come first; the
    rest of its budget takes the rows, in order of a hash of seed and key, whose
    running sum of words doesn't exceed it. Null langs and sources are nodes named
    ''; rows without words are never chosen; rows that repeat a key are chosen
    alike. Other columns stay, those named like added ones are replaced. Empty
    tables give none.
    """
    weights = WEIGHTS if weights is None else weights
    domain = default_domain(F.col("source")) if domain is None else F.coalesce(domain, F.lit(""))
    leaf = ["_d", "_l", "_s"]
    rows = docs.drop("domain", "n_tokens", "copies").select(
        "*", domain.alias("_d"), F.coalesce("lang", F.lit("")).alias("_l"), F.coalesce("source", F.lit("")).alias("_s"), token_count(F.col(text)).alias("n_tokens"), seeded_order(seed, F.col(key)).alias("_order")
    )
    rows = rows.filter("n_tokens > 0").withColumn("_bucket", F.shiftright("_order", BUCKET_SHIFT))
    # All that the budgets need of the corpus: words by leaf and bucket, summed before the shuffle; 4096 rows a leaf at most.
    sums = checkpointed(rows.groupBy(*leaf, "_bucket").agg(F.sum("n_tokens").alias("m")))
    sizes = sums.groupBy(*leaf).agg(F.sum("m").alias("tokens")).toDF(*LEVELS, "tokens")
    total = sizes.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * share).alias("budget"))
    budgets = leaf_budgets(sizes, _only(total), weights, epochs).toDF(*leaf, "tokens", "budget")
    upto = F.coalesce(F.sum("m").over(W.partitionBy(*leaf).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    met = sums.withColumn("before", upto).join(budgets, leaf).withColumn("whole", F.floor(F.col("budget") / F.col("tokens")))
    met = met.withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
    # One row a leaf: whole epochs, the bucket in which the prefix ends (those before it are in), and the room there.
    border = F.max_by(F.struct("_bucket", (F.col("rest") - F.col("before")).alias("room")), F.when(F.col("before") <= F.col("rest"), F.col("_bucket")))
    plan = checkpointed(met.groupBy(*leaf).agg(F.first("whole").alias("whole"), border.alias("at")))
    joined = rows.join(plan, leaf)
    names = [c for c in rows.columns if not c.startswith("_")]
    kept = [*[c for c in names if c != "n_tokens"], F.col("_d").alias("domain"), "n_tokens"]
    clear = joined.filter("_bucket <> at._bucket").withColumn("copies", (F.col("whole") + F.when(F.expr("_bucket < at._bucket"), 1).otherwise(0)).cast("int"))
    running = F.sum("n_tokens").over(W.partitionBy(*leaf).orderBy("_order").rangeBetween(W.unboundedPreceding, W.currentRow))
    last = joined.filter("_bucket = at._bucket").withColumn("upto", running)
    last = last.withColumn("copies", (F.col("whole") + F.when(F.col("upto") <= F.col("at.room"), 1).otherwise(0)).cast("int"))
    return clear.select(*kept, "copies").unionByName(last.select(*kept, "copies")).filter("copies > 0")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "domain", "lang", "source", "n_tokens", "copies")


def _sql_case(level: str) -> str:
    return "CASE " + level + "".join(f" WHEN '{k}' THEN {w}" for k, w in WEIGHTS[level].items()) + " ELSE 1 END"


def _sql_level(depth: int) -> str:
    """SQL of one level of leaf_budgets: node{depth} from node{depth - 1}."""
    names, level = ", ".join(LEVELS[: depth + 1]), LEVELS[depth]
    by = f"PARTITION BY {', '.join(LEVELS[:depth])}" if depth else ""
    order = f"ORDER BY cap / w, {level}"
    join = f"JOIN node{depth} USING ({', '.join(LEVELS[:depth])})" if depth else "CROSS JOIN node0"
    return f"""kids{depth} AS (
  SELECT {names}, {_sql_case(level)}::DOUBLE AS w, sum(tokens * 2)::DOUBLE AS cap FROM leaves GROUP BY ALL
), seq{depth} AS (
  SELECT *, budget - coalesce(sum(cap) OVER ({by} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER ({by} {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onward
  FROM kids{depth} {join}
), rate{depth} AS (
  SELECT *, first_value(rest / onward) OVER ({by} ORDER BY cap <= rest * w / onward, cap / w, {level}) AS rate FROM seq{depth}
), node{depth + 1} AS (
  SELECT {names}, CASE WHEN cap <= rest * w / onward THEN cap ELSE floor(w * rate + 1e-6) END AS budget FROM rate{depth}
)"""


SQL = rf"""
WITH rows_ AS (
  SELECT *, ('0x' || substr(o, 1, 15))::BIGINT AS ord FROM (
    SELECT doc_id, 'd' || (coalesce(try_cast(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS BIGINT), 0) % 4) AS domain, lang, source,
      len(regexp_extract_all(text, '[^ 	-]+'))::BIGINT AS n_tokens, md5('17:' || doc_id) AS o FROM documents) WHERE n_tokens > 0
), leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM rows_ GROUP BY ALL),
node0 AS (SELECT least(floor(sum(tokens) * 0.5), sum(tokens * 2))::DOUBLE AS budget FROM leaves),
{_sql_level(0)}, {_sql_level(1)}, {_sql_level(2)},
runs AS (
  SELECT r.*, tokens, budget::BIGINT AS budget, sum(n_tokens) OVER (PARTITION BY r.domain, r.lang, r.source ORDER BY ord) AS upto
  FROM rows_ r JOIN leaves USING (domain, lang, source) JOIN node3 USING (domain, lang, source)
)
SELECT doc_id, domain, lang, source, n_tokens, (budget // tokens + CASE WHEN upto <= budget % tokens THEN 1 ELSE 0 END)::INT AS copies
FROM runs WHERE budget // tokens + CASE WHEN upto <= budget % tokens THEN 1 ELSE 0 END > 0
"""
