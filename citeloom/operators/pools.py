"""Judgement pools: candidates, expansion by model judges, intersection of several judges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions import text as T
from citeloom.operators.storage import write_json_atomic

TRIPLE = ["qa_id", "sentence_id", "pmid"]
KEY = [*TRIPLE, "class"]
SUPPORTS = ("support", "partial_support")
CONTRADICTS = ("contradict", "partial_contradict")


def novel_triples(submission: DataFrame, qrels: DataFrame) -> DataFrame:
    """Cited triples that nobody has judged."""
    return submission.select(*TRIPLE).distinct().join(qrels.select(*TRIPLE), TRIPLE, "left_anti")


def candidate_triples(retrieved: list[DataFrame], human: DataFrame, top_k: int) -> DataFrame:
    """Triples in the first top_k of any ranking, less those that humans judged."""
    every = reduce(DataFrame.unionByName, [r.filter(F.col("rank") <= top_k).select(*TRIPLE) for r in retrieved])
    return every.distinct().join(human.select(*TRIPLE), TRIPLE, "left_anti")


def resume(todo: DataFrame, done: DataFrame) -> DataFrame:
    """Triples still to judge: every finished record counts, whatever its label."""
    return todo.join(done.select(*TRIPLE), TRIPLE, "left_anti")


def expanded_pool(human: DataFrame, judged: DataFrame) -> DataFrame:
    """Human rows (source human if none) and the judge's positives with source and confidence (4 digits)."""
    cols = [*KEY, "relevance", "source", "confidence"]
    h = human.withColumn("source", F.coalesce("source", F.lit("human"))).withColumn("relevance", F.coalesce("relevance", F.lit(1))).select(*cols)
    j = judged.withColumn("class", T.label_to_class(F.col("label"))).filter("class is not null")
    return h.unionByName(j.select(*KEY, F.lit(1).alias("relevance"), F.col("backend").alias("source"), F.round("confidence", 4).alias("confidence")))


def write_pool(human: DataFrame, judged: DataFrame, path: str, **meta) -> int:
    """The expanded pool as JSON lines put in place at once: human rows in their order (ord), then the judge's by key; its number of rows."""
    h = human.select(*TRIPLE, "class", "relevance", "source", "confidence", F.lit(0).alias("_part"), F.col("ord").cast("double").alias("_ord"))
    j = judged.select(*TRIPLE, "class", "relevance", "source", "confidence", F.lit(1).alias("_part"), F.lit(0.0).alias("_ord"))
    both = h.unionByName(j)
    order = ["_part", "_ord", *TRIPLE, "class"]
    lines = both.orderBy(*order).drop("_part", "_ord")
    return write_json_atomic(lines, path, None, {"human": h.count(), "judged": j.count()} | meta)


def _human():
    return F.coalesce("source", F.lit("human")) == "human"


def contradict_keys(pool: DataFrame) -> DataFrame:
    return pool.filter((F.coalesce("relevance", F.lit(1)) > 0) & ~_human() & F.col("class").isin(*CONTRADICTS)).select(*KEY).distinct()


def intersection_pool(inputs: list[DataFrame], supports_from: int = 0, marked: str = "llm-intersection") -> DataFrame:
    """Pool that keeps the first input's human rows, one input's supports, and contradictions all inputs agree on.

    Contradictions match by their exact class; their source becomes `marked`.
    Supports of an input other than the first are left out where the first pass
    emitted their key.
    """
    if len(inputs) < 2:
        raise ValueError("at least two inputs")
    base = inputs[0].filter(F.coalesce("relevance", F.lit(1)) > 0)
    human = base.filter(_human())
    agreed = base.filter(~_human() & F.col("class").isin(*CONTRADICTS))
    for other in inputs[1:]:
        agreed = agreed.join(contradict_keys(other), KEY, "left_semi")
    agreed = agreed.withColumn("source", F.lit(marked)).select(*base.columns)
    out = human.unionByName(agreed)
    sup = inputs[supports_from].filter((F.coalesce("relevance", F.lit(1)) > 0) & ~_human() & F.col("class").isin(*SUPPORTS))
    return out.unionByName(sup if supports_from == 0 else sup.join(out.select(*KEY).distinct(), KEY, "left_anti"))


def intersection_counts(inputs: list[DataFrame], pool: DataFrame) -> DataFrame:
    """One row: human, support and contradict rows before (first input) and after, and the share of contradictions dropped."""

    def kind(df: DataFrame) -> DataFrame:
        live = df.filter(F.coalesce("relevance", F.lit(1)) > 0)
        return live.select(F.when(_human(), "human").when(F.col("class").isin(*SUPPORTS), "support").when(F.col("class").isin(*CONTRADICTS), "contradict").alias("kind"))

    both = kind(inputs[0]).withColumn("at", F.lit("before")).unionByName(kind(pool).withColumn("at", F.lit("after")))
    counts = {f"{k}_{at}": F.count_if((F.col("kind") == k) & (F.col("at") == at)) for at in ("before", "after") for k in ("human", "support", "contradict")}
    out = both.agg(*[c.alias(n) for n, c in counts.items()])
    return out.withColumn("dropped_pct", F.round(F.when(F.col("contradict_before") > 0, 100.0 * (F.col("contradict_before") - F.col("contradict_after")) / F.col("contradict_before")).otherwise(0.0), 4))


def pairwise_intersections(inputs: list[DataFrame]) -> DataFrame:
    """(a, b, n): contradiction keys that each two inputs share."""
    keys = reduce(DataFrame.unionByName, [contradict_keys(p).withColumn("input", F.lit(i)) for i, p in enumerate(inputs)])
    names = keys.groupBy(*KEY).agg(F.sort_array(F.collect_set("input")).alias("s"))
    pairs = names.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).filter("a < b")
    every = keys.sparkSession.createDataFrame([(i, j) for i in range(len(inputs)) for j in range(i + 1, len(inputs))], "a int, b int")
    return every.join(pairs.groupBy("a", "b").agg(F.count("*").alias("n")), ["a", "b"], "left").fillna(0, ["n"])


def any_incomplete(flags: DataFrame) -> DataFrame:
    return flags.agg(F.coalesce(F.bool_or("incomplete"), F.lit(False)).alias("incomplete"))
