"""Reports over judgements and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLASSES = ["support", "contradict"]


def topical_bias(judged: DataFrame, human: DataFrame) -> DataFrame:
    """One row a topic: model and human counts by class, confidence statistics, support over (contradict + 1)."""
    llm = judged.groupBy("qa_id").pivot("class", CLASSES).agg(F.count(F.lit(1))).fillna(0)
    hum = human.groupBy("qa_id").pivot("class", CLASSES).agg(F.count(F.lit(1))).fillna(0).withColumnsRenamed({c: f"human_{c}" for c in CLASSES})
    conf = judged.groupBy("qa_id").agg(F.avg("confidence").alias("mean_conf"), F.median("confidence").alias("median_conf"), F.min("confidence").alias("min_conf"))
    out = llm.join(hum, "qa_id", "left").join(conf, "qa_id", "left").fillna(0, [f"human_{c}" for c in CLASSES])
    return out.withColumn("ratio", F.col("support") / (F.col("contradict") + 1))


def topical_extremes(bias: DataFrame, n: int = 10) -> DataFrame:
    """The n topics of highest and of lowest ratio."""
    top = bias.orderBy(F.round("ratio", 9).desc(), "qa_id").limit(n).select(F.lit("top").alias("side"), "qa_id", "ratio")
    return top.unionByName(bias.orderBy(F.round("ratio", 9), "qa_id").limit(n).select(F.lit("bottom").alias("side"), "qa_id", "ratio"))


def topical_summary(bias: DataFrame, low: float = 0.7) -> DataFrame:
    return bias.agg(
        F.count("*").alias("n"), F.avg("ratio").alias("mean_ratio"), F.median("ratio").alias("median_ratio"), F.percentile("ratio", F.lit(0.25)).alias("q25"), F.percentile("ratio", F.lit(0.75)).alias("q75"),
        F.count_if((F.col("support") >= 30) & (F.col("contradict") <= 1)).alias("one_sided"), F.avg(F.when(F.col("mean_conf") < low, 1.0).otherwise(0.0)).alias("low_share"),
    )


def cost_rollup(records: DataFrame) -> DataFrame:
    return records.groupBy("backend").agg(
        F.count("*").alias("calls"), F.count_if(F.col("skip_reason").isNotNull()).alias("skipped"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"),
    )


def phase_totals(phases: DataFrame) -> DataFrame:
    return phases.groupBy("run").agg(F.sum("seconds").alias("seconds"), F.max("vram_gib").alias("vram_gib"))


def filter_counts(df: DataFrame, keep) -> DataFrame:
    kept = F.count_if(keep)
    return df.agg(kept.alias("kept"), (F.count("*") - kept).alias("dropped"), F.count("*").alias("total"))


def audit_sample(dropped: DataFrame, key: str, n: int = 50, seed: str = "audit") -> DataFrame:
    """n rows least by a seeded hash."""
    return dropped.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), key).limit(n)
