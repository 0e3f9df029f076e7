"""Calibration of confidences: reliability bins, ECE, isotonic fits, k-fold ECE.

Pairs are (confidence, correct) with optional group columns `by`, so that many
judges and folds are fitted by one plan. The isotonic fit pools adjacent violators
over points tied by their exact confidence. Pooling may be done in any order, so
slices of each group's range are pooled on their own first, by as many tasks as
there are slices, and the blocks that remain are pooled once more.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from citeloom.functions import text as T

#: Slices of the range of confidences.
SLICES = 512


def pooled(x: np.ndarray, n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block end, size, sum) of the least-squares increasing fit to means s / n in order of x; sums are integers, compared exactly."""
    ends: list[float] = []
    sizes: list[int] = []
    sums: list[int] = []
    for end, size, total in zip(x.tolist(), n.tolist(), s.tolist(), strict=True):
        # Only violations are pooled; equal means stay two blocks.
        while sums and sums[-1] * size > total * sizes[-1]:
            ends.pop()
            size += sizes.pop()
            total += sums.pop()
        ends.append(end)
        sizes.append(size)
        sums.append(total)
    return np.array(ends, float), np.array(sizes, np.int64), np.array(sums, np.int64)


def reliability_bins(pairs: DataFrame, n_bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """(by, bin, n, mean_conf, mean_correct), empty bins as zeros; confidences outside [0, 1] are clipped into the end bins."""
    by = by or []
    c = F.col("confidence").cast("double")
    idx = F.least(F.lit(n_bins - 1), F.greatest(F.lit(0), (c * F.lit(float(n_bins))).cast("int")))
    got = pairs.withColumn("bin", idx).groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg(c).alias("mean_conf"), F.avg(F.col("correct").cast("double")).alias("mean_correct"))
    groups = pairs.select(*by).distinct() if by else pairs.sparkSession.range(1).select()
    every = groups.select(*by, F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    return every.join(got, [*by, "bin"], "left").fillna(0, ["n"]).fillna(0.0, ["mean_conf", "mean_correct"])


def ece(bins: DataFrame, by: list[str] | None = None) -> DataFrame:
    n = F.sum("n")
    return bins.groupBy(*(by or [])).agg(F.when(n > 0, F.sum(F.col("n") * F.abs(F.col("mean_conf") - F.col("mean_correct"))) / n).otherwise(F.lit(0.0)).alias("ece"))


def isotonic_fit(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, x, y): block ends and values of the increasing fit."""
    keys = by or ["_g"]
    rows = pairs if by else pairs.withColumn("_g", F.lit(0))
    tied = rows.filter("confidence is not null").groupBy(*keys, F.col("confidence").cast("double").alias("x")).agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("long")).alias("s"))
    tied = tied.withColumn("slice", F.least(F.lit(SLICES - 1), F.greatest(F.lit(0), F.floor(F.col("x") * SLICES))).cast("int"))
    schema = ST.StructType([*(tied.schema[k] for k in keys), *(tied.schema[c] for c in ("x", "n", "s"))])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        x, n, s = pooled(pdf["x"].to_numpy(), pdf["n"].to_numpy(), pdf["s"].to_numpy())
        return pd.DataFrame({k: pdf[k].iloc[0] for k in keys} | {"x": x, "n": n, "s": s}, columns=schema.names)

    blocks = tied.groupBy(*keys, "slice").applyInPandas(run, schema).groupBy(*keys).applyInPandas(run, schema)
    return blocks.select(*(by or []), "x", (F.col("s") / F.col("n")).alias("y"))


def isotonic_apply(points: DataFrame, fit: DataFrame, by: list[str] | None = None) -> DataFrame:
    """points with `calibrated`: between block ends by a straight line, flat beyond them; without a fit the confidence itself."""
    by = by or []
    xs = fit.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("fit"))
    met = points.join(xs, by, "left") if by else points.join(F.broadcast(xs), F.lit(True), "left")  # one row
    c = F.col("confidence").cast("double")
    below, above = F.filter("fit", lambda p: p["x"] <= c), F.filter("fit", lambda p: p["x"] > c)
    a, b = F.get(below, F.size(below) - 1), F.get(above, F.lit(0))
    line = a["y"] + (b["y"] - a["y"]) * (c - a["x"]) / (b["x"] - a["x"])
    value = F.when(F.col("fit").isNull(), c).when(F.size(below) == 0, b["y"]).when(F.size(above) == 0, a["y"]).otherwise(line)
    return met.withColumn("calibrated", value).drop("fit")


def kfold_ece(records: DataFrame, k: int = 5, n_bins: int = 10) -> DataFrame:
    """One row (k, n, raw_mean, raw_std, cal_mean, cal_std) over folds by topic.

    records: (qa_id, confidence, gold, pred). Confidences outside [0, 1] go. A fold
    is calibrated by a fit to the others; with fewer than two folds the fit is to
    all rows. k < 2 is an error; no rows give zeros.
    """
    if k < 2:
        raise ValueError("k must be at least 2")
    rows = records.filter("confidence between 0 and 1").select(T.fold_of(F.col("qa_id"), k).alias("fold"), F.col("confidence").cast("double").alias("confidence"), F.when(F.col("gold") == F.col("pred"), 1).otherwise(0).alias("correct"))
    folds = rows.select("fold").distinct()
    one = folds.count() < 2  # k values at most
    if one:
        rows = rows.withColumn("fold", F.lit(0))
        train = rows.withColumn("held", F.lit(0))
    else:
        train = rows.withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).filter("held <> fold")
    train = train.select(F.col("held").alias("fold"), "confidence", "correct")
    applied = isotonic_apply(rows, isotonic_fit(train, ["fold"]), ["fold"])
    raw = ece(reliability_bins(rows, n_bins, ["fold"]), ["fold"]).withColumnRenamed("ece", "raw")
    cal = ece(reliability_bins(applied.select("fold", F.col("calibrated").alias("confidence"), "correct"), n_bins, ["fold"]), ["fold"]).withColumnRenamed("ece", "cal")
    sizes = rows.groupBy("fold").agg(F.count("*").alias("n"))
    per = raw.join(cal, "fold").join(sizes, "fold")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return per.agg(F.count("*").alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), zero(F.avg("raw")).alias("raw_mean"), zero(F.stddev_pop("raw")).alias("raw_std"), zero(F.avg("cal")).alias("cal_mean"), zero(F.stddev_pop("cal")).alias("cal_std"))


def calibration_summary(records: DataFrame, n_bins: int = 10) -> DataFrame:
    """(backend, n, accuracy, mean_confidence, ece_raw, ece_in_sample) of (backend, confidence, correct), and ece_kfold where records name their topic (qa_id, gold, pred)."""
    by = ["backend"]
    base = records.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg("confidence").alias("mean_confidence"))
    raw = ece(reliability_bins(records, n_bins, by), by).withColumnRenamed("ece", "ece_raw")
    applied = isotonic_apply(records, isotonic_fit(records, by), by)
    cal = ece(reliability_bins(applied.select("backend", F.col("calibrated").alias("confidence"), "correct"), n_bins, by), by).withColumnRenamed("ece", "ece_in_sample")
    out = base.join(raw, by).join(cal, by)
    if not {"qa_id", "gold", "pred"} <= set(records.columns):
        return out
    names = [r["backend"] for r in records.select("backend").distinct().collect()]  # the registered judges, a handful
    folds = None
    for name in names:
        one = kfold_ece(records.filter(F.col("backend") == name), n_bins=n_bins).select(F.lit(name).alias("backend"), F.col("cal_mean").alias("ece_kfold"))
        folds = one if folds is None else folds.unionByName(one)
    return out.withColumn("ece_kfold", F.lit(None).cast("double")) if folds is None else out.join(folds, by, "left")
