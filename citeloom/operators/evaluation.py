"""Set-based precision, recall and F1 of runs against judged pools.

A cell is (topic, sentence, class). Cells come from the run, empty ones included;
all settings, classes and runs are scored by one plan.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.functions import text as T

CLASSES = ("support", "contradict")
KNOWN = (*CLASSES, "partial_support", "partial_contradict")
SETTINGS = ("strict", "relaxed")


def positives(qrels: DataFrame, source: str = "any") -> DataFrame:
    """(setting, qa_id, sentence_id, class, pmid, source) of judgements (ord: input order).

    Rows with relevance <= 0 or an unknown class go. Relaxed takes partial classes
    for their base. The last row of a key, by ord, names its source.
    """
    rows = qrels.filter((F.coalesce("relevance", F.lit(1)) > 0) & F.col("class").isin(*KNOWN)).withColumn("source", F.coalesce("source", F.lit("human")))
    both = rows.withColumn("setting", F.explode(F.when(F.col("class").isin(*CLASSES), F.array(*map(F.lit, SETTINGS))).otherwise(F.array(F.lit("relaxed")))))
    both = both.withColumn("class", F.when(F.col("setting") == "relaxed", T.base_class(F.col("class"))).otherwise(F.col("class")))
    out = both.groupBy("setting", "qa_id", "sentence_id", "class", "pmid").agg(F.max_by("source", "ord").alias("source"))
    return out if source == "any" else out.filter(F.col("source") == "human" if source == "human" else F.col("source") != "human")


def marked(qrels: DataFrame, source: str = "any") -> DataFrame:
    """(qa_id, sentence_id, class, pmid, j): judgements by base class; bit 0 of j says strict, bit 1 relaxed.

    The rows of positives() in another shape; where any source will do, they aren't grouped, as prf_cells does that.
    """
    key = ["qa_id", "sentence_id", "class", "pmid"]
    if source != "any":
        return positives(qrels, source).select(*key, _bits(F.col("setting"), SETTINGS).alias("j"))
    rows = qrels.filter((F.coalesce("relevance", F.lit(1)) > 0) & F.col("class").isin(*KNOWN))
    return rows.select("qa_id", "sentence_id", T.base_class(F.col("class")).alias("class"), "pmid", F.when(F.col("class").isin(*CLASSES), 3).otherwise(2).cast("long").alias("j"))


def marked_pools(qrels: DataFrame) -> DataFrame:
    """(qa_id, sentence_id, class, pmid, j): strict judgements; bit 0 of j says any source (expanded), bit 1 human (official)."""
    rows = qrels.filter((F.coalesce("relevance", F.lit(1)) > 0) & F.col("class").isin(*CLASSES))
    human = F.max_by(F.coalesce("source", F.lit("human")) == "human", "ord")
    return rows.groupBy("qa_id", "sentence_id", "class", "pmid").agg(F.when(human, 3).otherwise(1).cast("long").alias("j"))


def _bits(value: Column, names: tuple) -> Column:
    out = F.lit(0)
    for i, name in enumerate(names):
        out = F.when(value == name, 1 << i).otherwise(out)
    return out.cast("long")


#: Runs that one aggregation counts, a bit each; input that a task takes, as Spark estimates it.
MOST_RUNS, TASK_BYTES = 60, 16 << 20


def _dealt(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows dealt by columns, once, over as many tasks as their input asks for (those of the session at least, and where Spark knows no size)."""
    tasks = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) // TASK_BYTES
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *by) if usual < tasks < 1 << 17 else rows.repartition(*by)


def prf_cells(
    cells: DataFrame, predictions: DataFrame, pos: DataFrame, keys: list[str], unjudged_as_zero: bool = True, run: list[str] | None = None,
    names: list[tuple] | None = None, settings: tuple[str, ...] = SETTINGS, deal: list[str] | None = None,
) -> DataFrame:
    """(run, setting, keys, n_pred, n_pos, tp, P, R, F1) of every cell that counts.

    cells: (run, keys), or (keys) where every run in names has them all; repeated
    rows do no harm. predictions: (run, keys, pmid); pos: (setting, keys, pmid), or
    (keys, pmid, j) with a bit for each setting. A cell without positives counts as
    zeros if something is predicted there and unjudged_as_zero; otherwise it is dropped.

    No joins, and one exchange: what is predicted, judged and asked for is dealt by
    `deal` (the keys but for the class), grouped by (keys, pmid) and summed by keys
    where it lies; runs and settings are bits of a row until their counts are rows.
    A later aggregation by keys that hold `deal` needs no other exchange.
    """
    run = run or []
    if names is None:
        names = [tuple(r) for r in cells.select(*run).distinct().collect()] if run else [()]  # the runs
    if len(names) > MOST_RUNS:
        parts = [names[i : i + MOST_RUNS] for i in range(0, len(names), MOST_RUNS)]
        return reduce(DataFrame.unionByName, [prf_cells(cells, predictions, pos, keys, unjudged_as_zero, run, part, settings, deal) for part in parts])
    zero = F.lit(0).cast("long")
    of = zero if run else F.lit(1).cast("long")
    for i, name in enumerate(names if run else []):
        same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(run, name, strict=True)])
        of = F.when(same, F.lit(1 << i).cast("long")).otherwise(of)
    asked = of if set(run) <= set(cells.columns) else F.lit((1 << len(names)) - 1).cast("long")
    no_id = F.lit(None).cast(predictions.schema["pmid"].dataType)
    j = F.col("j") if "j" in pos.columns else _bits(F.col("setting"), settings)
    said = predictions.select(*keys, "pmid", of.alias("p"), zero.alias("j"), zero.alias("c"))
    judged = pos.select(*keys, "pmid", zero.alias("p"), j.alias("j"), zero.alias("c"))
    have = cells.select(*keys, no_id.alias("pmid"), zero.alias("p"), zero.alias("j"), asked.alias("c"))
    dealt = _dealt(said.unionByName(judged).unionByName(have), deal or [k for k in keys if k != "class"])
    met = dealt.groupBy(*keys, "pmid").agg(*[F.bit_or(c).alias(c) for c in "pjc"])
    has = lambda c, i: F.shiftright(c, i).bitwiseAND(F.lit(1).cast("long"))
    slots = [(i, s) for i in range(len(names)) for s in range(len(settings))]
    sums = met.groupBy(*keys).agg(
        F.bit_or("c").alias("c"),
        *[F.sum(has("p", i)).alias(f"n{i}") for i in range(len(names))],
        *[F.sum(has("j", s)).alias(f"all{s}") for s in range(len(settings))],
        *[F.sum(has("p", i).bitwiseAND(has("j", s))).alias(f"tp{i}_{s}") for i, s in slots],
    )
    kinds = {c: predictions.schema[c].dataType for c in run}
    each = [
        F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(run, names[i], strict=True)], F.lit(settings[s]).alias("setting"), has("c", i).alias("has"), F.col(f"n{i}").alias("n_pred"), F.col(f"all{s}").alias("n_pos"), F.col(f"tp{i}_{s}").alias("tp"))
        for i, s in slots
    ]
    out = sums.select(*keys, F.explode(F.array(*each)).alias("o")).select(*[f"o.{c}" for c in run], "o.setting", *keys, "o.has", "o.n_pred", "o.n_pos", "o.tp")
    out = out.filter((F.col("has") == 1) & ((F.col("n_pos") > 0) | ((F.col("n_pred") > 0) & F.lit(unjudged_as_zero)))).drop("has")
    share = lambda n: F.when(F.col(n) > 0, F.col("tp") / F.col(n)).otherwise(F.lit(0.0))
    f1 = F.when(F.col("tp") > 0, 2.0 * F.col("tp") / (F.col("n_pred") + F.col("n_pos"))).otherwise(F.lit(0.0))
    return out.withColumns({"P": share("n_pred"), "R": share("n_pos"), "F1": f1})


def macro(prf: DataFrame, runs: DataFrame, run: list[str] | None = None, settings: tuple[str, ...] = SETTINGS) -> DataFrame:
    """(run, setting, class, P, R, F1): means over cells; the four combinations are there for every run, zeros if empty."""
    run = run or []
    combos = F.explode(F.array(*[F.struct(F.lit(s).alias("setting"), F.lit(c).alias("class")) for s in settings for c in CLASSES])).alias("x")
    every = runs.select(*run, combos).select(*run, "x.setting", "x.class").distinct()
    means = prf.groupBy(*run, "setting", "class").agg(F.avg("P").alias("P"), F.avg("R").alias("R"), F.avg("F1").alias("F1"))
    return every.join(means, [*run, "setting", "class"], "left").fillna(0.0, ["P", "R", "F1"])


def evaluate(cells: DataFrame, predictions: DataFrame, qrels: DataFrame, level: str = "sentence", unjudged_as_zero: bool | None = None, source: str = "any", run: list[str] | None = None, runs: DataFrame | None = None) -> DataFrame:
    """Macro scores at sentence level (unjudged cells zero by default) or question level (dropped by default).

    runs (run): the runs, if they are known; cells (keys) are then those of each, and aren't read for their names.
    """
    keys = ["qa_id", "sentence_id", "class"] if level == "sentence" else ["qa_id", "class"]
    zero = level == "sentence" if unjudged_as_zero is None else unjudged_as_zero
    names = None if runs is None else [tuple(r) for r in runs.select(*run).distinct().collect()]
    prf = prf_cells(cells, predictions, marked(qrels, source), keys, zero, run, names)
    return macro(prf, cells if runs is None else runs, run)


def per_topic(prf: DataFrame, run: list[str] | None = None) -> DataFrame:
    """(run, qa_id, setting, class, P, R, F1, n_cells); a topic with any cell has all four slots.

    One aggregation by topic: without an exchange where prf is dealt by qa_id.
    """
    run = run or []
    slots = [(s, c) for s in SETTINGS for c in CLASSES]
    on = lambda s, c, v: F.when((F.col("setting") == s) & (F.col("class") == c), v)
    sums = [f(on(s, c, F.col(v))).alias(f"{n}{i}") for i, (s, c) in enumerate(slots) for n, v, f in (("P", "P", F.avg), ("R", "R", F.avg), ("F1_", "F1", F.avg), ("n", "tp", F.count))]
    each = [
        F.struct(F.lit(s).alias("setting"), F.lit(c).alias("class"), *[F.coalesce(f"{n}{i}", F.lit(0.0)).alias(v) for n, v in (("P", "P"), ("R", "R"), ("F1_", "F1"))], F.col(f"n{i}").alias("n_cells"))
        for i, (s, c) in enumerate(slots)
    ]
    return prf.groupBy(*run, "qa_id").agg(*sums).select(*run, "qa_id", F.explode(F.array(*each)).alias("x")).select(*run, "qa_id", "x.*")


def topic_delta(target: DataFrame, anchor: DataFrame, setting: str = "strict", cls: str = "support") -> DataFrame:
    on = (F.col("setting") == setting) & (F.col("class") == cls)
    return target.filter(on).select("qa_id", F.col("F1").alias("t")).join(anchor.filter(on).select("qa_id", F.col("F1").alias("a")), "qa_id").select("qa_id", (F.col("t") - F.col("a")).alias("delta"))


def run_delta(topics: DataFrame, target: str, anchor: str, setting: str = "strict", cls: str = "support") -> DataFrame:
    """topic_delta of two runs of one table (run, qa_id, ...), which is read once."""
    at = topics.filter((F.col("setting") == setting) & (F.col("class") == cls))
    both = at.groupBy("qa_id").agg(*[F.max(F.when(F.col("run") == r, F.col("F1"))).alias(n) for r, n in ((target, "t"), (anchor, "a"))])
    return both.filter("t is not null and a is not null").select("qa_id", (F.col("t") - F.col("a")).alias("delta"))


def select_three(deltas: DataFrame) -> DataFrame:
    """One row (positive, neutral, negative): largest, nearest zero, least; ties to the smaller number; neutral is neither other.

    Raises at run time with fewer than three topics. The deltas are read once: every
    task keeps its first, last and three nearest to zero, and one row is made of these.
    """
    num, _ = T.numeric_order(F.col("qa_id"))
    rows = deltas.select(F.round("delta", 9).alias("d"), num.alias("n"), F.col("qa_id").alias("q"))

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for pdf in batches:
            some = pdf if kept is None else pd.concat([kept, pdf], ignore_index=True)
            d, n, q = some["d"].to_numpy(float), some["n"].to_numpy(), some["q"].to_numpy()
            near = []
            for order in (-d, d, np.abs(d)):
                # Sorted are only those that may be among the three.
                on = np.flatnonzero(order <= np.partition(order, 2)[2]) if len(order) > 3 else np.arange(len(order))
                near += sorted(on, key=lambda i, o=order: (o[i], n[i], q[i]))[:3]
            kept = some.iloc[sorted(set(near))]
        if kept is not None:
            yield kept

    one = rows.mapInPandas(ends, rows.schema).groupBy().agg(F.collect_list(F.struct("d", "n", "q")).alias("rs"))  # nine a task at most
    first = lambda rs, d: F.array_min(F.transform(rs, lambda r: F.struct(d(r["d"]).alias("d"), r["n"].alias("n"), r["q"].alias("q"))))["q"]
    found = one.select("rs", first(F.col("rs"), lambda d: -d).alias("positive"), first(F.col("rs"), lambda d: d).alias("negative"))
    rest = F.filter("rs", lambda r: (r["q"] != F.col("positive")) & (r["q"] != F.col("negative")))
    few = F.when(F.size("rs") < 3, F.raise_error(F.lit("need at least 3 topics"))).otherwise(F.col("positive"))
    return found.select(few.alias("positive"), first(rest, F.abs).alias("neutral"), "negative")


def run_summary(macro_by_pool: DataFrame) -> DataFrame:
    """One row a run: strict F1 x 100 of both classes in each pool, and expanded minus official."""
    s = macro_by_pool.filter("setting = 'strict'").withColumn("slot", F.concat_ws("_", "pool", "class")).withColumn("f", F.round(F.col("F1") * 100, 4))
    slots = [f"{p}_{c}" for p in ("official", "expanded") for c in CLASSES]
    out = s.groupBy("run").pivot("slot", slots).agg(F.first("f"))
    return out.select("run", *slots, *[F.round(F.col(f"expanded_{c}") - F.col(f"official_{c}"), 4).alias(f"delta_{c}") for c in CLASSES])


#: Pools in the order in which a variant's scores are looked for.
POOLS = ("intersection", "expanded", "official")


def first_pool(topics: DataFrame) -> DataFrame:
    """Of scores (run, pool, ...) each run's rows of its first pool there is: intersection, expanded, official."""
    place = F.array_position(F.array(*map(F.lit, POOLS)), F.col("pool"))
    best = topics.filter(place > 0).groupBy("run").agg(F.min(place).alias("_best"))
    return topics.join(best, "run").filter(place == F.col("_best")).drop("_best")


def by_topic_matrix(topics: DataFrame, variants: list[str], cls: str = "support") -> DataFrame:
    """Topics by variants: strict F1 x 100, topics in numeric order; with a pool column, of each variant's first pool there is."""
    topics = first_pool(topics) if "pool" in topics.columns else topics
    on = (F.col("setting") == "strict") & (F.col("class") == cls)
    scores = [F.max(F.when(F.col("run") == v, F.round(F.col("F1") * 100, 4))).alias(v) for v in variants]
    return topics.filter(on).groupBy("qa_id").agg(*scores).orderBy(*T.numeric_order(F.col("qa_id")))


#: Floors of the leaderboard, reported baseline scores and their band.
LEAST_SUPPORT, LEAST_CONTRADICT, BASE_SUPPORT, BASE_CONTRADICT, BAND = 60.0, 10.0, 44.34, 4.67, 2.0


def leaderboard(macro_: DataFrame, least_support: float = LEAST_SUPPORT, least_contradict: float = LEAST_CONTRADICT) -> DataFrame:
    """(run, support, contradict, passed): strict F1 x 100 against two floors."""
    s = macro_.filter("setting = 'strict'").groupBy("run").pivot("class", list(CLASSES)).agg(F.first(F.col("F1") * 100))
    return s.select("run", F.round("support", 4).alias("support"), F.round("contradict", 4).alias("contradict"), ((F.col("support") >= least_support) & (F.col("contradict") >= least_contradict)).alias("passed"))


def baseline_gate(macro_: DataFrame, support: float = BASE_SUPPORT, contradict: float = BASE_CONTRADICT, within: float = BAND) -> DataFrame:
    s = macro_.filter("setting = 'strict'").groupBy("run").pivot("class", list(CLASSES)).agg(F.first(F.col("F1") * 100))
    return s.select("run", ((F.abs(F.col("support") - support) <= within) & (F.abs(F.col("contradict") - contradict) <= within)).alias("within"))


def run_diff(predictions: DataFrame, qrels: DataFrame, a: str, b: str) -> DataFrame:
    """(qa_id, sentence_id, class, pmid, side, judgement, source, confidence) of ids that only one of two runs cites."""
    keys = ["qa_id", "sentence_id", "class", "pmid"]
    by = predictions.groupBy(*keys).agg(F.max(F.col("run") == a).alias("in_a"), F.max(F.col("run") == b).alias("in_b")).filter("in_a <> in_b")
    j = qrels.filter((F.coalesce("relevance", F.lit(1)) > 0) & F.col("class").isin(*KNOWN))
    info = F.struct("class", F.coalesce("source", F.lit("human")).alias("source"), "confidence")
    j = j.groupBy("qa_id", "sentence_id", "pmid", T.base_class(F.col("class")).alias("base")).agg(F.max_by(info, F.struct((F.col("class").isin(*CLASSES)).alias("strict"), "ord")).alias("j"))
    out = by.withColumnRenamed("class", "base").join(j, ["qa_id", "sentence_id", "pmid", "base"], "left")
    named = F.when(F.col("j").isNull(), "<unjudged>").when(F.col("j.class") == F.col("base"), F.col("base")).otherwise(F.concat("base", F.lit(" (relaxed)")))
    return out.select("qa_id", "sentence_id", F.col("base").alias("class"), "pmid", F.when(F.col("in_a"), a).otherwise(b).alias("side"), named.alias("judgement"), F.col("j.source").alias("source"), F.col("j.confidence").alias("confidence"))


def cell_ranks(df: DataFrame, by: list[str], order: list) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
