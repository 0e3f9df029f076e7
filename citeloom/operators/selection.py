"""Greedy choice of citations without conflicts, and validation of submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def greedy_select(support: DataFrame, contradict: DataFrame, existing: DataFrame | None = None, tau_support: float = 0.5, tau_contradict: float = 0.5, cap: int = 3, first_class: str = "support") -> DataFrame:
    """(qa_id, sentence_id, class, pos, pmid): up to cap ids a cell, no id twice in a topic.

    support: (qa_id, sentence_id, pmid, entailment_prob), best first; contradict:
    (qa_id, sentence_id, pmid, contradict_score, bm25_rank), lowest rank first;
    thresholds are inclusive. existing (qa_id, sentence_id, pmid) is left out of its
    own sentence. Sentences go in order, first_class before the other; an id that
    is taken makes room for the next. The fold runs in one higher-order function a
    topic; a candidate past 2 * cap * sentences (plus the cap) of its cell can't be
    chosen and is pruned before it, so a topic's list is bounded by its sentences.
    """
    classes = ("support", "contradict") if first_class == "support" else ("contradict", "support")
    s = support.filter(F.col("entailment_prob") >= tau_support).select("qa_id", "sentence_id", "pmid", F.lit("support").alias("class"), (-F.round("entailment_prob", 9)).alias("ord"))
    c = contradict.filter(F.col("contradict_score") >= tau_contradict).select("qa_id", "sentence_id", "pmid", F.lit("contradict").alias("class"), F.col("bm25_rank").cast("double").alias("ord"))
    pool = s.unionByName(c)
    if existing is not None:
        pool = pool.join(existing.select("qa_id", "sentence_id", "pmid").distinct(), ["qa_id", "sentence_id", "pmid"], "left_anti")
    pool = pool.groupBy("qa_id", "sentence_id", "class", "pmid").agg(F.min("ord").alias("ord"))
    sentences = pool.groupBy("qa_id").agg(F.countDistinct("sentence_id").alias("n_s"))
    place = F.row_number().over(W.partitionBy("qa_id", "sentence_id", "class").orderBy("ord", "pmid"))
    pool = pool.withColumn("place", place).join(sentences, "qa_id").filter(F.col("place") <= 2 * cap * F.col("n_s"))
    rank = F.when(F.col("class") == classes[0], 0).otherwise(1)
    rows = F.array_sort(F.collect_list(F.struct("sentence_id", rank.alias("c"), "place", "pmid")))
    start = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast("array<struct<sentence_id:int,c:int,pmid:string>>").alias("got"), F.lit(-1).alias("s"), F.lit(-1).alias("c"), F.lit(0).alias("n"))

    def step(acc, x):
        same = (acc["s"] == x["sentence_id"]) & (acc["c"] == x["c"])
        n = F.when(same, acc["n"]).otherwise(0)
        take = (n < cap) & ~F.array_contains(acc["used"], x["pmid"])
        return F.struct(
            F.when(take, F.array_append(acc["used"], x["pmid"])).otherwise(acc["used"]).alias("used"),
            F.when(take, F.array_append(acc["got"], F.struct(x["sentence_id"].cast("int").alias("sentence_id"), x["c"].cast("int").alias("c"), x["pmid"].alias("pmid")))).otherwise(acc["got"]).alias("got"),
            x["sentence_id"].cast("int").alias("s"),
            x["c"].cast("int").alias("c"),
            F.when(take, n + 1).otherwise(n).cast("int").alias("n"),
        )

    picks = pool.withColumn("sentence_id", F.col("sentence_id").cast("int")).groupBy("qa_id").agg(rows.alias("rows")).select("qa_id", F.posexplode(F.aggregate("rows", start, step)["got"]).alias("i", "g"))
    out = picks.select("qa_id", F.col("g.sentence_id").alias("sentence_id"), F.when(F.col("g.c") == 0, classes[0]).otherwise(classes[1]).alias("class"), "i", F.col("g.pmid").alias("pmid"))
    pos = F.row_number().over(W.partitionBy("qa_id", "sentence_id", "class").orderBy("i")).alias("pos")
    return out.select("qa_id", "sentence_id", "class", pos, "pmid")


def violations(picks: DataFrame, corpus: DataFrame | None = None, existing: DataFrame | None = None, cap: int = 3) -> DataFrame:
    """(qa_id, sentence_id, class, pmid, rule) of everything that a submission must not hold.

    Rules: over_cap, empty_id, duplicate (in a list), reused (in a topic),
    not_in_corpus, existing. pmid is null for over_cap.
    """
    cell = ["qa_id", "sentence_id", "class"]
    n = picks.groupBy(*cell, "pmid").agg(F.count("*").alias("n"))
    none = F.lit(None).cast("string").alias("pmid")
    found = [
        n.groupBy(*cell).agg(F.sum("n").alias("n")).filter(F.col("n") > cap).select(*cell, none, F.lit("over_cap").alias("rule")),
        n.filter(F.coalesce(F.trim("pmid"), F.lit("")) == "").select(*cell, "pmid", F.lit("empty_id").alias("rule")),
        n.filter("n > 1").select(*cell, "pmid", F.lit("duplicate").alias("rule")),
    ]
    again = n.groupBy("qa_id", "pmid").agg(F.count("*").alias("cells")).filter("cells > 1")
    found.append(n.join(again, ["qa_id", "pmid"], "left_semi").select(*cell, "pmid", F.lit("reused").alias("rule")))
    if corpus is not None:
        found.append(n.join(corpus.select("pmid"), "pmid", "left_anti").select(*cell, "pmid", F.lit("not_in_corpus").alias("rule")))
    if existing is not None:
        found.append(n.join(existing, ["qa_id", "sentence_id", "pmid"], "left_semi").select(*cell, "pmid", F.lit("existing").alias("rule")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def order_violations(sentences: DataFrame) -> DataFrame:
    """Sentences (qa_id, pos, sentence_id) whose id doesn't rise within their topic."""
    before = F.lag("sentence_id").over(W.partitionBy("qa_id").orderBy("pos"))
    return sentences.withColumn("before", before).filter(F.col("before") >= F.col("sentence_id")).drop("before")


def shape_violations(topics: DataFrame) -> DataFrame:
    """(qa_id, rule) of topics read as `raw` JSON text, one a row, that don't have the official shape.

    Rules: not_an_object, no_qa_id, no_answer, no_text, and for each of the three
    lists of a sentence not_a_list (a null list of existing ids is fine).
    """
    v = F.try_parse_json("raw")
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    qa = F.try_variant_get(v, "$.meta_data.qa_id", "string")
    answers = F.coalesce(F.from_json(F.get_json_object("raw", "$.answer"), "array<string>"), F.array().cast("array<string>"))
    base = topics.select("raw", qa.alias("qa_id"), answers.alias("answers"), F.coalesce(kind("$"), F.lit("VOID")).alias("kind"))
    out = base.filter(~F.startswith("kind", F.lit("OBJECT"))).select("qa_id", F.lit("not_an_object").alias("rule"))
    good = base.filter(F.startswith("kind", F.lit("OBJECT")))
    out = out.unionByName(good.filter(F.coalesce(F.trim("qa_id"), F.lit("")) == "").select("qa_id", F.lit("no_qa_id").alias("rule")))
    out = out.unionByName(good.filter(F.size("answers") == 0).select("qa_id", F.lit("no_answer").alias("rule")))
    s = good.select("qa_id", F.explode("answers").alias("s"))
    out = out.unionByName(s.filter(F.coalesce(F.trim(F.get_json_object("s", "$.text")), F.lit("")) == "").select("qa_id", F.lit("no_text").alias("rule")))
    for name in ("existing_supported_citations", "supported_citations", "contradicted_citations"):
        got = F.trim(F.coalesce(F.get_json_object("s", f"$.{name}"), F.lit("null")))
        fine = F.startswith(got, F.lit("[")) | (F.lit(name == "existing_supported_citations") & (got == "null"))
        out = out.unionByName(s.filter(~fine).select("qa_id", F.lit(f"{name} not_a_list").alias("rule")))
    return out


def validate(picks: DataFrame, **rules) -> None:
    """Raise ValueError naming the first violation, if there is one."""
    order = ["qa_id", "sentence_id", "class", "rule", "pmid"]
    if (bad := violations(picks, **rules).orderBy(*order).first()) is not None:
        raise ValueError(f"{bad['rule']}: {bad['qa_id']}/{bad['sentence_id']}/{bad['class']}: {bad['pmid']}")
