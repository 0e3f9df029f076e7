"""The generic tables in the roles that the operators expect."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from citeloom.functions import text as T
from citeloom.operators.storage import kept_table


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def corpus(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("pmid"), F.col("text").alias("contents"))


def sentences(spark, d) -> DataFrame:
    """Each benchmark text is a topic; its sentences are numbered from 0."""
    return table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("qa_id"), F.posexplode(T.sentence_split(F.col("text"))).alias("sentence_id", "sentence_text"))


def queries(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("qa_id"), F.col("text").alias("query"))


def relevant(spark, d) -> DataFrame:
    """(qa_id, pmid): documents that hold a benchmark text as a run of words; a table that is written once a session."""
    b = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("qa_id"), F.col("text").alias("passage"))
    which = hashlib.sha256("\n".join(sorted(b.inputFiles())).encode()).hexdigest()[:16]
    return kept_table(corpus(spark, d), f"held-{which}", lambda docs: passages_held(docs, b))


#: White space as the JVM's \s has it.
SPACE = re.compile("[ \t\n\x0b\f\r]+")


def passages_held(docs: DataFrame, passages: DataFrame, k: int = 5) -> DataFrame:
    """(qa_id, pmid) of documents (pmid, contents) that hold a passage (qa_id, passage) whole, white space aside.

    Passages, a stated set, go to every task by their first k words (all of a
    shorter one). A task looks its documents' words up there and then for the whole
    passage, so that no text and no window of words is dealt.
    """
    keyed, firsts = {}, set()
    for r in passages.select("qa_id", "passage").collect():
        p = SPACE.sub(" ", r["passage"] or "").strip(" ").split(" ")
        if p[0]:
            keyed.setdefault(tuple(p[:k]), []).append((r["qa_id"], f" {' '.join(p)} "))
            firsts.add(p[0])
    lengths = sorted({len(key) for key in keyed})

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for pmid, text in zip(pdf["pmid"], pdf["contents"], strict=True):
                w = [] if text is None else SPACE.sub(" ", text).strip(" ").split(" ")
                if firsts.isdisjoint(w):
                    continue
                met = {key for i, x in enumerate(w) if x in firsts for n in lengths if (key := tuple(w[i : i + n])) in keyed}
                if met:
                    t = f" {' '.join(w)} "
                    out += {(q, pmid) for key in met for q, p in keyed[key] if p in t}
            yield pd.DataFrame(out, columns=["qa_id", "pmid"])

    named = [passages.schema["qa_id"], docs.schema["pmid"]]
    return docs.select("pmid", "contents").mapInPandas(look, StructType(named)).distinct()


def vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("pmid"), F.col("embedding").alias("vector"))


def qrels(spark, d) -> DataFrame:
    """Line items as judgements: classes by return flag, source by status."""
    li = table(spark, d, "lineitem")
    cls = F.when(F.col("l_returnflag") == "R", "contradict").when(F.col("l_returnflag") == "A", "support").otherwise("partial_support")
    return li.select(
        F.col("l_orderkey").cast("string").alias("qa_id"), F.col("l_linenumber").alias("sentence_id"), F.col("l_partkey").cast("string").alias("pmid"), cls.alias("class"), F.lit(1).alias("relevance"),
        F.when(F.col("l_linestatus") == "F", "human").otherwise("llm").alias("source"), F.col("l_discount").alias("confidence"), (F.col("l_extendedprice") * 100 + F.col("l_suppkey")).alias("ord"),
    )


def cells(spark, d, run: str | None = None, repeated: bool = False) -> DataFrame:
    """Every sentence of every order, in both classes; repeated: as often as the order names it, for operators that group them anyway."""
    both = F.explode(F.array(F.lit("support"), F.lit("contradict"))).alias("class")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("qa_id"), F.col("l_linenumber").alias("sentence_id"))
    return (rows if repeated else rows.distinct()).select("qa_id", "sentence_id", both)


def predictions(spark, d) -> DataFrame:
    """Two runs, a and b: line items with a large discount, or a large tax; support from 25 pieces on."""
    li = table(spark, d, "lineitem")
    cls = F.when(F.col("l_quantity") >= 25, "support").otherwise("contradict")
    base = li.select(F.col("l_orderkey").cast("string").alias("qa_id"), F.col("l_linenumber").alias("sentence_id"), cls.alias("class"), F.col("l_partkey").cast("string").alias("pmid"), "l_discount", "l_tax")
    runs = F.array_compact(F.array(F.when(F.col("l_discount") >= 0.05, "a"), F.when(F.col("l_tax") >= 0.04, "b")))
    return base.select(F.explode(runs).alias("run"), "qa_id", "sentence_id", "class", "pmid")


def stance(spark, d) -> DataFrame:
    """Line items as scored candidates with many conflicts: 500 topics, as many ids as suppliers."""
    return table(spark, d, "lineitem").select(
        (F.col("l_partkey") % 500).cast("string").alias("qa_id"), F.col("l_linenumber").alias("sentence_id"), F.col("l_suppkey").cast("string").alias("pmid"), (F.col("l_discount") * 10).alias("entailment_prob"),
        (F.col("l_tax") * 12.5).alias("contradict_score"), F.col("l_extendedprice").alias("bm25_score"), F.col("l_orderkey").alias("bm25_rank"),
    )


def records(spark, d) -> DataFrame:
    """Judge records of labelled documents: (qa_id, unit, backend, gold, pred, confidence, tokens)."""
    lab = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    name = lambda c: F.when(c == 1, "Supports").otherwise("Contradicts")
    rows = lab.withColumn("backend", F.explode(F.array(F.lit("openai-gpt-4o-mini"), F.lit("hf-llama-3.3-70b"))))
    key = F.concat_ws("|", "backend", F.col("doc_id").cast("string"))
    flip = T.hash_unit(F.concat(F.lit("p"), key)) < 0.2
    pred = F.when(flip, 1 - F.col("quality")).otherwise(F.col("quality"))
    return rows.select(F.col("source").alias("qa_id"), "doc_id", "backend", name(F.col("quality")).alias("gold"), name(pred).alias("pred"), F.round(T.hash_unit(key), 3).alias("confidence"), F.col("n_chars").alias("input_tokens"), F.lit(30).alias("output_tokens"), F.when(F.col("toxic") == 1, "empty_abstract").alias("skip_reason"))
