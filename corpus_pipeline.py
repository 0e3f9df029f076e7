"""The corpus pipeline: language ID, line dedup, MinHash near-dedup, source mixing, BPE.

Each stage is (name, function of (spark, docs, sf_dir)). run() writes each stage's
rows as Parquet in the shared folder and the next one reads them again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import bpe, common, langid, linededup, minhash, mixing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: A prediction below that is none: what it is made of is in no learned language.
LEAST_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no learned language go: those without a letter (or text), and those whose score is below LEAST_SCORE.

    The predicted language becomes a document's lang, by which sources are mixed
    later. Without a labelled row there is no model: documents with a letter stay
    as they are.
    """
    held = common.doc_fold(F.col("doc_id"), 5) == 0
    model = langid.fit_language_model(docs.filter(~held))
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    told = langid.predict_languages(docs.select(*COLUMNS), model)
    told = told.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return told.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicate lines go; documents that had nothing else go with them."""
    out = linededup.dedup_lines(docs.select(*COLUMNS))
    out = out.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, Jaccard 0.8) one document stays, the first by doc_id, then by its text's hash.

    Groups are of texts, not of ids: unlike texts under one doc_id each stay or go
    by their own group, and equal rows become one. A null doc_id, or a text
    without words, stands alone and stays.
    """
    rows = docs.select(*COLUMNS)
    leaders = minhash.leaders(rows, k=5, part=80, whole=100)
    alone = F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike(common.WORD_PATTERN), F.lit(False))
    named = rows.withColumn("th", F.xxhash64("text"))
    kept = named.filter(~alone).join(leaders, ["doc_id", "th"], "left_semi")
    again = common.checkpointed(kept.groupBy("doc_id", "th").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "th"))
    if not again.isEmpty():
        once = kept.join(again, ["doc_id", "th"], "left_semi").dropDuplicates(["doc_id", "th"])
        kept = kept.join(again, ["doc_id", "th"], "left_anti").unionByName(once)
    return kept.select(*COLUMNS).unionByName(rows.filter(alone))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the words, by the sources' weights; no document twice."""
    return mixing.mix_sources(docs, share=0.9, epochs=1).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with n_tokens, token_ids and the digests of ids and decoded text."""
    return bpe.encode_documents(docs.select(*COLUMNS))


STAGES = [("language_id", identify_language), ("line_dedup", dedup_lines), ("minhash_dedup", dedup_documents), ("source_mixing", mix), ("bpe_encoding", encode)]
#: Language ID and BPE aren't expressible in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's table goes once the next one is written, all of them if one fails."""
    at = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = common.table(spark, sf_dir, "documents"), None
    try:
        for name, stage in STAGES:
            with common.tidy(spark):
                stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
            docs = spark.read.parquet(f"{at}/{name}")
            if before:
                common.remove(spark, before)
            before = f"{at}/{name}"
    except BaseException:
        common.remove(spark, at)
        raise
    return docs
