"""Topics, judgements and submissions: JSON at the edges, flat rows inside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import text as T

SENTENCE = "array<struct<text:string,existing_supported_citations:array<string>,supported_citations:array<string>,contradicted_citations:array<string>>>"
META = "struct<qa_id:string,question:string>"
TOPICS = f"meta_data {META}, metadata {META}, question string, answer {SENTENCE}"
QRELS = "qa_id string, sentence_id int, pmid string, class string, relevance int, source string, confidence double"
LEGACY = "qa_id string, sentences array<struct<sentence_id:int,contradict_pmids:array<string>,support_pmids:array<string>>>"


def _first_byte(spark: SparkSession, path: str) -> str:
    head = spark.read.text(path, wholetext=False).filter(F.trim("value") != "").limit(1).collect()
    return head[0]["value"].lstrip()[:1] if head else ""


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """(qa_id, question, sentence_id, sentence_text, existing array<string>) of either JSON shape; bad topics raise when read.

    A list ([...]) or lines; a line whose answer is one string is split into sentences.
    """
    if _first_byte(spark, path) == "[":
        rows = spark.read.schema(TOPICS).option("multiLine", True).option("mode", "FAILFAST").json(path)
    else:
        flat = spark.read.schema(TOPICS.replace(SENTENCE, "string")).option("mode", "FAILFAST").json(path)
        listed = F.from_json("answer", SENTENCE)
        split = F.transform(T.sentence_split(F.col("answer")), lambda s: F.struct(s.alias("text"), *[F.lit(None).cast("array<string>").alias(n) for n in ("existing_supported_citations", "supported_citations", "contradicted_citations")]))
        rows = flat.withColumn("answer", F.when(F.startswith(F.trim("answer"), F.lit("[")), listed).otherwise(split))
    meta = F.coalesce("meta_data", "metadata")
    qa = F.when(F.coalesce(meta["qa_id"], F.lit("")) == "", F.raise_error(F.lit("topic without qa_id"))).otherwise(meta["qa_id"])
    answer = F.when(F.coalesce(F.size("answer"), F.lit(0)) < 1, F.raise_error(F.lit("topic without sentences"))).otherwise(F.col("answer"))
    out = rows.select(qa.alias("qa_id"), F.coalesce(meta["question"], "question", F.lit("")).alias("question"), F.posexplode(answer).alias("sentence_id", "s"))
    text = F.when(F.trim(F.coalesce("s.text", F.lit(""))) == "", F.raise_error(F.lit("empty sentence"))).otherwise(F.col("s.text"))
    return out.select("qa_id", "question", "sentence_id", text.alias("sentence_text"), F.coalesce("s.existing_supported_citations", F.array().cast("array<string>")).alias("existing"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Judgement lines with defaults (relevance 1, source human) and ord, the order of input."""
    rows = spark.read.schema(QRELS).json(path).withColumn("ord", F.monotonically_increasing_id())
    return rows.withColumn("relevance", F.coalesce("relevance", F.lit(1))).withColumn("source", F.coalesce("source", F.lit("human")))


def submission_cells(spark: SparkSession, path: str) -> DataFrame:
    """(qa_id, sentence_id, class, pmids array) of either submission shape; null lists are empty."""
    none = F.array().cast("array<string>")
    if _first_byte(spark, path) == "[":
        rows = spark.read.schema(TOPICS).option("multiLine", True).json(path).select(F.coalesce("meta_data.qa_id", "metadata.qa_id", F.lit("")).alias("qa_id"), F.posexplode("answer").alias("sentence_id", "s"))
        sup, con = "s.supported_citations", "s.contradicted_citations"
    else:
        rows = spark.read.schema(LEGACY).json(path).select("qa_id", F.explode("sentences").alias("s")).select("qa_id", F.col("s.sentence_id").alias("sentence_id"), "s")
        sup, con = "s.support_pmids", "s.contradict_pmids"
    both = F.explode(F.array(F.struct(F.lit("support").alias("class"), F.coalesce(sup, none).alias("pmids")), F.struct(F.lit("contradict").alias("class"), F.coalesce(con, none).alias("pmids")))).alias("x")
    return rows.select("qa_id", "sentence_id", both).select("qa_id", "sentence_id", "x.class", "x.pmids")


def predictions(cells: DataFrame) -> DataFrame:
    return cells.select("qa_id", "sentence_id", "class", F.explode("pmids").alias("pmid"))


def official_submission(sentences: DataFrame, picks: DataFrame, cap: int = 3) -> DataFrame:
    """One row a selected topic: meta_data and answer[], ids as numbers (others go), existing ids sorted or null."""
    number = lambda c: F.filter(F.transform(c, lambda p: p.try_cast("bigint")), lambda p: p.isNotNull())
    got = picks.groupBy("qa_id", "sentence_id", "class").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "pmid"))), lambda x: x["pmid"]).alias("ids"))
    wide = got.groupBy("qa_id", "sentence_id").pivot("class", ["support", "contradict"]).agg(F.first("ids"))
    rows = sentences.join(picks.select("qa_id").distinct(), "qa_id", "left_semi").join(wide, ["qa_id", "sentence_id"], "left")
    none = F.array().cast("array<string>")
    existing = F.array_sort(number(F.coalesce("existing", none)))
    one = F.struct("sentence_id", F.col("sentence_text").alias("text"), F.when(F.size(existing) > 0, existing).alias("existing_supported_citations"), F.slice(number(F.coalesce("support", none)), 1, cap).alias("supported_citations"), F.slice(number(F.coalesce("contradict", none)), 1, cap).alias("contradicted_citations"))
    out = rows.groupBy("qa_id").agg(F.first("question").alias("question"), F.array_sort(F.collect_list(one)).alias("answer"))
    return out.select(F.struct("qa_id", "question").alias("meta_data"), F.transform("answer", lambda a: a.dropFields("sentence_id")).alias("answer"))


def legacy_submission(picks: DataFrame, cap: int = 3) -> DataFrame:
    got = picks.filter(F.col("pos") <= cap).groupBy("qa_id", "sentence_id", "class").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "pmid"))), lambda x: x["pmid"]).alias("ids"))
    wide = got.groupBy("qa_id", "sentence_id").pivot("class", ["contradict", "support"]).agg(F.first("ids"))
    none = F.array().cast("array<string>")
    one = F.struct("sentence_id", F.coalesce("contradict", none).alias("contradict_pmids"), F.coalesce("support", none).alias("support_pmids"))
    return wide.groupBy("qa_id").agg(F.array_sort(F.collect_list(one)).alias("sentences"))


def qrels_from_label_maps(labels: DataFrame) -> DataFrame:
    """Distinct judgements of (qa_id, sentence_id, supported map, contradicted map); labels in any case."""
    names = {"supports": "support", "partially supports": "partial_support", "contradicts": "contradict", "partially contradicts": "partial_contradict"}
    long = labels.select("qa_id", "sentence_id", F.explode(F.map_entries("supported")).alias("e")).union(labels.select("qa_id", "sentence_id", F.explode(F.map_entries("contradicted")).alias("e")))
    cls = F.lit(None).cast("string")
    for k, v in names.items():
        cls = F.when(F.lower(F.trim("e.value")) == k, v).otherwise(cls)
    return long.select("qa_id", "sentence_id", F.col("e.key").alias("pmid"), cls.alias("class")).filter("class is not null").distinct()


def qrels_from_runs(runs: DataFrame) -> DataFrame:
    """(qa_id, pmid, class, n_judgements) of (qa_id, machine_generated_answers map<run, struct<answer_sentences array<struct<citation_assessment array<struct<evidence_relation, cited_pmid>>>>>>)."""
    a = runs.select("qa_id", F.explode(F.map_values("machine_generated_answers")).alias("r")).select("qa_id", F.explode("r.answer_sentences").alias("s"))
    c = a.select("qa_id", F.explode("s.citation_assessment").alias("c")).select("qa_id", F.col("c.cited_pmid").alias("pmid"), F.lower("c.evidence_relation").alias("rel"))
    cls = F.when(F.col("rel") == "supporting", "support").when(F.col("rel") == "contradicting", "contradict")
    return c.withColumn("class", cls).filter("class is not null").groupBy("qa_id", "pmid", "class").agg(F.count("*").alias("n_judgements")).withColumn("sentence_id", F.lit(-1))


def digests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def resolve_pool(available: dict[str, str]) -> tuple[str, str]:
    """The first pool there is: intersection, expanded, official."""
    for name in ("intersection", "expanded", "official"):
        if name in available:
            return name, available[name]
    raise FileNotFoundError("no pool")
