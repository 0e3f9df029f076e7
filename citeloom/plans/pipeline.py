"""The evidence run end to end, with its variants as settings.

Every stage is a Parquet table in the run's folder when one is given: a finished
stage is read again, of this run or of another whose stages are reused. Without a
folder all stages are one lazy plan.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions import text as T
from citeloom.operators import evaluation as EV
from citeloom.operators import retrieval as RT
from citeloom.operators import selection as SE
from citeloom.operators import storage
from citeloom.sources import judgements as JU

BY = ["qa_id", "sentence_id"]


@dataclass(frozen=True)
class EvidenceConfig:
    """flavour: bm25, rm3, filtered_rm3 (support only), rewrite or hybrid; rerank False passes the first rerank_k through;
    cue_patterns None takes the default cues, () skips the filter; tolerate_invalid lets a submission through that breaks a rule."""

    flavour: str = "bm25"
    support_k: int = 100
    contradict_k: int = 1000
    rerank: bool = False
    rerank_k: int = 30
    cue_patterns: tuple[str, ...] | None = ()
    tau_support: float = 0.5
    tau_contradict: float = 0.5
    cap: int = 3
    exclude_existing: bool = True
    tolerate_invalid: bool = False
    stance: str = "inference"
    initial_k: int = 30
    rewrites: int = 3


BASELINE = EvidenceConfig(rerank=True, cue_patterns=None)
VARIANTS = {
    "baseline": BASELINE,
    "no_rerank": replace(BASELINE, rerank=False),
    "no_cue_filter": replace(BASELINE, cue_patterns=()),
    "allow_existing": replace(BASELINE, exclude_existing=False, tolerate_invalid=True),
    "text_to_text_stance": replace(BASELINE, stance="text_to_text"),
    "rm3": replace(BASELINE, flavour="rm3"),
    "filtered_rm3": replace(BASELINE, flavour="filtered_rm3"),
    "rewrite": replace(BASELINE, flavour="rewrite"),
    "hybrid": replace(BASELINE, flavour="hybrid"),
}


@dataclass
class Models:
    """What a run asks models for; each maps a DataFrame to one with more columns. By default term overlap stands in.

    support: sentence_text, contents -> entailment_prob; contradict: sentence_text,
    abstract_sentence -> contradiction_prob; text_to_text takes the place of
    contradict where the stance asks for it; rerank -> ce_score; relevant ->
    relevant boolean; rewrites: question, sentence_text -> rewrites array<string>.
    queries (qa_id, sentence_id, vector) and vectors (pmid, vector) are the dense side.
    """

    support: Callable[[DataFrame], DataFrame] | None = None
    contradict: Callable[[DataFrame], DataFrame] | None = None
    text_to_text: Callable[[DataFrame], DataFrame] | None = None
    rerank: Callable[[DataFrame], DataFrame] | None = None
    relevant: Callable[[DataFrame], DataFrame] | None = None
    rewrites: Callable[[DataFrame], DataFrame] | None = None
    queries: DataFrame | None = None
    vectors: DataFrame | None = None


@dataclass
class EvidenceRun:
    hits: DataFrame
    picks: DataFrame
    scores: DataFrame
    seconds: dict[str, float] = field(default_factory=dict)
    made: list[str] = field(default_factory=list)


def overlap(a: str, b: str):
    """A stance stand-in on the JVM: share of the left's distinct terms that the right has."""
    x, y = F.array_distinct(T.terms(F.col(a))), F.array_distinct(T.terms(F.col(b)))
    return F.when(F.size(x) > 0, F.size(F.array_intersect(x, y)) / F.size(x)).otherwise(F.lit(0.0))


def retrieve(topics: DataFrame, docs: DataFrame, config: EvidenceConfig, k: int, path: str, models: Models) -> DataFrame:
    """(qa_id, sentence_id, pmid, bm25_score, rank) of one path, support or contradict, by the run's flavour.

    In hybrid and rewrite runs bm25_score is the fused score.
    """
    q = topics.select(*BY, "question", "sentence_text", T.query_build(F.col("question"), F.col("sentence_text")).alias("query"))
    terms = RT.query_terms(q, BY)
    if config.flavour == "rm3":
        return RT.rm3(terms, docs, BY, k)
    if config.flavour == "filtered_rm3" and path == "support":

        def accepted(first: DataFrame) -> DataFrame:
            pairs = first.join(docs, "pmid").join(q.select(*BY, "sentence_text"), BY)
            got = models.relevant(pairs) if models.relevant else pairs.withColumn("relevant", overlap("sentence_text", "contents") >= 0.5)
            return got.filter("relevant")

        return RT.filtered_feedback(q.select(*BY, "query"), accepted, docs, BY, k, config.initial_k)
    if config.flavour == "rewrite":
        none = F.array().cast("array<string>")
        asked = models.rewrites(q) if models.rewrites else q.withColumn("rewrites", none)
        variants = RT.with_fallback(q.select(*BY, "query"), asked, BY, config.rewrites)
        return RT.rewrite_fusion(variants, docs, BY, k).drop("query").withColumnRenamed("rrf_score", "bm25_score")
    if config.flavour == "hybrid":
        if models.queries is None or models.vectors is None:
            raise ValueError("a hybrid run needs query vectors and document vectors")
        dense = RT.dense_topk(models.queries, models.vectors, BY, k)
        return RT.hybrid(RT.bm25(terms, docs, BY, k), dense, BY, k).withColumnRenamed("rrf_score", "bm25_score")
    if config.flavour not in ("bm25", "filtered_rm3"):
        raise ValueError(f"unknown flavour {config.flavour}")
    return RT.bm25(terms, docs, BY, k)


def run_evidence(topics: DataFrame, docs: DataFrame, qrels: DataFrame, config: EvidenceConfig, support_score: Callable | None = None, contradict_score: Callable | None = None, models: Models | None = None, folder: str | None = None, reuse_from: str | None = None) -> EvidenceRun:
    """topics (qa_id, question, sentence_id, sentence_text, existing) ranked, scored, selected, validated and evaluated.

    With a folder, the stages retrieval_support, retrieval_contradict, scored_support,
    scored_contradict and picks are its tables; of reuse_from the two retrievals are read.
    """
    models = replace_models(models, support_score, contradict_score)
    seconds, made = {}, []

    def stage(name: str, make: Callable[[], DataFrame], reusable: bool = False) -> DataFrame:
        if folder is None:
            return make()
        began = time.monotonic()
        out, new = storage.stage(topics.sparkSession, folder, name, make, reuse_from if reusable else None)
        seconds[name] = round(time.monotonic() - began, 3)
        made.extend([name] if new else [])
        return out

    texts = topics.select(*BY, "sentence_text")
    if config.flavour in ("bm25", "rm3") and folder is None:  # both paths are one ranking
        every = retrieve(topics, docs, config, max(config.support_k, config.contradict_k), "both", models)
        sup_hits, con_hits = every.filter(F.col("rank") <= config.support_k), every.filter(F.col("rank") <= config.contradict_k)
    else:
        sup_hits = stage("retrieval_support", lambda: retrieve(topics, docs, config, config.support_k, "support", models), True)
        con_hits = stage("retrieval_contradict", lambda: retrieve(topics, docs, config, config.contradict_k, "contradict", models), True)

    def score_support() -> DataFrame:
        sup = sup_hits.join(docs, "pmid").join(texts, BY)
        if config.rerank:
            scored = models.rerank(sup) if models.rerank else sup.withColumn("ce_score", overlap("sentence_text", "contents"))
            sup = RT.rerank_topk(scored, BY, config.rerank_k)
        else:
            sup = RT.passthrough_rerank(sup, BY, config.rerank_k)
        return models.support(sup) if models.support else sup.withColumn("entailment_prob", overlap("sentence_text", "contents"))

    def score_contradict() -> DataFrame:
        # Each document is cut into sentences once, whatever number of cells it is in.
        cut = con_hits.select("pmid").distinct().join(docs, "pmid").select("pmid", F.explode(T.sentence_split(F.col("contents"))).alias("abstract_sentence"))
        if config.cue_patterns is None or config.cue_patterns:
            cut = cut.filter(T.cue_match(F.col("abstract_sentence"), None if config.cue_patterns is None else list(config.cue_patterns)))
        con = con_hits.select(*BY, "pmid", F.col("rank").alias("bm25_rank"), "bm25_score").join(texts, BY).join(cut, "pmid")
        model = models.text_to_text if config.stance == "text_to_text" else models.contradict
        con = model(con) if model else con.withColumn("contradiction_prob", overlap("sentence_text", "abstract_sentence"))
        return RT.max_pool(con, [*BY, "pmid"])

    sup, con = stage("scored_support", score_support), stage("scored_contradict", score_contradict)
    existing = topics.select(*BY, F.explode("existing").alias("pmid"))
    left_out = existing if config.exclude_existing else None
    picks = stage("picks", lambda: SE.greedy_select(sup, con, left_out, config.tau_support, config.tau_contradict, config.cap))
    if folder is not None and not config.tolerate_invalid:
        SE.validate(picks, corpus=docs, existing=existing, cap=config.cap)
    cells = topics.select(*BY, F.explode(F.array(F.lit("support"), F.lit("contradict"))).alias("class"))
    return EvidenceRun(sup_hits.unionByName(con_hits).dropDuplicates([*BY, "pmid"]), picks, EV.evaluate(cells, picks, qrels), seconds, made)


def replace_models(models: Models | None, support: Callable | None, contradict: Callable | None) -> Models:
    models = models or Models()
    return replace(models, support=support or models.support, contradict=contradict or models.contradict)


def write_run(topics: DataFrame, run: EvidenceRun, path: str, cap: int = 3) -> None:
    """The official submission as one JSON row a topic, put in place at once."""
    storage.write_json_atomic(JU.official_submission(topics, run.picks, cap), path)
