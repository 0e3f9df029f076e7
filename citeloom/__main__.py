"""Command lines: python -m citeloom COMMAND ... (each prints one JSON line)."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators import agreement as AG
from citeloom.operators import evaluation as EV
from citeloom.operators import pools as PO
from citeloom.operators import reports as RP
from citeloom.operators import storage
from citeloom.plans import pipeline as PL
from citeloom.sources import articles as AR
from citeloom.sources import judgements as JU


def _articles(spark: SparkSession, path: str) -> DataFrame:
    return AR.read_articles_jsonl(spark, path) if path.rstrip("/").endswith((".jsonl", ".json")) else AR.read_articles_xml(spark, path)


def _collection(spark: SparkSession, path: str) -> DataFrame:
    """(pmid, contents) of a collection (JSON lines of id, contents)."""
    return spark.read.schema("id string, contents string").json(path).withColumnRenamed("id", "pmid")


def _cells(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    cells = JU.submission_cells(spark, path)
    return cells.drop("pmids"), JU.predictions(cells)


def parse(spark, a) -> dict:
    """Articles of XML or JSON lines to JSON lines, or their number."""
    rows = _articles(spark, a.input)
    n = rows.count() if a.count else AR.write_jsonl(rows, a.output)
    if a.expect is not None:
        storage.count_within(rows, a.expect)
    return {"articles": n}


def collection(spark, a) -> dict:
    return {"documents": AR.write_jsonl(AR.to_collection(_articles(spark, a.input)), a.output)}


def run(spark, a) -> dict:
    """A run of a variant over topics and a collection: stages, submission and scores."""
    topics, docs, config = JU.read_topics(spark, a.topics), _collection(spark, a.collection), PL.VARIANTS[a.variant]
    got = PL.run_evidence(topics, docs, JU.read_qrels(spark, a.qrels), config, folder=a.output, reuse_from=a.reuse_from)
    PL.write_run(topics, got, f"{a.output}/submission", config.cap)
    return {"made": got.made, "seconds": got.seconds, "scores": [r.asDict() for r in got.scores.collect()]}


def metrics(spark, a) -> dict:
    cells, pred = _cells(spark, a.submission)
    return {"scores": [r.asDict() for r in EV.evaluate(cells, pred, JU.read_qrels(spark, a.qrels), a.level, source=a.source).collect()]}


def summary(spark, a) -> dict:
    """Runs (name=submission) against an official and an expanded pool."""
    out = None
    for item in a.runs:
        name, _, path = item.partition("=")
        cells, pred = _cells(spark, path)
        for pool, at in (("official", a.official), ("expanded", a.expanded)):
            one = EV.evaluate(cells, pred, JU.read_qrels(spark, at)).withColumns({"run": F.lit(name), "pool": F.lit(pool)})
            out = one if out is None else out.unionByName(one)
    return {"runs": [r.asDict() for r in EV.run_summary(out).collect()]}


def judge_validate(spark, a) -> dict:
    """Gate of a judge's validation records (gold, pred), and their cost."""
    rows = spark.read.json(a.records)
    gate = AG.gate(AG.label_scores(rows)).first().asDict()
    return gate | {"cost": [r.asDict() for r in RP.cost_rollup(rows).collect()] if "cost_usd" in rows.columns else []}


def expand_pool(spark, a) -> dict:
    """Human judgements and a judge's positives as one pool."""
    human = JU.read_qrels(spark, a.human)
    judged = PO.expanded_pool(human.limit(0), spark.read.schema("qa_id string, sentence_id int, pmid string, label string, confidence double, backend string").json(a.records))
    return {"rows": PO.write_pool(human, judged, a.output)}


def compare_judges(spark, a) -> dict:
    rows = spark.read.json(a.records).select(F.struct(*PO.TRIPLE).alias("unit"), F.col("backend").alias("rater"), "label", F.monotonically_increasing_id().alias("ord"))
    return {"pairs": [r.asDict() for r in AG.pairwise_agreement(rows, ["unit"]).collect()]}


def intersection(spark, a) -> dict:
    inputs = [JU.read_qrels(spark, p) for p in a.pools]
    pool = PO.intersection_pool(inputs, a.supports_from)
    counts = PO.intersection_counts(inputs, pool).first().asDict()
    shared = [r.asDict() for r in PO.pairwise_intersections(inputs).collect()] if len(inputs) > 2 else []
    storage.write_json_atomic(pool.drop("ord"), a.output, [*PO.KEY], {"counts": counts, "pairs": shared})
    return counts | {"pairs": shared}


def diff(spark, a) -> dict:
    """What one of two submissions cites and the other doesn't, with its judgement."""
    both = [(_cells(spark, p)[1]).withColumn("run", F.lit(n)) for n, p in (("a", a.first), ("b", a.second))]
    out = EV.run_diff(both[0].unionByName(both[1]), JU.read_qrels(spark, a.qrels), "a", "b")
    return {"rows": storage.write_json_atomic(out, a.output, ["qa_id", "sentence_id", "class", "pmid"])}


COMMANDS = {
    "parse": (parse, {"input": {}, "--output": {}, "--count": {"action": "store_true"}, "--expect": {"type": int}}),
    "collection": (collection, {"input": {}, "output": {}}),
    "run": (run, {"--variant": {"default": "baseline", "choices": sorted(PL.VARIANTS)}, "--topics": {"required": True}, "--collection": {"required": True}, "--qrels": {"required": True}, "--output": {"required": True}, "--reuse-from": {}}),
    "metrics": (metrics, {"submission": {}, "qrels": {}, "--level": {"default": "sentence", "choices": ["sentence", "question"]}, "--source": {"default": "any", "choices": ["any", "human", "llm"]}}),
    "summary": (summary, {"runs": {"nargs": "+"}, "--official": {"required": True}, "--expanded": {"required": True}}),
    "judge-validate": (judge_validate, {"records": {}}),
    "expand-pool": (expand_pool, {"human": {}, "records": {}, "output": {}}),
    "compare-judges": (compare_judges, {"records": {}}),
    "intersection": (intersection, {"pools": {"nargs": "+"}, "--output": {"required": True}, "--supports-from": {"type": int, "default": 0}}),
    "diff": (diff, {"first": {}, "second": {}, "qrels": {}, "output": {}}),
}


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    top = argparse.ArgumentParser(prog="citeloom", description=__doc__)
    subs = top.add_subparsers(dest="command", required=True)
    for name, (f, options) in COMMANDS.items():
        sub = subs.add_parser(name, help=f.__doc__)
        for option, more in options.items():
            sub.add_argument(option, **more)
    a = top.parse_args(args)
    out = COMMANDS[a.command][0](spark or SparkSession.builder.appName("citeloom").getOrCreate(), a)
    print(json.dumps(out, default=str, sort_keys=True))
    return out


if __name__ == "__main__":
    main()
