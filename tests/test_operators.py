"""Operators that no SQL expresses, against brute force or stated cases."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.functions import text as T
from citeloom.operators import agreement, calibration, evaluation, models, pools, resample, retrieval, selection
from citeloom.plans import bindings, pipeline
from citeloom.streaming import judging


def values(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_text_functions(spark):
    lit = F.lit
    assert values(spark, T.query_build(lit("q"), lit("s")), T.query_build(lit(""), lit("s"))) == ["q s", "s"]
    got = values(spark, *(T.label_normalise(lit(x)) for x in ("Supports", "contradicts.", '"Neutral"', "not relevant", "NOT sure", "maybe", "", None)))
    assert got == ["Supports", "Contradicts", "Neutral", "Not relevant", "Not relevant", "Neutral", "Neutral", "Neutral"]
    cases = {'{"label": "Supports", "confidence": 0.7}': ("Supports", 0.7), 'so: {"label": "x", "confidence": "0.5"}!': ("Neutral", 0.5), '{"confidence": 0.4}': ("Neutral", 0.4), "none": ("Neutral", 0.0), '{"label": "Supports", ': ("Neutral", 0.0), '{"label": "Contradicts", "confidence": 7}': ("Contradicts", 1.0), '{"label": "Supports", "confidence": "high"}': ("Supports", 0.0)}
    assert [tuple(r) for r in values(spark, *(T.parse_judgement(lit(c)) for c in cases))] == list(cases.values())
    assert values(spark, T.parse_rewrites(lit('x {"queries": [" a ", "", 3, "b", "c"]} y'), 2), T.parse_rewrites(lit("bad"), 2)) == [["a", "b"], []]
    assert values(spark, *(T.parse_relevant(lit(x)) for x in ('{"relevant": true}', 'well {"relevant": false}', '{"relevant": "yes"}', "", None))) == [True, False, False, False, False]
    for m in values(spark, T.judge_messages(lit(" s "), lit("a b c"), "sys", 2), T.filter_messages(lit(" s "), lit("a b"), "sys")):
        system, user = json.loads(m)
        assert system == {"role": "system", "content": "sys"} and user["content"] == "Answer sentence:\ns\n\nAbstract:\na b"
    assert json.loads(values(spark, T.rewrite_messages(lit("q"), lit("s"), 2))[0])[1]["content"] == "Question: q\nAnswer sentence: s\n\nWrite 2 varied search queries that target the claim."
    assert values(spark, T.excerpt(lit(None), lit("a\nb"), width=10), T.excerpt(lit("x" * 20), width=10)) == ["a b", "x" * 9 + "…"]
    assert np.allclose(values(spark, T.softmax(F.array(lit(1.0), lit(2.0))))[0], [1 / (1 + math.e), math.e / (1 + math.e)])
    assert values(spark, T.cue_match(lit("However, it DID NOT work")), T.cue_match(lit("it worked")), T.cue_match(lit(None))) == [True, False, False]


def test_pool_coverage_against_brute_force(spark):
    r = random.Random(1)
    keys = [(f"t{i}", j, c) for i in range(6) for j in range(2) for c in ("support", "contradict")]
    pool = sorted({(*r.choice(keys), f"d{r.randrange(12)}") for _ in range(70)})
    pred = sorted({(*r.choice(keys), f"d{r.randrange(12)}") for _ in range(40)})
    kind = "qa_id string, sentence_id int, class string"
    got = resample.pool_coverage(spark.createDataFrame(keys, kind), spark.createDataFrame(pred, kind + ", pmid string"), spark.createDataFrame(pool, kind + ", pmid string"), [0.05, 0.4, 1.0], 4, 3).collect()
    import hashlib

    want = {}
    for it in range(4):
        order = sorted(pool, key=lambda p: (int(hashlib.md5("|".join(map(str, (3, it, *p))).encode()).hexdigest()[:12], 16), p))
        for f in (0.05, 0.4, 1.0):
            sample = set(order[: max(1, round(len(pool) * f))])
            for c in ("support", "contradict"):
                f1 = []
                for k in keys:
                    pos, said = {p for p in sample if p[:3] == k}, {p for p in pred if p[:3] == k}
                    if k[2] == c and (pos or said):
                        f1.append(2 * len(pos & said) / (len(pos) + len(said)) if pos else 0.0)
                if any(p[2] == c for p in sample):
                    want[f, it, c] = sum(f1) / len(f1)
    assert {(x.fraction, x.it, x["class"]): pytest.approx(x.f1) for x in got} == want
    s = spark.createDataFrame([("a", "support", 0.1, 0.2), ("b", "support", 0.1, 0.3), ("a", "support", 1.0, 0.5), ("b", "support", 1.0, 0.4)], "run string, class string, fraction double, mean double")
    flip = resample.rank_flip(s).first()
    assert (flip.order_low, flip.order_high, flip.same) == (["b", "a"], ["a", "b"], False)


def test_percentiles_places_and_positions(spark):
    r = random.Random(2)
    rows = [(g, r.choice([1.0, 2.0, r.random() * 50])) for g in "aab" for _ in range(700)] + [("c", 5.0)]
    got = {x.g: (x.lo, x.hi) for x in resample.percentile_ci(spark.createDataFrame(rows, "g string, v double"), "v", by=["g"], buckets=16).collect()}
    for g in "abc":
        v = sorted(x for h, x in rows if h == g)
        assert got[g] == (v[max(0, int(0.025 * len(v)))], v[min(len(v) - 1, int(0.975 * len(v)))])
    few = resample.subsample(spark.range(1000), 0.25, ["id"], 4)
    assert few.count() == few.distinct().count() == 250
    from citeloom.operators.storage import with_position

    got = {x.id: x.i for x in with_position(spark.range(500).select((F.col("id") * 7919 % 500).alias("id")).repartition(5), ["id"]).collect()}
    assert got == {i: i for i in range(500)}


def test_isotonic_is_least_squares(spark):
    r = random.Random(3)
    rows = [(r.choice("ab"), round(r.random(), r.choice([1, 2, 6])), int(r.random() < 0.5)) for _ in range(600)]
    fit = calibration.isotonic_fit(spark.createDataFrame(rows, "g string, confidence double, correct int"), ["g"]).collect()
    for g in "ab":
        xs = sorted({c for h, c, _ in rows if h == g})
        means = {x: [k for h, c, k in rows if h == g and c == x] for x in xs}
        blocks = [[sum(means[x]), len(means[x]), [x]] for x in xs]  # textbook pooling, from the left
        i = 0
        while i < len(blocks) - 1:
            if blocks[i][0] * blocks[i + 1][1] > blocks[i + 1][0] * blocks[i][1]:
                b = blocks.pop(i + 1)
                blocks[i] = [blocks[i][0] + b[0], blocks[i][1] + b[1], blocks[i][2] + b[2]]
                i = max(0, i - 1)
            else:
                i += 1
        got = sorted((f.x, f.y) for f in fit if f.g == g)
        assert got == [(b[2][-1], pytest.approx(b[0] / b[1])) for b in blocks]


def test_alpha_input_and_pools(spark):
    kind = "unit int, coder string, label string"
    for rows in ([(1, "a", "Neutral")], [(1, "a", "Neutral"), (1, "b", "Neutral"), (2, "a", "Neutral")], [(1, "a", "odd"), (1, "b", "Neutral")]):
        with pytest.raises(ValueError):
            agreement.check_ratings(spark.createDataFrame(rows, kind))
    agreement.check_ratings(spark.createDataFrame([(1, "a", "Neutral"), (1, "b", None)], kind))
    t = spark.createDataFrame([("r1", "official", "1", 0.1), ("r1", "expanded", "1", 0.2), ("r2", "official", "1", 0.3)], "run string, pool string, qa_id string, F1 double").withColumns({"setting": F.lit("strict"), "class": F.lit("support")})
    assert evaluation.by_topic_matrix(t, ["r1", "r2"]).first().asDict() == {"qa_id": "1", "r1": 20.0, "r2": 30.0}
    flags = spark.createDataFrame([(False,), (True,), (None,)], "incomplete boolean")
    assert pools.any_incomplete(flags).first().incomplete and not pools.any_incomplete(flags.limit(0)).first().incomplete
    triple = "qa_id string, sentence_id int, pmid string, label string"
    todo, done = spark.createDataFrame([("1", 0, "5", None), ("1", 0, "6", None)], triple), spark.createDataFrame([("1", 0, "5", "Neutral")], triple)
    assert [r.pmid for r in pools.resume(todo, done).collect()] == ["6"]


def test_calibration_summary_has_folds(spark):
    rows = [("m", f"t{i % 7}", "Supports", "Supports" if i % 3 else "Neutral", (i % 10) / 10, int(i % 3 > 0)) for i in range(120)]
    got = calibration.calibration_summary(spark.createDataFrame(rows, "backend string, qa_id string, gold string, pred string, confidence double, correct int")).first()
    assert got.n == 120 and 0 <= got.ece_kfold <= 1 and got.ece_in_sample <= got.ece_raw + 1e-9


def test_validation(spark):
    picks = spark.createDataFrame([("1", 0, "support", p) for p in ("5", "5", "", "6")] + [("1", 0, "contradict", "6")], "qa_id string, sentence_id int, class string, pmid string")
    rules = {r.rule for r in selection.violations(picks, spark.createDataFrame([("5",)], "pmid string"), spark.createDataFrame([("1", 0, "5")], "qa_id string, sentence_id int, pmid string")).collect()}
    assert rules == {"over_cap", "empty_id", "duplicate", "reused", "not_in_corpus", "existing"}
    with pytest.raises(ValueError, match="reused"):
        selection.validate(picks)
    selection.validate(picks.filter("pmid = '6' and class = 'support'"))
    good = {"meta_data": {"qa_id": "1"}, "answer": [{"text": "t", "existing_supported_citations": None, "supported_citations": [], "contradicted_citations": [1]}]}
    bad = [good | {"meta_data": {}}, good | {"answer": []}, good | {"answer": [{"text": "", "existing_supported_citations": 3, "supported_citations": None, "contradicted_citations": []}]}]
    raw = spark.createDataFrame([(json.dumps(x),) for x in [good, *bad]] + [("[1]",), ("nope",)], "raw string")
    found = sorted(r.rule for r in selection.shape_violations(raw).collect())
    assert found == sorted(["no_qa_id", "no_answer", "no_text", "existing_supported_citations not_a_list", "supported_citations not_a_list", "not_an_object", "not_an_object"])
    assert [r.sentence_id for r in selection.order_violations(spark.createDataFrame([("1", 0, 1), ("1", 1, 1), ("1", 2, 2)], "qa_id string, pos int, sentence_id int")).collect()] == [1]


def test_models(spark):
    pairs = spark.createDataFrame([("1", 0, "a", "the cat sat", "the cat"), ("1", 0, "b", "the cat sat", ""), ("1", 0, "c", "x", None)], "qa_id string, sentence_id int, pmid string, sentence_text string, contents string")
    got = {r.pmid: r.ce for r in models.score_pairs(pairs, lambda: models.token_overlap, "sentence_text", "contents", ["ce"]).collect()}
    assert got == {"a": pytest.approx(2 / 3), "b": 0.0, "c": 0.0}
    s = models.stance(pairs, lambda: lambda a, b: np.array([[1.0, 0.0, -1.0]] * len(a))).first()
    assert s.entailment_prob + s.neutral_prob + s.contradiction_prob == pytest.approx(1) and s.entailment_prob > s.contradiction_prob
    seen = models.constrained_stance(pairs, lambda: lambda texts: np.array([[0.0, len(t), 0.0, 1.0, 2.0] for t in texts]), (3, 4, 1)).collect()
    assert len(seen) == 3 and all(abs(r.entailment_prob + r.neutral_prob + r.contradiction_prob - 1) < 1e-9 and r.contradiction_prob > 0.9 for r in seen)
    assert values(spark, T.premise(F.lit("A"), F.lit("s"))) == ["mednli: premise: A hypothesis: s"]
    v = models.encode_texts(pairs, lambda: lambda t: np.array([[3.0, 4.0]] * len(t)), "contents").first().vector
    assert np.allclose(v, [0.6, 0.8])
    calls = spark.sparkContext.accumulator(0)

    def make():
        def call(sentence, abstract):
            calls.add(1)
            return {"label": "Supports", "confidence": 2, "input_tokens": 1_000_000, "output_tokens": 0}

        return call

    rows = {r.pmid: r for r in models.judge(pairs, models.backend_of("openai-mini", make)).collect()}
    assert (rows["a"].label, rows["a"].confidence, rows["a"].cost_usd, rows["a"].backend) == ("Supports", 1.0, 0.15, "openai-gpt-4o-mini")
    assert (rows["b"].label, rows["b"].skip_reason, rows["c"].skip_reason) == ("Not relevant", "empty_abstract", "empty_abstract") and calls.value == 1
    assert len(models.NAMES) == 5 and models.output_path("/x/", "hf-qwen") == "/x/records-hf-qwen-2.5-72b"
    with pytest.raises(KeyError):
        models.backend_of("nobody")
    models.register(models.Backend("mine", make))
    assert models.backend_of("mine").price == (0.0, 0.0)
    answers = {r.pmid: r.relevant for r in models.relevance_filter(pairs, lambda: lambda m: '{"relevant": true}' if "the cat" in m else "what?").collect()}
    assert answers == {"a": True, "b": False, "c": False}


def test_quota_and_retries(spark):
    waits, left = [], [models.CallFailed(500), TimeoutError(), models.CallFailed(429)]

    def call():
        if left:
            raise left.pop(0)
        return {"ok": 1}

    assert models.with_retries(call, sleep=waits.append) == {"ok": 1} and len(waits) == 3 and waits[2] > waits[0]
    for e in (models.CallFailed(402), models.CallFailed(429, "insufficient_quota")):
        with pytest.raises(models.QuotaExhausted):
            models.with_retries(lambda e=e: (_ for _ in ()).throw(e))
    with pytest.raises(models.CallFailed):
        models.with_retries(lambda: (_ for _ in ()).throw(models.CallFailed(400)))

    def make():
        n = [0]

        def ask(s, t):
            n[0] += 1
            if n[0] > 1:
                raise models.CallFailed(402)
            return {"label": "Neutral", "confidence": 0.5}

        return ask

    pairs = spark.createDataFrame([(i, "s", "a") for i in range(4)], "i int, sentence_text string, contents string").coalesce(1)
    rows = models.judge(pairs, models.Backend("q", make)).orderBy("i").collect()
    assert [r.skip_reason for r in rows] == [None, "quota", "quota", "quota"]


def test_replay(spark):
    pairs = spark.createDataFrame([("s", "a"), ("s", "b")], "sentence_text string, contents string")
    recorded = pairs.limit(1).select(T.prompt_key(F.col("sentence_text"), F.col("contents")).alias("prompt_key"), F.lit("Supports").alias("label"), F.lit(0.9).alias("confidence"))
    got = {r.contents: (r.label, r.confidence) for r in models.replay(pairs, recorded, "sentence_text", "contents").collect()}
    assert got == {"a": ("Supports", 0.9), "b": ("Neutral", 0.0)}
    with pytest.raises(Exception, match="no recorded reply"):
        models.replay(pairs, recorded, "sentence_text", "contents", None).collect()


def test_dense_build_in_shards(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), "x" * (i + 1)) for i in range(25)], "id string, contents string")
    made = spark.sparkContext.accumulator(0)

    def encoder():
        def run(texts):
            made.add(len(texts))
            return np.array([[len(t), 1.0] for t in texts])

        return run

    for _ in range(2):  # the second run finds all shards finished
        out = models.build_dense(rows, encoder, str(tmp_path), shard=10)
        assert out.count() == 25 and made.value == 25 and len({r.shard for r in out.collect()}) <= 3


def test_judging_stream_resumes(spark, tmp_path):
    kind = "qa_id string, sentence_id int, pmid string"
    source, records, state = (str(tmp_path / n) for n in ("source", "records", "state"))
    judge = lambda df: df.select("*", F.lit("Neutral").alias("label"), F.lit(0.01).alias("cost_usd"))
    for rows in ([("1", 0, "5"), ("1", 0, "5"), ("1", 0, "6")], [("1", 0, "6"), ("1", 0, "7")]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
        judging.judge_stream(spark, source, kind, records, state, judge).awaitTermination()
    assert sorted(r.pmid for r in spark.read.parquet(records).collect()) == ["5", "6", "7"]
    spark.createDataFrame([("1", 0, "8")], kind).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="cost cap"):
        judging.judge_stream(spark, source, kind, records, state, judge, max_cost=0.02).awaitTermination()


def test_rewrites_and_passages(spark):
    q = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "qa_id string, query string")
    w = spark.createDataFrame([("1", ["x", " ", "y", "z"]), ("2", [" "])], "qa_id string, rewrites array<string>")
    got = sorted(map(tuple, retrieval.with_fallback(q, w, ["qa_id"], 2).collect()))
    assert got == [("1", 0, "a"), ("1", 1, "x"), ("1", 2, "y"), ("2", 0, "b"), ("3", 0, "c")]
    assert ("2", 0, "b") in map(tuple, retrieval.with_fallback(q, w, ["qa_id"], 2, original=False).collect())
    docs = spark.createDataFrame([("d1", "say  one two three four five six now"), ("d2", "one two three four five sixty"), ("d3", "Hello"), ("d4", None)], "pmid string, contents string")
    texts = spark.createDataFrame([("long", "one two three\nfour five six"), ("short", "Hello"), ("none", "six seven"), ("empty", " ")], "qa_id string, passage string")
    assert sorted(map(tuple, bindings.passages_held(docs, texts).collect())) == [("long", "d1"), ("short", "d3")]


def test_bm25_and_dense_against_brute_force(spark):
    r = random.Random(5)
    docs = [(f"d{i}", " ".join(f"w{min(int(r.paretovariate(0.8)), 30)}" for _ in range(r.randint(0, 30)))) for i in range(300)]
    docs += [(f"e{i}", docs[0][1]) for i in range(20)]  # ties
    queries = [(f"q{i}", " ".join(f"w{r.randint(1, 32)}" for _ in range(r.randint(1, 5)))) for i in range(12)]
    by = ["qa_id"]
    got = retrieval.bm25(retrieval.query_terms(spark.createDataFrame(queries, "qa_id string, query string"), by), spark.createDataFrame(docs, "pmid string, contents string").repartition(3), by, 7).collect()
    toks = {d: t.split() for d, t in docs}
    avg, n = sum(map(len, toks.values())) / len(toks), len(toks)
    for q, t in queries:
        scores = {}
        for w in t.split():
            df = sum(w in ts for ts in toks.values())
            for d, ts in toks.items():
                if tf := ts.count(w):
                    scores[d] = scores.get(d, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * len(ts) / avg))
        want = sorted(scores, key=lambda d: (-round(scores[d], 9), d))[:7]
        assert [x.pmid for x in sorted((g for g in got if g.qa_id == q), key=lambda g: g.rank)] == want
    x = np.random.default_rng(1).standard_normal((60, 8))
    v = spark.createDataFrame([(i, [float(e) for e in row]) for i, row in enumerate(x)], "pmid long, vector array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for block in (4096, 3):
        got = retrieval.dense_topk(v.filter("pmid < 9").withColumnRenamed("pmid", "qa_id"), v.repartition(4), by, 5, block=block).collect()
        assert all([g.pmid for g in sorted((g for g in got if g.qa_id == q), key=lambda g: g.rank)] == list(np.argsort(-(u[q] @ u.T), kind="stable")[:5]) for q in range(9))


def evidence(spark):
    topics = spark.createDataFrame([("1", "Does tea help?", 0, "Tea lowers pressure.", ["9"]), ("1", "Does tea help?", 1, "Coffee raises pressure.", [])], "qa_id string, question string, sentence_id int, sentence_text string, existing array<string>")
    docs = spark.createDataFrame([("9", "Tea lowers pressure. However tea did not help."), ("8", "Tea lowers pressure in a trial."), ("7", "Coffee raises pressure. However coffee raises pressure."), ("6", "Nothing here.")], "pmid string, contents string")
    qrels = spark.createDataFrame([("1", 0, "8", "support", 1, "human", None, 0)], "qa_id string, sentence_id int, pmid string, class string, relevance int, source string, confidence double, ord int")
    return topics, docs, qrels


@pytest.mark.parametrize("name", sorted(pipeline.VARIANTS))
def test_variants(spark, name):
    topics, docs, qrels = evidence(spark)
    m = pipeline.Models(
        rewrites=lambda q: q.withColumn("rewrites", F.array(F.lit("tea pressure"), F.lit(""))),
        text_to_text=lambda c: c.withColumn("contradiction_prob", F.lit(0.9)),
        queries=spark.createDataFrame([("1", 0, [1.0, 0.0]), ("1", 1, [0.0, 1.0])], "qa_id string, sentence_id int, vector array<double>"),
        vectors=spark.createDataFrame([("8", [1.0, 0.1]), ("7", [0.1, 1.0])], "pmid string, vector array<double>"),
    )
    got = pipeline.run_evidence(topics, docs, qrels, pipeline.VARIANTS[name], models=m)
    picks = {(r.sentence_id, r["class"], r.pmid) for r in got.picks.collect()}
    assert (0, "support", "8") in picks and got.scores.count() == 4
    assert ((0, "support", "9") in picks) == (name == "allow_existing")


def test_run_in_a_folder(spark, tmp_path):
    topics, docs, qrels = evidence(spark)
    one = pipeline.run_evidence(topics, docs, qrels, pipeline.BASELINE, folder=str(tmp_path / "one"))
    assert one.made == ["retrieval_support", "retrieval_contradict", "scored_support", "scored_contradict", "picks"]
    assert pipeline.run_evidence(topics, docs, qrels, pipeline.BASELINE, folder=str(tmp_path / "one")).made == []
    two = pipeline.run_evidence(topics, docs, qrels, pipeline.VARIANTS["no_rerank"], folder=str(tmp_path / "two"), reuse_from=str(tmp_path / "one"))
    assert two.made == ["scored_support", "scored_contradict", "picks"] and set(two.seconds) >= set(two.made)
    with pytest.raises(ValueError, match="existing"):
        pipeline.run_evidence(topics, docs, qrels, pipeline.replace(pipeline.BASELINE, exclude_existing=False), folder=str(tmp_path / "three"))
    assert pipeline.run_evidence(topics, docs, qrels, pipeline.VARIANTS["allow_existing"], folder=str(tmp_path / "four")).made


def test_command_lines(spark, tmp_path, capsys):
    from citeloom.__main__ import main

    topics, docs, qrels = evidence(spark)
    t = [{"meta_data": {"qa_id": "1", "question": "Does tea help?"}, "answer": [{"text": "Tea lowers pressure.", "existing_supported_citations": [9]}]}]
    (tmp_path / "t.json").write_text(json.dumps(t))
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps({"pmid": r.pmid, "title": "", "abstract": r.contents}) for r in docs.collect()))
    (tmp_path / "q.jsonl").write_text(json.dumps({"qa_id": "1", "sentence_id": 0, "pmid": "8", "class": "support"}))
    at = lambda n: str(tmp_path / n)
    assert main(["parse", at("a.jsonl"), "--count", "--expect", "4"], spark) == {"articles": 4}
    assert main(["collection", at("a.jsonl"), at("c")], spark) == {"documents": 4}
    got = main(["run", "--topics", at("t.json"), "--collection", at("c"), "--qrels", at("q.jsonl"), "--output", at("run")], spark)
    assert len(got["made"]) == 5
    (tmp_path / "s.json").write_text(json.dumps([json.loads(x) for f in (tmp_path / "run" / "submission").glob("part-*") for x in f.read_text().splitlines()]))
    scores = main(["metrics", at("s.json"), at("q.jsonl")], spark)["scores"]
    assert any(x["class"] == "support" and x["F1"] == 1.0 for x in scores)
    assert main(["summary", f"r={at('s.json')}", "--official", at("q.jsonl"), "--expanded", at("q.jsonl")], spark)["runs"][0]["official_support"] == 100.0
    rec = [{"qa_id": "1", "sentence_id": 0, "pmid": p, "label": x, "gold": x, "pred": x, "confidence": 0.8, "backend": b, "cost_usd": 0.1, "input_tokens": 1, "output_tokens": 1, "skip_reason": None} for p, x in (("7", "Contradicts"), ("6", "Neutral")) for b in ("m", "n")]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, rec)))
    assert main(["judge-validate", at("r.jsonl")], spark)["passed"]
    assert main(["compare-judges", at("r.jsonl")], spark)["pairs"][0]["agreement"] == 1.0
    assert main(["expand-pool", at("q.jsonl"), at("r.jsonl"), at("pool")], spark) == {"rows": 3}
    assert main(["intersection", at("pool"), at("pool"), "--output", at("both")], spark)["human_after"] == 1
    assert main(["diff", at("s.json"), at("s.json"), at("q.jsonl"), at("d")], spark) == {"rows": 0}
    assert capsys.readouterr().out.count("\n") == 10


def exchanges(df):
    return df.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange ")  # of a plan not run yet


def test_cells_are_dealt_once(spark):
    r = random.Random(8)
    cell = "qa_id string, sentence_id int, class string"
    keys = [(f"{t}", n, c) for t in range(5) for n in range(3) for c in evaluation.CLASSES]
    said = sorted({(r.choice("ab"), *r.choice(keys), f"d{r.randrange(4)}") for _ in range(90)})
    asked = [("a", *k) for k in keys] + [("b", *k) for k in keys[:20]]
    rows = [(*r.choice(keys), f"d{r.randrange(4)}", r.choice(["human", "llm"]), i) for i in range(80)]
    rows = [(t, n, r.choice([c, f"partial_{c}"]), p, 1, s, i) for t, n, c, p, s, i in rows]
    qrels = spark.createDataFrame(rows, f"{cell}, pmid string, relevance int, source string, ord int")
    predictions, cells = spark.createDataFrame(said, f"run string, {cell}, pmid string"), spark.createDataFrame(asked * 2, f"run string, {cell}")
    prf = evaluation.prf_cells(cells, predictions, evaluation.marked(qrels), ["qa_id", "sentence_id", "class"], run=["run"], deal=["qa_id"])
    got = {(x.run, x.setting, x.qa_id, x.sentence_id, x["class"]): (x.n_pred, x.n_pos, x.tp) for x in prf.collect()}
    want = {}
    for run, *k in asked:
        for setting in evaluation.SETTINGS:
            p = {d for t, n, c, d, *_ in rows if [t, n, c.replace("partial_", "")] == k and (setting == "relaxed" or c in evaluation.CLASSES)}
            q = {d for s, *x, d in said if s == run and x == k}
            if p or q:
                want[run, setting, *k] = (len(q), len(p), len(p & q))
    assert got == want
    topics = evaluation.per_topic(prf, ["run"])
    assert exchanges(prf) == exchanges(topics) == exchanges(evaluation.run_delta(topics, "a", "b")) == 1
    delta = {x.qa_id: x.delta for x in evaluation.run_delta(topics, "a", "b").collect()}
    old = {x.qa_id: x.delta for x in evaluation.topic_delta(topics.filter("run = 'a'"), topics.filter("run = 'b'")).collect()}
    assert delta == old and delta
    official = {(t, n, c, p) for t, n, c, p in {x[:4] for x in rows if x[2] in evaluation.CLASSES} if max((x[6], x[5]) for x in rows if x[:4] == (t, n, c, p))[1] == "human"}
    assert {tuple(x)[:4] for x in evaluation.marked_pools(qrels).filter("j = 3").collect()} == official


def test_three_topics_from_one_reading(spark):
    r = random.Random(9)
    for n in (3, 4, 400):
        rows = [(str(i), r.choice([-0.5, -0.25, 0.0, 0.25, 0.5]) if n > 4 else 0.25) for i in range(n)]
        made = spark.createDataFrame(rows, "qa_id string, delta double").repartition(3)
        p = min(rows, key=lambda x: (-x[1], int(x[0])))[0]
        m = min(rows, key=lambda x: (x[1], int(x[0])))[0]
        z = min((x for x in rows if x[0] not in (p, m)), key=lambda x: (abs(x[1]), int(x[0])))[0]
        out = evaluation.select_three(made)
        assert tuple(out.first()) == (p, z, m) and out._jdf.queryExecution().executedPlan().toString().count("RepartitionByNum") <= 1
    with pytest.raises(Exception, match="at least 3 topics"):
        evaluation.select_three(spark.createDataFrame([("1", 0.5), ("2", 0.1)], "qa_id string, delta double")).collect()


def test_draws_stay_where_they_are(spark):
    import hashlib

    r = random.Random(10)
    rows = [(i, r.random(), r.choice(["Supports", "Neutral"]), r.choice(["Supports", "Contradicts"])) for i in range(700)]
    made = spark.createDataFrame(rows, "id long, v double, gold string, pred string").repartition(3)
    at = lambda it: [int(hashlib.md5(f"4|{it}|{d}".encode()).hexdigest()[:12], 16) % 700 for d in range(700)]
    for pack, most in ((1 << 16, 1 << 22), (64, 1 << 22), (64, 10)):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(resample, "PACK", pack)
            m.setattr(resample, "MOST_SENT", most)
            means = resample.bootstrap_mean(made, "v", ["id"], 5, 4)
            assert {x.it: x["mean"] for x in means.collect()} == {it: pytest.approx(sum(rows[i][1] for i in at(it)) / 700) for it in range(5)}
            got = {x.it: x.weighted_f1 for x in resample.bootstrap_weighted_f1(made, ["id"], 5, 4).collect()}
        for it in range(5):
            some = [rows[i] for i in at(it)]
            f1 = {}
            for label in ("Supports", "Contradicts", "Neutral"):
                g, p, t = (sum(f(x) for x in some) for f in (lambda x, k=label: x[2] == k, lambda x, k=label: x[3] == k, lambda x, k=label: x[2] == x[3] == k))
                f1[label] = g * (2 * t / (g + p) if t else 0) / 700
            assert got[it] == pytest.approx(sum(f1.values()))
    sized = resample.draws(1_000_000, 1000, spark)  # Spark knows that these are too many to broadcast
    assert int(sized._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > 1 << 30


def test_passages_and_slabs_stay_in_tasks(spark):
    docs = spark.createDataFrame([(f"d{i}", f"x{i} one two three four five six y") for i in range(20)] + [("z", "one two three four five seven six")], "pmid string, contents string")
    texts = spark.createDataFrame([("a", "one two three\tfour five six"), ("b", "two  three"), ("c", "four six"), ("d", None)], "qa_id string, passage string")
    got = bindings.passages_held(docs, texts)
    assert {tuple(r) for r in got.collect()} == {(q, f"d{i}") for q in "ab" for i in range(20)} | {("b", "z")}
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    x = np.random.default_rng(2).integers(-2, 3, (300, 3)).astype(float) + 0.1  # many ties
    v = spark.createDataFrame([(i, [float(e) for e in row]) for i, row in enumerate(x)], "pmid long, vector array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(retrieval, "MOST_SCORES", 600)
        m.setattr(retrieval, "MOST_FOUND", 50)
        rows = retrieval.dense_topk(v.filter("pmid < 40").withColumnRenamed("pmid", "qa_id"), v.repartition(2), ["qa_id"], 5).collect()
    for q in range(40):
        want = sorted(range(300), key=lambda i: (-round(float(u[q] @ u[i]), 9), i))[:5]
        assert [r.pmid for r in sorted((r for r in rows if r.qa_id == q), key=lambda r: r["rank"])] == want


def test_pool_is_not_repeated(spark):
    rows = [(f"t{i % 9}", i % 3, "support", f"d{i}") for i in range(400)]
    pool = spark.createDataFrame(rows, "qa_id string, sentence_id int, class string, pmid string")
    named = pool.withColumn("name", F.concat_ws("|", "qa_id", "sentence_id", "class", "pmid"))
    key = ["qa_id", "sentence_id", "class", "pmid"]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(resample, "SIGMAS", 0.01)  # windows that miss are widened
        got = resample._last_rows(named, key, 400, [20, 200], 3, 5)
    for it in range(3):
        order = sorted((int(__import__("hashlib").md5("|".join(map(str, (5, it, *r))).encode()).hexdigest()[:12], 16), *r) for r in rows)
        assert got[it, 20] == order[19] and got[it, 200] == order[199]
