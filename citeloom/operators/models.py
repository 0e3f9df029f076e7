"""Models behind Arrow batches: scorers, encoders and judges, with replay and retries."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.functions import text as X
from citeloom.operators import storage

Scorer = Callable[[list[str], list[str]], np.ndarray]
RETRYABLE = {408, 429, 500, 502, 503, 504}


class QuotaExhausted(Exception):
    """No further call can succeed."""


class CallFailed(Exception):
    def __init__(self, status: int, reason: str = ""):
        super().__init__(f"{status} {reason}")
        self.status, self.reason = status, reason


def token_overlap(left: list[str], right: list[str]) -> np.ndarray:
    """A deterministic stand-in for a cross-encoder: share of the left's distinct words that the right has."""
    out = []
    for a, b in zip(left, right, strict=True):
        x, y = set(a.lower().split()), set(b.lower().split())
        out.append(len(x & y) / len(x) if x else 0.0)
    return np.array(out, float)


def score_pairs(pairs: DataFrame, scorer: Callable[[], Scorer], left: str, right: str, names: list[str], batch: int = 16) -> DataFrame:
    """pairs with one double column a name from scorer()(lefts, rights); the model is made once a task."""
    base = pairs.drop(*names)
    schema = T.StructType([*base.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = scorer()
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                got = np.asarray(model(part[left].fillna("").tolist(), part[right].fillna("").tolist()), float).reshape(len(part), -1)
                yield part.assign(**{n: got[:, i] for i, n in enumerate(names)})

    return base.mapInPandas(run, schema)


STANCE = ["entailment_prob", "neutral_prob", "contradiction_prob"]


def softmax_rows(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def stance(pairs: DataFrame, scorer: Callable[[], Scorer], left: str = "sentence_text", right: str = "contents", batch: int = 16) -> DataFrame:
    """pairs with the three probabilities of an inference model whose scorer gives (n, 3) logits or probabilities in that order."""

    def make() -> Scorer:
        model = scorer()

        def run(a: list[str], b: list[str]) -> np.ndarray:
            x = np.asarray(model(a, b), float)
            sums = x.sum(axis=1)
            return x if ((x >= 0).all() and np.allclose(sums, 1.0, atol=1e-6)) else softmax_rows(x)

        return run

    return score_pairs(pairs, make, left, right, STANCE, batch)


def constrained_stance(pairs: DataFrame, decoder: Callable[[], Callable[[list[str]], np.ndarray]], label_ids: tuple[int, int, int], left: str = "sentence_text", right: str = "contents", batch: int = 16) -> DataFrame:
    """pairs with the three probabilities of a text-to-text model decoded under constraint.

    decoder()(texts) gives the first output token's logits over the vocabulary;
    label_ids are the first tokens of entailment, neutral and contradiction, and
    the softmax is taken over these three.
    """
    base = pairs.drop(*STANCE).withColumn("_input", X.premise(F.col(right), F.col(left)))
    schema = T.StructType([*(f for f in base.schema.fields if f.name != "_input"), *(T.StructField(n, T.DoubleType()) for n in STANCE)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = decoder()
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                p = softmax_rows(np.asarray(model(part["_input"].tolist()), float)[:, list(label_ids)])
                yield part.drop(columns="_input").assign(**{n: p[:, i] for i, n in enumerate(STANCE)})

    return base.mapInPandas(run, schema)


def build_dense(rows: DataFrame, encoder: Callable[[], Callable[[list[str]], np.ndarray]], path: str, key: str = "id", text: str = "contents", shard: int = 10_000) -> DataFrame:
    """(key, vector, shard) of a dense index in `path`, encoded in shards of about `shard` rows; finished shards are skipped.

    Rows are dealt to shards by a hash of their key, so that a rerun finds the same
    ones; the lookup (key, shard) is written last. Raises if vectors and lookup differ in number.
    """
    spark = rows.sparkSession
    shards = max(1, -(-rows.count() // shard))
    dealt = rows.select(key, text).withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int"))
    vectors, lookup = f"{path}/vectors-of-{shards}", f"{path}/lookup"
    done = [r["shard"] for r in spark.read.parquet(f"{vectors}/done").distinct().collect()] if storage.exists(spark, f"{vectors}/done") else []
    todo = dealt.filter(~F.col("shard").isin(done)) if done else dealt
    if len(done) < shards:
        made = encode_texts(todo.repartition("shard"), encoder, text).select(key, "vector", "shard")
        # A shard that was begun is replaced as a whole.
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(f"{vectors}/data")
        todo.select("shard").distinct().write.mode("append").parquet(f"{vectors}/done")
    dealt.select(key, "shard").write.mode("overwrite").parquet(lookup)
    out = spark.read.parquet(f"{vectors}/data").select(key, "vector", "shard")
    if (n := out.count()) != (m := spark.read.parquet(lookup).count()):
        raise ValueError(f"{n} vectors, {m} rows in the lookup")
    return out


def encode_texts(rows: DataFrame, encoder: Callable[[], Callable[[list[str]], np.ndarray]], text: str, batch: int = 64) -> DataFrame:
    """rows with `vector` (array<float>, length one) from an encoder made once a task."""
    base = rows.drop("vector")
    schema = T.StructType([*base.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = encoder()
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                v = np.asarray(model(part[text].fillna("").tolist()), np.float32)
                v = v / np.maximum(1e-12, np.linalg.norm(v, axis=1, keepdims=True))
                yield part.assign(vector=list(v))

    return base.mapInPandas(run, schema)


def with_retries(call: Callable[[], dict], most: int = 20, first: float = 1.0, longest: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> dict:
    """Call until it succeeds: 429, 5xx and time-outs back off, doubling up to `longest`; 402 and exhausted quotas end the job."""
    wait = first
    for attempt in range(most + 1):
        try:
            return call()
        except TimeoutError:
            if attempt == most:
                raise
        except CallFailed as e:
            if e.status == 402 or (e.status == 429 and "insufficient_quota" in e.reason):
                raise QuotaExhausted(str(e)) from e
            if e.status not in RETRYABLE and e.status < 500 or attempt == most:
                raise
        sleep(wait + random.random() * 0.1 * wait)
        wait = min(longest, 2 * wait)
    raise AssertionError("unreachable")


@dataclass(frozen=True)
class Backend:
    """A judge: how to call it (made once a task) and what it costs."""

    name: str
    make: Callable[[], Callable[[str, str], dict]]
    price: tuple[float, float] = (0.0, 0.0)


RECORD = "label string, confidence double, input_tokens long, output_tokens long, cost_usd double, backend string, skip_reason string"
#: Fixed: the names under which judges are asked for, and the backends they stand for.
NAMES = {
    "together": "together-llama-3.3-70b",
    "openai-mini": "openai-gpt-4o-mini",
    "openai-4o": "openai-gpt-4o",
    "hf-llama": "hf-llama-3.3-70b",
    "hf-qwen": "hf-qwen-2.5-72b",
}
REGISTRY: dict[str, Backend] = {}


def register(backend: Backend) -> None:
    REGISTRY[backend.name] = backend


def backend_of(name: str, make: Callable[[], Callable[[str, str], dict]] | None = None) -> Backend:
    """A registered judge by its short or full name; with `make` one of the five is made on the spot with its price."""
    full = NAMES.get(name, name)
    if make is not None and full in NAMES.values():
        return Backend(full, make, X.PRICES[full])
    if full not in REGISTRY:
        raise KeyError(f"no judge called {name}; known: {sorted({*NAMES, *REGISTRY})}")
    return REGISTRY[full]


def output_path(root: str, name: str) -> str:
    """Each judge's records have a folder of their own."""
    return f"{root.rstrip('/')}/records-{NAMES.get(name, name)}"


def relevance_filter(pairs: DataFrame, make: Callable[[], Callable[[str], str]], sentence: str = "sentence_text", abstract: str = "contents", system: str = X.FILTER_ASKED) -> DataFrame:
    """pairs with `relevant` from a model that answers messages (JSON) with a reply; an empty abstract is not relevant, without a call."""
    base = pairs.drop("relevant", "_reply").withColumn("_messages", F.when(F.trim(F.coalesce(abstract, F.lit(""))) != "", X.filter_messages(F.col(sentence), F.col(abstract), system)))
    schema = T.StructType([*(f for f in base.schema.fields if f.name != "_messages"), T.StructField("_reply", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = make()
        for pdf in batches:
            replies = [None if m is None else with_retries(lambda m=m: {"reply": ask(m)})["reply"] for m in pdf["_messages"]]
            yield pdf.drop(columns="_messages").assign(_reply=replies)

    return base.mapInPandas(run, schema).withColumn("relevant", X.parse_relevant(F.col("_reply"))).drop("_reply")


def judge(pairs: DataFrame, backend: Backend, sentence: str = "sentence_text", abstract: str = "contents", max_concurrent: int | None = None) -> DataFrame:
    """pairs with a judge's record; an empty abstract is 'Not relevant' without a call.

    When the quota ends, that row and the rest of its task are flagged by
    skip_reason, so that finished records can be kept and the others resumed.
    """
    base = pairs.drop(*[f.name for f in T._parse_datatype_string(RECORD).fields])
    fields = T._parse_datatype_string(RECORD).fields
    schema = T.StructType([*base.schema.fields, *fields])
    a, b = backend.price

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, halted = backend.make(), False
        for pdf in batches:
            out = []
            for s, t in zip(pdf[sentence], pdf[abstract], strict=True):
                if not (t or "").strip():
                    out.append(("Not relevant", 1.0, 0, 0, 0.0, backend.name, "empty_abstract"))
                    continue
                if not halted:
                    try:
                        r = with_retries(lambda s=s, t=t: call(s or "", t))
                        i, o = int(r.get("input_tokens", 0)), int(r.get("output_tokens", 0))
                        out.append((r["label"], min(1.0, max(0.0, float(r["confidence"]))), i, o, round((i * a + o * b) / 1e6, 6), backend.name, None))
                        continue
                    except QuotaExhausted:
                        halted = True
                    except (CallFailed, TimeoutError):
                        out.append((None, None, 0, 0, 0.0, backend.name, "failed"))
                        continue
                out.append((None, None, 0, 0, 0.0, backend.name, "quota"))
            got = pd.DataFrame(out, columns=[f.name for f in fields], index=pdf.index)
            yield pd.concat([pdf, got], axis=1)

    return (base.repartition(max_concurrent) if max_concurrent else base).mapInPandas(run, schema)


def replay(pairs: DataFrame, recorded: DataFrame, sentence: str, abstract: str, default: tuple[str, float] | None = ("Neutral", 0.0)) -> DataFrame:
    """pairs with label and confidence of recorded (prompt_key, label, confidence); without default, an unknown prompt is an error."""
    out = pairs.withColumn("prompt_key", X.prompt_key(F.coalesce(sentence, F.lit("")), F.coalesce(abstract, F.lit("")))).join(recorded, "prompt_key", "left")
    if default is None:
        return out.withColumn("label", F.coalesce("label", F.raise_error(F.concat(F.lit("no recorded reply: "), "prompt_key"))))
    return out.withColumn("label", F.coalesce("label", F.lit(default[0]))).withColumn("confidence", F.coalesce("confidence", F.lit(float(default[1]))))
