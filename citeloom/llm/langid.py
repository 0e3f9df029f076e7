"""Operator 6: language identification by hierarchical discrimination.

A text is a vector of hashed letter n-grams. A first layer of one-versus-one
linear support vector machines tells language families apart; within the winning
family another one-versus-one layer separates its closely related languages.
Training reads a bounded sample of labelled rows (``train_rows``); predicting is
one map over all rows with the weights in the task's closure, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.llm.common import doc_fold, table

#: Fixed: language codes by family; a code that isn't here is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bg", "mk"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz"],
    "semitic": ["ar", "he", "mt"],
}
UNDETERMINED = "und"


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def features(text: str | None, dims: int) -> np.ndarray | None:
    """Unit vector of the square roots of n-gram counts (n = 1 to 3, word borders as 0); None without a letter.

    Every letter of the text counts; it is read in slices so that memory doesn't
    grow with the text.
    """
    if not text:
        return None
    counts = np.zeros(dims, np.int64)
    is_letter, seen = letter_table(), False
    for at in range(0, len(text), 1 << 20):
        part = text[max(0, at - 2) : at + (1 << 20)].lower()
        code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        keep = is_letter[code]
        seen = seen or bool(keep.any())
        c = np.zeros(len(code) + 2, np.uint32)
        c[1:-1] = np.where(keep, code, 0)
        one, two, three = c[1:-1], c[:-1], c[:-2]
        h = one * np.uint32(0x9E3779B1)
        pair = two[:-1] * np.uint32(0x85EBCA6B) + h
        triple = three * np.uint32(0xC2B2AE35) + pair
        for x, on in ((h, keep), (pair, keep), (triple, keep)):
            x = x ^ (x >> np.uint32(15))
            x = (x * np.uint32(0x2C1B3C6D)) >> np.uint32(9)
            counts += np.bincount((x % np.uint32(dims))[on], minlength=dims)
    if not seen:
        return None
    v = np.sqrt(counts)
    return (v / np.linalg.norm(v)).astype(np.float32)


def linear_svm(x: np.ndarray, rows: np.ndarray, y: np.ndarray, cost: float = 10.0, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) of an L2-regularised hinge-loss machine on some rows of x, by dual coordinate descent."""
    w, alpha = np.zeros(x.shape[1] + 1, np.float32), np.zeros(len(rows))
    norm = np.einsum("ij,ij->i", x[rows], x[rows]) + 1.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            v = x[rows[i]]
            new = min(cost, max(0.0, alpha[i] - (y[i] * float(v @ w[:-1] + w[-1]) - 1) / norm[i]))
            if new != alpha[i]:
                step = np.float32((new - alpha[i]) * y[i])
                w[:-1] += step * v
                w[-1] += step
                alpha[i] = new
    return w


@dataclass
class OneVersusOne:
    """Machines between every two of some classes; with one class there is nothing to decide."""

    classes: list[str]
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    @classmethod
    def fit(cls, x: np.ndarray, rows: np.ndarray, y: np.ndarray) -> OneVersusOne:
        """y: the class of each of the rows of x."""
        out = cls(sorted(set(y)))
        for a, b in combinations(range(len(out.classes)), 2):
            on = (y == out.classes[a]) | (y == out.classes[b])
            out.pairs[a, b] = linear_svm(x, rows[on], np.where(y[on] == out.classes[a], 1.0, -1.0))
        return out

    def decide(self, v: np.ndarray, slope: float = 4.0) -> tuple[str, float]:
        """The class with most votes (ties: the larger sum of margins, then the name) and its least pairwise probability."""
        if len(self.classes) == 1:
            return self.classes[0], 1.0
        n = len(self.classes)
        votes, total, least = np.zeros(n), np.zeros(n), np.ones(n)
        for (a, b), w in self.pairs.items():
            m = float(v @ w[:-1] + w[-1])
            p = 1.0 / (1.0 + np.exp(-slope * m))
            votes[a if m >= 0 else b] += 1
            total[a] += m
            total[b] -= m
            least[a], least[b] = min(least[a], p), min(least[b], 1 - p)
        best = max(range(n), key=lambda i: (votes[i], total[i], -i))
        return self.classes[best], float(least[best])


@dataclass
class LanguageModel:
    dims: int
    families: OneVersusOne
    within: dict[str, OneVersusOne]

    @classmethod
    def fit(cls, x: np.ndarray, langs: np.ndarray, dims: int) -> LanguageModel:
        fam = np.array([family_of(lang) for lang in langs], dtype=object)
        every = np.arange(len(x))
        within = {f: OneVersusOne.fit(x, every[fam == f], langs[fam == f]) for f in set(fam)}
        return cls(dims, OneVersusOne.fit(x, every, fam), within)

    def predict(self, text: str | None) -> tuple[str, float]:
        v = features(text, self.dims)
        if v is None:
            return UNDETERMINED, 0.0
        family, p = self.families.decide(v)
        lang, q = self.within[family].decide(v)
        return lang, p * q


def training_sample(labelled: DataFrame, key: str, train_rows: int) -> DataFrame:
    """About train_rows rows at most, as even over languages as they allow; picked by a hash of the key."""
    rows = labelled.filter("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return rows.select("lang", "text").limit(0)
    each = max(1, train_rows // len(counts))
    share = F.pmod(F.xxhash64(F.lit("langid"), F.col(key)), F.lit(1_000_000)) / 1_000_000.0
    want = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, each / n))) for k, n in counts.items()])
    return rows.filter(share < want).select("lang", "text")


def fit_language_model(labelled: DataFrame, key: str = "doc_id", train_rows: int = 2000, dims: int = 4096) -> LanguageModel | None:
    """Fit on a bounded sample of rows (lang, text, key); None when there is no usable row.

    train_rows bounds the sample and with it what the driver holds: 2 * train_rows
    vectors of dims 16-bit floats. Whole texts become vectors on the executors.
    """

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [features(t, dims) for t in pdf["text"]]
            on = [v is not None for v in got]
            yield pd.DataFrame({"lang": pdf["lang"][on], "v": [v.astype(np.float16).tobytes() for v in got if v is not None]})

    rows = training_sample(labelled, key, train_rows).mapInPandas(vectors, "lang string, v binary").limit(2 * train_rows).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], bytes(r["v"])))
    x = np.stack([np.frombuffer(r["v"], np.float16) for r in rows]).astype(np.float32)
    return LanguageModel.fit(x, np.array([r["lang"] for r in rows], dtype=object), dims)


def predict_languages(docs: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """Add lang_pred and score to every row.

    A null text, or one without a letter, is ``und`` with score 0 (so is every text
    if no labelled row gave a model). Repeated rows stay repeated; other columns
    stay, but for those that are named like the two added.
    """
    base = docs.drop("lang_pred", "score")
    schema = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 2000):
                part = pdf.iloc[at : at + 2000]
                got = [model.predict(t) if model else (UNDETERMINED, 0.0) for t in part[text]]
                yield part.assign(lang_pred=[g[0] for g in got], score=np.array([g[1] for g in got], float))[[f.name for f in schema.fields]]

    return base.mapInPandas(run, schema)


def identify(docs: DataFrame, folds: int = 5, train_rows: int = 2000) -> DataFrame:
    """doc_id, held_out, text, lang_pred, score; the model learns from rows outside fold 0 only."""
    held = doc_fold(F.col("doc_id"), folds) == 0
    model = fit_language_model(docs.filter(~held), train_rows=train_rows)
    return predict_languages(docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "text"), model)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")
