"""Ranking of documents for queries: BM25, feedback, exact vector search, fusion, reranking.

Queries are ranked a block at a time: each task multiplies the block's matrix with
its documents and keeps its own best, so that a shuffle moves a few rows a query and
task. Ties are broken by id; scores that are sums of floats are rounded in sort keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.functions import text as T
from citeloom.operators.storage import kept_table

K1, B = 0.9, 0.4
DIGITS = 9
#: Scores that a task looks through at once, and hits after which it keeps the best of them.
MOST_SCORES, MOST_FOUND = 1 << 18, 1 << 18


def ranked(df: DataFrame, by: list[str], score: str, key: str | list[str], k: int | None, rank: str = "rank") -> DataFrame:
    """Rank 1.. in each group by score desc, keys asc; the first k only."""
    keys = [key] if isinstance(key, str) else key
    out = df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(F.round(score, DIGITS).desc(), *keys)))
    return out if k is None else out.filter(F.col(rank) <= k)


def postings(docs: DataFrame, key: str = "pmid", text: str = "contents") -> DataFrame:
    """(pmid, term, tf, dl): term vectors with the document's length."""
    words = docs.select(F.col(key).alias("pmid"), T.terms(F.col(text)).alias("ts"))
    return words.select("pmid", F.size("ts").alias("dl"), F.explode("ts").alias("term")).groupBy("pmid", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def query_terms(queries: DataFrame, by: list[str], text: str = "query") -> DataFrame:
    """(by, term, weight): a query's terms weighted by how often it has them."""
    return queries.select(*by, F.explode(T.terms(F.col(text))).alias("term")).groupBy(*by, "term").agg(F.count("*").cast("double").alias("weight"))


def token_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(pmid, hs): each document's tokens as 64-bit hashes, a table that is written once a session and read by every ranking."""
    made = docs.select(F.col(key).alias("pmid"), F.col(text).alias("text"))
    return kept_table(made, "tokens", lambda d: d.select("pmid", F.transform(T.terms(F.col("text")), lambda t: F.xxhash64(t)).alias("hs")))


def _best(thresholds: np.ndarray, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of found (query, key, score) what may be among its query's k best, ties kept; thresholds are raised in place."""
    q, p, s = (np.concatenate(x) for x in zip(*found, strict=True))
    r = np.round(s, DIGITS)
    order = np.lexsort((-r, q))
    q, p, s, r = q[order], p[order], s[order], r[order]
    starts = np.searchsorted(q, np.arange(len(thresholds)))
    full = np.searchsorted(q, np.arange(len(thresholds)), side="right") - starts >= k
    thresholds[full] = np.maximum(thresholds[full], r[starts[full] + k - 1])
    on = r >= thresholds[q]
    return [(q[on], p[on], s[on])]


def _blocks_of(weighted: DataFrame, by: list[str], cells: int = 8_000_000) -> Iterator[pd.DataFrame]:
    """The query terms in blocks whose matrix (queries by terms) stays below `cells`."""
    w = weighted.select(*by, F.xxhash64("term").alias("h"), F.col("weight").cast("double").alias("weight"))
    size = w.agg(F.count("*").alias("n"), F.count_distinct(*by).alias("q")).first()
    if not size["n"]:
        return
    most = max(1.0, math.sqrt(cells / (size["n"] / size["q"])))
    blocks = math.ceil(size["q"] / most)
    for i in range(blocks):
        part = w.filter(F.pmod(F.xxhash64(*by), F.lit(blocks)) == i).toPandas()  # bounded by `cells`
        if len(part):
            yield part


def bm25(weighted: DataFrame, docs: DataFrame, by: list[str], k: int, key: str = "pmid", text: str = "contents", k1: float = K1, b: float = B) -> DataFrame:
    """(by, pmid, bm25_score, rank) of the k best documents for weighted query terms.

    idf = ln(1 + (N - df + 0.5) / (df + 0.5)); lengths are exact. Queries are a stated
    set, taken in blocks; a block's terms are a matrix that every task multiplies with
    its documents' term weights, keeping its k best (and ties) of each query. Nothing
    but these goes through a shuffle, whatever the number of documents that hold a
    frequent term. The documents' tokens are read twice a block, for document
    frequencies and for scores.
    """
    tokens = token_table(docs, key, text)
    size = tokens.agg(F.count("*").alias("n"), F.avg(F.size("hs")).alias("avgdl")).first()
    n, avgdl = size["n"], size["avgdl"] or 1.0
    kind = tokens.schema["pmid"].dataType.simpleString()
    head = ", ".join(f"`{c}` {weighted.schema[c].dataType.simpleString()}" for c in by)
    out = weighted.sparkSession.createDataFrame([], f"{head}, pmid {kind}, bm25_score double")
    for part in _blocks_of(weighted, by):
        names, at = part[by].drop_duplicates().reset_index(drop=True), part.groupby(by, sort=False, dropna=False).ngroup().to_numpy()
        vocabulary, term = np.unique(part["h"].to_numpy(np.int64), return_inverse=True)
        weight = part["weight"].to_numpy(float)

        def hits(pdf: pd.DataFrame, vocabulary=vocabulary) -> tuple[np.ndarray, ...]:
            """Lengths, and (document, term, frequency) of the vocabulary's terms."""
            lens = pdf["hs"].map(len).to_numpy(np.int64)
            flat = np.concatenate(pdf["hs"].to_list()).astype(np.int64) if lens.sum() else np.zeros(0, np.int64)
            t = np.minimum(np.searchsorted(vocabulary, flat), len(vocabulary) - 1)
            on = vocabulary[t] == flat
            code, tf = np.unique(np.repeat(np.arange(len(pdf)), lens)[on] * len(vocabulary) + t[on], return_counts=True)
            return lens, code // len(vocabulary), code % len(vocabulary), tf

        def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(len(vocabulary), np.int64)
            for pdf in batches:
                for lo in range(0, len(pdf), 256):
                    total += np.bincount(hits(pdf.iloc[lo : lo + 256])[2], minlength=len(vocabulary))
            on = np.flatnonzero(total)
            yield pd.DataFrame({"t": on, "df": total[on]})

        df = np.zeros(len(vocabulary))
        for row in tokens.select("hs").mapInPandas(frequencies, "t long, df long").groupBy("t").agg(F.sum("df").alias("df")).collect():  # the block's terms
            df[row["t"]] = row["df"]
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            matrix = np.zeros((len(names), len(vocabulary)))
            np.add.at(matrix, (at, term), weight * idf[term])
            thresholds, found = np.zeros(len(names)), []
            for pdf in batches:
                for lo in range(0, len(pdf), 256):
                    some = pdf.iloc[lo : lo + 256]
                    lens, d, t, tf = hits(some)
                    part = np.zeros((len(vocabulary), len(some)))
                    part[t, d] = tf * (k1 + 1) / (tf + k1 * (1 - b + b * lens[d] / avgdl))
                    s = matrix @ part
                    q, j = np.nonzero((s > 0) & (np.round(s, DIGITS) >= thresholds[:, None]))
                    found.append((q, some["pmid"].to_numpy()[j], s[q, j]))
                    if len(found) > 16 or sum(len(x[0]) for x in found) > MOST_FOUND:
                        found = _best(thresholds, found, k)
            if found:
                q, p, s = _best(thresholds, found, k)[0]
                yield names.iloc[q].reset_index(drop=True).assign(pmid=p, bm25_score=s)

        out = out.unionByName(tokens.mapInPandas(score, out.schema))
    return ranked(out, by, "bm25_score", "pmid", k)


def rm1_terms(accepted: DataFrame, vectors: DataFrame, by: list[str], n: int = 10, exclude: DataFrame | None = None) -> DataFrame:
    """(by, term, w): mean over accepted documents with a vector of tf / document length, best n.

    vectors: (pmid, term, tf, dl). exclude (by, term) removes terms after lengths are taken.
    """
    rows = accepted.select(*by, "pmid").distinct().join(vectors, "pmid")
    docs = rows.groupBy(*by).agg(F.countDistinct("pmid").alias("n_docs"))
    weights = rows.groupBy(*by, "term").agg(F.sum(F.col("tf") / F.col("dl")).alias("s")).join(docs, by).select(*by, "term", (F.col("s") / F.col("n_docs")).alias("w"))
    if exclude is not None:
        weights = weights.join(exclude.select(*by, F.lower("term").alias("term")).distinct(), [*by, "term"], "left_anti")
    return ranked(weights, by, "w", "term", n, "term_rank")


def vectors_of(first: DataFrame, docs: DataFrame, key: str = "pmid", text: str = "contents") -> DataFrame:
    """Term vectors of the documents that a ranking names, and of no others."""
    return postings(docs.join(first.select(F.col("pmid").alias(key)).distinct(), key, "left_semi"), key, text)


def rm3(weighted: DataFrame, docs: DataFrame, by: list[str], k: int, fb_docs: int = 10, fb_terms: int = 10, original: float = 0.5, **cols) -> DataFrame:
    """BM25 over the query mixed with feedback terms of its first fb_docs documents."""
    first = bm25(weighted, docs, by, fb_docs, **cols)
    fb = rm1_terms(first, vectors_of(first, docs, **cols), by, fb_terms)
    fb = fb.withColumn("share", F.col("w") / F.sum("w").over(W.partitionBy(*by)))
    q = weighted.withColumn("share", F.col("weight") / F.sum("weight").over(W.partitionBy(*by)))
    mixed = q.select(*by, "term", (F.col("share") * original).alias("weight")).unionByName(fb.select(*by, "term", (F.col("share") * (1 - original)).alias("weight")))
    return bm25(mixed.groupBy(*by, "term").agg(F.sum("weight").alias("weight")), docs, by, k, **cols)


def filtered_feedback(queries: DataFrame, relevant: DataFrame, docs: DataFrame, by: list[str], k: int, initial: int = 30, n: int = 10, text: str = "query", **cols) -> DataFrame:
    """Feedback from those of the first `initial` documents that `relevant` accepts: rows (by, pmid), or a function of the first hits to such rows.

    Their best terms, but for the query's own white-space tokens, are appended to
    the query, which is then ranked anew; without an accepted document the query
    stays as it is, and a query without a first hit gives no row.
    """
    first = bm25(query_terms(queries, by, text), docs, by, initial, **cols)
    accepted = relevant(first) if callable(relevant) else relevant
    accepted = first.join(accepted.select(*by, "pmid").distinct(), [*by, "pmid"], "left_semi")
    own = queries.select(*by, F.explode(F.split(F.lower(text), r"\s+")).alias("term"))
    more = rm1_terms(accepted, vectors_of(accepted, docs, **cols), by, n, own)
    more = more.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("term_rank", "term"))), lambda x: x["term"]).alias("more"))
    had = queries.join(first.select(*by).distinct(), by, "left_semi").join(more, by, "left")
    grown = had.withColumn(text, T.expand_query(F.col(text), F.coalesce("more", F.array().cast("array<string>"))))
    return bm25(query_terms(grown, by, text), docs, by, k, **cols)


def rrf(rankings: DataFrame, by: list[str], key: str = "pmid", k: int = 60, top: int | None = None, rank: str = "rank") -> DataFrame:
    """(by, key, rrf_score, rank): reciprocal ranks summed over rankings; each hit counts with its own rank."""
    return ranked(rankings.groupBy(*by, key).agg(F.sum(F.lit(1.0) / (k + F.col(rank))).alias("rrf_score")), by, "rrf_score", key, top)


def with_fallback(queries: DataFrame, rewrites: DataFrame, by: list[str], n: int = 3, original: bool = True, text: str = "query") -> DataFrame:
    """(by, variant, query): the original as variant 0 and up to n rewrites; the original alone where all rewrites are empty.

    rewrites: (by, rewrites array<string>), e.g. of parse_rewrites.
    """
    met = queries.select(*by, text).join(rewrites.select(*by, "rewrites"), by, "left")
    usable = F.slice(F.filter(F.coalesce("rewrites", F.array().cast("array<string>")), lambda r: F.trim(r) != ""), 1, n)
    variants = F.concat(F.array(text), usable) if original else F.when(F.size(usable) > 0, usable).otherwise(F.array(text))
    return met.select(*by, F.posexplode(variants).alias("variant", text))


def rewrite_fusion(variants: DataFrame, docs: DataFrame, by: list[str], k: int, text: str = "query", **cols) -> DataFrame:
    """Rank each variant (by, variant, query) of a query and fuse the rankings; variants joined by ' || ' are kept as query."""
    hits = bm25(query_terms(variants, [*by, "variant"], text), docs, [*by, "variant"], k, **cols)
    joined = variants.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("variant", text))), lambda x: x[text]), " || ").alias("query"))
    return rrf(hits, by, top=k).join(joined, by)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def dense_topk(queries: DataFrame, vectors: DataFrame, by: list[str], k: int, key: str = "pmid", block: int = 4096) -> DataFrame:
    """(by, key, score, rank): exact inner products of unit vectors, a stated set of queries against all vectors.

    Queries are taken in blocks of about `block`, each a matrix that every task
    multiplies with its vectors, keeping its k best (and ties) of each query; all
    vectors are read once a block.
    """
    q = queries.select(*by, T.l2_normalise(F.col("vector")).alias("vector"))
    v = vectors.select(key, T.l2_normalise(F.col("vector")).alias("vector"))
    blocks = math.ceil(q.count() / block)
    head = ", ".join(f"`{c}` {queries.schema[c].dataType.simpleString()}" for c in by)
    out = queries.sparkSession.createDataFrame([], f"{head}, `{key}` {vectors.schema[key].dataType.simpleString()}, score double")
    for i in range(blocks):
        part = q.filter(F.pmod(F.xxhash64(*by), F.lit(blocks)) == i).toPandas()  # about `block` rows
        if not len(part):
            continue
        names, matrix = part[by], np.stack(part["vector"].to_list()).astype(float)

        def score(batches: Iterator[pd.DataFrame], names=names, matrix=matrix) -> Iterator[pd.DataFrame]:
            thresholds, found = np.full(len(names), -np.inf), []
            for pdf in batches:
                for lo in range(0, len(pdf), 256):
                    some = pdf.iloc[lo : lo + 256]
                    x = np.stack(some["vector"].to_list()).astype(float).T
                    for at in range(0, len(matrix), step := max(1, MOST_SCORES // len(some))):
                        s = matrix[at : at + step] @ x
                        a, j = np.nonzero(np.round(s, DIGITS) >= thresholds[at : at + step, None])
                        found.append((a + at, some[key].to_numpy()[j], s[a, j]))
                        if sum(len(y[0]) for y in found) > MOST_FOUND + 2 * k * len(names):
                            found = _best(thresholds, found, k)
            if found:
                a, p, s = _best(thresholds, found, k)[0]
                yield names.iloc[a].reset_index(drop=True).assign(**{key: p, "score": s})

        out = out.unionByName(v.mapInPandas(score, out.schema))
    return ranked(out, by, "score", key, k)


def hybrid(lexical: DataFrame, dense: DataFrame, by: list[str], top: int, key: str = "pmid", k: int = 60) -> DataFrame:
    cols = [*by, key, "rank"]
    return rrf(lexical.select(*cols).unionByName(dense.select(*cols)), by, key, k, top)


def rerank_topk(scored: DataFrame, by: list[str], k: int = 30, key: str | list[str] = "pmid") -> DataFrame:
    return ranked(scored, by, "ce_score", key, k, "rank_after_rerank")


def passthrough_rerank(hits: DataFrame, by: list[str], k: int = 30) -> DataFrame:
    return hits.filter(F.col("rank") <= k).withColumn("ce_score", F.col("bm25_score")).withColumn("rank_after_rerank", F.col("rank"))


def top_n_docs(vectors: DataFrame, n: int) -> DataFrame:
    """The n longest documents: a global top-n, which Spark takes per partition first."""
    return vectors.groupBy("pmid").agg(F.sum("tf").alias("score")).orderBy(F.desc("score"), "pmid").limit(n)


def max_pool(scored: DataFrame, by: list[str]) -> DataFrame:
    return scored.groupBy(*by).agg(F.max("contradiction_prob").alias("contradict_score"), F.min("bm25_rank").alias("bm25_rank"), F.max("bm25_score").alias("bm25_score"))


def verify_count(df: DataFrame, least: int) -> None:
    """Raise if a table has fewer rows than it should."""
    if (n := df.count()) < least:
        raise ValueError(f"{n} rows, at least {least} expected")
