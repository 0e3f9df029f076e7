"""Connected components: local union-find, then alternating large-star and small-star joins.

Links lie in partitions of bounded size, each of which reduces its own to a forest
(every node linked with the least node it reaches there). If that was the only
partition, the forest is the answer. Otherwise star rounds go on over the forests:
each is two aggregations with map-side combine and two equi-joins whose skewed
partitions AQE can split, so that a node with millions of links doesn't end in one
task; once the links fit in one partition, a last union-find ends it. Labels live
in DataFrames only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import checkpointed

#: Links that one task reduces in memory.
LINKS_PER_TASK = 250_000


class Forest(dict):
    """Union-find over integers; the least of a tree is its root."""

    def root(self, x: int) -> int:
        while (y := self.get(x, x)) != x:
            self[x] = x = self.get(y, y)
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self[max(a, b)] = min(a, b)
        return True


def _reduced(links: DataFrame, parts: int) -> DataFrame:
    """Links (a, b), a > b, with the same components: a forest for each of about `parts` partitions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = Forest()
        for pdf in batches:
            for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
                forest.join(a, b)
        nodes = np.fromiter(forest, np.int64, len(forest))
        roots = np.fromiter(map(forest.root, list(forest)), np.int64, len(nodes))
        yield pd.DataFrame({"a": nodes, "b": roots})[nodes != roots]

    return links.coalesce(parts).mapInPandas(run, "a long, b long")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with u <> v in both directions; link neighbours with the least one."""
    if large:
        low = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = edges.join(low, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.filter("v < u")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(low, "u")
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            low.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return out.filter("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60, links_per_task: int = LINKS_PER_TASK) -> DataFrame:
    """(id, component) for every id in edges (a, b); component is the least id reachable.

    Null ends and self-links are ignored, repeated links count once; no edges give
    an empty result. Raises if it doesn't settle in max_rounds (never seen: rounds
    grow with the logarithm of the diameter).
    """
    now = checkpointed(edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")))
    parts = math.ceil(now.count() / links_per_task)
    signature = None
    for _ in range(max_rounds):
        alone = parts <= 1
        now = checkpointed(_reduced(now, max(1, parts)))
        if alone:
            break
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        big = _star(both, True)
        both = big.select(F.col("a").alias("u"), F.col("b").alias("v")).union(big.select(F.col("b").alias("u"), F.col("a").alias("v")))
        now = checkpointed(_star(both, False))
        got = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if got == signature:
            break
        signature, parts = got, math.ceil(got[0] / links_per_task)
    else:
        raise RuntimeError("connected components did not settle")
    ids = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return ids.unionByName(roots)
