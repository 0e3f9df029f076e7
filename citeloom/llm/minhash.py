"""Operator 9: near-duplicate documents by b-bit MinHash.

Every text becomes its set of word shingles, of which K minima are taken. Their
low bits are packed into a few longs; hashes of r full minima make the band keys.
Pairs that share a band are candidates; bit counts of the packed signatures give
a similarity corrected for chance agreement of low bits, and pairs clearly below
the threshold go; the rest is confirmed on the full sets in integers.

Nodes are the distinct shingle sets. No bucket is expanded into all its pairs while
links can still merge it: in star rounds each node is compared with one leader of
its buckets and components are contracted, as long as that settles a good part of
the comparisons. What is left in buckets of unlike components is compared in blocks
of nodes that share their largest bucket. This is exact with regard to the bands: a
pair that shares a band is either compared or already in one component. Bands are
chosen so that a pair at the threshold shares none with probability below ``miss``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.common import checkpointed, table, words_of
from citeloom.llm.components import Forest, connected_components

LOW_BITS = 2
PER_LONG = 64 // LOW_BITS


class WordHashes(dict):
    """64-bit hashes of words, kept for words seen again; emptied when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[word] = v = xxhash.xxh64_intdigest(word)
        return v


_words = WordHashes()


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's k-word shingles; fewer words make one shingle, none an empty set."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(k, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out ^ h[i : len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def choose_bands(threshold: float, miss: float = 1e-7, most: int = 150) -> tuple[int, int]:
    """The most selective (rows, bands) with at most `most` minima that misses a pair at the threshold with probability below `miss`."""
    for rows in range(8, 0, -1):
        bands = math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))
        if rows * bands <= most:
            return rows, bands
    raise ValueError("threshold too low for MinHash bands")


def minima(sets: np.ndarray, count: int, seed: int = 11) -> np.ndarray:
    """count minima of a set under as many odd multiply-add permutations of 32 bits."""
    rng = np.random.default_rng(seed)
    a = (rng.integers(0, 1 << 32, count, dtype=np.uint32) | np.uint32(1))[:, None]
    b = rng.integers(0, 1 << 32, count, dtype=np.uint32)[:, None]
    x, out = (sets >> np.uint64(32)).astype(np.uint32), np.full(count, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(out, (x[None, at : at + 1024] * a + b).min(1), out=out)
    return out


def band_keys(mins: np.ndarray, rows: int, bands: int) -> np.ndarray:
    m = mins[: rows * bands].reshape(bands, rows).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for i in range(rows):
        key = (key ^ m[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def packed_low_bits(mins: np.ndarray) -> np.ndarray:
    slots = np.zeros(-(-len(mins) // PER_LONG) * PER_LONG, np.uint64)
    slots[: len(mins)] = mins & np.uint32((1 << LOW_BITS) - 1)
    shift = (np.arange(PER_LONG) * LOW_BITS).astype(np.uint64)
    return np.bitwise_or.reduce(slots.reshape(-1, PER_LONG) << shift, axis=1).view(np.int64)


def estimated_similarity(a: Column, b: Column, count: int) -> Column:
    """Jaccard estimate from packed low bits: matches m of count, less those due to chance."""
    longs = -(-count // PER_LONG)
    differ = F.lit(0)
    for i in range(longs):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        either = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
        differ = differ + F.bit_count(either)
    chance = 1 / (1 << LOW_BITS)
    return (1 - differ / count - chance) / (1 - chance)


def slack(threshold: float, count: int, sigmas: float = 6.0) -> float:
    chance = 1 / (1 << LOW_BITS)
    p = threshold + (1 - threshold) * chance
    return sigmas * math.sqrt(p * (1 - p) / count) / (1 - chance)


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh128_digest(shingles.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _sketches(docs: DataFrame, key: str, text: str, k: int, rows: int, bands: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t in pdf[text]:
                s = shingle_set(t, k)
                if not len(s):
                    out.append((0, None, None, None, None))
                    continue
                m = minima(s, rows * bands)
                out.append((len(s), *_digest(s), band_keys(m, rows, bands), packed_low_bits(m)))
            got = pd.DataFrame(out, columns=["n_shingles", "d1", "d2", "bands", "sig"], dtype=object)
            for n, name in enumerate((key, "keyless", "th")):
                got.insert(n, name, pdf[name].to_numpy())
            yield got
        _words.clear()  # idle workers hold no words

    kind = docs.schema[key].dataType.simpleString()
    # Null keys would turn a batch's keys into doubles.
    filled = docs.select(F.coalesce(key, F.lit(0)).cast(kind).alias(key), F.col(key).isNull().alias("keyless"), text, "th")
    out = filled.mapInPandas(run, f"`{key}` {kind}, keyless boolean, th long, n_shingles long, d1 long, d2 long, bands array<long>, sig array<long>")
    return out.withColumn(key, F.when(~F.col("keyless"), F.col(key))).drop("keyless")


def _alike(a: np.ndarray, b: np.ndarray, part: int, whole: int) -> bool:
    """Whether whole * |a and b| >= part * |a or b|, of sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if whole * len(a) < part * len(b):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return whole * both >= part * (len(a) + len(b) - both)


def _confirmed(pairs: DataFrame, sets: DataFrame, part: int, whole: int) -> DataFrame:
    """Links (a, b) among pairs (task, a, b, ca, cb), by their full sets.

    ca and cb are the ends' components so far: pairs that links found in the same
    task have joined already are skipped. A set travels once for each task.
    """
    need = pairs.select("task", F.col("a").alias("id")).union(pairs.select("task", F.col("b").alias("id"))).distinct()
    have = need.join(sets, "id").select(F.col("task").alias("at"), "id", "set")

    def run(have: pd.DataFrame, todo: pd.DataFrame) -> pd.DataFrame:
        of = {i: np.frombuffer(x, np.uint64) for i, x in zip(have["id"], have["set"], strict=True)}
        forest, keep = Forest(), []
        for a, b, ca, cb in zip(todo["a"], todo["b"], todo["ca"], todo["cb"], strict=True):
            if a in of and b in of and forest.root(ca) != forest.root(cb) and _alike(of[a], of[b], part, whole):
                keep.append((a, b))
                forest.join(ca, cb)
        return pd.DataFrame(keep, columns=["a", "b"], dtype="int64")

    return have.groupBy("at").cogroup(pairs.groupBy("task")).applyInPandas(run, "a long, b long")


def _compared(members: DataFrame, sets: DataFrame, count: int, least: float, part: int, whole: int, block: int = 768) -> DataFrame:
    """Links (a, b) between members (band, id, c, home, sig) of one band's bucket and unlike components c.

    Every id has one home, the largest bucket it lies in, and homes are cut into
    blocks of about `block` ids: a component with that many ids in a home has blocks
    of its own there. Two blocks that some bucket holds in common meet in one task,
    unless both belong to the same component. There ids and packed low bits are
    compared, and what is alike by them is confirmed on the sets, unless links of the
    same task have joined the components already.
    """
    ids = members.select("id", "c", "home", "sig").dropDuplicates(["id"])
    sizes = ids.groupBy("home", "c").agg(F.count("*").alias("m"))
    rest = sizes.groupBy("home").agg(F.sum(F.when(F.col("m") < block, F.col("m")).otherwise(0)).alias("rest"))
    own = F.col("m") >= block
    cut = F.greatest(F.lit(1), F.ceil(F.when(own, F.col("m")).otherwise(F.col("rest")) / block).cast("long"))
    at = F.xxhash64("home", F.when(own, F.col("c")), F.pmod(F.xxhash64("id"), cut))
    placed = checkpointed(ids.join(sizes, ["home", "c"]).join(rest, "home").select("id", "c", "sig", at.alias("k"), F.when(own, F.col("c")).alias("pure")))
    blocks = members.select("band", "id").join(placed.select("id", "k", "pure"), "id").select("band", "k", "pure").distinct()
    one, two = blocks.toDF("band", "k1", "p1"), blocks.toDF("band2", "k2", "p2")
    met = one.join(two, (F.col("band") == F.col("band2")) & (F.col("k1") <= F.col("k2")) & ~F.coalesce(F.col("p1") == F.col("p2"), F.lit(False)))
    met = checkpointed(met.select("k1", "k2").distinct())
    tasks = max(1, met.count() * block // 65536, placed.count() // block)
    met = met.withColumn("task", F.pmod(F.xxhash64("k1", "k2"), F.lit(tasks)))
    left = placed.join(met.withColumn("k", F.col("k1")), "k").withColumn("side", F.lit(0))
    right = placed.join(met.filter("k1 <> k2").withColumn("k", F.col("k2")), "k").withColumn("side", F.lit(1))
    dealt = left.unionByName(right).join(sets, "id").select("task", "k1", "k2", "side", "id", "c", "sig", "set")
    most = count - int((least * (1 - 1 / (1 << LOW_BITS)) + 1 / (1 << LOW_BITS)) * count)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k1", "k2", "side"], kind="stable")
        k1, k2, side, ids, c = (pdf[n].to_numpy() for n in ("k1", "k2", "side", "id", "c"))
        sig = np.stack(pdf["sig"].to_list()).astype(np.int64).view(np.uint64)
        sets = [np.frombuffer(b, np.uint64) for b in pdf["set"]]
        starts = np.flatnonzero(np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
        forest, keep = Forest(), []
        for lo, hi in zip(starts, np.r_[starts[1:], len(pdf)], strict=True):
            alone = k1[lo] == k2[lo]
            mid = hi if alone else lo + int((side[lo:hi] == 0).sum())
            for n in range(lo, mid):
                at = n + 1 if alone else mid
                d = sig[at:hi] ^ sig[n]
                far = np.bitwise_count((d | (d >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(1)
                for j in np.flatnonzero((far <= most) & (c[at:hi] != c[n])) + at:
                    if forest.root(int(c[n])) != forest.root(int(c[j])) and _alike(sets[n], sets[j], part, whole):
                        keep.append((ids[n], ids[j]))
                        forest.join(int(c[n]), int(c[j]))
        return pd.DataFrame(keep, columns=["a", "b"], dtype="int64")

    return dealt.groupBy("task").applyInPandas(run, "a long, b long")


def _mixed(buckets: DataFrame, labels: DataFrame | None, order: Column) -> DataFrame:
    """Buckets that hold unlike components, with each row's component c and the bucket's leader, the first by order."""
    if labels is None:
        now = buckets.withColumn("c", F.col("id"))
    else:
        now = buckets.join(labels, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    lead = now.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min(F.struct(order.alias("x"), "id", "c", "n", "sig")).alias("lead"))
    return now.join(lead.filter("lo < hi").select("band", "lead"), "band")


def _labelled(every: DataFrame, nodes: DataFrame, labels: DataFrame | None, key: str) -> DataFrame:
    """key, th, n_shingles, first (key, th) of every row: the least key, and the least hash of its texts, of the row's component."""
    of_node = nodes.select("id", F.col("d1").alias("e1"), F.col("d2").alias("e2"), F.struct("key", "th").alias("first"))
    if labels is not None:
        called = labels.join(of_node.select("id", "first"), "id")
        called = called.join(called.groupBy("component").agg(F.min("first").alias("name")), "component").select("id", "name")
        of_node = of_node.join(called, "id", "left").withColumn("first", F.coalesce("name", "first"))
    light = every.select(key, "th", "n_shingles", F.when(F.col(key).isNotNull(), F.col("d1")).alias("d1"), "d2")
    out = light.join(of_node.select("e1", "e2", "first"), (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")), "left")
    return out.select(key, "th", "n_shingles", "first")


def near_duplicates(docs: DataFrame, k: int = 3, part: int = 85, whole: int = 100, key: str = "doc_id", text: str = "text", star_rounds: int = 5) -> DataFrame:
    """key, n_shingles, component_id, kept for every row; links are Jaccard >= part / whole of k-word shingle sets.

    A text without words (or null) has the empty set and stands alone. Equal sets
    are one node, found by its digest, so rows that repeat a key keep what their own
    texts decide, and none of their links is lost; component_id is the least key of
    the rows reachable by links. Keys must be integers; a null key is a document that
    stands alone, with a null component and kept. Other columns don't matter. An
    empty table gives an empty result.
    """
    out = _grouped(docs, k, part, whole, key, text, star_rounds).select(key, "n_shingles", F.coalesce("first.key", F.col(key)).alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def leaders(docs: DataFrame, k: int = 3, part: int = 85, whole: int = 100, key: str = "doc_id", text: str = "text", star_rounds: int = 5) -> DataFrame:
    """(key, th): the first row of each group of near-duplicates, by key, then by th, its text's xxhash64. Null keys and empty sets have no group."""
    return _grouped(docs, k, part, whole, key, text, star_rounds).filter("first is not null").select(F.col("first.key").alias(key), F.col("first.th").alias("th")).distinct()


def _grouped(docs: DataFrame, k: int, part: int, whole: int, key: str, text: str, star_rounds: int) -> DataFrame:
    threshold = part / whole
    rows, bands = choose_bands(threshold)
    count = rows * bands
    hashed = docs.select(F.col(key), F.col(text), F.xxhash64(text).alias("th"))
    every = checkpointed(_sketches(hashed, key, text, k, rows, bands))
    mine = every.filter(f"n_shingles > 0 and `{key}` is not null")
    first = mine.groupBy("d1", "d2").agg(F.min(F.struct(F.col(key).cast("long").alias("key"), "th")).alias("at"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    nodes = checkpointed(first.select(F.monotonically_increasing_id().alias("id"), "d1", "d2", "at.key", "at.th", "n", "bands", "sig"))
    shared = nodes.select("id", "n", "sig", F.explode("bands").alias("band"))
    sized = shared.groupBy("band").agg(F.count("*").alias("m")).filter("m > 1")
    shared = shared.join(sized, "band")
    # Who shares bands with many others is the likely original of a group of copies, and leads first.
    of_id = shared.groupBy("id").agg(F.sum("m").alias("fame"), F.max(F.struct("m", "band")).alias("largest")).select("id", "fame", F.col("largest.band").alias("home"))
    buckets = checkpointed(shared.join(of_id, "id").select("band", "id", "n", "sig", "m", "fame", "home"))
    if buckets.isEmpty():
        return _labelled(every, nodes, None, key)
    ids = buckets.select("id").distinct().join(nodes.select("id", "d1", "d2", "key", "th"), "id")
    wanted = hashed.join(ids, (hashed[key] == ids["key"]) & (hashed["th"] == ids["th"])).select("id", "d1", hashed[text].alias("text"))

    def to_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [shingle_set(t, k) for t in pdf["text"]]
            on = np.array([_digest(x)[0] for x in sets], np.int64) == pdf["d1"].to_numpy()
            yield pd.DataFrame({"id": pdf["id"], "set": [x.tobytes() for x in sets]})[on]
        _words.clear()

    sets = checkpointed(wanted.mapInPandas(to_sets, "id long, set binary"))
    least = threshold - slack(threshold, count)
    links: DataFrame | None = None
    labels: DataFrame | None = None
    for turn in range(star_rounds):
        order = F.xxhash64(F.lit(turn), "id") if turn else -F.col("fame")
        mixed = _mixed(buckets, labels, order)
        # Every document meets the most alike of the leaders of its buckets.
        alike = estimated_similarity(F.col("sig"), F.col("lead.sig"), count)
        near = mixed.filter((F.col("c") != F.col("lead.c")) & (F.least("n", "lead.n") * whole >= F.greatest("n", "lead.n") * part)).withColumn("alike", alike).filter(F.col("alike") >= least)
        near = near.select("id", "c", "m", F.struct("alike", F.col("lead.id").alias("id"), F.col("lead.c").alias("c")).alias("lead"))
        near = checkpointed(near.groupBy("id", "c").agg(F.max(F.struct("lead", "m")).alias("to")).select("id", "c", "to.lead", "to.m"))
        tried = near.count()
        task = F.pmod(F.xxhash64("lead.id", F.pmod(F.xxhash64("id"), F.ceil(F.col("m") / 256).cast("long"))), F.lit(max(1, tried // 256)))
        pairs = near.select(task.alias("task"), F.col("id").alias("a"), F.col("lead.id").alias("b"), F.col("c").alias("ca"), F.col("lead.c").alias("cb"))
        got = checkpointed(_confirmed(pairs, sets, part, whole))
        settled = got.count()
        links = got if links is None else links.unionByName(got)
        if settled:
            labels = connected_components(links)
        if settled * 4 < tried or not tried:
            break
    # What leaders didn't settle is compared within its buckets.
    members = checkpointed(_mixed(buckets, labels, F.col("id")).select("band", "id", "c", "home", "sig"))
    if not members.isEmpty():
        got = checkpointed(_compared(members, sets, count, least, part, whole))
        if not got.isEmpty():
            labels = connected_components(got if links is None else links.unionByName(got))
    return _labelled(every, nodes, labels, key)


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
