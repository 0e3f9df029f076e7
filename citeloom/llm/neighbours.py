"""Operator 2: near-duplicate embeddings by NN-descent and a sweep over what it leaves apart.

The neighbour graph starts from a forest of random-hyperplane trees whose leaves
are compared within themselves, and is refined by neighbours-of-neighbours joins:
each vector brings its neighbours and those that chose it together, and what they
find nearer than their worst neighbour so far replaces it. Lists of fixed length
can't hold all links, so the components of their links are a start only: a sweep
by random hyperplanes in bands compares all vectors of unlike components that
share a bucket, whatever the bucket's size, with so many bands that a pair at the
threshold shares none with a probability below MISS. Members of the resulting
components are compared in blocks of double-precision products, which counts every
link. Recall is audited against brute force for all vectors whose key is divisible by
20; while it is too low, the descent goes on with lists twice as long and the sweep is
repeated with other hyperplanes; three such attempts in vain raise an error. Equal
vectors are one node, whatever their keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.common import checkpointed, table, union_all
from citeloom.llm.components import connected_components

LEAF = 48
TREES = 8
#: The probability that two vectors at the threshold share no bucket of the sweep.
MISS = 1e-7
#: Bands of the sweep that are on disk at a time.
BATCH = 14


def unit(v) -> np.ndarray | None:
    """A vector in double precision with length one; None if null, zero, or with null or non-finite parts."""
    if v is None:
        return None
    x = np.array([np.nan if e is None else e for e in v], np.float64) if not isinstance(v, np.ndarray) or v.dtype == object else v.astype(np.float64)
    with np.errstate(all="ignore"):
        if not len(x) or not np.isfinite(x).all() or not (m := np.abs(x).max()):
            return None
        x = x / m
        return x / np.sqrt(x @ x)


def _nodes(vectors: DataFrame, key: str, column: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            units = [unit(v) for v in pdf[column]]
            raw = [None if u is None else u.tobytes() for u in units]
            d = [None if b is None else xxhash.xxh3_128_digest(b) for b in raw]
            yield pd.DataFrame({key: pdf[key], "digest": d, "vec": raw})

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.select(key, column).mapInPandas(run, f"`{key}` {kind}, digest binary, vec binary")


def _matrix(parts) -> np.ndarray:
    return np.stack([np.frombuffer(b, np.float64) for b in parts])


def linked(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products row by row: the one sum that decides at the threshold, whatever block a pair lies in."""
    return np.einsum("ij,ij->i", x, y)


def links_of(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of x and y are linked; pairs within rounding of the threshold are decided by `linked`."""
    s = x @ y.T
    on = s >= threshold
    i, j = np.nonzero(np.abs(s - threshold) < 1e-9)
    on[i, j] = linked(x[i], y[j]) >= threshold
    return on


def _best(ids: np.ndarray, x: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest of each among these, as (src, dst, sim)."""
    s = x.astype(np.float32) @ x.astype(np.float32).T
    np.fill_diagonal(s, -2)
    k = min(k, len(ids) - 1)
    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
    row = np.arange(len(ids))[:, None]
    return pd.DataFrame({"src": np.repeat(ids, k), "dst": ids[top].reshape(-1), "sim": s[row, top].reshape(-1).astype(np.float64)})


def _forest(nodes: DataFrame, count: int, k: int, dims: int, seed: int) -> DataFrame:
    depth = max(0, math.ceil(math.log2(max(1, count) / LEAF)))
    planes = np.random.default_rng(seed).standard_normal((dims, TREES * max(depth, 1)))

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            side = (_matrix(pdf["vec"]) @ planes > 0).reshape(len(pdf), TREES, -1)
            codes = (side[:, :, :depth] << np.arange(depth)).sum(2) if depth else np.zeros((len(pdf), TREES), np.int64)
            for t in range(TREES):
                yield pd.DataFrame({"leaf": codes[:, t].astype(np.int64) * TREES + t, "id": pdf["id"], "vec": pdf["vec"]})

    leaves = nodes.mapInPandas(code, "leaf long, id long, vec binary")
    # A crowded leaf is dealt out into parts of about four leaves' size.
    crowd = leaves.groupBy("leaf").agg(F.ceil(F.count("*") / (4 * LEAF)).cast("long").alias("parts"))
    leaves = leaves.join(crowd, "leaf").withColumn("part", F.pmod(F.xxhash64("id", "leaf"), F.col("parts")))

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < 2:
            return pd.DataFrame({"src": [], "dst": [], "sim": []})
        return _best(pdf["id"].to_numpy(), _matrix(pdf["vec"]), k)

    return leaves.groupBy("leaf", "part").applyInPandas(within, "src long, dst long, sim double")


def _lists(edges: DataFrame, k: int) -> DataFrame:
    """(src, dst, sim): the k nearest of each src."""
    top = edges.groupBy("src").agg(F.slice(F.sort_array(F.collect_set(F.struct("sim", "dst")), asc=False), 1, k).alias("near"))
    return top.select("src", F.explode("near").alias("e")).select("src", F.col("e.dst").alias("dst"), F.col("e.sim").alias("sim"))


def _descend(graph: DataFrame, nodes: DataFrame, k: int, turn: int) -> DataFrame:
    """One neighbours-of-neighbours join; of those that chose a vector, up to 2k drawn by hash take part in a turn."""
    worst = graph.groupBy("src").agg(F.min("sim").alias("worst"), F.count("*").alias("n"))
    chosen = graph.select(F.col("dst").alias("v"), F.col("src").alias("u"), F.xxhash64(F.lit(turn), "src").alias("x"))
    back = chosen.groupBy("v").agg(F.slice(F.sort_array(F.collect_set(F.struct("x", "u"))), 1, 2 * k).alias("us")).select("v", F.explode("us.u").alias("u"))
    meets = graph.select(F.col("src").alias("v"), F.col("dst").alias("u")).union(back).union(graph.select(F.col("src").alias("v"), F.col("src").alias("u"))).distinct()
    brought = nodes.join(worst, nodes.id == worst.src).select(F.col("id").alias("u"), "vec", F.when(F.col("n") < k, -2.0).otherwise(F.col("worst")).alias("worst"))
    groups = meets.join(brought, "u").groupBy("v").agg(F.collect_list("u").alias("us"), F.collect_list("vec").alias("vecs"), F.collect_list("worst").alias("worsts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for ids, vecs, worsts in zip(pdf["us"], pdf["vecs"], pdf["worsts"], strict=True):
                if len(ids) > 1:
                    got = _best(np.asarray(ids, np.int64), _matrix(vecs), 3)
                    out.append(got[got["sim"].to_numpy() > np.repeat(np.asarray(worsts, float), min(3, len(ids) - 1))])
            if out:
                yield pd.concat(out)

    return groups.mapInPandas(run, "src long, dst long, sim double")


def _confirmed(graph: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b): edges of the graph confirmed in double precision."""
    near = graph.filter(F.col("sim") >= threshold - 1e-4).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    one, two = nodes.select(F.col("id").alias("a"), F.col("vec").alias("va")), nodes.select(F.col("id").alias("b"), F.col("vec").alias("vb"))

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.loc[linked(_matrix(pdf["va"]), _matrix(pdf["vb"])) >= threshold, ["a", "b"]]

    return near.join(one, "a").join(two, "b").mapInPandas(confirm, "a long, b long")


def choose_bands(count: int, threshold: float) -> tuple[int, int]:
    """(bits, bands): a bucket holds about eight of count spread-out vectors, a pair at the threshold shares none with probability below MISS."""
    bits = min(40, max(1, math.ceil(math.log2(max(2, count) / 8))))
    same = min(0.999, (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits)
    return bits, math.ceil(math.log(MISS) / math.log1p(-same))


def _close(x: np.ndarray, y: np.ndarray | None, g: np.ndarray, cx: np.ndarray, cy: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of linked rows of unlike components: of x and y, or without y within each run of equal g of x."""
    if y is not None:
        return np.nonzero(links_of(x, y, threshold) & (cx[:, None] != cy[None, :]))
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    sizes = np.diff(np.r_[starts, len(g)])
    one, two = [], []
    for at, n in zip(starts[sizes > 64], sizes[sizes > 64], strict=True):
        part = slice(at, at + n)
        i, j = np.nonzero(np.triu(links_of(x[part], x[part], threshold), 1) & (cx[part, None] != cx[None, part]))
        one.append(i + at)
        two.append(j + at)
    # Small buckets together: each row with the one `step` places after it.
    few = np.repeat(sizes <= 64, sizes)
    for step in range(1, min(64, len(g))):
        i = np.flatnonzero(few[:-step] & (g[:-step] == g[step:]) & (cx[:-step] != cx[step:]))
        if len(i):
            i = i[linked(x[i], x[i + step]) >= threshold]
            one.append(i)
            two.append(i + step)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *one]), np.concatenate([none, *two])


def _forest_of(i: np.ndarray, j: np.ndarray, ci: np.ndarray, cj: np.ndarray) -> np.ndarray:
    """Which of the links (i, j) suffice to join the components ci, cj that they join."""
    _, first = np.unique(np.stack([np.minimum(ci, cj), np.maximum(ci, cj)]), axis=1, return_index=True)
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while (w := root.get(v, v)) != v:
            root[v] = root.get(w, w)
            v = w
        return v

    keep = []
    for n in first:
        a, b = find(int(ci[n])), find(int(cj[n]))
        if a != b:
            root[a] = b
            keep.append(n)
    return np.array(keep, np.int64)


def _met(keys: DataFrame, placed: DataFrame, threshold: float, count: int, block: int) -> DataFrame:
    """Links (a, b) that join the components c of each bucket of keys (g, id, c), comparing all its members of unlike components.

    A component with `block` members in a bucket has blocks of its own, which
    aren't paired with each other; all others share blocks; small buckets share tasks.
    """
    sizes = keys.groupBy("g", "c").agg(F.count("*").alias("m"))
    of_g = sizes.groupBy("g").agg(F.sum("m").alias("n"), F.count("*").alias("cs"), F.sum(F.when(F.col("m") < block, F.col("m")).otherwise(0)).alias("rest")).filter("cs > 1")
    own, small = F.col("m") >= block, F.col("n") <= block
    cut = F.greatest(F.lit(1), F.ceil(F.when(own, F.col("m")).otherwise(F.col("rest")) / block).cast("long"))
    at = F.xxhash64(F.when(own, F.col("c")), F.pmod(F.xxhash64("id"), cut))
    shared = F.pmod(F.xxhash64("g"), F.lit(max(1, count // 1024)))
    dealt = keys.join(sizes, ["g", "c"]).join(of_g, "g").select(
        F.when(small, shared).otherwise(F.xxhash64(F.lit("own"), "g")).alias("u"), F.when(small, F.lit(0)).otherwise(at).cast("long").alias("k"), F.when(own & ~small, F.col("c")).alias("pure"), "g", "id", "c"
    )
    dealt = checkpointed(dealt)
    blocks = dealt.select("u", "k", "pure").distinct()
    one, two = blocks.toDF("u", "k1", "p1"), blocks.toDF("u2", "k2", "p2")
    pairs = one.join(two, (F.col("u") == F.col("u2")) & (F.col("k1") <= F.col("k2")) & ~F.coalesce(F.col("p1") == F.col("p2"), F.lit(False))).select("u", "k1", "k2")
    left = dealt.join(pairs.withColumn("k", F.col("k1")), ["u", "k"]).withColumn("side", F.lit(0))
    right = dealt.join(pairs.filter("k1 <> k2").withColumn("k", F.col("k2")), ["u", "k"]).withColumn("side", F.lit(1))
    both = left.unionByName(right).select("u", "k1", "k2", "side", "g", "id", "c").join(placed.select("id", "vec"), "id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["k1"].iloc[0] == pdf["k2"].iloc[0]:
            pdf = pdf.sort_values("g")
            g, c, ids = (pdf[n].to_numpy() for n in ("g", "c", "id"))
            i, j = _close(_matrix(pdf["vec"]), None, g, c, c, threshold)
            ai, aj, ci, cj = ids[i], ids[j], c[i], c[j]
        else:
            x, y = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
            cx, cy = x["c"].to_numpy(), y["c"].to_numpy()
            i, j = _close(_matrix(x["vec"]), _matrix(y["vec"]), cx, cx, cy, threshold)
            ai, aj, ci, cj = x["id"].to_numpy()[i], y["id"].to_numpy()[j], cx[i], cy[j]
        if not len(ai):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        on = _forest_of(ai, aj, ci, cj)
        return pd.DataFrame({"a": ai[on], "b": aj[on]})

    return both.groupBy("u", "k1", "k2").applyInPandas(run, "a long, b long")


def _sweep(labels: DataFrame, nodes: DataFrame, count: int, dims: int, threshold: float, seed: int, block: int = 768) -> DataFrame:
    """Links (a, b) between nodes that the labels (id, component) leave apart, enough of them to join their components."""
    bits, bands = choose_bands(count, threshold)
    planes = np.random.default_rng([seed, 2]).standard_normal((dims, bands, bits))
    placed = checkpointed(nodes.join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("c"), "vec"))

    def keys_of(at: int) -> DataFrame:
        some = planes[:, at : at + BATCH]
        n = some.shape[1]

        def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    side = (_matrix(pdf["vec"]) @ some.reshape(dims, n * bits) > 0).reshape(len(pdf), n, bits)
                    codes = (side.astype(np.int64) << np.arange(bits)).sum(2) * n + np.arange(n)
                    yield pd.DataFrame({"g": codes.reshape(-1), "id": np.repeat(pdf["id"].to_numpy(), n), "c": np.repeat(pdf["c"].to_numpy(), n)})

        return placed.mapInPandas(code, "g long, id long, c long")

    found = [checkpointed(_met(checkpointed(keys_of(at)), placed, threshold, count * min(BATCH, bands), block)) for at in range(0, bands, BATCH)]
    return union_all(found)


def _linked(graph: DataFrame, nodes: DataFrame, count: int, dims: int, threshold: float, seed: int) -> DataFrame:
    """(id, component, weight, vec) of nodes that some edge of the graph or of the sweep links."""
    links = checkpointed(_confirmed(graph, nodes, threshold))
    more = _sweep(connected_components(links), nodes, count, dims, threshold, seed)
    labels = connected_components(links.unionByName(more))
    return nodes.join(labels, "id").select("id", "component", "weight", "vec")


def _count_links(linked: DataFrame, threshold: float, block: int = 512) -> DataFrame:
    """(id, links, least): weight of the others that each node is linked with, comparing every two blocks of its component."""
    sizes = linked.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = linked.join(sizes, "component").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("component", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "id", "weight", "vec")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        left = pdf[pdf["mine"] == i]
        right = pdf[pdf["mine"] == j]
        if not len(left) or not len(right):
            return pd.DataFrame({"id": [], "links": []})
        on = links_of(_matrix(left["vec"]), _matrix(right["vec"]), threshold)
        on &= left["id"].to_numpy()[:, None] != right["id"].to_numpy()[None, :]
        out = pd.DataFrame({"id": left["id"], "links": on @ right["weight"].to_numpy()})
        return out if i == j else pd.concat([out, pd.DataFrame({"id": right["id"], "links": on.T @ left["weight"].to_numpy()})])

    return spread.groupBy("component", "i", "j").applyInPandas(run, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def audit(nodes: DataFrame, found: DataFrame, links: DataFrame, threshold: float, block: int = 2048) -> float:
    """Recall of links of the nodes in `asked` (a column), compared with all nodes, a block of queries at a time.

    The share of what brute force links a query with that the result counts for it;
    queries of one component count as one, so that a large group doesn't hide what
    others miss. Queries without links don't count.
    """
    ask = nodes.filter("asked").select("id", "vec")
    blocks = math.ceil(ask.count() / block)
    true = None
    for i in range(blocks):
        part = ask.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).collect()  # about `block` rows
        if not part:
            continue
        ids, q = np.array([r["id"] for r in part]), _matrix([bytes(r["vec"]) for r in part])

        def run(batches: Iterator[pd.DataFrame], ids=ids, q=q) -> Iterator[pd.DataFrame]:
            total = np.zeros(len(ids), np.int64)
            for pdf in batches:
                for lo in range(0, len(pdf), 256):
                    part = pdf.iloc[lo : lo + 256]
                    on = links_of(q, _matrix(part["vec"]), threshold)
                    on &= ids[:, None] != part["id"].to_numpy()[None, :]
                    total += on @ part["weight"].to_numpy(np.int64)
            some = np.flatnonzero(total)
            yield pd.DataFrame({"id": ids[some], "n": total[some]})

        got = nodes.select("id", "weight", "vec").mapInPandas(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
        true = got if true is None else true.unionByName(got)
    if true is None:
        return 1.0
    met = true.join(found.select("id", "component"), "id", "left").join(links, "id", "left")
    each = met.groupBy(F.coalesce("component", "id").alias("c")).agg(F.avg(F.least(F.coalesce("links", F.lit(0)), "n") / F.col("n")).alias("share"))
    recall = each.agg(F.avg("share").alias("recall")).first()["recall"]
    return 1.0 if recall is None else recall


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.95, k: int = 8, turns: int = 2, recall: float = 0.995, every: int = 20, key: str = "vec_id", column: str = "embedding", seed: int = 3) -> DataFrame:
    """key, n_links, component_id, kept for every row.

    Links: cosine >= threshold in double precision. Vectors that are null, zero or
    hold null or non-finite components link with nothing. Equal directions (bit by
    bit) are one node, found by its digest, and are linked without being expanded
    into pairs. Rows that repeat a key keep what their own vectors decide;
    component_id is the least key of the rows reachable. Rows with a null key link
    with nothing and have a null component. Vectors of unlike lengths raise an
    error, and so does a recall that stays below ``recall``: it is audited with all
    rows whose key is divisible by ``every`` as queries against all rows. Other
    columns don't matter.
    """
    rows = checkpointed(_nodes(vectors, key, column))
    good = rows.filter(f"vec is not null and `{key}` is not null")
    met = good.groupBy("digest").agg(F.min(key).cast("long").alias("least"), F.count("*").alias("weight"), F.first("vec").alias("vec"), F.max(F.col(key) % every == 0).alias("asked"))
    nodes = checkpointed(met.withColumn("id", F.monotonically_increasing_id()))
    first = nodes.select(F.length("vec")).first()
    base = rows.select(key, "digest")
    if first is None:
        return base.select(key, F.lit(0).cast("long").alias("n_links"), F.col(key).alias("component_id"), F.col(key).eqNullSafe(F.col(key)).alias("kept"))
    count, dims = nodes.count(), first[0] // 8
    bare = nodes.select("id", "vec")
    graph = checkpointed(_lists(_forest(bare, count, k, dims, seed), k))
    for attempt in range(3):
        for turn in range(turns):
            found = _descend(graph, bare, k, attempt * turns + turn)
            graph = checkpointed(_lists(graph.union(found), k))
        joined = checkpointed(_linked(graph, nodes, count, dims, threshold, seed + attempt))
        links = checkpointed(_count_links(joined, threshold))
        if audit(nodes, joined, links, threshold) >= recall:
            break
        # Audited recall is too low: longer lists, more trees.
        k *= 2
        graph = checkpointed(_lists(graph.union(_forest(bare, count, k, dims, seed + 1 + attempt)), k))
    else:
        raise RuntimeError(f"audited recall stayed below {recall}")
    of = nodes.select("id", "digest", "weight", "least").join(joined.select("id", "component"), "id", "left").join(links, "id", "left").withColumn("component", F.coalesce("component", "id"))
    called = of.groupBy("component").agg(F.min("least").alias("name"))
    classes = of.join(called, "component").select("digest", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"), F.col("name").alias("c"))
    has_key = F.col(key).isNotNull()
    out = base.join(classes, "digest", "left").select(
        key, F.when(has_key, F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("n_links"), F.when(has_key, F.coalesce("c", key)).alias("component_id")
    )
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
