"""Operator 7: language-model scores by a hierarchical Pitman-Yor model.

Order two: each context word is a Chinese restaurant, and all of them share the
unigram restaurant as their parent, whose base is uniform over the known words and
one class of unseen ones. Customers of a context are its training tokens; each of
its tables sends one customer to the parent. Seating is sampled by Gibbs, a dish at
a time: all customers of a word leave its restaurant and are seated again, given the
other dishes' tables and the parent's probability. Predictions need no more of a
seating than its number of tables, so that is what is drawn, from its distribution
over all seatings (generalised Stirling numbers); a dish costs the same whatever its
count. The parent's customers are the tables below it and are seated in the same way.

Sweeps are synchronous: within one, all dishes see the tables and the parent of the
sweep before. After burn-in, each sweep's predictive probabilities are kept, and
their average is what scores a token. Draws are a hash of seed, sweep, word pair and
step, so the layout of blocks and ranges changes no score.

Layout: texts are packed once into blocks of bounded size (word ids within the
block, sorted 64-bit word hashes, training counts). What blocks ask about words goes
to hash ranges, which give every distinct word of the corpus its number. Word pairs,
as numbers, go to the cells of a grid (context, word), so that a frequent context is
spread over many cells; a pair is one entry a block, and never more rows are made
than there are such entries. Cells hold what is known of their pairs; in each sweep
their contexts and words send sums to key ranges and get totals back. All of this
grows with the corpus and is spread over it; only totals and one number for each
range go to the driver.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.common import Tables, checkpointed, release_shuffles, table, words_of

END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: Discounts and strengths of the pair level and of the unigram level.
D2, S2, D1, S1 = 0.8, 1.0, 0.5, 10.0
GOLDEN = 0x9E3779B97F4A7C15


def pack(a: np.ndarray) -> bytes:
    """An array as compressed byte planes (sorted unsigned arrays as differences)."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T if len(a) else a.view(np.uint8)
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def unpack(b: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).reshape(-1) if len(raw) else np.empty(0, dtype)


def pack_keys(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=np.uint64(0)) if len(a) else a)


def unpack_keys(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, np.uint64), dtype=np.uint64)


def bounds(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each hash range starts in sorted keys, and the end."""
    at = (np.arange(1, ranges, dtype=object) * ((1 << 64) // ranges)).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, at), [len(keys)]]).astype(np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit integers as well-mixed ones."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(key: np.ndarray, step: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on key and step only."""
    return ((mixed(key + np.uint64((step + 1) * GOLDEN & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(12)).astype(np.float64) + 0.5) / (1 << 52)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers (shift by eight, then Stirling's series)."""
    x = np.asarray(x, np.float64)
    low = x < 8
    z = np.where(low, x + 8, x)
    r = 1 / (z * z)
    out = (z - 0.5) * np.log(z) - z + 0.9189385332046727 + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / z
    if low.any():
        y = x[low]
        out[low] -= np.log(y * (y + 1) * (y + 2) * (y + 3)) + np.log((y + 4) * (y + 5) * (y + 6) * (y + 7))
    return out


#: Dishes of up to so many customers are drawn from a table of exact weights.
FEW = 64
#: Larger dishes' Stirling numbers: the alternating sum where t * c ** -d is up to REACH, with up to TERMS terms.
REACH, TERMS = 1.8, 40


@lru_cache(maxsize=8)
def stirling_table(d: float, most: int = FEW) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S_d(c, t), the weight of all seatings of c customers at t tables."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(most):
        t = np.arange(1, c + 2)
        out[c + 1, t] = np.logaddexp(out[c, t - 1], np.log(np.maximum(c - d * t, 1e-300)) + out[c, t])
    return out


def _saddle(r: np.ndarray, d: float) -> np.ndarray:
    """w < 0 with h(w) = d * exp((d - 1) w) * (1 - exp(w)) / (1 - exp(d w)) = r > 1, by Newton steps in log(-w)."""
    v = np.log(np.where(r < 2, 2 * (r - 1) / (1 - d), np.log(r / d) / (1 - d)))
    for _ in range(10):
        w = -np.exp(v)
        e, ed = np.expm1(w), np.expm1(d * w)
        f = np.log(d) + (d - 1) * w + np.log(e / ed) - np.log(r)
        slope = ((d - 1) + (e + 1) / e - d * (ed + 1) / ed) * w
        v -= np.clip(f / slope, -1.5, 1.5)
    return -np.exp(v)


def log_stirling(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log S_d(c, t) of dishes of more than FEW customers.

    Few tables: the alternating sum over j of C(t, j) * (-j d)_c, whose terms fall as
    c ** (-j d). Many: the saddle point of the generating function ((1 - (1 - z) ** d)
    / d) ** t / t!. Weights are within 2 % (for the discounts used
    here), and neighbouring ones' ratio within 0.2 % but where the rule changes.
    """
    c, t = c.astype(np.float64), t.astype(np.float64)
    out = np.zeros(len(c))
    few = (t * c**-d <= REACH) & (t < c)
    if few.any():
        cf, tf = c[few], t[few]
        total, first = np.zeros(len(cf)), log_gamma(cf - d)
        for j in range(1, TERMS + 1):
            on = tf >= j
            if math.isclose(j * d, round(j * d)) or not on.any():
                continue  # the term is zero
            ways = log_gamma(tf[on] + 1) - math.lgamma(j + 1) - log_gamma(tf[on] - j + 1)
            size = np.exp(ways + log_gamma(cf[on] - j * d) - first[on] + math.lgamma(1 + j * d) - math.log(math.pi))
            total[on] += (-1) ** (j + 1) * math.sin(math.pi * j * d) * size
        out[few] = first - tf * math.log(d) - log_gamma(tf + 1) + np.log(np.maximum(total, 1e-300))
    many = ~few & (t < c)
    if many.any():
        cm, tm = c[many], t[many]
        w = _saddle(cm / tm, d)
        e, ed = np.expm1(w), np.expm1(d * w)
        slope = (d - 1) + (e + 1) / e - d * (ed + 1) / ed
        spread = cm * e * slope * np.exp(-w)
        m = cm - tm  # where few customers join old tables, the error is that of Stirling's m!
        spread *= np.exp(2 * (log_gamma(m + 1) - m * np.log(m) + m)) / (2 * math.pi * m)
        out[many] = log_gamma(cm + 1) - log_gamma(tm + 1) - tm * math.log(d) + tm * np.log(-ed) - cm * np.log(-e) - 0.5 * np.log(2 * math.pi * spread)
    return out


def sampled(c: np.ndarray, rest: np.ndarray, parent: np.ndarray, d: float, s: float, key: np.ndarray, steps: int) -> np.ndarray:
    """Tables of c >= 1 customers of each dish, drawn from their distribution given all others.

    rest: tables of the restaurant's other dishes; parent: the dish's probability
    above. All customers of the dish leave and are seated again: t tables have the
    weight S_d(c, t) * parent ** t * product over j < t of s + d * (rest + j). Up to
    FEW customers all weights are summed; beyond, Metropolis steps start at the mode.
    """
    t = np.ones(len(c), np.int64)
    a = s / d + rest
    gain = np.log(d * parent)
    u = uniform(key, 0)
    few = np.flatnonzero((c > 1) & (c <= FEW))
    few = few[np.argsort(c[few], kind="stable")]
    sizes, starts = np.unique(c[few], return_index=True)
    for n, lo, hi in zip(sizes, starts, np.append(starts, len(few))[1:], strict=True):
        for at in range(lo, hi, 65536):
            i = few[at : min(hi, at + 65536)]
            j = np.arange(1, n + 1)
            logs = np.log(a[i, None] + j[None, :-1]).cumsum(1) + j[1:] * gain[i, None]
            logs = stirling_table(d)[n, 1 : n + 1] + np.column_stack([gain[i], logs])
            mass = np.exp(logs - logs.max(1, keepdims=True)).cumsum(1)
            t[i] = 1 + (mass < u[i, None] * mass[:, -1:]).sum(1)
    big = np.flatnonzero(c > FEW)
    if len(big):
        cb, ab, gb, kb = c[big], a[big], gain[big], key[big]
        # The mode, where one more table is as likely as one less, by halving its logarithm's range.
        lo, hi = np.zeros(len(big)), np.log(cb - 0.5)
        for _ in range(18):
            mode = np.exp((lo + hi) / 2)
            more = (ab + mode) * parent[big] * -np.expm1(d * _saddle(cb / mode, d)) > mode + 0.5
            lo, hi = np.where(more, (lo + hi) / 2, lo), np.where(more, hi, (lo + hi) / 2)

        def weight(x: np.ndarray) -> np.ndarray:
            return log_stirling(cb, x, d) + log_gamma(ab + x) - log_gamma(ab) + x * gb

        now = np.round(mode)
        have, width = weight(now), 1 + 2.0 * np.sqrt(np.minimum(mode, cb - mode + 1))
        for step in range(steps):
            to = now + np.round((2 * uniform(kb, 2 * step + 1) - 1) * width)
            inside = (to >= 1) & (to <= cb)
            new = weight(np.where(inside, to, 1.0))
            take = inside & (np.log(uniform(kb, 2 * step + 2)) < new - have)
            now, have = np.where(take, to, now), np.where(take, new, have)
        t[big] = now.astype(np.int64)
    return t


def _blocks(docs: DataFrame, key: str, text: str, folds: int, block_bytes: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq = TaskContext.get().partitionId(), 0
        rows: list[tuple] = []
        size = 0

        def close() -> pd.DataFrame:
            nonlocal rows, size, seq
            local: dict[bytes, int] = {}
            toks, lens, held, null = [], [], [], []
            for d, ws in rows:
                toks.append(np.fromiter((local.setdefault(w, len(local)) for w in ws), np.int64, len(ws)))
                lens.append(len(ws))
                null.append(pd.isna(d))
                held.append(not null[-1] and zlib.crc32(str(int(d)).encode()) % folds == 0)
            h = np.fromiter(map(xxhash.xxh64_intdigest, local), np.uint64, len(local))
            keys, first = np.unique(np.concatenate([h, [END, BEGIN]]), return_index=True)
            place = np.searchsorted(keys, h)
            end = np.searchsorted(keys, END)
            flat = np.concatenate([x for t in toks for x in (place[t], [end])]).astype(np.int64)
            lens, held = np.array(lens, np.int32) + 1, np.array(held)
            count = np.bincount(flat[~np.repeat(held, lens)], minlength=len(keys))
            # Tokens are stored as ranks of frequency, which pack better.
            order = np.argsort(-np.bincount(flat, minlength=len(keys)), kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            out = (part << 32) + seq, len(rows), pack(np.array([0 if n else int(d) for (d, _), n in zip(rows, null, strict=True)], np.int64)), pack(np.array(null, np.uint8)), pack(held.astype(np.uint8)), pack(lens), pack(rank[flat].astype(np.uint32)), pack(order.astype(np.uint32)), pack_keys(keys), pack(count.astype(np.uint32)), len(flat)
            rows, size, seq = [], 0, seq + 1
            return pd.DataFrame([out], columns=["block", "n", "ids", "nulls", "held", "lens", "toks", "order", "keys", "seen", "tokens"])

        for pdf in batches:
            for d, t in zip(pdf[key], pdf[text], strict=True):
                ws = words_of(t)
                rows.append((d, ws))
                size += 64 + (len(t) if t else 0)
                if size >= block_bytes:
                    yield close()
        if rows:
            yield close()

    return docs.select(key, text).mapInPandas(run, "block long, n int, ids binary, nulls binary, held binary, lens binary, toks binary, order binary, keys binary, seen binary, tokens long")


def _joined(parts, field: str, dtype) -> np.ndarray:
    return np.concatenate([unpack(p[field], dtype) for p in parts]) if len(parts) else np.empty(0, dtype)


def saved(**arrays) -> bytes:
    return pickle.dumps({k: pack(v) for k, v in arrays.items()} | {"": {k: v.dtype.str for k, v in arrays.items()}})


def loaded(b: bytes) -> dict[str, np.ndarray]:
    got = pickle.loads(b)
    return {k: unpack(got[k], dtype) for k, dtype in got[""].items()}


def _pairs(row, grid: int) -> tuple[np.ndarray, ...]:
    """Of a block with its words' answers: tokens, lens, held; cells and codes of its distinct pairs in their order, place of each token's pair, training counts of pairs."""
    keys, flat = unpack_keys(row.keys), unpack(row.order, np.uint32).astype(np.int64)[unpack(row.toks, np.uint32)]
    lens, held = unpack(row.lens, np.int32), unpack(row.held, np.uint8).astype(bool)
    number = _joined(row.wc, "number", np.int64)
    prev = np.empty_like(flat)
    prev[1:] = flat[:-1]
    prev[np.cumsum(lens) - lens] = np.searchsorted(keys, BEGIN)
    local, inverse = np.unique(prev * len(keys) + flat, return_inverse=True)
    u, w = number[local // len(keys)], number[local % len(keys)]
    cell = (u % grid) * grid + w % grid
    order = np.lexsort((w, u, cell))
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    inverse = rank[inverse]
    seen = np.bincount(inverse[~np.repeat(held, lens)], minlength=len(order))
    return flat, lens, held, cell[order], u[order], w[order], inverse, seen


def _owned(numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where each range of word numbers begins in sorted numbers, and the end."""
    return np.searchsorted(numbers, np.append(starts, np.iinfo(np.int64).max))


def _ranges(at: np.ndarray) -> Iterator[tuple[int, int, int]]:
    for r in np.flatnonzero(np.diff(at)):
        yield int(r), int(at[r]), int(at[r + 1])


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 10, burn: int = 2, sweeps: int = 3, steps: int = 8, block_bytes: int = 16_000_000, range_tokens: int = 2_000_000, seed: int = 7) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for every row.

    A null text is empty: one token, its end. Rows with a null key are learned from.
    Repeated rows count as often as they occur and score alike. Other columns don't
    matter; an empty table gives none, and one whose rows are all held out trains on
    nothing (every token is of the unseen class, base_score is 0 and score too). A
    text longer than block_bytes is a block of its own.
    """
    with Tables(docs.sparkSession) as tables:
        return _scored(docs, key, text, folds, burn, sweeps, steps, block_bytes, range_tokens, seed, tables)


def _scored(docs: DataFrame, key: str, text: str, folds: int, burn: int, sweeps: int, steps: int, block_bytes: int, range_tokens: int, seed: int, tables: Tables) -> DataFrame:
    packed = checkpointed(_blocks(docs, key, text, folds, block_bytes))
    size = packed.agg(F.sum("tokens"), F.count("*")).first()
    ranges = max(1, math.ceil((size[0] or 0) / range_tokens))
    grid = math.ceil(math.sqrt(ranges))

    def ask_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                keys, seen = unpack_keys(row.keys), unpack(row.seen, np.uint32)
                yield pd.DataFrame([(r, row.block, pack_keys(keys[a:b]), pack(seen[a:b])) for r, a, b in _ranges(bounds(keys, ranges))], columns=["r", "block", "keys", "seen"])

    def sum_words(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack_keys(k) for k in pdf["keys"]]
        every, place = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(place, np.concatenate([unpack(s, np.uint32) for s in pdf["seen"]]), len(every)).astype(np.int64)
        split = np.split(place, np.cumsum([len(p) for p in parts])[:-1])
        return pd.DataFrame({"r": pdf["r"], "block": pdf["block"], "c": [pack(total[i]) for i in split], "at": [pack_keys(i.astype(np.uint64)) for i in split], "words": len(every), "tokens": int(total.sum()), "kinds": int((total > 0).sum())})

    asked = packed.select("block", "keys", "seen").mapInPandas(ask_words, "r int, block long, keys binary, seen binary")
    words = checkpointed(asked.groupBy("r").applyInPandas(sum_words, "r int, block long, c binary, at binary, words long, tokens long, kinds long"))
    release_shuffles(docs.sparkSession)
    of_range = words.groupBy("r").agg(F.first("words").alias("n"), F.first("tokens").alias("t"), F.first("kinds").alias("k")).collect()  # one row a range
    total, kinds = sum(x["t"] for x in of_range), sum(x["k"] for x in of_range)
    sizes = np.zeros(ranges, np.int64)
    sizes[[x["r"] for x in of_range]] = [x["n"] for x in of_range]
    starts = np.cumsum(sizes) - sizes

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"block": pdf["block"], "r": pdf["r"], "c": pdf["c"], "number": [pack(unpack_keys(a).astype(np.int64) + starts[r]) for a, r in zip(pdf["at"], pdf["r"], strict=True)]})

    answers = words.mapInPandas(numbered, "block long, r int, c binary, number binary").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("r", "c", "number"))).alias("wc"))
    with_words = packed.select("block", "held", "lens", "toks", "order", "keys").join(answers, "block")

    def ask_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                _, _, _, cell, u, w, _, seen = _pairs(row, grid)
                for r, a, b in _ranges(np.searchsorted(cell, np.arange(grid * grid + 1))):
                    yield pd.DataFrame([(r, row.block, pack_keys((u[a:b] // grid).astype(np.uint64)), pack(w[a:b] // grid), pack(seen[a:b].astype(np.uint32)))], columns=["cell", "block", "us", "ws", "seen"])

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        """A cell's distinct pairs (places of their context and word among the cell's), counts, and each block's pairs among them."""
        cell = int(pdf["cell"].iloc[0])
        u = np.concatenate([unpack_keys(x) for x in pdf["us"]]).astype(np.int64) * grid + cell // grid
        w = np.concatenate([unpack(x, np.int64) for x in pdf["ws"]]) * grid + cell % grid
        us, ui = np.unique(u, return_inverse=True)
        ws, wi = np.unique(w, return_inverse=True)
        code, place = np.unique(ui * len(ws) + wi, return_inverse=True)
        c = np.bincount(place, np.concatenate([unpack(x, np.uint32) for x in pdf["seen"]]), len(code)).astype(np.int64)
        sizes = [len(unpack(x, np.uint32)) for x in pdf["seen"]]
        split = np.split(place, np.cumsum(sizes)[:-1])
        body = saved(us=np.diff(us, prepend=0), ws=np.diff(ws, prepend=0), code=np.diff(code, prepend=0), c=c)
        many = c > 1
        state = saved(us=us, ws=ws, uc=np.bincount(code // len(ws), c, len(us)).astype(np.int64), alone_u=np.bincount(code // len(ws), c == 1, len(us)).astype(np.int64), alone_w=np.bincount(code % len(ws), c == 1, len(ws)).astype(np.int64), ui=code[many] // len(ws), wi=code[many] % len(ws), c=c[many], t=np.ones(int(many.sum()), np.int64))
        places = pickle.dumps([pack_keys(i.astype(np.uint64)) for i in split])
        return pd.DataFrame([(cell, body, state, pdf["block"].tolist(), places)], columns=["cell", "body", "state", "blocks", "places"])

    asked = with_words.mapInPandas(ask_pairs, "cell int, block long, us binary, ws binary, seen binary")
    cells = tables.keep(asked.groupBy("cell").applyInPandas(build, "cell int, body binary, state binary, blocks array<long>, places binary"))
    state, kept = cells.select("cell", "state"), []
    above = float(kinds)  # tables of the unigram restaurant: one a word to begin with
    for sweep in range(burn + sweeps):
        base = 1 / (kinds + 1)

        def ask_totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for cell, body in zip(pdf["cell"], pdf["state"], strict=True):
                    x = loaded(body)
                    open_tables = np.bincount(x["ui"], x["t"], len(x["us"])).astype(np.int64) + x["alone_u"]
                    customers = np.bincount(x["wi"], x["t"], len(x["ws"])).astype(np.int64) + x["alone_w"]
                    out = []
                    for kind, numbers, n in ((0, x["us"], open_tables), (1, x["ws"], customers)):
                        # Contexts have customers to sum besides, which don't change.
                        other = x["uc"] if kind == 0 and sweep == 0 else np.zeros(0, np.int64)
                        out += [(kind, r, cell, pack(np.diff(numbers[a:b], prepend=0)), pack(n[a:b]), pack(other[a:b])) for r, a, b in _ranges(_owned(numbers, starts))]
                    yield pd.DataFrame(out, columns=["kind", "r", "cell", "numbers", "n", "other"])

        def sum_totals(pdf: pd.DataFrame) -> pd.DataFrame:
            """Contexts: tables and, in the first sweep, customers. Words: customers of the unigram restaurant and their tables there."""
            parts = [np.cumsum(unpack(k, np.int64)) for k in pdf["numbers"]]
            every, place = np.unique(np.concatenate(parts), return_inverse=True)
            n = np.bincount(place, np.concatenate([unpack(x, np.int64) for x in pdf["n"]]), len(every)).astype(np.int64)
            if pdf["kind"].iloc[0]:
                more, on = np.zeros(len(every), np.int64), np.flatnonzero(n)
                k = mixed(every[on].astype(np.uint64) + np.uint64(seed * 1000 + sweep * 2 + 1))
                more[on] = sampled(n[on], np.full(len(on), above - 1), np.full(len(on), base), D1, S1, k, steps)
            else:
                other = np.concatenate([unpack(x, np.int64) for x in pdf["other"]])
                more = np.bincount(place, other, len(every)).astype(np.int64) if len(other) else other
            split = np.split(place, np.cumsum([len(p) for p in parts])[:-1])
            return pd.DataFrame({"kind": pdf["kind"], "r": pdf["r"], "cell": pdf["cell"], "n": [pack(n[i]) for i in split], "more": [pack(more[i] if len(more) else more) for i in split], "all_n": int(n.sum()), "all_more": int(more.sum())})

        asked = state.mapInPandas(ask_totals, "kind int, r int, cell int, numbers binary, n binary, other binary")
        totals = tables.keep(asked.groupBy("kind", "r").applyInPandas(sum_totals, "kind int, r int, cell int, n binary, more binary, all_n long, all_more long"))
        sums = totals.filter("kind = 1").groupBy("r").agg(F.first("all_n").alias("n"), F.first("all_more").alias("m")).agg(F.sum("n"), F.sum("m")).first()
        customers, above = int(sums[0] or 0), float(sums[1] or 0)
        keep = sweep >= burn
        if keep:
            kept.append((customers, above))
        # The last totals belong to the last seating; it isn't seated again.
        last = sweep == burn + sweeps - 1

        def seat_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for cell, body, told in zip(pdf["cell"], pdf["state"], pdf["told"], strict=True):
                    x = loaded(body)
                    contexts, words = [p for p in told if not p["kind"]], [p for p in told if p["kind"]]
                    open_tables, n, k = _joined(contexts, "n", np.int64), _joined(words, "n", np.int64), _joined(words, "more", np.int64)
                    if sweep == 0:
                        x["uc"] = _joined(contexts, "more", np.int64)
                    if keep:
                        x |= {f"t{len(kept)}": x["t"], f"u{len(kept)}": open_tables, f"n{len(kept)}": n, f"k{len(kept)}": k}
                    if not last:
                        p = unigram(n, k, customers, above, base)
                        pair = mixed(x["us"][x["ui"]].astype(np.uint64) + np.uint64(seed * 1000 + sweep * 2)) + x["ws"][x["wi"]].astype(np.uint64)
                        x["t"] = sampled(x["c"], open_tables[x["ui"]] - x["t"], p[x["wi"]], D2, S2, mixed(pair), steps)
                    out.append((cell, saved(**x)))
                yield pd.DataFrame(out, columns=["cell", "state"])

        told = totals.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("kind", "r", "n", "more"))).alias("told"))
        new = tables.keep(state.join(told, "cell").mapInPandas(seat_pairs, "cell int, state binary"))
        tables.drop(totals)
        if sweep:
            tables.drop(state)
        state = new

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """log10 of the averaged predictive probability of each block's pairs in a cell."""
        for pdf in batches:
            for cell, body, state, blocks, places in pdf.itertuples(index=False):
                x, y = loaded(body), loaded(state)
                code, c, p = np.cumsum(x["code"]), x["c"], np.zeros(len(x["c"]))
                ui, wi = code // max(1, len(y["ws"])), code % max(1, len(y["ws"]))
                for i, (customers, above) in enumerate(kept, 1):
                    t = np.minimum(c, 1)
                    t[c > 1] = y[f"t{i}"]
                    up = unigram(y[f"n{i}"], y[f"k{i}"], customers, above, 1 / (kinds + 1))
                    p += (c - D2 * t + (S2 + D2 * y[f"u{i}"][ui]) * up[wi]) / (S2 + y["uc"][ui]) / len(kept)
                # Without any training token everything is of the unseen class.
                got = (np.log10(p) if total else np.zeros(len(p))).astype(np.float32)
                for block, i in zip(blocks, pickle.loads(places), strict=True):
                    yield pd.DataFrame([(block, cell, pack(got[unpack_keys(i).astype(np.int64)]))], columns=["block", "cell", "p"])

    found = cells.drop("state").join(state, "cell").select("cell", "body", "state", "blocks", "places").mapInPandas(answer, "block long, cell int, p binary")
    found = tables.keep(found.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("cell", "p"))).alias("pp")))
    tables.drop(cells)
    tables.drop(state)
    found = checkpointed(found)  # outlives the tables, as the result refers to it
    last = packed.select("block", "ids", "nulls", "held", "lens", "toks", "order", "keys").join(answers, "block").join(found, "block")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                flat, lens, held, _, _, _, inverse, _ = _pairs(row, grid)
                c, logs = _joined(row.wc, "c", np.int64), _joined(row.pp, "p", np.float32).astype(np.float64)
                base = np.log10((c + 0.1) / (total + 0.1 * (kinds + 1)))
                at = np.cumsum(lens) - lens
                null = unpack(row.nulls, np.uint8).astype(bool)
                got = np.add.reduceat(logs[inverse], at)
                yield pd.DataFrame(
                    {
                        key: pd.array(unpack(row.ids, np.int64), dtype="Int64"),
                        "held_out": held,
                        "n_tokens": lens.astype(np.int64),
                        "n_known": np.add.reduceat((c[flat] > 0).astype(np.int64), at),
                        "train_tokens": total,
                        "base_score": np.add.reduceat(base[flat], at),
                        "score": got,
                        "perplexity": 10 ** np.minimum(-got / lens, 300.0),
                    }
                ).assign(**{key: lambda x, null=null: x[key].mask(null)})

    return last.mapInPandas(score, f"`{key}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def unigram(n: np.ndarray, k: np.ndarray, customers: int, tables: float, base: float) -> np.ndarray:
    """Predictive probabilities of the unigram restaurant for dishes of n customers at k tables."""
    return (n - D1 * k + (S1 + D1 * tables) * base) / (S1 + customers)


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
