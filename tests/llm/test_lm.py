import math
import random
import zlib
from collections import Counter

import numpy as np

from citeloom.llm import lm


def corpus():
    r = random.Random(9)
    words = [f"w{min(int(r.paretovariate(0.7)), 300)}" for _ in range(50)] + ["Ünï", "the"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 60)))) for i in range(300)]
    fixed = "this exact sentence comes again and again in every tenth text"
    rows += [(1000 + i, f"{fixed} nr{i}") for i in range(60)]
    return [*rows, (2000, None), (2001, ""), (2002, "ONLY once\tnever\x0bseen")]


def test_contract_and_gain(spark):
    rows = corpus()
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string").selectExpr("*", "1D as score").repartition(3)
    got = lm.score_documents(df, block_bytes=4000).collect()
    assert len(got) == len(rows) + 1
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    tokens = {i: [*((t or "").encode().lower().split()), "END"] for i, t in rows}
    c = Counter(w for i, _ in [*rows, rows[0]] if not held[i] for w in tokens[i])
    n, v = sum(c.values()), len(c)
    gain = 0.0
    for r in got:
        want = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(tokens[r.doc_id]), sum(c[w] > 0 for w in tokens[r.doc_id]), n)
        assert abs(r.base_score - want) < 1e-6 and r.score < 0
        gain += (r.score - r.base_score) * r.held_out
    assert gain > 0
    assert all(abs(r.perplexity - 10 ** (-r.score / r.n_tokens)) < 1e-6 * r.perplexity for r in got)


def test_layout_changes_no_score(spark):
    rows = corpus()
    scores = []
    for parts, block, tokens in ((1, 16_000_000, 2_000_000), (7, 3000, 700)):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        scores.append({r.doc_id: r.score for r in lm.score_documents(df, block_bytes=block, range_tokens=tokens).collect()})
    assert all(abs(scores[1][d] - s) <= 1e-9 * abs(s) for d, s in scores[0].items())


def gibbs(rows, held, burn, sweeps, seed):
    """A hierarchical Pitman-Yor model in plain Python, one customer at a time: tables as lists of sizes."""
    r = random.Random(seed)
    tokens = {i: [*((t or "").lower().split()), "END"] for i, t in rows}
    train = [(u, w) for i, _ in rows if not held[i] for u, w in zip(["BEGIN", *tokens[i]], tokens[i], strict=False)]
    kinds = len({w for _, w in train})
    up, low = {}, {}
    count = {"n": 0, "k": 0}

    def add(tables, parent, d, s, open_tables):
        new = (s + d * open_tables) * parent
        x = r.random() * (new + sum(tables) - d * len(tables))
        if x < new:
            tables.append(1)
            return True
        x -= new
        for i, n in enumerate(tables):
            x -= n - d
            if x < 0 or i == len(tables) - 1:
                tables[i] += 1
                return False

    def drop(tables):
        x = r.random() * sum(tables)
        for i, n in enumerate(tables):
            x -= n
            if x < 0 or i == len(tables) - 1:
                tables[i] -= 1
                if not tables[i]:
                    tables.pop(i)
                    return True
                return False

    def p1(w):
        t = up.get(w, [])
        return (sum(t) - lm.D1 * len(t) + (lm.S1 + lm.D1 * count["k"]) / (kinds + 1)) / (lm.S1 + count["n"])

    def seat(u, w):
        here = low.setdefault(u, {})
        if add(here.setdefault(w, []), p1(w), lm.D2, lm.S2, sum(map(len, here.values()))):
            count["k"] += add(up.setdefault(w, []), 1 / (kinds + 1), lm.D1, lm.S1, count["k"])
            count["n"] += 1

    for u, w in train:
        seat(u, w)
    sums = {}
    for sweep in range(burn + sweeps):
        for u, w in train:
            if drop(low[u][w]):
                count["n"] -= 1
                count["k"] -= drop(up[w])
            seat(u, w)
        if sweep >= burn:
            for ws in tokens.values():
                for u, w in zip(["BEGIN", *ws], ws, strict=False):
                    here = low.get(u, {})
                    t, c = here.get(w, []), sum(map(sum, here.values()))
                    p = (sum(t) - lm.D2 * len(t) + (lm.S2 + lm.D2 * sum(map(len, here.values()))) * p1(w)) / (lm.S2 + c)
                    sums[u, w] = sums.get((u, w), 0.0) + p / sweeps
    seen = {}
    for ws in tokens.values():
        for pair in zip(["BEGIN", *ws], ws, strict=False):
            seen[pair] = seen.get(pair, 0) + 1
    return {i: sum(math.log10(sums[pair] / seen[pair]) for pair in zip(["BEGIN", *ws], ws, strict=False)) for i, ws in tokens.items()}


def test_against_plain_gibbs(spark):
    r = random.Random(2)
    words = [f"w{min(int(r.paretovariate(0.8)), 40)}" for _ in range(40)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 12)))) for i in range(120)]
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    want = gibbs(rows, held, 10, 20, 1)
    got = {x.doc_id: x.score for x in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), burn=6, sweeps=8).collect()}
    apart = [abs(got[i] - s) / len((dict(rows)[i] + " E").split()) for i, s in want.items()]
    assert max(apart) < 0.06 and sum(apart) / len(apart) < 0.015


def test_seen_beats_unseen(spark):
    rows = [(i, "a b c a b a") for i in range(1, 30)] + [(50, "c a")]
    vocabulary = ["a", "b", "c"]
    probe = [(2_000_000 + 10 * k, w) for k, w in enumerate([*vocabulary, "unseen", ""])]
    held = [(i, t) for j, (i0, t) in enumerate(probe) for i in [next(x for x in range(i0, i0 + 10_000) if zlib.crc32(str(x).encode()) % 10 == 0)]]
    got = {r.doc_id: r for r in lm.score_documents(spark.createDataFrame(rows + held, "doc_id long, text string")).collect()}
    assert all(got[i].held_out for i, _ in held) and all(got[i].score <= 0 for i, _ in held)
    assert got[held[0][0]].score > got[held[3][0]].score


def test_edges(spark):
    assert lm.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = lm.score_documents(spark.createDataFrame([(None, "x y"), (None, None)], "doc_id long, text string")).collect()
    assert [r.doc_id for r in got] == [None, None] and not any(r.held_out for r in got) and sorted(r.n_tokens for r in got) == [1, 3]


def test_seating():
    x = np.array([1e-3, 0.2, 1, 2.5, 7.9, 8, 123.4, 1e6, 1e12])
    assert np.allclose(lm.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-11)
    for d in (lm.D2, lm.D1):
        exact = lm.stirling_table(d, 1200)
        for c in (65, 150, 400, 1200):
            t = np.arange(1, c + 1)
            error = lm.log_stirling(np.full(c, c), t, d) - exact[c, 1 : c + 1]
            assert np.abs(error).max() < 0.02 and np.sort(np.abs(np.diff(error)))[-2] < 0.002, (d, c)
    a = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (lm.unpack_keys(lm.pack_keys(a)) == a).all() and len(lm.unpack(lm.pack(a[:0]), np.uint64)) == 0


def test_conditional_distribution():
    """Tables against all ways to seat four customers, and, for larger dishes, against exact weights."""
    c, rest, parent, d, s = 4, 3, 0.25, lm.D2, lm.S2
    weight = {}

    def ways(sizes, left, w):
        if not left:
            weight[len(sizes)] = weight.get(len(sizes), 0.0) + w
            return
        ways([*sizes, 1], left - 1, w * (s + d * (rest + len(sizes))) * parent)
        for i, n in enumerate(sizes):
            ways([*sizes[:i], n + 1, *sizes[i + 1 :]], left - 1, w * (n - d))

    ways([], c, 1.0)
    n = 20000
    key = lm.mixed(np.arange(n, dtype=np.uint64))
    t = lm.sampled(np.full(n, c), np.full(n, float(rest)), np.full(n, parent), d, s, key, 6)
    for tables, w in weight.items():
        assert abs((t == tables).mean() - w / sum(weight.values())) < 0.012
    for c, rest, parent, d in ((300, 500.0, 0.05, lm.D2), (300, 40.0, 0.001, lm.D2), (350, 5000.0, 0.2, lm.D2), (200, 900.0, 0.001, lm.D1)):
        x = np.arange(1, c + 1)
        logs = lm.stirling_table(d, 400)[c, 1 : c + 1] + x * math.log(d * parent) + np.array([math.lgamma(s / d + rest + v) for v in x])
        p = np.exp(logs - logs.max())
        p /= p.sum()
        mean, spread = (p * x).sum(), math.sqrt((p * x * x).sum() - (p * x).sum() ** 2)
        t = lm.sampled(np.full(n, c), np.full(n, rest), np.full(n, parent), d, s, key, 12)
        assert abs(t.mean() - mean) < 0.06 * spread + 0.01 and abs(t.std() - spread) < 0.06 * spread + 0.01, (c, rest, parent, t.mean(), mean, t.std(), spread)
