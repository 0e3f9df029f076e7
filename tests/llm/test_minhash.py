import random
from collections import Counter

import numpy as np

from citeloom.llm import components, minhash


def brute(rows, k, part, whole):
    def words(t):
        return [] if t is None else t.encode().lower().split()

    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and whole * len(sets[i] & sets[j]) >= part * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)]


def corpus(seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[r.choice(vocabulary) for _ in range(r.choice([4, 20, 60, 150]))] for _ in range(60)]
    rows, i = [], 0
    for b in base:
        rows.append((i, " ".join(b)))
        i += 1
    for b in base[:25]:
        for _ in range(r.choice([1, 2, 5, 25])):
            c = list(b)
            for _ in range(r.choice([0, 1, 1, 2, 3, 4])):
                c[r.randrange(len(c))] = r.choice(vocabulary)
            rows.append((i, "  ".join(c).upper() if r.random() < 0.3 else " ".join(c)))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \n "), (i + 3, "Two Words"), (i + 4, "two\twords"), (i + 5, "x"), (i + 6, "É"), (i + 7, "é")]
    r.shuffle(rows)
    return [(100 + n, t) for n, (_, t) in enumerate(rows)]


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_shingles", "true as kept")
    for k, part, whole in ((3, 85, 100), (5, 80, 100)):
        out = minhash.near_duplicates(df, k, part, whole).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == sorted(brute(rows, k, part, whole))
        assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_unlike_texts_under_one_id(spark):
    rows = [(d % 90 + (1 << 60), t) for d, t in corpus(3)]
    out = minhash.near_duplicates(spark.createDataFrame([*rows, (None, "a b c")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out if r.doc_id is not None) == sorted(brute(rows, 3, 85, 100))
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, a), (5, b), (7, a + " x"), (9, b + " y")]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in out} == {(5, 5), (7, 5), (9, 5)}


def test_crowded_group(spark):
    """A group of many texts that all share buckets, linked and not, over blocks of its own."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(1700):
        c = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3, 4])):
            c[r.randrange(60)] = f"v{r.randrange(10**6)}"
        rows.append((i, " ".join(c)))
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), star_rounds=1).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == sorted(brute_large(rows))


def brute_large(rows):
    """brute() by counting common shingles through an index."""
    sets = [frozenset(zip(w, w[1:], w[2:], strict=False)) for w in (t.split() for _, t in rows)]
    where, label = {}, list(range(len(rows)))
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        near = Counter(j for x in s for j in where[x] if j < i)
        for j, n in near.items():
            if label[i] != label[j] and 100 * n >= 85 * (len(s) + len(sets[j]) - n):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if v == old else v for v in label]
    return [(d, len(sets[i]), rows[label[i]][0]) for i, (d, _) in enumerate(rows)]


def test_edges(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "a b c d"), (3, None)]
    out = sorted(map(tuple, minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert out == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (None, 2, None, True)], key=str)


def test_estimate_and_bands(spark):
    for t in (0.8, 0.85, 0.95):
        rows, bands = minhash.choose_bands(t)
        assert rows * bands <= 150 and (1 - t**rows) ** bands < 1e-7
    r = np.random.default_rng(2)
    pool = r.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:2500])
    m = [minhash.packed_low_bits(minhash.minima(s, 140)).tolist() for s in (a, b)]
    df = spark.createDataFrame([tuple(m)], "a array<long>, b array<long>")
    got = df.select(minhash.estimated_similarity(df.a, df.b, 140), minhash.estimated_similarity(df.a, df.a, 140)).first()
    assert abs(got[0] - 0.6) < 0.2 and got[1] == 1.0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (200, 300), (300, 200), (None, 5)] + [(500, i) for i in range(501, 560)]
    for most in (10, 50, 10**6):
        got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), links_per_task=most).collect()}
        assert got == {i: 0 for i in range(41)} | {200: 200, 300: 200} | {i: 500 for i in range(500, 560)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
