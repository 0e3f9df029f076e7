import numpy as np
import pytest

from citeloom.llm import neighbours


def brute(rows, threshold):
    units = {i: neighbours.unit(v) for i, v in rows}
    ids = [i for i, _ in rows if units[i] is not None]
    x = np.stack([units[i] for i in ids]) if ids else np.zeros((0, 1))
    s = x @ x.T >= threshold
    np.fill_diagonal(s, False)
    comp = dict(zip(ids, ids, strict=True))
    changed = True
    while changed:
        changed = False
        for a in range(len(ids)):
            for b in np.flatnonzero(s[a]):
                m = min(comp[ids[a]], comp[ids[b]])
                if comp[ids[a]] != m or comp[ids[b]] != m:
                    comp[ids[a]] = comp[ids[b]] = m
                    changed = True
    links = {i: int(n) for i, n in zip(ids, s.sum(1), strict=True)}
    return {i: (links.get(i, 0), comp.get(i, i)) for i, _ in rows}


def brute_rows(rows, threshold):
    """(key, n_links, component) of rows that may repeat keys: brute force by place, components called by their least key."""
    got = brute(list(enumerate(v for _, v in rows)), threshold)
    least = {}
    for i, (k, _) in enumerate(rows):
        c = got[i][1]
        least[c] = min(least.get(c, k), k)
    return sorted((k, got[i][0], least[got[i][1]]) for i, (k, _) in enumerate(rows))


def test_against_brute_force(spark):
    r = np.random.default_rng(5)
    x = r.standard_normal((1500, 16))
    centre = r.standard_normal(16)
    x[100:400] = centre + 0.12 * r.standard_normal((300, 16))  # one crowded spot
    for i in range(500, 700, 2):
        x[i + 1] = x[i] * 2 + 0.1 * r.standard_normal(16)
    x[800:830] = x[7]
    rows = [(i, [float(e) for e in v]) for i, v in enumerate(x)]
    rows += [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [float("inf")] + [1.0] * 15), (5004, [None] + [1.0] * 15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'l' as label", "true as kept")
    got = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.near_duplicate_vectors(df).collect()}
    want = brute(rows, 0.95)
    assert len(got) == len(rows)
    missed = [i for i in want if got[i] != want[i]]
    assert len(missed) <= len(want) // 200, missed[:9]


def test_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert neighbours.near_duplicate_vectors(spark.createDataFrame([], schema)).count() == 0
    got = sorted(map(tuple, neighbours.near_duplicate_vectors(spark.createDataFrame([(1, None), (2, [0.0, 0.0])], schema)).collect()))
    assert got == [(1, 0, 1, True), (2, 0, 2, True)]
    rows = [(3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [2.0, 0.0]), (5, [0.0, 1.0]), (None, [1.0, 0.0])]
    got = sorted(map(tuple, neighbours.near_duplicate_vectors(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(3, 2, 3, True), (3, 2, 3, True), (4, 2, 3, False), (5, 0, 5, True), (None, 0, None, True)], key=str)


def test_groups_that_fill_each_others_lists(spark):
    r = np.random.default_rng(11)
    away = r.standard_normal((2, 32))
    one = away[0] / np.linalg.norm(away[0])
    two = away[1] - (away[1] @ one) * one
    two = 0.96 * one + np.sqrt(1 - 0.96**2) * two / np.linalg.norm(two)
    x = np.concatenate([c + 0.0005 * r.standard_normal((40, 32)) for c in (one, two)] + [r.standard_normal((300, 32))])
    rows = [(i, [float(e) for e in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {q.vec_id: (q.n_links, q.component_id) for q in neighbours.near_duplicate_vectors(df).collect()}
    assert got == brute(rows, 0.95)
    assert all(got[i] == (79, 0) for i in range(80))


def test_unlike_vectors_under_one_key(spark):
    r = np.random.default_rng(6)
    x = r.standard_normal((400, 24))
    for i in range(0, 200, 4):
        x[i + 1], x[i + 2] = x[i] + 0.05 * r.standard_normal(24), x[i]
    rows = [(int(r.integers(0, 150)), [float(e) for e in v]) for v in x]
    rows.append(rows[0])
    got = neighbours.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((q.vec_id, q.n_links, q.component_id) for q in got) == brute_rows(rows, 0.95)


def test_pairs_at_the_threshold():
    r = np.random.default_rng(3)
    x = r.standard_normal((300, 40))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t = float(neighbours.linked(x[:1], x[1:2])[0])
    for m in (2, 7, 64, 300):
        assert neighbours.links_of(x[:m], x[:m], t)[0, 1] and neighbours.links_of(x[:m], x[:m], t)[1, 0]


def test_audit_sees_lost_groups_beside_a_large_one(spark, monkeypatch):
    r = np.random.default_rng(4)
    centres = r.standard_normal((21, 32))
    x = np.concatenate([c + 0.001 * r.standard_normal((n, 32)) for c, n in zip(centres, [600] + [2] * 20, strict=True)])
    nodes = spark.createDataFrame([(i, neighbours.unit(v).tobytes(), 1, True) for i, v in enumerate(x)], "id long, vec binary, weight long, asked boolean")
    links = nodes.selectExpr("id", "if(id < 600, 599L, 1L) as links")
    large = nodes.filter("id < 600").selectExpr("id", "0L as component")
    assert neighbours.audit(nodes, large, links.filter("id < 600"), 0.95, block=100) < 0.9
    groups = nodes.selectExpr("id", "if(id < 600, 0L, id - id % 2) as component")
    assert neighbours.audit(nodes, groups, links, 0.95) == 1.0
    monkeypatch.setattr(neighbours, "audit", lambda *a: 0.5)
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)], "vec_id long, embedding array<double>")
    with pytest.raises(RuntimeError):
        neighbours.near_duplicate_vectors(df, turns=0)
