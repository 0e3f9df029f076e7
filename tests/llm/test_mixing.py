import hashlib
import re
from collections import defaultdict

from citeloom.llm import mixing
from tests.oracle import compare


def pour(budget, children):
    """Water-filling by rounds: {name: (capacity, weight)} -> {name: given}."""
    given, open_ = dict.fromkeys(children, 0.0), dict(children)
    while open_:
        w = sum(x[1] for x in open_.values())
        full = {k: c for k, (c, x) in open_.items() if x == 0 or c <= budget * x / w + 1e-9}
        if not full:
            return given | {k: float(int(budget * x / w + 1e-6)) for k, (_, x) in open_.items()}
        for k, c in full.items():
            given[k] = c if open_[k][1] else 0.0
            budget -= given[k]
            del open_[k]
    return given


def brute(rows, share, epochs, weights, seed=17):
    def words(t):
        return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))

    leaves = defaultdict(list)
    for d, t, lang, source in rows:
        if words(t):
            m = re.search(r"([0-9]{1,9})$", source or "")
            leaves[f"d{(int(m[1]) if m else 0) % 4}", lang or "", source or ""].append((int(hashlib.md5(f"{seed}:{d}".encode()).hexdigest()[:15], 16), d, words(t)))
    tokens = {k: sum(x[2] for x in v) for k, v in leaves.items()}
    budgets = {(): min(float(int(sum(tokens.values()) * share)), float(sum(tokens.values()) * epochs))}
    for depth in range(3):
        new = {}
        for node, b in budgets.items():
            kids = defaultdict(float)
            for k, n in tokens.items():
                if k[:depth] == node:
                    kids[k[depth]] += n * epochs
            level = mixing.LEVELS[depth]
            given = pour(b, {k: (c if weights.get(level, {}).get(k, 1) else 0.0, weights.get(level, {}).get(k, 1)) for k, c in kids.items()})
            new |= {(*node, k): g for k, g in given.items()}
        budgets = new
    out = {}
    for leaf, items in leaves.items():
        whole, rest = divmod(int(budgets[leaf]), tokens[leaf])
        upto = 0
        for _, d, n in sorted(items):
            upto += n
            if whole + (upto <= rest):
                out[d] = whole + (upto <= rest)
    return out


def test_against_brute_force(spark):
    rows = [(i, "w " * (1 + i * 7 % 23), ["en", "en", "en", "de", "fr"][i % 5], f"src{i % 7 if i % 3 else 0}") for i in range(400)]
    rows += [(1000, None, "en", "src1"), (1001, " ", "en", "src1"), (1002, "a b c", None, None), (1003, "x y", "en", "nodigits")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "'x' as domain", "5 as copies")
    for share, epochs, weights in ((0.5, 2, mixing.WEIGHTS), (0.9, 1, mixing.WEIGHTS), (1.5, 3, {}), (0.3, 1, {"lang": {"de": 0, "fr": 9}}), (9.0, 2, {})):
        got = mixing.mix_sources(df, share, epochs, weights=weights).collect()
        assert {r.doc_id: r.copies for r in got} == brute(rows, share, epochs, weights)
        assert len(got) == len({r.doc_id for r in got})
    assert mixing.mix_sources(df.limit(0)).count() == 0
    twice = mixing.mix_sources(df.union(df), 9.0, 1).collect()
    assert len(twice) == 2 * 402


def test_oracle(spark):
    assert compare(spark, mixing.op4_mixing, mixing.SQL, "/root/testdata/sf0.001") > 0
    assert compare(spark, mixing.op4_mixing, mixing.SQL, "/root/testdata/sf0.01") > 0
