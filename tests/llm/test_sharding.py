import zlib
from collections import Counter, defaultdict

from citeloom.llm import sharding


def check(rows, out, n=8):
    assert sorted((r.doc_id for r in out), key=str) == sorted((i for i, _ in rows), key=str)
    count = Counter(r.shard for r in out)
    sizes = [count.get(s, 0) for s in range(n)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1 and set(count) <= set(range(n))
    for s in range(n):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want
    assert {r.law for r in out} <= {"rows"} and all(r.grown_shard is None for r in out)


def test_even_and_together(spark):
    rows = [(i, f"text {i}") for i in range(700)]
    rows += [(1000 + 10 * g + k, f"copy of {g}é") for g in range(30) for k in range(2 + g % 5)]
    rows += [(3000 + i, "hot") for i in range(400)] + [(5000, None), (5001, None), (5002, ""), (5003, ""), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as shard", "'a' as law")
    out = sharding.balanced_shards(df).collect()
    check(rows, out)
    of, shards = dict(rows), defaultdict(set)
    for r in out:
        if of[r.doc_id] is not None:
            shards[of[r.doc_id]].add(r.shard)
    assert all(len(v) == 1 for t, v in shards.items() if t.startswith("copy"))
    assert len(shards["hot"]) < 8 or len(rows) / 8 < 60


def test_small_tables_and_repeats(spark):
    for rows in ([], [(1, "a")], [(1, "a")] * 5, [(i, "same") for i in range(50)], [(i, None) for i in range(9)]):
        check(rows, sharding.balanced_shards(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_no_group_is_cut_while_a_shard_has_room(spark):
    # Unlike sizes of one size class and shards nearly full of groups: whole buckets don't fit, single groups do.
    groups = [(f"group {g}", 2 + g % 37) for g in range(400)]
    rows = [t for t, n in groups for _ in range(n)]
    rows = [(i, t) for i, t in enumerate(rows)] + [(100_000 + i, f"alone {i}") for i in range(len(rows) * 3 // 7)]
    out = sharding.balanced_shards(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check(rows, out)
    of, shards = dict(rows), defaultdict(set)
    for r in out:
        shards[of[r.doc_id]].add(r.shard)
    assert all(len(v) == 1 for v in shards.values())


def test_cut_links_and_pieces_that_follow_each_other(spark):
    rows = [(i, "hot") for i in range(900)] + [(1000 + i, f"alone {i}") for i in range(700)] + [(3000 + i, f"pair {i // 2}") for i in range(200)] + [(9000, "long " * 100_000), (9001, "long " * 100_000), (9002, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = sharding.balanced_shards(df)
    found = out.collect()
    check(rows, found)
    links = sharding.cut_links(out, df).first()
    of, inside, whole = dict(rows), Counter(), Counter(t for _, t in rows if t is not None)
    for r in found:
        if of[r.doc_id] is not None:
            inside[of[r.doc_id], r.shard] += 1
    pairs = lambda n: n * (n - 1) // 2
    assert links.links == sum(map(pairs, whole.values())) and links.cut == links.links - sum(map(pairs, inside.values()))
    # By hash alone seven of eight links are cut.
    start = df.selectExpr("doc_id", "pmod(xxhash64(doc_id), 8) as shard")
    assert links.cut < 0.95 * sharding.cut_links(start, df).first().cut
    assert all(len({r.shard for r in found if of[r.doc_id] == t}) == 1 for t in ("long " * 100_000, "pair 3", "pair 77"))
