"""Operator 8: balanced shards by label propagation.

Rows start in a shard drawn by hash. Linked rows (equal texts) are a piece, which
moves as one; a group larger than a shard is first split into salted pieces. In
every round votes are counted anew, from the shards in which the neighbours of each
piece are now: its own members where they started, and the pieces of its group where
they have moved to. Each piece asks for the shard with most votes that has room,
under per-shard capacity quotas. A size class that asks for more than a shard has
left sends so many of its hash buckets as would fill the room; each bucket that fits
is taken, the largest pieces first. Refused pieces vote again, until none fits
anywhere. Rows without links, and members of pieces that found no room, then fill
the shards to sizes that differ by one at most; ``cut_links`` tells what of the
links the shards cut. Only eight loads and a table of bounded size (shards times 4096
buckets) leave the executors; ranks come from per-bucket windows plus offsets, so no
window spans the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.llm.common import checkpointed, table

#: Quota buckets: 64 size classes, the largest first, of 64 hash values each that ask in a round.
HASHES = 64


def _settle(groups: DataFrame, capacity: list[int]) -> DataFrame:
    """(h1, h2, piece, home) for the pieces of groups that found a shard; no other piece fits into what is left."""
    shards, spark = len(capacity), groups.sparkSession
    free, left, settled = list(capacity), groups, []
    turn = 0
    split = groups.groupBy("h1", "h2").agg(F.count("*").alias("pieces")).filter("pieces > 1").select("h1", "h2")
    followed = checkpointed(split)  # groups with more than one piece: larger than a shard, so fewer than shards
    moving = not followed.isEmpty()
    while True:
        if moving and turn:
            # Neighbours that have moved vote where they are now.
            moved = settled[-1].join(F.broadcast(followed), ["h1", "h2"]).groupBy("h1", "h2").agg(F.array(*[F.sum(F.when(F.col("home") == s, F.col("n")).otherwise(0)) for s in range(shards)]).alias("more"))
            left = left.join(moved, ["h1", "h2"], "left").withColumn("votes", F.when(F.col("more").isNull(), F.col("votes")).otherwise(F.zip_with("votes", "more", lambda a, b: a + b))).drop("more")
        room = F.array(*[F.lit(int(x)) for x in free])
        # The fullest vote among the shards that can take the whole piece; ties by hash.
        options = F.transform(
            F.sequence(F.lit(0), F.lit(shards - 1)),
            lambda s: F.struct(F.when(F.get(room, s) >= F.col("n"), F.get("votes", s)).alias("v"), F.pmod(F.xxhash64("h1", s), F.lit(1 << 20)).alias("t"), s.alias("s")),
        )
        best = F.array_max(F.filter(options, lambda o: o["v"].isNotNull()))["s"]
        # Room only shrinks: what fits nowhere now never will.
        asked = checkpointed(left.withColumn("home", best).filter("home is not null").withColumn("class", (63 - F.floor(F.log2("n"))).cast("int")))
        wants = asked.groupBy("home", "class").agg(F.sum("n").alias("m")).collect()  # shards * 64 at most
        if not wants:
            break
        widths = spark.createDataFrame([(r["home"], r["class"], HASHES * max(1, -(-r["m"] // free[r["home"]]))) for r in wants], "home int, class int, width long")
        value = F.pmod(F.xxhash64(F.lit(turn), "h2", "piece"), F.col("width"))
        asked = asked.join(F.broadcast(widths), ["home", "class"]).withColumn("bucket", F.when(value < HASHES, F.col("class") * HASHES + value)).drop("width", "class")
        load = asked.filter("bucket is not null").groupBy("home", "bucket").agg(F.sum("n").alias("m")).collect()  # shards * 4096 at most
        fits = []
        for r in sorted(load, key=lambda r: (r["home"], r["bucket"])):
            if r["m"] <= free[r["home"]]:
                free[r["home"]] -= r["m"]
                fits.append((r["home"], r["bucket"], True))
        now = asked.join(F.broadcast(spark.createDataFrame(fits, "home int, bucket long, ok boolean")), ["home", "bucket"], "left")
        now = checkpointed(now)
        settled.append(now.filter("ok").select("h1", "h2", "piece", "home", "n"))
        left = now.filter("ok is null").drop("home", "bucket", "ok")
        turn += 1
    out = settled[0] if settled else groups.select("h1", "h2", "piece", F.lit(0).alias("home"), "n").limit(0)
    for x in settled[1:]:
        out = out.unionByName(x)
    return out.drop("n")


def cut_links(placed: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", shard: str = "shard") -> DataFrame:
    """One row (links, cut): pairs of rows with equal texts, and those whose rows lie in unlike shards.

    placed: (key, shard) of each row of docs; keys are unique. Pairs are counted from
    group sizes, never made.
    """
    of = docs.filter(F.col(text).isNotNull()).select(key, F.xxhash64(F.lit(1), text).alias("h1"), F.xxhash64(F.lit(2), text).alias("h2"))
    inside = of.join(placed.select(key, shard), key).groupBy("h1", "h2", shard).agg(F.count("*").alias("n"))
    pairs = lambda n: n * (n - 1) / 2
    each = inside.groupBy("h1", "h2").agg(pairs(F.sum("n")).alias("links"), F.sum(pairs(F.col("n"))).alias("kept"))
    return each.agg(F.coalesce(F.sum("links"), F.lit(0)).cast("long").alias("links"), F.coalesce(F.sum(F.col("links") - F.col("kept")), F.lit(0)).cast("long").alias("cut"))


def balanced_shards(docs: DataFrame, n_shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law ('rows'), shard, slot, grown_shard (null: another shard count means a new run).

    size is the text's UTF-8 bytes plus 1 (null: 1; its crc32 is that of nothing).
    Null texts are linked with nothing; empty texts are equal texts. Counts of
    rows per shard differ by one at most, slots are gapless from 0 in each shard.
    Repeated rows are rows of their own. An empty table gives an empty result.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    base = checkpointed(
        docs.select(
            F.col(key),
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.when(F.col(text).isNotNull(), F.xxhash64(F.lit(1), text)).alias("h1"),
            F.when(F.col(text).isNotNull(), F.xxhash64(F.lit(2), text)).alias("h2"),
        )
    )
    total = base.count()
    even, extra = divmod(total, n_shards)
    sizes = [even + (s < extra) for s in range(n_shards)]
    limit = max(1, even * 9 // 10)
    groups = base.filter("h1 is not null").groupBy("h1", "h2").agg(F.count("*").alias("of")).filter("of > 1")
    rows = base.join(groups, ["h1", "h2"], "left").withColumn(
        "piece", F.when(F.col("of").isNotNull(), F.when(F.col("of") <= even, F.lit(0)).otherwise(F.pmod(F.xxhash64(F.lit("piece"), key), F.ceil(F.col("of") / limit).cast("long"))))
    )
    rows = checkpointed(rows.drop("of"))
    start = F.pmod(F.xxhash64(F.lit("start"), key), F.lit(n_shards))
    pieces = (
        rows.filter("piece is not null")
        .withColumn("start", start)
        .groupBy("h1", "h2", "piece")
        .agg(F.count("*").alias("n"), F.array(*[F.count_if(F.col("start") == s) for s in range(n_shards)]).alias("votes"))
    )
    homes = _settle(checkpointed(pieces), sizes)
    buckets = max(1024, total // 50_000)
    placed = rows.join(homes, ["h1", "h2", "piece"], "left").select(
        key, "size", "text_crc32", F.coalesce(F.col("home").cast("int"), F.lit(-1)).alias("home"), F.pmod(F.xxhash64(F.lit("slot"), key), F.lit(buckets)).alias("bucket")
    )
    placed = checkpointed(placed)
    counts = placed.groupBy("home", "bucket").agg(F.count("*").alias("m"))
    offsets = counts.withColumn("before", F.sum("m").over(W.partitionBy("home").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))).drop("m")
    load = {r["home"]: r["n"] for r in placed.groupBy("home").agg(F.count("*").alias("n")).collect()}
    inside = F.row_number().over(W.partitionBy("home", "bucket").orderBy(key)) - 1
    # (shards + 1) * buckets rows, one for at least 50,000 rows beyond the first 1024 buckets: a join, and Spark may broadcast it.
    ranked = placed.withColumn("inside", inside).join(offsets, ["home", "bucket"]).withColumn("rank", F.coalesce("before", F.lit(0)) + F.col("inside"))
    upto, shard, slot = 0, F.lit(None).cast("int"), F.lit(None).cast("long")
    for s in reversed(range(n_shards)):
        upto = sum(sizes[i] - load.get(i, 0) for i in range(s))
        here = F.col("rank") >= upto
        shard = F.when(here & shard.isNull(), F.lit(s)).otherwise(shard)
        slot = F.when(here & slot.isNull(), F.col("rank") - upto + load.get(s, 0)).otherwise(slot)
    alone = F.col("home") < 0
    return ranked.select(
        key,
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.when(alone, shard).otherwise(F.col("home")).cast("int").alias("shard"),
        F.when(alone, slot).otherwise(F.col("rank")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(table(spark, sf_dir, "documents"))
