import math
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from rallyspark.llm import sharding


def test_shards_and_growth(spark, docs, wide, empty):
    out = sharding.shard_documents(wide, 40).collect()
    assert len(out) == docs.count()
    texts = defaultdict(set)
    for r in docs.collect():
        b = (r.text or "").encode()
        texts[r.doc_id].add((len(b) + 16, zlib.crc32(b)))
    slots = defaultdict(list)
    for r in out:
        assert (r.size, r.text_crc32) in texts[r.doc_id] and r.grown_shard in (r.shard, 40) and 0 <= r.shard < 40
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(empty).count() == 0


def test_weights_move_only_their_subtree(spark):
    keys = spark.range(20000).select(F.col("id").alias("k"))
    tree = sharding.balanced_tree(40)
    changed = [[list(r) for r in region] for region in tree]
    changed[1][2][3] = 3.0
    a, b = sharding.place(keys, "k", tree), sharding.place(keys, "k", changed, "new_")
    moved = a.join(b, "k").where("shard <> new_shard")
    grown = 1 * 20 + 2 * 5 + 3
    assert moved.where(f"new_shard <> {grown} and region <> 1 and new_region <> 1").count() == 0
    counts = [r["count"] for r in a.groupBy("shard").count().collect()]
    assert len(counts) == 40 and 350 < min(counts) and max(counts) < 660
    new = {r.new_shard: r["count"] for r in b.groupBy("new_shard").count().collect()}
    assert 1200 < new[grown] < 1750  # three parts of 42


def test_last_shard_takes_its_share(spark):
    keys = spark.range(41000).select(F.col("id").alias("k"))
    a, b = sharding.place(keys, "k", sharding.balanced_tree(40)), sharding.place(keys, "k", sharding.balanced_tree(41), "g_")
    j = a.join(b, "k")
    assert j.where("shard <> g_shard and g_shard <> 40").count() == 0
    assert 850 < j.where("g_shard = 40").count() < 1150


def test_any_number_of_shards_grows_into_the_new_one_only(spark):
    keys = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    for shards in (1, 7, 30, 39, 40):
        out = sharding.shard_documents(keys, shards)
        assert out.where(f"grown_shard <> shard and grown_shard <> {shards}").count() == 0, shards
        assert abs(out.where(f"grown_shard = {shards}").count() - 4000 / (shards + 1)) < 5 * (4000 / (shards + 1)) ** 0.5


def plain_place(key, tree):
    """The shard of a key, by a loop over the tree's levels with the session's own hash as a table of draws."""
    n, regions = 0, []
    for r, racks in enumerate(tree):
        best = []
        for k, weights in enumerate(racks):
            draws = [(-math.log(key[(r, k, i)]) / w, n + i) for i, w in enumerate(weights) if w > 0]
            n += len(weights)
            if draws:
                best.append(min(draws))
        if best:
            regions.append(min(best))
    return min(regions)[1]


def test_one_tree_for_each_number_of_shards(spark):
    keys = spark.range(3000).select(F.col("id").alias("doc_id"))
    placed, columns = keys, []
    for n in range(1, 62):
        placed = sharding.place(placed, "doc_id", sharding.balanced_tree(n), f"n{n}_").drop(f"n{n}_region", f"n{n}_rack")
        columns.append(f"n{n}_shard")
    for row in placed.select(columns).collect():
        for n, (a, b) in enumerate(zip(row, row[1:]), 1):
            assert 0 <= a < n and b in (a, n)
    docs = keys.withColumn("text", F.lit("t"))
    for n in (19, 20, 39):
        grown = {r.doc_id: r.grown_shard for r in sharding.shard_documents(docs, n).collect()}
        assert grown == {r.doc_id: r.shard for r in sharding.shard_documents(docs, n + 1).collect()}


def test_place_by_a_scalar_tree(spark):
    tree = [[[1.0, 2.0], [0.5]], [[3.0, 0.0, 1.0]]]
    u = lambda r, k, i: (F.shiftrightunsigned(F.xxhash64("id", F.lit(r), F.lit(k), F.lit(i)), 11) + 0.5) / float(1 << 53)
    leaves = [(r, k, i) for r, racks in enumerate(tree) for k, weights in enumerate(racks) for i in range(len(weights))]
    rows = sharding.place(spark.range(500), "id", tree).select("shard", *[u(*leaf).alias(f"u{n}") for n, leaf in enumerate(leaves)]).collect()
    for row in rows:
        assert row.shard == plain_place(dict(zip(leaves, row[1:], strict=True)), tree)
