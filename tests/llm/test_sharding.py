"""Balanced label propagation: the law of sizes, slots, links kept together, hot and shared hubs."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from waymark.llm import registry, sharding

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, shard int, slot long, row string, kind string, part int, hub string"


def held(rows, shards=24):
    """Counts at most one apart, slots gapless in every shard."""
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    counts = [len(slots[k]) for k in range(shards)]
    assert set(slots) <= set(range(shards)) and max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return counts


def table(spark, texts):
    return spark.createDataFrame([(k, t, 7, 7, "r", "k", 7, "h") for k, t in enumerate(texts)], SCHEMA)


def test_query_keeps_copies_together(spark):
    rows = registry.op13_sharding(spark, DATA).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        data = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "rows", None)
    counts = held(rows)
    where = defaultdict(list)
    for r in rows:
        where[docs[r.doc_id]].append(r.shard)
    # every group that fits a shard lies in one
    assert all(len(set(s)) == 1 for s in where.values() if len(s) <= min(counts))


def test_nulls_repeats_empty_and_clashing_columns(spark):
    texts = [None, "", "", None, "ä" * 5, "x" * 300_000] + ["same"] * 5 + [f"t{k}" for k in range(20)]
    docs = table(spark, texts).unionByName(table(spark, ["same", "t1"]).withColumn("doc_id", F.lit(None).cast("long")))
    rows = sharding.shard_documents(docs, shards=3).collect()
    held(rows, 3)
    assert len(rows) == len(texts) + 2 and sum(r.doc_id is None for r in rows) == 2
    assert {r.size for r in rows if r.doc_id in (0, 1, 2, 3)} == {8} and len({r.shard for r in rows if r.size == 8}) == 1
    assert {r.size for r in rows if r.doc_id == 4} == {18} and {r.size for r in rows if r.doc_id == 5} == {300_008}
    assert len({r.shard for r in rows if r.text_crc32 == zlib.crc32(b"same")}) == 1
    none = sharding.shard_documents(docs.limit(0))
    assert none.collect() == [] and none.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "text_hash"]
    held(sharding.shard_documents(table(spark, ["a", "b", "a"]), shards=5).collect(), 5)


@pytest.mark.parametrize(("hot", "others"), [(400, 800), (1200, 0), (500, 700)])
def test_hot_group_takes_few_shards(spark, hot, others):
    pick = random.Random(5)
    texts = ["hot"] * hot + [f"pair {pick.randrange(max(1, others // 3))}" for _ in range(others)]
    pick.shuffle(texts)
    rows = sharding.shard_documents(table(spark, texts), shards=12).collect()
    held(rows, 12)
    where = defaultdict(Counter)
    for r in rows:
        where[texts[r.doc_id]][r.shard] += 1
    need = -(-hot * 12 // len(texts))
    assert sum(n for _, n in where["hot"].most_common(need)) >= 0.85 * hot
    links = {t: sum(c.values()) * (sum(c.values()) - 1) // 2 for t, c in where.items() if t != "hot"}
    cut = sum(links[t] - sum(n * (n - 1) // 2 for n in where[t].values()) for t in links)
    assert cut <= 0.05 * sum(links.values())


def test_rows_with_several_hubs_follow_their_neighbours(spark):
    """Two-dimensional blocks: 12 clusters of 20 rows linked by hubs at random, a few hubs between clusters."""
    pick = random.Random(3)
    members = []
    for c in range(12):
        for h in range(25):
            members += [(20 * c + r, 1000 * c + h) for r in pick.sample(range(20), 4)]
    for h in range(30):
        members += [(r, 10**6 + h) for r in pick.sample(range(240), 2)]
    hubs = defaultdict(list)
    for r, h in members:
        hubs[h].append(r)
    links = [(a, b) for rows in hubs.values() for a in rows for b in rows if a < b]
    labels = sharding.propagate(spark.createDataFrame(members, "row long, hub long"), [60] * 4)
    at = {r.row: r.shard for r in labels.collect()}
    first = {k: k % 4 for k in at}
    cut = lambda where: sum(where[a] != where[b] for a, b in links) / len(links)
    assert cut(at) < 0.5 * cut(first)


def test_quotas_never_exceed_room_and_swaps():
    may = sharding._quotas({(0, 1): 10, (1, 0): 4, (2, 1): 6}, [0, 6, -3])
    assert may == {(0, 1): 4 + 3, (1, 0): 4, (2, 1): 3}
    assert sharding._relief([30, 5, 10], [15, 15, 15]) == {(0, 1): 10, (0, 2): 5}


def test_plan_is_native(spark):
    plan = sharding.shard_documents(spark.read.parquet(f"{DATA}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "ExistingRDD[python", "Cartesian", "NestedLoop"))
