"""Sharding by balanced label propagation (after Ugander and Backstrom, WSDM 2013).

A document's label is its shard.  Documents are linked through the hubs that they
share: here a hub is a text and its documents are the copies, but any table of
rows and hubs (urls, sites, the two ends of an edge) does.  In each round every
hub counts its documents by shard, every document sums the counts of its hubs and
wants to go where most of its neighbours are.  Quotas of each pair of shards let
as many go as come back the other way, and as the room of the target allows; shards
above their quota lose small hubs as a whole to shards with room.
Documents without neighbours carry no cut edge, so they are placed last and even
out the sizes exactly: the counts of two shards differ by one at most.

A hub with more documents than a shard has room for wants as many shards as it
needs.  Hubs with a thousandth of all memberships, of which there are a thousand
at most, meet their documents by a broadcast, so no task gets all of them.  What
comes to the driver are counts by pair of shards.

Defined cases: a null text has no bytes and is a copy of an empty one; repeated
rows and null ids are documents of their own; ties between shards are broken by a
hash of the hub, so that no shard is preferred; fewer documents than shards leave
shards empty; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SHARDS = 24
#: Most rounds; they end when nothing moves any more.
ROUNDS = 12
#: A hub with this share (one in so many) of all memberships is broadcast.
HEAVY = 1000
#: How far above its quota a shard may be filled by the votes of the first rounds.
SLACK = (1.0, 0.5, 0.25, 0.1)
#: Priorities among equally large hubs.
BUCKETS = 64


def _at(values: list, index: Column) -> Column:
    """One of few numbers known to the driver, by an index from 0."""
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def _with_hubs(members: DataFrame, sizes: DataFrame, share: float, columns: list[str]) -> DataFrame:
    """members joined with a table by hub; its hubs of at least ``share`` memberships are few and broadcast."""
    heavy, light = sizes.where(F.col("total") >= share), sizes.where(F.col("total") < share)
    by_broadcast = members.join(F.broadcast(heavy), "hub")
    by_shuffle = members.join(F.broadcast(heavy.select("hub")), "hub", "left_anti").join(light, "hub")
    return by_broadcast.select(columns).unionByName(by_shuffle.select(columns))


def _linked(members: DataFrame, share: float, shards: int) -> DataFrame:
    """row, shard, hubs (hub, total) of the rows that share a hub, dealt out by a hash."""
    sizes = cut(members.groupBy("hub").agg(F.count("*").alias("total")).where("total > 1"))
    known = _with_hubs(members, sizes, share, ["row", "hub", "total"])
    rows = known.groupBy("row").agg(F.collect_list(F.struct("hub", "total")).alias("hubs"))
    return cut(rows.select("row", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), "hubs"))


def _proposals(state: DataFrame, share: float, quota: int, full: list[bool], over: list[bool], spare: list[int]) -> DataFrame:
    """row, shard, hubs, kind, target, bucket, large: where each row wants to be (kind 0) or, being content in a shard that holds too much, might go (1).

    ``full`` shards are wanted only by those in them; ``spare`` are those with room.
    """
    shards = len(full)
    members = state.select("row", "shard", F.explode("hubs").alias("h")).select("row", "shard", "h.hub", "h.total")
    counted = [F.count(F.when(F.col("shard") == k, 1)).alias(f"c{k}") for k in range(shards)]
    counts = members.groupBy("hub", "total").agg(*counted)
    names = [f"c{k}" for k in range(shards)]
    met = _with_hubs(members.drop("total"), counts, share, ["row", "shard", "hub", "total", *names])
    votes = met.groupBy("row").agg(
        F.first("shard").alias("shard"), F.collect_list(F.struct("hub", "total")).alias("hubs"), F.max(F.struct("total", "hub")).alias("main"), *(F.sum(c).alias(c) for c in names)
    )
    turn = F.pmod(F.xxhash64("main.hub"), F.lit(shards))
    order = []
    for k in range(shards):
        have = F.when(F.col("shard") != k, F.lit(1)).otherwise(-F.col(f"c{k}")) if full[k] else -F.col(f"c{k}")
        order.append(F.struct(have.alias("v"), F.pmod(F.lit(k) - turn, F.lit(shards)).alias("tie"), F.lit(k).alias("k")))
    needs = F.least(F.lit(shards), F.greatest(F.lit(1), F.ceil(F.col("main.total") / F.lit(quota)))).cast("int")
    homes = votes.withColumn("needs", needs).withColumn("homes", F.slice(F.array_sort(F.array(*order))["k"], F.lit(1), F.col("needs")))
    wants = F.when(F.array_contains("homes", F.col("shard")), F.col("shard")).otherwise(F.element_at("homes", (F.pmod(F.xxhash64("row"), F.col("needs")) + 1).cast("int")))
    # large hubs may move in parts, small ones move whole; of those that want to go, large ones go first, of those that might go, small ones
    is_large = F.col("main.total") * shards >= quota
    lot = F.when(is_large, F.xxhash64("row", "main.hub")).otherwise(F.xxhash64("main.hub"))
    relief = (_at(over, F.col("shard")) & (F.col("wants") == F.col("shard"))) if any(over) and spare else F.lit(False)
    out = homes.withColumn("wants", wants).withColumn("kind", relief.cast("int")).withColumn("lot", F.pmod(lot, F.lit(1 << 20)))
    elsewhere = _at(spare, F.pmod(F.floor(F.col("lot") / BUCKETS), F.lit(len(spare)))) if spare else F.col("shard")
    target = F.when(F.col("kind") == 1, elsewhere).otherwise(F.col("wants"))
    size = F.floor(F.log2(F.col("main.total")))
    bucket = F.when(F.col("kind") == 1, size).otherwise(F.lit(63) - size) * BUCKETS + F.pmod("lot", F.lit(BUCKETS))
    return out.select("row", "shard", "hubs", "kind", target.cast("int").alias("target"), bucket.cast("long").alias("bucket"), is_large.cast("int").alias("large"))


def _quotas(wanted: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many may go from i to j: as many as come back, and a share of j's room."""
    swaps = {(i, j): min(n, wanted.get((j, i), 0)) for (i, j), n in wanted.items()}
    rest = {p: n - swaps[p] for p, n in wanted.items()}
    into = [sum(n for (_, j), n in rest.items() if j == k) for k in range(len(room))]
    return {(i, j): swaps[i, j] + (min(n, max(0, room[j]) * n // into[j]) if into[j] else 0) for (i, j), n in rest.items()}


def _relief(load: list[int], quotas: list[int]) -> dict[tuple[int, int], int]:
    """How many of i's rows above its quota may go to j, by j's room."""
    over, room = [max(0, n - q) for n, q in zip(load, quotas, strict=True)], [max(0, q - n) for n, q in zip(load, quotas, strict=True)]
    return {(i, j): min(a * b // max(1, sum(room)), b * a // max(1, sum(over))) for i, a in enumerate(over) for j, b in enumerate(room) if a and b}


def propagate(members: DataFrame, quotas: list[int], rounds: int = ROUNDS) -> DataFrame:
    """row, shard, large of the rows of ``members`` (row, hub) that share a hub; ``quotas`` are the shards' rows.

    Early rounds let a shard hold more than its quota, so that links decide first;
    what is above it then leaves by whole small hubs.
    """
    shards = len(quotas)
    members = members.select("row", "hub").where("row is not null and hub is not null")
    share = members.count() / HEAVY
    state = _linked(members, share, shards)
    load = [0] * shards
    for r in state.groupBy("shard").count().collect():  # a row a shard
        load[r["shard"]] = r["count"]
    large, still = F.lit(0).alias("large"), 0
    every = [(kind, i, j) for kind in (0, 1) for i in range(shards) for j in range(shards)]
    index = (F.col("kind") * shards + F.col("shard")) * shards + F.col("target")
    for turn in range(rounds):
        soft = [int(q * (1 + (SLACK[turn] if turn < len(SLACK) else 0))) for q in quotas]
        full = [turn % 2 == 1 and n >= q for n, q in zip(load, soft, strict=True)]
        over, spare = [n > q for n, q in zip(load, quotas, strict=True)], [k for k, (n, q) in enumerate(zip(load, quotas, strict=True)) if n < q]
        asked = cut(_proposals(state, share, max(1, min(quotas)), full, over, spare))
        pairs = {(r["kind"], r["shard"], r["target"]): r["count"] for r in asked.groupBy("kind", "shard", "target").count().collect()}  # two rows a pair of shards
        wanted = {(i, j): n for (kind, i, j), n in pairs.items() if kind == 0 and i != j}
        may = {(0, i, j): n for (i, j), n in _quotas(wanted, [q - n for q, n in zip(soft, load, strict=True)]).items()}
        may |= {(1, i, j): n for (i, j), n in _relief(load, quotas).items()}
        flows = asked.where("shard <> target").groupBy("kind", "shard", "target", "bucket").agg(F.count("*").alias("n"))
        earlier = Window.partitionBy("kind", "shard", "target").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        going = flows.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).where(F.col("before") < _at([may.get(p, 0) for p in every], index))
        last = {(r["kind"], r["shard"], r["target"]): (r["last"], r["n"]) for r in going.groupBy("kind", "shard", "target").agg(F.max("bucket").alias("last"), F.sum("n").alias("n")).collect()}
        goes = (F.col("shard") != F.col("target")) & (F.col("bucket") <= _at([last.get(p, (-1, 0))[0] for p in every], index))
        state = asked.select("row", F.when(goes, F.col("target")).otherwise(F.col("shard")).alias("shard"), "hubs", "large")
        large = F.col("large")
        for (_, i, j), (_, n) in last.items():
            load[i], load[j] = load[i] - n, load[j] + n
        still = 0 if last else still + 1
        if still == 2 or not (wanted or any(over)):  # still with full shards left out and let in
            break
    return state.select("row", "shard", large)


def _settle(rows: DataFrame, quotas: list[int]) -> DataFrame:
    """Every row gets a shard and a slot, and every shard exactly its quota.

    rows: shard (null: anywhere), large, and other columns that stay, as checkpointed.
    Ranks come from counts by partition, so no task sees all rows of a shard.
    """
    shards = len(quotas)
    kind = F.when(F.col("shard").isNull(), F.lit(2 * shards)).otherwise(2 * F.col("shard") + F.col("large")).alias("kind")
    placed = rows.select("*", kind, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("nth"))
    counts = cut(placed.groupBy("kind", "part").agg(F.count("*").alias("n")))
    earlier = Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("kind", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    n = [0] * (2 * shards + 1)
    for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect():  # two rows a shard
        n[r["kind"]] = r["n"]
    here = [n[2 * k] + n[2 * k + 1] for k in range(shards)]
    kept = [min(a, q) for a, q in zip(here, quotas, strict=True)]
    over, low = [n[-1]], [0]
    for k in range(shards):
        over.append(over[-1] + here[k] - kept[k])
        low.append(low[-1] + quotas[k] - kept[k])
    within = Window.partitionBy("part", "kind").orderBy("nth")
    ranked = placed.withColumn("rank", F.row_number().over(within) - 1).join(starts, ["kind", "part"]).withColumn("rank", F.col("before") + F.col("rank"))
    # small hubs keep their places before large ones, which are split anyway
    ranked = ranked.withColumn("rank", F.col("rank") + F.when(F.col("large") == 1, _at(n[0 : 2 * shards : 2], F.coalesce("shard", F.lit(0)))).otherwise(0))
    stays = F.col("shard").isNotNull() & (F.col("rank") < _at(quotas, F.coalesce("shard", F.lit(0))))
    spare = F.when(F.col("shard").isNull(), F.col("rank")).otherwise(_at(over, F.coalesce("shard", F.lit(0))) + F.col("rank") - _at(quotas, F.coalesce("shard", F.lit(0))))
    ranked = ranked.withColumn("spare", F.when(~stays, spare))
    to = sum((F.when(F.col("spare") >= hi, 1).otherwise(0) for hi in low[1:-1]), F.lit(0))
    ranked = ranked.withColumn("shard", F.when(F.col("spare").isNull(), F.col("shard")).otherwise(to))
    slot = F.when(F.col("spare").isNull(), F.col("rank")).otherwise(F.col("spare") - _at(low[:-1], F.col("shard")) + _at(kept, F.col("shard")))
    return ranked.withColumn("slot", slot.cast("long"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, text_hash: copies of a text together, counts even.

    Texts are read once; equal hashes of different texts would only keep them together.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash")))
    rows = base.withColumn("row", F.monotonically_increasing_id())
    total = base.count()
    quotas = [total // shards + (k < total % shards) for k in range(shards)]
    labels = propagate(rows.select("row", F.col("text_hash").alias("hub")), quotas, rounds)
    settled = _settle(cut(rows.join(labels, "row", "left")), quotas)
    return settled.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), "text_hash")
