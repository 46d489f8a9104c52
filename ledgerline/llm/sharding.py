"""Sharding by balanced label propagation.

Documents are linked if their texts are equal. Linked documents begin in shards by a hash; in each round a group's most
populated shards (as many as its size needs) become its homes, and members elsewhere wish to move there. The wishes from
each shard to each other one are let through as far as every shard's inflow fits into its room and its outflow of the same
round (whole small groups at a time, large groups document by document). Rounds end when nobody wishes to move or wishes
stop falling. At the end each shard has exactly its quota of rows (law `rows`: counts at most one apart): documents
without links, and members over a shard's quota, group by group, fill what is left. So an edge is cut only where a group
is larger than a shard's room, meets the end of a shard, or was still apart in the last round.

Groups are found and moved by joins, groups of many rows from a bounded broadcast; only shard totals (shards x shards
numbers) come to the driver. A group that holds a third of all rows is numbered in chunks, never in one task.
"""

from __future__ import annotations

import logging

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.ranking import by_group, hot_join, in_chunks, root
from ledgerline.llm.tables import cut, uniform

WHOLE = 1 << 30
log = logging.getLogger(__name__)


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, key, row (parts rows that have no id): null texts count as empty."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("key"),
        F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("row"),
    )


def flows(wishes: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The part of each wish (from, to) that is let through: all, scaled down until each shard takes in no more than its
    room and what leaves it."""
    f = wishes.astype(np.float64)
    for _ in range(200):
        come, go = f.sum(0), f.sum(1)
        scale = np.minimum(1, (np.maximum(room, 0) + go) / np.maximum(come, 1e-9))
        if (scale > 1 - 1e-6).all():
            break
        f *= scale
    return f / np.maximum(wishes, 1e-9)


def propagate(members: DataFrame, shards: int, room: int, rounds: int, seed: int = 3) -> DataFrame:
    """members: key, n (members of the key), doc_id, row, and more; adds home, its shard. room: members that a shard can take."""
    one = F.struct("key", "doc_id", "row")
    state = cut(members.withColumn("home", uniform(one, seed, shards).cast("int")))
    least = None
    for turn in range(rounds):
        here = state.groupBy("key", "home", "n").agg(F.count("*").alias("c"))
        # the populated shards of a group, the fullest first, equal ones in another order each round; as many as it fills
        order = F.sort_array(F.collect_list(F.struct("c", F.xxhash64("key", "home", F.lit(turn)).alias("tie"), "home")), asc=False)
        wide = F.ceil(F.col("n") / max(1, room)).cast("int")
        homes = cut(here.groupBy("key", "n").agg(order.alias("o")).select("key", "n", F.transform(F.slice("o", 1, F.least(wide, F.size("o"))), lambda x: x["home"]).alias("homes")))
        pick = F.get("homes", F.pmod(F.xxhash64("doc_id", "row", F.lit(turn)), F.size("homes")).cast("int"))
        wish = hot_join(state.drop("n"), homes, "key", "n").withColumn("wish", F.when(F.array_contains("homes", F.col("home")), F.col("home")).otherwise(pick)).drop("homes")
        wish = cut(wish)
        load, want = np.zeros(shards), np.zeros((shards, shards))
        for r in wish.groupBy("home", "wish").count().collect():  # shards x shards rows
            load[r.home] += r["count"]
            if r.home != r.wish:
                want[r.home, r.wish] += r["count"]
        if not want.any() or (least is not None and want.sum() > 0.98 * least):
            log.info("label propagation ends after %d rounds, %d rows wish to move", turn, want.sum())
            break
        least = want.sum()
        through = flows(want, room - load)
        share = F.get(F.split(F.lit(",".join(f"{x:.6f}" for x in through.ravel())), ",").cast("array<double>"), F.col("home") * shards + F.col("wish"))
        whole = uniform(F.struct("key", F.lit(turn)), seed + 1)
        single = uniform(F.struct("key", "doc_id", "row", F.lit(turn)), seed + 2)
        let = F.when(F.col("n") * 4 <= room, whole).otherwise(single) < share * WHOLE
        state = cut(wish.withColumn("home", F.when(let, F.col("wish")).otherwise(F.col("home"))).drop("wish"))
    return state


def in_groups(df: DataFrame, group: str, sizes: dict, out: str) -> DataFrame:
    """df (key, n, doc_id, row, and more) numbered in each group from 0, the rows of a key one after another, and none in one
    task that has more than the root of the group, or 64."""
    deal = by_group(group, {s: root(n) for s, n in sizes.items()}, 1)
    piece = F.greatest(deal, F.lit(64))
    big = F.col("n") > piece
    dealt = df.select(
        "*",
        F.pmod(F.xxhash64("key"), deal).cast("int").alias("_deal"),
        F.when(big, F.xxhash64(F.lit(1), "key")).otherwise(F.lit(0)).alias("_big"),
        F.when(big, F.pmod(F.xxhash64(F.lit(2), "doc_id", "row"), F.ceil(F.col("n") / piece).cast("int"))).otherwise(F.lit(0)).cast("int").alias("_piece"),
    )
    return in_chunks(dealt, [group], ["_deal", "_big", "_piece"], ["key", "doc_id", "row"], out)


def shard(docs: DataFrame, shards: int = 40, rounds: int = 20) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law): one row for each row of docs, repeated
    and null ids included. Slots are 0, 1, ... in each shard. Null and empty texts are one group; very long ones count as
    any row does. An empty table has no rows; other columns are not looked at."""
    rows = cut(linked(docs))
    total = rows.count()
    quota = {s: total // shards + (s < total % shards) for s in range(shards)}
    groups = cut(rows.groupBy("key").agg(F.count("*").alias("n")))
    sized = cut(hot_join(rows, groups, "key", "n"))
    members = propagate(sized.where("n > 1"), shards, total // shards, rounds)
    held = {r.home: r["count"] for r in members.groupBy("home").count().collect()}
    placed = cut(in_groups(members, "home", held, "_slot"))
    stays = F.col("_slot") < by_group("home", quota, 0)
    plain = ["doc_id", "size", "text_crc32"]
    kept = [*plain, "key", "n", "row"]
    rest = cut(sized.where("n = 1").select(*kept).unionByName(placed.where(~stays).select(*kept)).withColumn("_all", F.lit(0)))
    spare, start = {}, {}
    at = 0
    for s in range(shards):
        taken = min(held.get(s, 0), quota[s])
        spare[s], start[s] = taken, at
        at += quota[s] - taken
    ranked = in_groups(rest, "_all", {0: at}, "_rank")
    shard_of: Column = F.lit(0)
    for s in range(1, shards):
        if quota[s] > spare[s]:
            shard_of = F.when(F.col("_rank") >= start[s], F.lit(s)).otherwise(shard_of)
    filled = ranked.withColumn("shard", shard_of)
    filled = filled.withColumn("slot", F.col("_rank") - by_group("shard", start, 0) + by_group("shard", spare, 0))
    out = placed.where(stays).select(*plain, F.col("home").alias("shard"), F.col("_slot").alias("slot")).unionByName(filled.select(*plain, "shard", "slot"))
    return out.select(*plain, F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
