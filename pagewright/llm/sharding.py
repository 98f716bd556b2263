"""Sharding by balanced label propagation.

Linked rows share a link key. Each row starts in a shard given by a hash; in each round every link key's
rows are counted by shard, each linked row wants the shard where most of its neighbours are, and of those
that want to move into a shard only as many do as it has room for. Rows without links fill what is left,
so that counts differ by one at most.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, join_counted, ordered, stored

SHARDS = 16
ROUNDS = 8
_UNIT = 1 << 30


def _hash(*cols) -> Column:
    """0 to _UNIT - 1."""
    return F.pmod(F.xxhash64(*cols), F.lit(_UNIT)).cast("long")


def _share(table: np.ndarray, row: Column) -> Column:
    return F.element_at(F.array(*(F.lit(int(x)) for x in table)), row + 1)


def propagate(linked: DataFrame, shards: int, room: list[int], rounds: int = ROUNDS) -> DataFrame:
    """linked (id, link, shard) with new shards: no shard takes in more rows in a round than it has room for
    (about: a hash draws the lot). Rows of a link move together where there is room."""
    total = linked.count()
    for turn in range(rounds):
        counts = linked.groupBy("link", "shard").agg(F.count(F.lit(1)).alias("n"))
        # The shard with most rows of a link; ties go by a hash, so that links spread over shards.
        best = counts.groupBy("link").agg(F.max(F.struct("n", _hash("link", "shard").alias("tie"), "shard")).alias("top")).select("link", F.col("top.shard").alias("wanted"))
        # A row for each pair of link and shard is enough to know what would move.
        moves = counts.join(best, "link").where("shard <> wanted")
        sums = moves.groupBy("shard", "wanted").agg(F.sum("n").alias("n")).collect()  # at most shards * shards rows
        if not sums:
            break
        held = np.zeros(shards)
        for r in linked.groupBy("shard").count().collect():  # a row for each shard
            held[r["shard"]] = r["count"]
        free = np.maximum(0, np.array(room) - held)
        # What leaves a shard makes room there: the pairwise exchange of both ways comes on top of what is free.
        pairs = np.zeros((shards, shards))
        for r in sums:
            pairs[r["shard"], r["wanted"]] = r["n"]
        swap = np.minimum(pairs, pairs.T)
        rest = pairs - swap
        share_rest = np.minimum(1.0, free / np.maximum(1, rest.sum(axis=0)))
        share = np.where(pairs > 0, (swap + rest * share_rest[None]) / np.maximum(1, pairs), 0.0)
        table = np.floor(share * _UNIT).astype(np.int64).reshape(-1)
        # One lot for a link's rows in a shard; where only some may move, a lot for each row.
        pair = F.col("shard") * shards + F.col("wanted")
        lot = F.when(F.col("together"), _hash("link", "shard", F.lit(turn))).otherwise(_hash("id", "link", F.lit(turn)))
        plan = moves.select(F.xxhash64("link", "shard").alias("pair"), F.col("n").alias("rows"), "wanted", (F.col("n") <= F.lit(float(max(1.0, free.mean() / 8)))).alias("together"))
        joined = join_counted(linked.withColumn("pair", F.xxhash64("link", "shard")), plan, "pair", "rows", total)
        linked = stored(joined.select("id", "link", F.when(F.col("wanted").isNotNull() & (lot < _share(table, pair)), F.col("wanted")).otherwise(F.col("shard")).alias("shard")), "round", linked)
        if not table.any():
            break
    return linked


def shard_rows(rows: DataFrame, link: str, key: str, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """rows with shard (int, 0 to shards - 1) and slot (long, gapless from 0 in each shard).

    Rows of equal, non-null `link` are linked; they move towards the shard of most of their neighbours, so
    few links are cut, while the counts of rows in shards differ by at most one. A link with more rows than
    a shard holds is spread over as few shards as have room. `key` orders rows (nulls last); rows that
    repeat are rows of their own. Columns of rows by the names shard and slot are replaced. An empty table
    stays empty.
    """
    uid, lk = free_name(rows, "shard_uid"), free_name(rows, "shard_link")
    base = stored(rows.withColumns({uid: F.monotonically_increasing_id(), lk: F.xxhash64(link)}), "shard_rows")
    total = base.count()
    room = [(s + 1) * total // shards - s * total // shards for s in range(shards)]
    known = base.where(F.col(f"`{link}`").isNotNull()).select(F.col(uid).alias("id"), F.col(lk).alias("link"), F.col(f"`{link}`").alias("whole"))
    groups = known.groupBy("whole").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    links = join_counted(known, groups, "whole", "rows", total, "inner").select("id", "link")
    linked = stored(links.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")), "linked")
    linked = propagate(linked, shards, room, rounds)
    # What a link could not bring to its main shard is dealt out in one piece, with the rows without links.
    counts = linked.groupBy("link", "shard").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("link").agg(F.max(F.struct("n", "shard")).alias("top"), F.sum("n").alias("rows")).select("link", "rows", F.col("top.shard").alias("main"))
    linked = stored(join_counted(linked, main, "link", "rows", linked.count(), "inner").where("shard = main").select("id", "link", "shard"), "whole", linked)
    # Quotas: of a shard's linked rows as many stay as it holds, the rest are dealt out with those without links.
    ranked = ordered(linked, ["shard", "link", "id"])
    held = {r["shard"]: r["count"] for r in linked.groupBy("shard").count().collect()}  # a row for each shard
    starts = np.concatenate([[0], np.cumsum([held.get(s, 0) for s in range(shards)])]).astype(int)
    inside = F.col("rank") - _share(starts[:-1], F.col("shard"))
    quota = [min(held.get(s, 0), room[s]) for s in range(shards)]
    placed = stored(ranked.select("id", "shard", inside.alias("slot")).where(F.col("slot") < _share(np.array(quota), F.col("shard"))), "placed")
    # All others fill the shards in turn.
    others = base.select(uid, lk).join(placed.select(F.col("id").alias(uid)), uid, "left_anti")
    filled = ordered(others, [lk, uid])
    left = np.array(room) - np.array(quota)
    ends = np.cumsum(left)
    shard = F.lit(0)
    for e in ends[:-1]:
        shard = shard + (F.col("rank") >= int(e)).cast("int")
    fill = filled.select(F.col(uid).alias("id"), shard.cast("int").alias("shard"), "rank")
    fill = fill.select("id", "shard", (F.col("rank") - _share(ends - left, F.col("shard")) + _share(np.array(quota), F.col("shard"))).cast("long").alias("slot"))
    every = placed.select("id", "shard", F.col("slot").cast("long").alias("slot")).unionByName(fill).select(F.col("id").alias(uid), F.struct("shard", "slot").alias(lk))
    joined = base.drop(lk).join(every, uid)
    kept = [F.col(f"`{c}`") for c in rows.columns if c.lower() not in ("shard", "slot")]
    return joined.select(*kept, F.col(f"{lk}.shard").alias("shard"), F.col(f"{lk}.slot").alias("slot"))
