"""Shards of equal row counts that keep linked rows together, by balanced label propagation."""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrove.llm.store import spread_number, stored, text_bytes

ROUNDS = 10


def _loads(state: DataFrame, shards: int) -> list[int]:
    found = {r.shard: r.n for r in state.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def _picked(values: list[int], index):
    return F.element_at(F.array(*(F.lit(v) for v in values)), index + 1)


def _quotas(asks: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many rows may move from one shard to another: as many as come back, and what there is room for."""
    quotas, room = {}, list(room)
    for (a, b), n in sorted(asks.items()):
        back = min(n, asks.get((b, a), 0))
        more = min(n - back, room[b])
        quotas[a, b] = back + more
        room[b] -= more
    return quotas


def propagate(links: DataFrame, shards: int, capacity: int, rounds: int = ROUNDS) -> DataFrame:
    """Labels (row, shard) of the rows that links(a, b) tie.

    Every row starts in the shard of its hash. In each round, half of the rows (another half each
    time, so that neighbours don't swap places forever) ask for the shard that holds most of their
    neighbours, if it holds more than their own does. Two shards exchange as many rows as both
    ask for; beyond, a shard lets in as many as `capacity` leaves room for. Only counts by shard and
    by pair of shards go to the driver. It ends when two rounds move nothing.
    """
    both = links.select(F.col("a").alias("row"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("row"), F.col("a").alias("other")))
    both = stored(both.where("row <> other").distinct(), "links")
    state = stored(both.select("row").distinct().withColumn("shard", F.pmod(F.xxhash64(F.lit(11), "row"), F.lit(shards)).cast("int")), "labels")
    loads, still = _loads(state, shards), 0
    for k in range(rounds):
        room = [max(0, capacity - n) for n in loads]
        asking = F.pmod(F.xxhash64(F.lit(100 + k), "row"), F.lit(2)) == 0
        votes = both.where(asking).join(state.select(F.col("row").alias("other"), "shard"), "other").groupBy("row", "shard").agg(F.count(F.lit(1)).alias("votes"))
        votes = votes.join(state.select("row", F.col("shard").alias("own")), "row")
        stays = F.col("shard") == F.col("own")
        best = votes.groupBy("row", "own").agg(F.max(F.struct("votes", stays.alias("stays"), F.xxhash64("shard", F.lit(k)).alias("tie"), "shard")).alias("best"))
        moves = best.select("row", F.col("best.shard").alias("shard"), "own").where("shard <> own").withColumn("pair", F.col("own") * shards + F.col("shard"))
        moves = stored(spread_number(moves, "pair", ["row"], "nth"), "moves")
        quotas = _quotas({(r.own, r.shard): r.n for r in moves.groupBy("own", "shard").agg(F.count(F.lit(1)).alias("n")).collect()}, room)
        moves = moves.where(F.col("nth") < _picked([quotas.get((a, b), 0) for a in range(shards) for b in range(shards)], F.col("pair")))
        state = stored(state.join(moves.select("row", F.col("shard").alias("to")), "row", "left").select("row", F.coalesce("to", "shard").alias("shard")), "labels")
        before, loads = loads, _loads(state, shards)
        still = still + 1 if before == loads and moves.isEmpty() else 0
        if still == 2:
            break
    return state


def packed(sizes: dict[int, int], rooms: list[int]) -> list[tuple[int, int, int, int, int, int]]:
    """Places sizes[n] groups of n rows each into rooms, the largest first, each into the tightest room.

    A group that fits into none fills the largest room and goes on as a group of its other rows; as that
    room is full then, at most as many groups are cut as there are rooms. Gives (n, first group, end of
    groups, first row, end of rows, shard); groups of a size are numbered from 0, and a group's rows.
    """
    plan, rooms, done = [], list(rooms), defaultdict(int)
    heap = [(-n, n, 0, -1, m) for n, m in sizes.items()]  # rows left, rows, rows placed, the group if cut, groups
    heapq.heapify(heap)
    while heap:
        left, n, placed, group, m = heapq.heappop(heap)
        left = -left
        while m:
            fitting = [s for s, r in enumerate(rooms) if r >= left]
            if fitting:
                s = min(fitting, key=rooms.__getitem__)
                k, part = min(m, rooms[s] // left), left
            else:
                s = max(range(len(rooms)), key=rooms.__getitem__)
                k, part = 1, rooms[s]
            first = group
            if group < 0:
                first, done[n] = done[n], done[n] + k
            plan.append((n, first, first + k, placed, placed + part, s))
            rooms[s] -= k * part
            m -= k
            if part < left:
                heapq.heappush(heap, (part - left, n, placed + part, first, 1))
    return plan


def cut(plan: list[tuple[int, int, int, int, int, int]]) -> int:
    """Rows of a plan that are not with the largest part of their group."""
    largest: dict[tuple[int, int], int] = {}
    for n, first, _, a, b, _ in plan:
        if b - a < n:
            largest[n, first] = max(largest.get((n, first), 0), b - a)
    return sum(n - part for (n, _), part in largest.items())


def grouped(members: DataFrame, labels: DataFrame, shares: list[int]) -> DataFrame:
    """(row, shard) of members(row, group): a group that propagation brought together stays where it is.

    The others are packed into what is left of the shares. Where that cuts groups, all are packed
    anew if it cuts less. Only the numbers of groups of each size go to the driver.
    """
    shards = len(shares)
    groups = members.join(labels, "row").groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("shard").alias("shard"), (F.min("shard") < F.max("shard")).alias("split"))
    groups = stored(groups, "groups")
    found = groups.groupBy("n", "split", F.when(~F.col("split"), F.col("shard")).alias("shard")).agg(F.count(F.lit(1)).alias("m")).collect()
    rooms, split, every = list(shares), defaultdict(int), defaultdict(int)
    for r in found:
        every[r.n] += r.m
        if r.split:
            split[r.n] += r.m
        else:
            rooms[r.shard] -= r.n * r.m
    fits = min(rooms) >= 0  # the first labels may have put more rows into a shard than its share
    plan, moved = packed(split, rooms) if fits else [], groups.where("split")
    if not fits or cut(plan):
        anew = packed(every, shares)
        if not fits or cut(anew) < cut(plan):
            plan, moved = anew, groups
    spark = members.sparkSession
    parts = spark.createDataFrame(plan, "n long, first long, last long, low long, high long, shard int")
    moved = spread_number(moved.select("group", "n"), "n", ["group"], "nth").join(F.broadcast(parts), "n").where("first <= nth and nth < last")
    moved = stored(moved.select("group", "n", "low", "high", "shard"), "parts")
    whole = moved.where("high - low = n").select("group", "shard").unionByName(groups.join(moved.select("group").distinct(), "group", "left_anti").select("group", "shard"))
    out = members.join(stored(whole, "whole"), "group").select("row", "shard")
    pieces = moved.where("high - low < n").select("group", "low", "high", "shard")  # of one group a shard
    held = spread_number(members.join(F.broadcast(pieces.select("group").distinct()), "group").select("row", "group"), "group", ["row"], "at")
    return out.unionByName(held.join(F.broadcast(pieces), "group").where("low <= at and at < high").select("row", "shard"))


def even_shards(rows: DataFrame, members: DataFrame, links: DataFrame, shards: int) -> DataFrame:
    """Adds to rows(row, ...) shard and slot: counts of shards differ by one at most.

    Rows of a group of members(row, group), which links(a, b) tie, lie together, but for at most as many
    groups as there are shards; the other rows fill the shares that are left. slot numbers the rows of a
    shard from 0.
    """
    total = rows.count()
    shares = [total // shards + (s < total % shards) for s in range(shards)]
    cell = max(256, math.isqrt(total))
    kept = stored(grouped(members, propagate(links, shards, total // shards), shares), "kept")
    filled = _loads(kept, shards)
    placed = rows.select("row").join(kept, "row", "left")
    pool = spread_number(placed.where("shard is null").select("row", F.lit(0).alias("all")), "all", ["row"], "nth", cell)
    ends = list(accumulate(s - f for s, f in zip(shares, filled, strict=True)))
    shard = F.size(F.filter(F.array(*(F.lit(e) for e in ends)), lambda e: e <= F.col("nth")))
    whole = stored(placed.where("shard is not null").select("row", "shard").unionByName(pool.select("row", shard.cast("int").alias("shard"))), "shards")
    return rows.join(spread_number(whole, "shard", ["row"], "slot", cell), "row")


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Shards of documents(doc_id, text), equal texts together as far as equal counts allow.

    An empty table gives no rows; other columns are ignored. Returns per row doc_id, size, text_crc32, law (rows), shard, slot, grown_shard (null). Null and
    empty texts are equal. Rows that are equal in everything are rows of their own. A group larger
    than a shard becomes stars of a shard's size each, whose centres are linked. At most as many
    groups as there are shards are cut.
    """
    body = text_bytes("text")
    base = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), (F.length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("text_hash")
    )
    base = stored(base, "rows")
    capacity = max(1, base.count() // shards)
    groups = base.groupBy("text_hash", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = base.select("row", "text_hash", "size", "text_crc32").join(stored(groups, "groups"), ["text_hash", "size", "text_crc32"])
    members = stored(members.withColumn("star", F.pmod(F.xxhash64(F.lit(7), "row"), F.ceil(F.col("n") * 1.1 / capacity))), "members")
    stars = stored(members.groupBy("text_hash", "size", "text_crc32", "star").agg(F.min("row").alias("centre")), "stars")
    middles = stored(stars.groupBy("text_hash", "size", "text_crc32").agg(F.min("centre").alias("middle")), "middles")
    links = members.join(stars, ["text_hash", "size", "text_crc32", "star"]).select(F.col("row").alias("a"), F.col("centre").alias("b"))
    links = links.unionByName(stars.join(middles, ["text_hash", "size", "text_crc32"]).select(F.col("centre").alias("a"), F.col("middle").alias("b"))).where("a <> b")
    grouping = members.join(middles, ["text_hash", "size", "text_crc32"]).select("row", F.col("middle").alias("group"))
    out = even_shards(base, grouping, links, shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
