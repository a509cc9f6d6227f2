"""Exact top-k by inner product, by aggregation of sorted lists without random access.

A block of vectors has a list for each component, sorted by it. All queries of a block read its lists
side by side, best products first, in a few depths. What a query has read of a vector, with the worst
and the best that the unread lists can still add, bounds its score from below and above. A query stops
when the vectors whose upper bound reaches the k-th lower bound have less left to read than the next
depth would read; only theirs are resolved. A block whose upper bound is below what a query has found
already is not read for it at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgrove.llm.store import sorted_groups, stored

#: Vectors in a block, queries that go through a block together, blocks in a lane at least (what is found
#: in one spares reading in the next), and lanes at most.
BLOCK, QUERIES, FOLLOWING, LANES = 4096, 16_384, 4, 64
#: Shares of the lists that are read before each look at the bounds, and queries bounded at a time.
DEPTHS, AT_ONCE = (1 / 8, 1 / 4, 1 / 2, 5 / 8, 3 / 4, 1.0), 256


class Lists:
    """A block's sorted lists."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.rows = vectors.astype(float)
        self.lists = np.sort(self.rows, axis=0)  # a list for each component, smallest first
        self.read = 0

    def depth(self, n: int) -> tuple[np.ndarray, ...]:
        """Best and worst values by row and component, read from the large and from the small end, when n entries of each end are read; how many those are, as equal values are read together."""
        rows, lists = self.rows, self.lists
        first, last = lists[-n], lists[n - 1]
        above, below = rows >= first, rows <= last
        return np.maximum(rows, first), np.minimum(rows, last), np.where(above, rows, lists[0]), np.where(below, rows, lists[-1]), above.sum(axis=0), below.sum(axis=0)

    def best(self, queries: np.ndarray, k: int, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query (a row) that the block may hold something for: its place, and the rows that may be among the k best and reach its floor, with their scores."""
        size, width = self.vectors.shape
        up, down = np.maximum(queries, 0).T.astype(float), np.minimum(queries, 0).T.astype(float)
        ceiling = self.lists[-1] @ up + self.lists[0] @ down
        slack = 1e-9 * (np.abs(self.lists).max(axis=0) @ (up - down))
        active = np.flatnonzero(ceiling + slack >= floor)
        used = (queries != 0).sum(axis=1)
        for at, share in enumerate(DEPTHS):
            if not len(active):
                return
            top, low, top_worst, low_worst, n_top, n_low = self.depth(max(1, round(size * share)))
            ahead = DEPTHS[min(at + 1, len(DEPTHS) - 1)] - share
            going = []
            for a in range(0, len(active), AT_ONCE):
                own = active[a : a + AT_ONCE]
                high = top @ up[:, own] + low @ down[:, own]
                bar = floor[own]
                if size > k:
                    sure = top_worst @ up[:, own] + low_worst @ down[:, own]
                    bar = np.maximum(bar, np.partition(sure, size - k, axis=0)[size - k])
                left = high + slack[own] >= bar
                count = left.sum(axis=0)
                done = (count * (1 - share) <= size * ahead) | (share == 1)
                spent = n_top @ (up[:, own] > 0) + n_low @ (down[:, own] < 0)
                for c in np.flatnonzero(done):
                    rows = np.flatnonzero(left[:, c])
                    self.read += int(spent[c] + len(rows) * max(0.0, used[own[c]] - spent[c] / size))
                    if len(rows):
                        yield int(own[c]), rows, self.vectors[rows] @ queries[own[c]]
                going.append(own[~done])
            active = np.concatenate(going)


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    lane, queries = None, None
    best: list[tuple[np.ndarray, np.ndarray]] = []  # scores and vec_ids of each query, best first

    def out() -> Iterator[pa.RecordBatch]:
        if queries is None:
            return
        sizes = [len(s) for s, _ in best]
        if sum(sizes):
            columns = (np.repeat(queries[0], sizes), np.repeat(queries[1], sizes), np.concatenate([s for s, _ in best]), np.concatenate([v for _, v in best]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["row", "query_id", "score", "vec_id"])

    for group in sorted_groups(batches, ["dims", "of", "lane", "block"]):
        group = group.combine_chunks()
        dims, of, own, block = (group.column(c)[0].as_py() for c in ("dims", "of", "lane", "block"))
        rows, ids = (group.column(c).to_numpy() for c in ("row", "vec_id"))
        vectors = group.column("vector").chunk(0).flatten().to_numpy().reshape(-1, dims)
        if block < 0:
            yield from out()
            lane, queries = (dims, of, own), (rows, ids, vectors)
            best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(rows)
            floor = np.full(len(rows), -np.inf)
            continue
        if lane != (dims, of, own):
            continue
        for i, found, scores in Lists(vectors).best(queries[2], k + 1, floor):  # one more: the query's own row may be among them
            other = rows[found] != queries[0][i]
            scores, names = np.concatenate([best[i][0], scores[other]]), np.concatenate([best[i][1], ids[found[other]]])
            order = np.lexsort((names, -scores))[:k]
            best[i] = scores[order], names[order]
            if len(order) == k:
                floor[i] = scores[order[-1]]
    yield from out()


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024) -> DataFrame:
    """The k best rows of embeddings(vec_id, embedding) for each whose vec_id is divisible by `every`.

    Components become floor(scale * x); the score is the integer inner product; ties go to the
    smaller vec_id. Returns query_id, rank (from 1), vec_id, score. A query's own row is no
    candidate, a row that repeats it is. Rows with a null vec_id, and vectors that are null or hold
    null or non-finite components, take no part; empty vectors neither; vectors of other lengths
    than the query's are not compared with it.
    """
    x = F.transform(F.col("embedding"), lambda v: F.floor(F.lit(scale) * v.cast("double")))
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.coalesce(sound, F.lit(False)))
    rows = good.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dims"), x.alias("vector"))
    rows = stored(rows, "vectors")
    n = rows.count()
    asked = F.col("vec_id") % every == 0
    blocks, parts = max(1, -(-n // BLOCK)), max(1, -(-rows.where(asked).count() // QUERIES))
    lanes = min(-(-blocks // FOLLOWING), LANES)
    deal = lambda m, seed: F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(m)).cast("int")
    held = rows.withColumn("block", deal(blocks, 13)).withColumn("lane", F.col("block") % lanes).withColumn("of", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    queries = rows.where(asked).withColumn("of", deal(parts, 17)).withColumn("block", F.lit(-1)).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    names = ["dims", "of", "lane", "block", "row", "vec_id", "vector"]
    dealt = queries.select(names).unionByName(held.select(names)).repartition("dims", "of", "lane").sortWithinPartitions("dims", "of", "lane", "block", "vec_id", "row")
    found = dealt.mapInArrow(lambda b: _search(b, k), "row long, query_id long, score long, vec_id long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
