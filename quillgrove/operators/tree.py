"""Section trees as rows: building, ranges, lookups, merging.

nodes(doc_id, node_id, parent_id, ordinal, depth, structure, title, start_page, end_page, summary).
A node's parent is known from its section code, so levels need no recursion: an ancestor is a
prefix of the code.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgrove.functions.text import chapter_number, is_chapter_title, node_id, parent_structure
from quillgrove.operators.toc import end_pages
from quillgrove.plans.lineage import Rounds, settled

ROOT = "Document"
SPAN = 16
#: Rows of a cell in which pointers are followed: a task holds their ids.
CELL_ROWS = 250_000


def first_wins(items: DataFrame) -> DataFrame:
    """Of items with the same code the first in order (`nth`), as their tree holds one node for a code."""
    first = F.row_number().over(Window.partitionBy("doc_id", "structure").orderBy("nth"))
    return items.withColumn("first", first).where("first = 1").drop("first")


def placeholders(items: DataFrame, total_pages: int) -> DataFrame:
    """(doc_id, structure, title, start_page, end_page): ancestors that no item has, over all pages, named after their code."""
    parts = F.split("structure", r"\.")
    above = F.transform(F.filter(F.sequence(F.lit(1), F.size(parts)), lambda n: n < F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    missing = items.select("doc_id", F.explode(above).alias("structure")).distinct().join(items.select("doc_id", "structure"), ["doc_id", "structure"], "left_anti")
    title = F.concat(F.lit("第"), F.col("structure"), F.lit("章"))
    return missing.select("doc_id", "structure", title.alias("title"), F.lit(1).alias("start_page"), F.lit(total_pages).alias("end_page"))


def linked(nodes: DataFrame) -> DataFrame:
    """Adds node_id, parent_id, depth and ordinal (among siblings, by start page, then code)."""
    parent = parent_structure("structure")
    return nodes.withColumns({
        "node_id": node_id("doc_id", "structure"),
        "parent_id": F.when(parent != "", node_id("doc_id", parent)),
        "depth": F.size(F.split("structure", r"\.")),
        "ordinal": F.row_number().over(Window.partitionBy("doc_id", parent).orderBy("start_page", F.length("structure"), "structure")),
    })


def closure(nodes: DataFrame) -> DataFrame:
    """(doc_id, ancestor, structure, start_page, end_page, leaf): each node under itself and all its ancestors."""
    parts = F.split("structure", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    inner = nodes.select("doc_id", parent_structure("structure").alias("structure")).distinct().withColumn("inner", F.lit(True))
    marked = nodes.join(inner, ["doc_id", "structure"], "left")
    return marked.select("doc_id", F.explode(above).alias("ancestor"), "structure", "start_page", "end_page", F.col("inner").isNull().alias("leaf"))


def rolled_up(nodes: DataFrame) -> DataFrame:
    """Nodes with a parent's range from its leaves: a parent loses its own start and end. Adds `size`, its subtree's nodes."""
    own = closure(nodes).groupBy("doc_id", F.col("ancestor").alias("structure")).agg(
        F.min(F.when(F.col("leaf"), F.col("start_page"))).alias("low"), F.max(F.when(F.col("leaf"), F.col("end_page"))).alias("high"), F.count(F.lit(1)).alias("size")
    )
    joined = nodes.join(own, ["doc_id", "structure"])
    return joined.withColumn("start_page", F.col("low")).withColumn("end_page", F.col("high")).drop("low", "high")


def with_ancestors(ranged: DataFrame) -> DataFrame:
    """Nodes (doc_id, structure, title, start_page, end_page, size) of items with ranges and all their ancestors, rolled up.

    The same as rolled_up() of the items and their placeholders, without a join: an item is a leaf
    if the next one in the order of codes isn't below it, and brings its range to every prefix of
    its code. All windows and aggregates are within a document, so documents move once.
    """
    order = F.translate("structure", ".", "\1")
    below = F.lead("structure").over(Window.partitionBy("doc_id").orderBy(order)).startswith(F.concat(F.col("structure"), F.lit(".")))
    rows = ranged.withColumn("leaf", ~F.coalesce(below, F.lit(False)))
    own = F.col("structure") == F.col("node")
    found = rows.select("*", F.explode(_prefixes()).alias("node")).groupBy("doc_id", F.col("node").alias("structure")).agg(
        F.when(F.max(own), F.max(F.when(own, F.col("title")))).otherwise(F.concat(F.lit("第"), F.col("node"), F.lit("章"))).alias("title"),
        F.min(F.when(F.col("leaf"), F.col("start_page"))).alias("start_page"), F.max(F.when(F.col("leaf"), F.col("end_page"))).alias("end_page"),
    )
    self_row = F.max(F.when(own, F.struct("title", "start_page", "end_page"))).alias("own")
    sized = found.select("*", F.explode(_prefixes()).alias("node")).groupBy("doc_id", F.col("node").alias("structure")).agg(self_row, F.count(F.lit(1)).alias("size"))
    return sized.select("doc_id", "structure", "own.*", "size")


def _prefixes():
    parts = F.length("structure") - F.length(F.translate("structure", ".", "")) + 1
    return F.transform(F.sequence(F.lit(1), parts), lambda n: F.call_function("substring_index", F.col("structure"), F.lit("."), n))


def built(items: DataFrame, total_pages: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """The nodes of contents items: one for a code, missing ancestors added, ranges rolled up, linked.

    Takes toc_items(doc_id, structure, title, physical_index, list_index, ties...).
    """
    ranged = first_wins(end_pages(items, total_pages, ties)).select("doc_id", "structure", "title", F.col("physical_index").alias("start_page"), "end_page")
    return linked(with_ancestors(ranged))


def roots(nodes: DataFrame, total_pages: Column | int) -> DataFrame:
    """(doc_id, title, start_page, end_page, wrapped): a document's root; total_pages is a number, or a column of nodes.

    Several top nodes, or one that is a chapter, are wrapped in one over all pages; another single
    one is the root itself, and ends where its subtree does.
    """
    deepest = nodes.groupBy("doc_id").agg(F.max("end_page").alias("last"))
    top = nodes.where("depth = 1").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("start_page").alias("start"), F.max("end_page").alias("end"), F.first("title").alias("title"),
        F.max(total_pages if isinstance(total_pages, Column) else F.lit(total_pages)).alias("total"),
    )
    wrapped = (F.col("n") > 1) | is_chapter_title("title")
    return top.join(deepest, "doc_id").select(
        "doc_id",
        F.when(wrapped, ROOT).otherwise(F.col("title")).alias("title"),
        F.when(wrapped, F.least(F.lit(1), F.col("start"))).otherwise(F.col("start")).alias("start_page"),
        F.when(wrapped, F.greatest("total", "end")).otherwise(F.col("last")).alias("end_page"),
        wrapped.alias("wrapped"),
    )


def rooted(nodes: DataFrame, last: DataFrame) -> DataFrame:
    """Nodes of documents with their root, chosen as roots() does; last(doc_id, total_pages). A single node that is the root stands at depth 0."""
    columns = ["doc_id", "node_id", "parent_id", "ordinal", "depth", "structure", "title", "start_page", "end_page"]
    chosen = settled(roots(nodes.join(last, "doc_id"), F.col("total_pages")))
    root_id = node_id("doc_id", F.lit(ROOT))
    top = chosen.where("wrapped").select("doc_id", root_id.alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(1).alias("ordinal"), F.lit(0).alias("depth"), F.lit("").alias("structure"), "title", "start_page", "end_page")
    own = nodes.join(chosen.select("doc_id", "wrapped", F.col("end_page").alias("last")), "doc_id")
    alone = ~F.col("wrapped") & (F.col("depth") == 1)
    own = own.withColumns({
        "parent_id": F.when(F.col("wrapped"), F.coalesce("parent_id", root_id)).otherwise(F.col("parent_id")), "end_page": F.when(alone, F.col("last")).otherwise(F.col("end_page")),
        "depth": F.when(F.col("wrapped"), F.col("depth")).otherwise(F.col("depth") - 1),
    })
    return top.unionByName(own.select(columns))


def flat(items: DataFrame, total_pages: int) -> DataFrame:
    """Every item under one root: (doc_id, ordinal, title, start_page, end_page); ordinal 0 is the root."""
    own = items.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("nth")).alias("ordinal"), "title", F.col("physical_index").alias("start_page"), "end_page")
    root = items.select("doc_id").distinct().select("doc_id", F.lit(0).alias("ordinal"), F.lit(ROOT).alias("title"), F.lit(1).alias("start_page"), F.lit(total_pages).alias("end_page"))
    return root.unionByName(own)


def chapters_merged(nodes: DataFrame) -> DataFrame:
    """Top nodes of one chapter number become one: (doc_id, node_id, into, title, start_page, end_page).

    The longest title (in bytes; the first of equal ones) stays, with the range of all; `into` says
    where a node's children go. nodes: top nodes with `ordinal`. Titles without a number stay alone.
    """
    number = chapter_number("title")
    key = F.when(number != "", number).otherwise(F.concat(F.lit("\0"), F.col("node_id")))
    own = nodes.withColumn("chapter", key)
    all_of = Window.partitionBy("doc_id", "chapter")
    best = F.first("node_id").over(all_of.orderBy(F.octet_length("title").desc(), "ordinal").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = own.withColumn("into", best).withColumn("start_page", F.min("start_page").over(all_of)).withColumn("end_page", F.max("end_page").over(all_of))
    return out.select("doc_id", "node_id", "into", "title", "start_page", "end_page")


def reparented(children: DataFrame, merged: DataFrame) -> DataFrame:
    """Children of chapters_merged nodes under the node that stays."""
    to = merged.select("doc_id", F.col("node_id").alias("parent_id"), "into")
    return children.join(to, ["doc_id", "parent_id"], "left").withColumn("parent_id", F.coalesce("into", "parent_id")).drop("into")


def chapters_joined(nodes: DataFrame) -> DataFrame:
    """Nodes (as linked() makes them, with `size`) where top nodes of one chapter number are one, with the children of all.

    Its range is that of the leaves below it, so of those that had children if any had; else that of all.
    `nodes` is read several times.
    """
    tops = nodes.where("depth = 1")
    merged = settled(chapters_merged(tops).select("doc_id", "node_id", "into"))
    parent = F.col("size") > 1
    ranges = tops.join(merged, ["doc_id", "node_id"]).groupBy("doc_id", F.col("into").alias("node_id")).agg(
        F.coalesce(F.min(F.when(parent, F.col("start_page"))), F.min("start_page")).alias("start_page"), F.coalesce(F.max(F.when(parent, F.col("end_page"))), F.max("end_page")).alias("end_page"),
        (F.sum("size") - F.count(F.lit(1)) + 1).alias("size"),
    )
    kept = tops.drop("start_page", "end_page", "size").join(ranges, ["doc_id", "node_id"])
    beside = Window.partitionBy("doc_id", "parent_id").orderBy("start_page", F.length("structure"), "structure")
    numbered = lambda own: own.select(nodes.columns).withColumn("ordinal", F.row_number().over(beside))
    below = nodes.where("depth > 1")
    # Children of chapters that stay alone keep their places.
    joined = settled(merged.join(merged.where("node_id <> into").select("doc_id", "into").distinct(), ["doc_id", "into"], "left_semi"))
    if joined.isEmpty():
        return numbered(kept).unionByName(below.select(nodes.columns))
    theirs = joined.select("doc_id", F.col("node_id").alias("parent_id"))
    moved = reparented(below.join(theirs, ["doc_id", "parent_id"], "left_semi"), joined)
    return numbered(kept).unionByName(below.join(theirs, ["doc_id", "parent_id"], "left_anti").select(nodes.columns)).unionByName(numbered(moved))


def overlapping(nodes: DataFrame, ranges: DataFrame, span: int = SPAN) -> DataFrame:
    """Nodes and the ranges(range_id, doc_id, first_page, last_page) that they share a page with, both ends included.

    Pages fall into buckets of `span`: a hash join on document and bucket, of which each pair keeps
    the first bucket that both have, in place of comparing all nodes with all ranges.
    """
    bucket = lambda c: F.floor(F.col(c) / span).cast("int")
    left = nodes.where("start_page <= end_page").withColumn("bucket", F.explode(F.sequence(bucket("start_page"), bucket("end_page"))))
    right = ranges.where("first_page <= last_page").withColumn("bucket", F.explode(F.sequence(bucket("first_page"), bucket("last_page"))))
    met = left.join(right, ["doc_id", "bucket"]).where((F.col("start_page") <= F.col("last_page")) & (F.col("end_page") >= F.col("first_page")))
    return met.where(F.col("bucket") == F.greatest(bucket("start_page"), bucket("first_page"))).drop("bucket")


def node_text(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, node_id, text): the pages of a node's range in order, an empty line after each; missing pages are left out.

    Ranges are small integers: a row for each page and a hash join.
    """
    wanted = nodes.where("start_page <= end_page").select("doc_id", "node_id", F.explode(F.sequence("start_page", "end_page")).alias("page_number"))
    met = wanted.join(pages, ["doc_id", "page_number"]).groupBy("doc_id", "node_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("p"))
    return met.select("doc_id", "node_id", F.concat(F.array_join(F.transform("p", lambda p: p["text"]), "\n\n"), F.lit("\n\n")).alias("text"))


def looked_up(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, rank, node_id, title, start_page, end_page) of wanted(query_id, doc_id, node_ids), in their order.

    Repeated ids stay, unknown ones are left out.
    """
    rows = wanted.select("query_id", "doc_id", F.posexplode("node_ids").alias("pos", "node_id"))
    met = rows.join(nodes.select("doc_id", "node_id", "title", "start_page", "end_page"), ["doc_id", "node_id"])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))
    return met.select("query_id", rank.alias("rank"), "node_id", "title", "start_page", "end_page")


NO_ROOT = "some nodes belong to no root"


def levelled(nodes: DataFrame, key: str = "doc_id", rounds: Rounds | None = None) -> DataFrame:
    """Nodes with `level` (0 for a root), `top` (the ancestor below the root, or the node itself at level 0 and 1) and `leaf`.

    Trees of any depth, by pointer doubling, see _pointed(). Pointers end at the nodes below the roots. A node that no root leads to, in a cycle or below a missing one, is an error.
    `nodes` is computed once; of the tables in between the last one is kept, in `rounds` if given.
    """
    rounds = rounds or Rounds(nodes.sparkSession)
    is_root = F.col("parent_id").isNull()
    columns = nodes.columns
    # Read twice: only the roots' ids, and all.
    nodes = rounds.put(nodes)
    rounds.drop()
    top = nodes.where(is_root).select(key, F.col("node_id").alias("parent_id"), F.lit(True).alias("_below"))
    inner = nodes.where(~is_root).select(key, F.col("parent_id").alias("node_id")).distinct().withColumn("_inner", F.lit(True))
    done = F.coalesce("_below", F.lit(False))
    marked = nodes.join(inner, [key, "node_id"], "left").join(top, [key, "parent_id"], "left")
    marked = rounds.put(marked.select(*columns, F.when(is_root, 0).otherwise(1).alias("level"), F.col("node_id").alias("top"), F.col("_inner").isNull().alias("leaf"), (is_root | done).alias("_done")))
    rounds.drop(rounds.made - 1)
    if marked.where("not _done").isEmpty():
        return marked.drop("_done")
    state = marked.where(~is_root).select(key, "node_id", F.when(F.col("_done"), F.col("node_id")).otherwise(F.col("parent_id")).alias("up"), F.when(F.col("_done"), 0).otherwise(1).alias("way"), F.col("_done").alias("done"))
    placed = _pointed(settled(state), key).select(key, "node_id", (F.col("way") + 1).alias("level"), F.col("up").alias("top"))
    deep = marked.where("not _done").drop("level", "top", "_done").join(placed, [key, "node_id"])
    out = rounds.put(marked.where("_done").drop("_done").unionByName(deep))
    rounds.drop(rounds.made - 1)
    return out


def _pointed(state: DataFrame, key: str, cells: bool = True) -> DataFrame:
    """state(key, node_id, up, way, done) with all pointers at their end: `up` the node below the root, `way` steps up.

    In a round each node takes over the pointer of the one that it points at, so a depth of d takes log2(d)
    joins. Deep trees take one of all rows: after it, rows near each other in the order of their ids
    walk as far as they can within a cell, and the rounds are over the nodes that pointers from other
    cells end at. Where ids tell nothing of the tree those are most nodes, and it takes the joins.
    """
    most = state.count()
    for k in range(most.bit_length() + 1):
        open_ = state.where("not done")
        if open_.isEmpty():
            break
        if k == most.bit_length() or not open_.where("up = node_id").isEmpty():
            raise ValueError(f"{NO_ROOT}: {[tuple(r) for r in open_.select(key, 'node_id').limit(3).collect()]}")
        if cells and k == 1:
            count = max(-(-most // CELL_ROWS), int(state.sparkSession.conf.get("spark.sql.shuffle.partitions")))
            walked = settled(state.repartitionByRange(count, key, "node_id").mapInArrow(_walker(key), state.schema))
            ends = walked.where("not done").select(key, F.col("up").alias("node_id")).distinct()
            found = _pointed(settled(walked.join(ends, [key, "node_id"], "left_semi")), key, False)
            state = settled(walked.where("done").unionByName(_moved(walked.where("not done"), found, key)))
            lost = state.where("not done").select(key, "node_id").limit(3).collect()
            if lost:
                raise ValueError(f"{NO_ROOT}: {[tuple(r) for r in lost]}")
            break
        state = settled(state.where("done").unionByName(_moved(open_, state, key)))
    return state


def _moved(open_: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Rows of open_ with the pointers of those rows of state that they point at."""
    on = state.select(key, F.col("node_id").alias("up"), F.col("up").alias("further"), F.col("way").alias("more"), F.col("done").alias("there"))
    return open_.join(on, [key, "up"], "left").select(key, "node_id", F.coalesce("further", "up").alias("up"), (F.col("way") + F.coalesce("more", F.lit(0))).alias("way"), F.coalesce("there", F.lit(False)).alias("done"))


def _above(rows: pa.Table, key: str) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the place of the row that `up` names, and whether there is one."""
    n = len(rows)
    numbers = lambda c: pc.fill_null(c.dictionary_encode().combine_chunks().indices, -1).to_numpy(zero_copy_only=False).astype("int64")
    keys, names = numbers(rows[key]), numbers(pa.chunked_array([*rows["node_id"].chunks, *rows["up"].chunks]))
    wide = names.max(initial=0) + 2
    me, on = keys * wide + names[:n], keys * wide + names[n:]
    order = np.argsort(me, kind="stable")
    place = order[np.minimum(np.searchsorted(me, on, sorter=order), max(n - 1, 0))]
    return place, (me[place] == on) & (keys >= 0) & (names[n:] >= 0)


def _walker(key: str):
    """For mapInArrow: pointers of a partition's rows as far as they lead within it. Rows on a cycle stay as they are."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held)
        n = len(rows)
        place, found = _above(rows, key)
        done, way, own = rows["done"].to_numpy(), rows["way"].to_numpy().astype("int64"), np.arange(n)
        inside = ~done & found
        to, walked = np.where(inside, place, own), np.where(inside, way, 0)
        for _ in range(n.bit_length()):
            if (to[to] == to).all():
                break
            walked, to = walked + walked[to], to[to]
        ends = ~inside[to]
        to, walked = np.where(ends, to, own), np.where(ends, walked, 0)
        moved = {"up": rows["up"].take(to), "way": pa.array((walked + way[to]).astype("int32")), "done": pa.array(done[to])}
        yield from pa.table({c: moved.get(c, rows[c]) for c in rows.column_names}).to_batches(10_000)

    return walk


def subtrees(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, node_id, size, start_page, end_page): a node's subtree, and the range of the leaves in it; trees without codes, of any depth.

    Leaves pass on what they are at once. Inner nodes are dealt to cells of near ids, within which each
    adds up what is below it in its cell. Nodes whose parent is in another cell, and those parents, are
    a smaller tree that takes pointer doubling, see _summed(); what comes up to a cell's nodes from the
    others is added up within it once more. Where ids tell nothing of the tree, that smaller one has most
    nodes. Of the tables in between the last ones are kept. A cycle is an error.
    """
    rounds = Rounds(nodes.sparkSession)
    inner = nodes.where("parent_id is not null").select(key, F.col("parent_id").alias("node_id")).distinct().withColumn("inner", F.lit(True))
    own = rounds.put(nodes.select(key, "node_id", "parent_id", "start_page", "end_page").join(inner, [key, "node_id"], "left"))
    one = F.lit(1).cast("long").alias("size")
    leaves = own.where("inner is null")
    passed = leaves.groupBy(key, F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("more"), F.min("start_page").alias("start_page"), F.max("end_page").alias("end_page"))
    above = own.where("inner").select(key, "node_id", F.col("parent_id").alias("up"))
    held = rounds.put(above.join(passed, [key, "node_id"], "left").select(key, "node_id", "up", (one + F.coalesce("more", F.lit(0))).alias("size"), "start_page", "end_page"))
    rounds.drop()
    count = max(-(-held.count() // CELL_ROWS), int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    schema = ", ".join(f"`{c}` {t}" for c, t in held.dtypes)
    # A cell's number is written down, as another dealing might draw other bounds.
    cells = rounds.put(held.repartitionByRange(count, key, "node_id").withColumn("cell", F.spark_partition_id()))
    rounds.drop(rounds.made - 1)
    of_cells = lambda df, f, also="": df.groupBy("cell").applyInArrow(f, schema + also)
    leaving = rounds.put(of_cells(cells.select(*held.columns, "cell"), _leaving(key)).select(key, "node_id", "up"))
    ports = leaving.select(key, F.col("up").alias("node_id"), F.lit(True).alias("port")).distinct()
    tops = rounds.put(of_cells(cells.join(ports, [key, "node_id"], "left"), _drawn_together(key)))
    totals = _summed(tops, key, rounds)
    add = (F.sum("size").alias("size"), F.min("start_page").alias("start_page"), F.max("end_page").alias("end_page"))
    come = totals.join(leaving, [key, "node_id"]).select(key, F.col("up").alias("node_id"), "size", "start_page", "end_page").groupBy(key, "node_id").agg(*add)
    come = come.select(key, "node_id", F.col("size").alias("more"), F.col("start_page").alias("low"), F.col("end_page").alias("high"))
    met = cells.join(come, [key, "node_id"], "left").select(
        key, "node_id", "up", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"), F.least("start_page", "low").alias("start_page"), F.greatest("end_page", "high").alias("end_page"), "cell"
    )
    summed = rounds.put(of_cells(met, _added_up(key)))
    rounds.drop(*range(2, rounds.made))
    return summed.drop("up").unionByName(leaves.select(key, "node_id", one, "start_page", "end_page"))


def _summed(tops: DataFrame, key: str, rounds: Rounds) -> DataFrame:
    """tops(key, node_id, up, size, start_page, end_page) with sizes and ranges of all below.

    By pointer doubling: after round k a node holds what the nodes less than 2^k steps below it add up
    to, and knows its ancestor 2^k steps up, which it passes that on to. A depth of d takes log2(d) rounds.
    """
    held = tops.drop("up")
    up = rounds.put(tops.where("up is not null").select(key, "node_id", "up"))
    most, first = up.count().bit_length(), rounds.made
    for k in range(most + 2):
        if up.isEmpty():
            break
        if k > most or not up.where("up = node_id").isEmpty():
            raise ValueError(f"{NO_ROOT}: {[tuple(r) for r in up.select(key, 'node_id').limit(3).collect()]}")
        passed = held.join(up, [key, "node_id"]).groupBy(key, F.col("up").alias("node_id")).agg(F.sum("size").alias("more"), F.min("start_page").alias("low"), F.max("end_page").alias("high"))
        met = held.join(passed, [key, "node_id"], "left")
        held = rounds.put(met.select(key, "node_id", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"), F.least("start_page", "low").alias("start_page"), F.greatest("end_page", "high").alias("end_page")))
        on = up.select(key, F.col("node_id").alias("up"), F.col("up").alias("further"))
        up = rounds.put(up.join(on, [key, "up"]).select(key, "node_id", F.col("further").alias("up")))
        rounds.drop(*(x for x in (rounds.made - 3, rounds.made - 2) if x >= first))
    return held


def _leaving(key: str):
    """For applyInArrow: a cell's rows whose parent is in another cell, or nowhere."""
    return lambda rows: rows.drop_columns("cell").filter(pa.array(~_above(rows, key)[1] & rows["up"].is_valid().to_numpy()))


def _below(rows: pa.Table, key: str) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """A cell's rows: the row above (-1: none here), the one where the way up ends (-1: in a cycle), and [size, low, high] of all below in the cell."""
    place, found = _above(rows, key)
    above = np.where(found, place, -1)
    wide = np.iinfo("int64")
    values = [pc.fill_null(pc.cast(rows[c], "int64"), none).to_numpy().copy() for c, none in (("size", 0), ("start_page", wide.max), ("end_page", wide.min))]
    to, end = above.copy(), np.arange(len(rows))
    for _ in range(len(rows).bit_length() + 1):
        going = np.flatnonzero(to >= 0)
        if not len(going):
            break
        at = to[going]
        for v, gather in zip(values, (np.add, np.minimum, np.maximum), strict=True):
            gather.at(v, at, v[going])
        end[going], to[going] = end[at], to[at]
    end[to >= 0] = -1
    return above, end, values


def _with(rows: pa.Table, values: list[np.ndarray]) -> pa.Table:
    """rows with these sizes and ranges; ends of int64 are null."""
    out = {c: rows[c] for c in rows.column_names if c not in ("cell", "port")}
    wide = np.iinfo("int64")
    for c, v, none in zip(("size", "start_page", "end_page"), values, (wide.min, wide.max, wide.min), strict=True):
        out[c] = pa.array(v, mask=v == none).cast(rows[c].type)
    return pa.table(out)


def _added_up(key: str):
    """For applyInArrow: a cell's rows with what is below them in it."""
    return lambda rows: _with(rows, _below(rows, key)[2])


def _drawn_together(key: str):
    """For applyInArrow: of a cell's rows those that others hang on or that leave it, each under the next such one, with what is below it but in none of them."""

    def run(rows: pa.Table) -> pa.Table:
        above, end, (size, low, high) = _below(rows, key)
        kept = (above < 0) | pc.fill_null(rows["port"], False).to_numpy() | (end < 0)
        # The next kept row above each row, by doubling over those that are not kept.
        to = above.copy()
        for _ in range(len(rows).bit_length() + 1):
            going = np.flatnonzero((to >= 0) & ~kept[np.maximum(to, 0)])
            if not len(going):
                break
            to[going] = to[to[going]]
        inside = kept & (above >= 0)
        alone = size.copy()
        np.subtract.at(alone, to[inside], size[inside])
        names, ups = rows["node_id"].combine_chunks(), rows["up"].combine_chunks()
        up = pc.if_else(pa.array(above >= 0), names.take(pa.array(np.maximum(to, 0))), ups)
        out = _with(rows, [alone, low, high])
        return out.set_column(out.column_names.index("up"), "up", up).filter(pa.array(kept))

    return run


def appended(nodes: DataFrame, trees: DataFrame, other_nodes: DataFrame, other_trees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trees with other trees of the same tree_id behind them: (nodes, trees).

    nodes(tree_id, node_id, parent_id, title, start_page, end_page, ...), trees(tree_id, total_pages,
    document_info, version). The other tree's pages come after the first one's; both get a new root, as
    its first and second child where nodes have an ordinal, a level deeper where they have a depth. All
    other columns stay as they are; one that only one side has is null on the other. Where both use a
    node_id, the other tree's nodes are named anew. A tree without another one stays as it is; one that
    is new comes as it is.
    """
    pair = trees.join(other_trees.select("tree_id", F.col("total_pages").alias("more"), F.col("document_info").alias("info")), "tree_id", "full_outer")
    both = F.col("total_pages").isNotNull() & F.col("more").isNotNull()
    total = F.coalesce("total_pages", F.lit(0)) + F.coalesce("more", F.lit(0))
    info = F.when(both, F.concat(F.lit("Combined document: "), F.col("document_info"), F.lit(" + "), F.col("info"))).otherwise(F.coalesce("document_info", "info"))
    version = F.when(F.col("total_pages").isNull(), F.lit(0)).otherwise(F.col("version") + F.when(both, 1).otherwise(0))
    made = pair.select("tree_id", total.cast("int").alias("total_pages"), info.alias("document_info"), version.cast("int").alias("version"), F.coalesce("total_pages", F.lit(0)).alias("offset"), both.alias("both"))
    root = node_id("tree_id", F.lit("combined"), F.col("version"))
    clash = nodes.select("tree_id", "node_id").join(other_nodes.select("tree_id", "node_id"), ["tree_id", "node_id"]).select("tree_id").distinct().withColumn("clash", F.lit(True))
    keep = made.join(clash, "tree_id", "left").select("tree_id", "offset", "both", "clash", "version", root.alias("root"))

    def under(own: DataFrame, place: int) -> DataFrame:
        met = own.join(keep, "tree_id")
        if place == 2:
            renamed = lambda c: F.when(F.col("clash") & F.col(c).isNotNull(), node_id("tree_id", F.col("version"), F.col(c))).otherwise(F.col(c))
            met = met.withColumns({"node_id": renamed("node_id"), "parent_id": renamed("parent_id"), "start_page": F.col("start_page") + F.col("offset"), "end_page": F.col("end_page") + F.col("offset")})
        lifted = F.col("both") & F.col("parent_id").isNull()
        changes = {"parent_id": F.when(lifted, F.col("root")).otherwise(F.col("parent_id"))}
        if "ordinal" in own.columns:
            changes["ordinal"] = F.when(lifted, F.lit(place)).otherwise(F.col("ordinal"))
        if "depth" in own.columns:
            changes["depth"] = F.col("depth") + F.when(F.col("both"), 1).otherwise(0)
        return met.withColumns(changes).select(own.columns)

    tops = made.where("both").select(
        "tree_id", root.alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("Combined Document").alias("title"), F.lit(1).alias("start_page"), F.col("total_pages").alias("end_page"),
        *(F.lit(v).alias(c) for c, v in (("ordinal", 1), ("depth", 0)) if c in nodes.columns),
    )
    return under(nodes, 1).unionByName(under(other_nodes, 2), allowMissingColumns=True).unionByName(tops, allowMissingColumns=True), made.drop("offset", "both")


def groups_merged(groups: DataFrame) -> DataFrame:
    """The trees of page groups as one for each document: groups' columns, ordinal and depth.

    groups(doc_id, group_no, node_id, parent_id, title, start_page, end_page, ...), trees of any depth:
    what stands below a group's root, or the root itself if nothing does, comes under one root. A node
    and all below it end before the next top node begins, even if that is before its own start. A
    document of one group keeps its tree. Siblings are in the order of `ordinal` if groups have one, else
    of pages; columns that only groups have are null for the new root.
    """
    names = [c for c in groups.columns if c not in ("group_no", "ordinal", "depth")]
    order = [c for c in ("ordinal", "start_page", "node_id") if c in groups.columns]
    rounds = Rounds(groups.sparkSession)
    own = levelled(groups, rounds=rounds)
    single = settled(own.where("parent_id is null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("start_page").alias("low"), F.max("end_page").alias("high")))
    marked = rounds.put(own.join(single.select("doc_id", "n"), "doc_id"))
    rounds.drop(rounds.made - 1)
    several = marked.where("n > 1 and not (level = 0 and not leaf)")
    by_start = Window.partitionBy("doc_id").orderBy("start_page", "node_id")
    beside = F.row_number().over(Window.partitionBy("doc_id", "parent_id").orderBy(*order))
    new_root = node_id("doc_id", F.lit(ROOT))
    columns = [*names, "ordinal", "depth"]
    ends = F.least("end_page", F.coalesce("limit", "end_page"))
    limited = several.where("node_id = top").withColumns({"nth": F.row_number().over(by_start), "limit": F.lead("start_page").over(by_start) - 1})
    tops = limited.withColumns({"ordinal": F.col("nth"), "depth": F.lit(1), "parent_id": new_root, "end_page": ends}).select(columns)
    alone = marked.where("n = 1").withColumns({"ordinal": beside, "depth": F.col("level")})
    root = single.where("n > 1").select("doc_id", new_root.alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(1).alias("ordinal"), F.lit(0).alias("depth"), F.lit(ROOT).alias("title"), F.col("low").alias("start_page"), F.col("high").alias("end_page"))
    lower = several.where("node_id <> top")
    out = tops.unionByName(alone.select(columns))
    if not lower.isEmpty():
        met = lower.join(limited.select("doc_id", "top", "limit"), ["doc_id", "top"])
        out = out.unionByName(met.withColumns({"ordinal": beside, "depth": F.col("level"), "end_page": ends}).select(columns))
    return out.unionByName(root, allowMissingColumns=True)


def as_json(nodes: DataFrame) -> DataFrame:
    """(doc_id, tree): each tree as JSON, children in order, without empty fields.

    nodes: (doc_id, node_id, parent_id, ordinal, title, start_page, end_page, summary). Levels are put
    together from the lowest one up, as many as there are; a level's table goes when the next one is written.
    """
    rounds = Rounds(nodes.sparkSession)
    fields = [F.col(c) for c in ("node_id", "title", "start_page", "end_page", "summary")]
    own = levelled(nodes, rounds=rounds)
    first = rounds.made
    deepest = own.agg(F.max("level")).first()[0] or 0
    below: DataFrame | None = None
    for k in range(deepest, -1, -1):
        rows = own.where(F.col("level") == k)
        rows = rows.withColumn("children", F.lit(None).cast("array<string>")) if below is None else rows.join(below, ["doc_id", "node_id"], "left")
        children = F.concat(F.lit(',"children":['), F.array_join("children", ","), F.lit("]}"))
        rows = rows.withColumn("h", F.to_json(F.struct(*fields)))
        rows = rows.withColumn("tree", F.when(F.col("children").isNull(), F.col("h")).otherwise(F.concat(F.expr("substring(h, 1, length(h) - 1)"), children)))
        if k:
            below = rounds.put(rows.groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "node_id", "tree"))), lambda c: c["tree"]).alias("children")))
            rounds.drop(*range(max(first + 1, rounds.made - 1), rounds.made))
    out = rounds.put(rows.select("doc_id", "tree"))
    rounds.drop(*range(first, rounds.made))
    return out


def outlines(groups: DataFrame) -> DataFrame:
    """groups_merged()'s input from groups(doc_id, group_no, start_page, end_page, v): v a variant {"title", "children": [{"title", "physical_index", "children"}]}.

    A level a round, over all groups at once. A section begins on its page, or where the one that holds
    it does, within that one's range, and ends where the next one beside it begins, or with what holds it.
    """
    title = F.try_variant_get("v", "$.title", "string")
    level = settled(groups.select("doc_id", "group_no", node_id("doc_id", "group_no").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.coalesce(title, F.lit(ROOT)).alias("title"), "start_page", "end_page", "v"))
    out: DataFrame | None = None
    depth = 0
    while out is None or not level.isEmpty():
        rows = level.drop("v")
        out = rows if out is None else out.unionByName(rows)
        inside = level.select("doc_id", "group_no", F.col("node_id").alias("parent_id"), "start_page", "end_page", F.try_variant_get("v", "$.children", "variant").alias("c")).where("c is not null")
        children = inside.lateralJoin(inside.sparkSession.tvf.variant_explode(F.col("c").outer())).withColumnRenamed("value", "v")
        begins = F.greatest("start_page", F.least("end_page", F.coalesce(F.try_variant_get("v", "$.physical_index", "int"), "start_page")))
        following = F.lead("at").over(Window.partitionBy("doc_id", "group_no", "parent_id").orderBy("pos"))
        own = node_id("doc_id", "group_no", "pos") if depth == 0 else node_id("parent_id", "pos")
        placed = children.withColumn("at", begins)
        level = settled(placed.select("doc_id", "group_no", own.alias("node_id"), "parent_id", title.alias("title"), F.col("at").alias("start_page"), F.greatest("at", F.coalesce(following, "end_page")).alias("end_page"), "v"))
        depth += 1
    return out


def from_json(trees: DataFrame) -> DataFrame:
    """Nodes (doc_id, node_id, parent_id, ordinal, depth, title, start_page, end_page, summary) of trees(doc_id, tree), JSON as as_json() writes it.

    The JSON becomes a variant, of which each round takes out the children of one level, in all
    documents at once; what it took them out of goes. Text that is no JSON is an error; a null tree has no nodes.
    """
    one = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind).alias(name)
    rounds = Rounds(trees.sparkSession)
    level = rounds.put(trees.where("tree is not null").select("doc_id", F.lit(None).cast("string").alias("parent_id"), F.lit(1).alias("ordinal"), F.parse_json("tree").alias("v")))
    out: DataFrame | None = None
    depth = 0
    while out is None or not level.isEmpty():
        at = rounds.made
        rows = rounds.put(level.select("doc_id", one("node_id", "string"), "parent_id", "ordinal", F.lit(depth).alias("depth"), one("title", "string"), one("start_page", "int"), one("end_page", "int"), one("summary", "string")))
        out = rows if out is None else out.unionByName(rows)
        inside = level.select("doc_id", one("node_id", "string"), F.try_variant_get("v", "$.children", "variant").alias("c")).where("c is not null")
        children = inside.lateralJoin(inside.sparkSession.tvf.variant_explode(F.col("c").outer()))
        level = rounds.put(children.select("doc_id", F.col("node_id").alias("parent_id"), (F.col("pos") + 1).alias("ordinal"), F.col("value").alias("v")))
        rounds.drop(at)  # its rows and its children are written
        depth += 1
    rounds.drop(rounds.made)
    return out


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of the index files of a folder: each file one JSON object {"root": tree, ...}, or a tree itself; doc_id is the file's path."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.parse_json("value").alias("v"))
    root = F.coalesce(F.to_json(F.try_variant_get("v", "$.root", "variant")), F.to_json("v"))
    return from_json(text.select("doc_id", root.alias("tree")))
