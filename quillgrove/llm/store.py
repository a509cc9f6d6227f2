"""Reading tables, written intermediate tables, and small helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    A local session that names none (tests) gets a temporary one; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillgrove-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, written as Parquet in the shared folder and reread: its lineage ends here.

    A lost executor costs the tasks that it ran, not the steps before the table. Spark deletes the
    shuffle files of earlier steps when the driver collects its garbage, which may be long after, so
    it is asked to here: they would otherwise add up to several times the input.
    """
    spark = df.sparkSession
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow; at its end the process gives back the memory that it has freed.

    Spark keeps Python workers for later tasks. Arrow and the C library keep what was freed, so each
    worker would stay as large as the largest task that it ever had, beside the executor's heap.
    """

    def leaning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)

    return leaning


#: Stands for a null id within an operator, as joins don't match nulls.
NO_ID = -(1 << 63)


def keyed(df: DataFrame, id_name: str = "doc_id") -> DataFrame:
    return df.withColumn(id_name, F.coalesce(F.col(id_name).cast("long"), F.lit(NO_ID)))


def named(df: DataFrame, id_name: str = "doc_id") -> DataFrame:
    """Undoes keyed()."""
    return df.withColumn(id_name, F.nullif(F.col(id_name), F.lit(NO_ID)))


def text_bytes(col: str | Column) -> Column:
    """UTF-8 bytes of a text, none for null."""
    return F.coalesce(F.encode(F.col(col) if isinstance(col, str) else col, "UTF-8"), F.lit(b""))


def spread_number(df: DataFrame, group: str, ties: Sequence[str], out: str, cell_rows: int = 256) -> DataFrame:
    """Adds `out`: 0, 1, 2, ... within each value of `group`, without putting a group into one task.

    Rows fall by a hash of `ties` into cells of about `cell_rows` rows, or of the square root of the
    group's rows if that is more: neither a cell nor the cells of a group are much for one task. The
    cells' counts, summed along the group, give each cell its first number; rows are numbered only
    within their cell.
    `group` must have few values (shards, lengths); rows that are equal in `ties` are interchangeable.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    dealt = df.join(F.broadcast(sizes), group).withColumn(
        "_cell", F.pmod(F.xxhash64(F.lit(71), *ties), F.ceil(F.col("_n") / F.greatest(F.lit(cell_rows), F.ceil(F.sqrt(F.col("_n").cast("double"))))))
    )
    from pyspark.sql import Window

    before = Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        dealt.groupBy(group, "_cell")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(group, "_cell", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first"))
    )
    inside = Window.partitionBy(group, "_cell").orderBy(*ties)
    return (
        dealt.join(firsts, [group, "_cell"])
        .withColumn(out, (F.col("_first") + F.row_number().over(inside) - 1).cast("long"))
        .drop("_n", "_cell", "_first")
    )


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """One table for each run of equal integer keys; the batches must arrive sorted by them."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(n, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        change[0] = last is not None and last != tuple(c[0] for c in columns)
        edges = [0, *np.flatnonzero(change).tolist(), n] if not change[0] else [*np.flatnonzero(change).tolist(), n]
        if change[0]:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            held.append(batch.slice(a, b - a))
            if b < n:
                yield pa.Table.from_batches(held)
                held = []
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str], least: int) -> Iterator[pa.Table]:
    """Tables of at least so many rows (the last may have fewer) that end where a run of equal integer keys does; batches must arrive sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        change = np.zeros(table.num_rows - 1, bool)
        for k in keys:
            c = table.column(k).to_numpy()
            change |= c[1:] != c[:-1]
        at = np.flatnonzero(change)
        if not len(at):
            held = table.to_batches()
            continue
        cut = int(at[-1]) + 1
        yield table.slice(0, cut)
        held = table.slice(cut).combine_chunks().to_batches()
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components: (node, root), root the smallest node; edges (a, b) as longs.

    Alternating large-star and small-star steps. A star's centre may have any number of rows:
    each step is an aggregation (combined before the shuffle) and a join that Spark may split.
    """
    now = stored(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges"
    )
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Stored, a side is broadcast if it is small, and else Spark may split a centre's rows.
        low = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a <> b").distinct(), "large")
        mins = stored(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        linked = large.join(mins, "a")
        small = linked.select("a", F.col("m").alias("b")).unionByName(
            linked.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        now = stored(small.where("a <> b").distinct(), "edges")
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == before:
            break
        before = seen
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
