"""From raw documents to packed sequences: five stages, each on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrove.llm import decontaminate, jaccard_join, packing, suffix_dedup, toxicity
from quillgrove.llm.store import NO_ID, keyed, stored, table


def _doc() -> Column:
    """The operators' hash of a row's id and text."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "text")


#: Rows of an Arrow batch at most. Of whole texts the default of 10,000 are tens of MB, which an executor holds several times beside its heap.
BATCH_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    """Sets Arrow's batches for the session, as they are made when a stage's result is read, after its function has ended."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the labelled ones among them, rejects go.

    Null and empty texts get what the biases say; repeated rows fare alike; an empty table stays empty.
    """
    _small_batches(spark)
    chain = toxicity.chain_for(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, chain).where(F.col("p_toxic") <= toxicity.LIMIT).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document of the smallest doc_id stays, of equal rows one. Those without words all stay.

    A null doc_id counts as the smallest; null and empty texts have no words; an empty table stays empty.
    """
    _small_batches(spark)
    keys = ["_id", "_h1", "_h2"]
    found = keyed(jaccard_join.join(docs)).where("class_node is not null")
    found = stored(found.select(F.col("doc_id").alias("_id"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "class_node"), "classes")
    stays = stored(found.groupBy("class_node").agg(F.min(F.struct(*keys)).alias("s")).select("s.*"), "stays")
    goes = stored(found.select(keys).distinct().join(stays, keys, "left_anti"), "goes")
    own = docs.withColumns(dict(zip(keys, (F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), *jaccard_join.text_keys()), strict=True)))
    rest = own.join(goes, keys, "left_anti")
    again = stored(found.groupBy(keys).count().where("count > 1").select(keys), "again")  # rows that repeat one in id and text
    if not again.isEmpty():
        rest = rest.join(again, keys, "left_anti").unionByName(rest.join(again, keys, "left_semi").dropDuplicates(keys))
    return rest.select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in strings that occur elsewhere too go from the texts; bytes of a character cut in two go with them.

    A null text stays null, an empty one empty; repeated rows are occurrences of each other, so what they
    share from 200 bytes on goes from all of them; an empty table stays empty, and other columns as they are.
    """
    _small_batches(spark)
    found = suffix_dedup.removed(docs).where("n_removed > 0").dropDuplicates(["doc"])
    found = stored(found.select(F.col("doc").alias("_doc"), F.coalesce("kept", F.lit("")).alias("_kept")), "cut")
    met = docs.withColumn("_doc", _doc()).join(found, "_doc", "left")
    changed = F.col("_kept").isNotNull()
    met = met.withColumn("text", F.coalesce("_kept", "text"))
    if "n_chars" in docs.columns:
        met = met.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return met.select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and empty texts hold none; repeated rows go or stay together; an empty table stays empty, and
    without items all stay.
    """
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc").alias("_doc")).distinct()
    return docs.withColumn("_doc", _doc()).join(stored(found, "contaminated"), "_doc", "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of all documents in sequences; null and empty texts are one token each, repeated rows are packed each."""
    _small_batches(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL can express none of the learned, iterative and byte-wise stages; tests compare each with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
