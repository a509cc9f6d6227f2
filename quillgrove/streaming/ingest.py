"""Trees that grow as pages arrive: a Structured Streaming source of pages, appended to the trees of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from quillgrove.operators.model import Model
from quillgrove.operators.provider import Provider, by_rule
from quillgrove.plans.pipeline import update

NODES = "tree_id long, node_id string, parent_id string, ordinal int, depth int, structure string, title string, start_page int, end_page int, summary string"
TREES = "tree_id long, total_pages int, document_info string, version int"


def append_batch(spark: SparkSession, folder: str, pages: DataFrame, batch: int, provider: Provider | Model = by_rule, tokens: int = 16_000, summarise: bool = False) -> None:
    """Writes the trees with a batch's documents behind them as version `batch`; a batch that is written again is the same."""
    nodes, trees = read_trees(spark, folder, batch - 1)
    new_nodes, new_trees = update(nodes, trees, pages, provider, tokens, summarise=summarise)
    new_nodes.write.mode("overwrite").parquet(f"{folder}/nodes/version={batch}")
    new_trees.write.mode("overwrite").parquet(f"{folder}/trees/version={batch}")


def read_trees(spark: SparkSession, folder: str, version: int) -> tuple[DataFrame, DataFrame]:
    """nodes and trees as of a version; none before the first."""
    if version < 0:
        return spark.createDataFrame([], NODES), spark.createDataFrame([], TREES)
    return spark.read.schema(NODES).parquet(f"{folder}/nodes/version={version}"), spark.read.schema(TREES).parquet(f"{folder}/trees/version={version}")


def follow(pages: DataFrame, folder: str, checkpoint: str, provider: Provider | Model = by_rule, tokens: int = 16_000, summarise: bool = False, **trigger) -> StreamingQuery:
    """Starts appending the documents of a stream of pages(doc_id, page_number, text). A document's pages must come in one batch (streaming.gather takes them in any)."""

    def write(batch_pages: DataFrame, batch: int) -> None:
        append_batch(batch_pages.sparkSession, folder, batch_pages, batch, provider, tokens, summarise)

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
