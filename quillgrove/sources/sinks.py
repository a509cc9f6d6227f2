"""Trees and search results as files."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrove.operators.tree import as_json


def index_name(source: str) -> str:
    return f"{source}.index.json"


def merged_name(index: str) -> str:
    return f"{index}.merged.json"


def save_nodes(nodes: DataFrame, path: str) -> None:
    """The canonical form: rows, by document."""
    nodes.write.mode("overwrite").parquet(path)


def save_json(nodes: DataFrame, path: str) -> None:
    """A line of JSON for each document's tree; children in order, empty fields left out."""
    as_json(nodes).select(F.to_json(F.struct("doc_id", F.parse_json("tree").alias("root"))).alias("value")).write.mode("overwrite").text(path)


def save_results(answers: DataFrame, found: DataFrame, path: str) -> None:
    """Search results as JSON: query, answer and the nodes referred to, in order."""
    listed = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "node_id", "title", "start_page", "end_page"))).alias("nodes"))
    answers.join(listed, "query_id", "left").write.mode("overwrite").json(path)


def tool_result(columns: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return columns.select(F.to_json(F.struct(*columns.columns)).alias("result"))


def stem(path: str) -> str:
    return PurePosixPath(path).name
