"""python -m quillgrove.cli generate | search | update"""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrove.functions.text import page_range
from quillgrove.operators.chat import chat
from quillgrove.operators.model import Model, ModelError
from quillgrove.operators.tree import as_json, read_json
from quillgrove.plans import pipeline
from quillgrove.plans.lineage import settled
from quillgrove.sources.readers import READERS

#: What an index file's nodes are as rows; a file is one tree, whose document is ONE.
ONE = "0"
NODES = ("node_id", "parent_id", "ordinal", "title", "start_page", "end_page", "summary")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillgrove")
    verbs = top.add_subparsers(dest="verb", required=True)
    make = verbs.add_parser("generate", help="a document's section tree")
    search = verbs.add_parser("search", help="sections that answer a query")
    update = verbs.add_parser("update", help="a tree with another document behind it")
    for verb, out in ((make, "index.json"), (update, "merged_index.json")):
        source = verb.add_mutually_exclusive_group(required=True)
        source.add_argument("--pdf")
        source.add_argument("--md")
        verb.add_argument("-o", "--output", default=out)
        verb.add_argument("--max-tokens", type=int, default=16_000)
        verb.add_argument("--max-concurrency", type=int, default=5, help="model calls under way at a time")
    make.add_argument("--verify", action="store_true", help="check titles on their pages")
    for verb in (make, update):
        verb.add_argument("--summaries", action="store_true")
    for verb in (make, search, update):
        verb.add_argument("--model", help="a model's name; without one the rules that need no network")
        verb.add_argument("--base-url", default="https://api.openai.com/v1", help="address of its chat completions service")
        verb.add_argument("--key-file", help="file with the service's key")
        verb.add_argument("--rate", type=float, help="model calls a second at most")
    search.add_argument("--index", required=True)
    search.add_argument("-q", "--query", required=True)
    search.add_argument("-o", "--output")
    update.add_argument("--existing", required=True)
    return top


def pages_of(spark: SparkSession, path: str) -> DataFrame:
    pages, problems = READERS.pages(spark, path)
    found = problems.collect()  # of one file
    if found:
        raise SystemExit("; ".join(f"{p.source_path}: {p.problem}" for p in found))
    return pages


def load(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    return read_json(spark, "file://" + os.path.abspath(path)).select(F.lit(ONE).alias("doc_id"), *NODES), held


def model_of(args: argparse.Namespace) -> Model:
    """What the options say; a request that stays without a reply ends the run."""
    calls, rate = getattr(args, "max_concurrency", 5), args.rate
    if not args.model:
        return Model(calls=calls, strict=True)
    key = ""
    if args.key_file:
        with open(args.key_file, encoding="utf-8") as file:
            key = file.read().strip()
    return Model(chat(args.base_url, args.model, key), calls, rate, strict=True)


def save(tree: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as file:
        json.dump(tree, file, ensure_ascii=False, indent=2)


def main(arguments: Sequence[str] | None = None) -> int:
    args = parser().parse_args(arguments)
    try:
        return run(args, model_of(args))
    except ModelError as problem:
        print(problem, file=sys.stderr)
        return 1


def run(args: argparse.Namespace, model: Model) -> int:
    spark = SparkSession.builder.getOrCreate()
    if args.verb == "generate":
        path = args.pdf or args.md
        pages = settled(pages_of(spark, path))
        nodes = pipeline.generate(pages, model, tokens=args.max_tokens, summarise=args.summaries, verify=args.verify)
        total = pages.count()
        save({"root": json.loads(as_json(nodes).first().tree), "total_pages": total, "document_info": path, "version": 0}, args.output)
        print(f"Pages: {total}\nNodes: {nodes.count()}\nSaved to: {args.output}")
    elif args.verb == "search":
        nodes, _ = load(spark, args.index)
        asked = spark.createDataFrame([("q", ONE, args.query)], "query_id string, doc_id string, query string")
        answers, found = pipeline.search(asked, nodes, model)
        row = answers.first()
        listed = [r.asDict() for r in found.orderBy("rank").drop("query_id").withColumn("pages", page_range("start_page", "end_page")).collect()]
        print(f"Query: {args.query}\nAnswer: {row.answer if row else None}")
        for r in listed:
            print(f"  {r['rank']}. {r['title']} ({r.pop('pages')})")
        if args.output:
            save({"query": args.query, "answer": row.answer if row else None, "nodes": listed}, args.output)
    else:
        old, held = load(spark, args.existing)
        path = args.pdf or args.md
        pages = settled(pages_of(spark, path).withColumn("doc_id", F.lit(ONE)))
        known = (ONE, held.get("total_pages") or held["root"]["end_page"], held.get("document_info") or "", held.get("version") or 0)
        trees = spark.createDataFrame([known], "tree_id string, total_pages int, document_info string, version int")
        nodes, made = pipeline.update(old.withColumnRenamed("doc_id", "tree_id"), trees, pages, model, tokens=args.max_tokens, info=F.lit(path), by_groups=False, summarise=args.summaries)
        rows = settled(nodes.withColumnRenamed("tree_id", "doc_id"))
        own = made.first()
        save({"root": json.loads(as_json(rows).first().tree), "total_pages": own.total_pages, "document_info": own.document_info, "version": own.version}, args.output)
        print(f"Pages: {own.total_pages}\nNodes: {rows.count()}\nSaved to: {args.output}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
