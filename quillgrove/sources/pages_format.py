"""spark.read.format("quillgrove_pages"): pages of the document files of a folder, as a Spark data source.

A partition is a file. What can't be read is a row with a problem. Driver and executors must see the
same folder; where only Spark's own readers reach the files, sources.readers does the same by them.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from quillgrove.sources.adapters import EXTENSIONS, PDF_BYTES, _pypdf, markdown_text

NAME = "quillgrove_pages"
SCHEMA = "source_path string, kind string, page_number int, text string, problem string"


def _markdown(content: bytes) -> list[str]:
    return [markdown_text(content.decode("utf-8", "replace"))]


#: What turns a file's bytes into the texts of its pages, by kind.
READERS: dict[str, Callable[[bytes], list[str]]] = {"markdown": _markdown, "pdf": _pypdf}


def kind_of(path: str) -> str | None:
    extension = path.rpartition(".")[2]
    return None if extension not in EXTENSIONS else "pdf" if extension.lower() == "pdf" else "markdown"


class Pages(DataSourceReader):
    """Reads the files under `path`; filters on kind and source_path choose files before any is opened.

    A schema given to spark.read.schema() is all that is produced: without `text`, Markdown files are not
    opened at all, and others only to count their pages.
    """

    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.names = path, schema.names
        self.wanted: list[tuple[str, set[str]]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in (("kind",), ("source_path",)):
                self.wanted.append((f.attribute[0], {f.value} if isinstance(f, EqualTo) else set(f.value)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        root = self.path.removeprefix("file://")
        found = [root] if os.path.isfile(root) else sorted(os.path.join(d, x) for d, _, names in os.walk(root) for x in names if not x.startswith(("_", ".")))
        if not found and not os.path.isdir(root):
            raise FileNotFoundError(root)
        fits = lambda p: all({"kind": kind_of(p), "source_path": p}[name] in values for name, values in self.wanted)
        return [InputPartition(p) for p in found if fits(p)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path = partition.value
        if path is None:
            return
        kind, pages, problem = kind_of(path), [], None
        try:
            pages = self.pages(path, kind)
        except Exception as found:  # noqa: BLE001  reported as the file's row
            problem = f"{type(found).__name__}: {found}"
        rows = [(k + 1, text, None) for k, text in enumerate(pages)] if problem is None else [(None, None, problem)]
        for number, text, said in rows:
            row = {"source_path": path, "kind": kind, "page_number": number, "text": text, "problem": said}
            yield tuple(row[n] for n in self.names)

    def pages(self, path: str, kind: str | None) -> list[str]:
        if kind is None:
            raise ValueError("unsupported file type")
        if kind == "markdown" and "text" not in self.names:
            return [""]
        with open(path, "rb") as file:
            content = file.read(PDF_BYTES + 1 if kind == "pdf" else -1)
        if kind == "pdf" and (len(content) > PDF_BYTES or not content.startswith(b"%PDF-")):
            raise ValueError("not a PDF, or too large")
        return READERS[kind](content)


class PagesSource(DataSource):
    """The data source; option path (or load(path)) names a file or folder."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Pages:
        return Pages(self.options["path"], schema)


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, and lets Spark hand it filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagesSource)
