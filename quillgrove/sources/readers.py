"""Readers of files by extension, and the pages of a folder of files of several kinds."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from quillgrove.plans.lineage import settled
from quillgrove.sources.adapters import files, markdown_pages, pdf_pages, rendered, with_ocr

#: Of documents of files() of its kind, pages(doc_id, page_number, text).
Reader = Callable[[DataFrame], DataFrame]


class Readers:
    """Kinds of files by extension, and a reader for each kind."""

    def __init__(self) -> None:
        self.kinds: dict[str, str] = {}
        self.readers: dict[str, Reader] = {}

    def add(self, kind: str, extensions: Iterable[str], reader: Reader) -> Readers:
        """`reader` gets documents whose `kind` it is; an extension that is known changes hands."""
        self.kinds |= {plain(x): kind for x in extensions}
        self.readers[kind] = reader
        return self

    def reader(self, extension: str) -> Reader:
        """Of an extension in any case, with or without its dot; ValueError for one that is not known."""
        if plain(extension) not in self.kinds:
            raise ValueError(f"unsupported file type: {extension}")
        return self.readers[self.kinds[plain(extension)]]

    def pages(self, spark: SparkSession, path: str, recognise: Callable[[bytes], str] | None = None, renderer=None, calls: int = 20) -> tuple[DataFrame, DataFrame]:
        """(pages(doc_id, page_number, text), problems(doc_id, source_path, problem)) of a file, folder or glob.

        With `recognise`, PDF documents whose text layer is empty or too thin are rendered and read from the images.
        """
        docs = files(spark, path, self.kinds)
        found = None
        met = {r.kind for r in docs.where("problem is null").select("kind").distinct().collect()}  # of the registry's kinds
        for kind, reader in self.readers.items():
            if kind in met or not met and found is None:
                own = reader(docs.where((docs["kind"] == kind) & docs["content"].isNotNull()))
                found = own if found is None else found.unionByName(own)
        problems = docs.where("problem is not null").select("doc_id", "source_path", "problem")
        if recognise is None or "pdf" not in met:
            return found, problems
        pages, failed = with_ocr(settled(found), rendered(docs, renderer=renderer), recognise, calls)
        return pages, problems.unionByName(failed.join(docs.select("doc_id", "source_path"), "doc_id").select(problems.columns))


def plain(extension: str) -> str:
    return extension.lower().removeprefix(".")


#: What the library reads by itself.
READERS = Readers().add("pdf", ["pdf"], pdf_pages).add("markdown", ["md", "markdown"], markdown_pages)
