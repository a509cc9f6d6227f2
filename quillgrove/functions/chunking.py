"""text_chunks as a table function: FROM t, LATERAL text_chunks(t.text, 300)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from quillgrove.operators.grouping import chunks


class TextChunks:
    """(chunk_no, chunk) of a text: pieces as grouping.chunks() cuts them. A null text has none."""

    def eval(self, text: str, tokens: int) -> Iterator[tuple[int, str]]:
        if text is not None:
            yield from enumerate(chunks(text, tokens))


def register(spark: SparkSession, name: str = "text_chunks") -> None:
    """Makes the function known to SQL. Rows go to Python and back as Arrow batches."""
    spark.udtf.register(name, udtf(TextChunks, returnType="chunk_no int, chunk string", useArrow=True))
