"""Token estimates, context limits, batch sizes and retry delays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgrove.functions.text import col

# Tokens that models take, by name.
LIMITS: dict[str, int] = {
    "gpt-4": 8192,
    "gpt-4-0613": 8192,
    "gpt-4-32k": 32768,
    "gpt-4-32k-0613": 32768,
    "gpt-4-turbo": 128000,
    "gpt-4-turbo-2024-04-09": 128000,
    "gpt-4o": 128000,
    "gpt-4o-2024-05-13": 128000,
    "gpt-4o-mini": 128000,
    "gpt-4o-mini-2024-07-18": 128000,
    "gpt-3.5-turbo": 4096,
    "gpt-3.5-turbo-0613": 4096,
    "gpt-3.5-turbo-16k": 16384,
    "gpt-3.5-turbo-16k-0613": 16384,
    "gpt-3.5-turbo-instruct": 4096,
    "claude-3-opus-20240229": 200000,
    "claude-3-sonnet-20240229": 200000,
    "claude-3-haiku-20240307": 200000,
    "claude-2.1": 200000,
    "claude-2.0": 100000,
    "claude-instant-1.2": 100000,
    "Mistral-7B-Instruct-v0.3": 32768,
    "Mixtral-8x7B-Instruct-v0.1": 32768,
    "Mixtral-8x22B-Instruct-v0.1": 65536,
    "Gemma-2-2B-it": 8192,
    "Gemma-2-9B-it": 8192,
    "Gemma-2-27B-it": 8192,
    "Phi-3-mini-4k-instruct": 4096,
    "Phi-3-small-8k-instruct": 4096,
    "Phi-3-medium-4k-instruct": 4096,
}
FAMILIES = {"Qwen": 32768, "Llama": 8192}
OTHER = 32768


def estimate(text: Column | str) -> Column:
    """A token for every four bytes."""
    return F.floor(F.octet_length(col(text)) / 4).cast("int")


def truncated(text: Column | str, most: int) -> Column:
    """The text's beginning that `estimate` takes for at most `most` tokens, cut between characters."""
    held = F.substring(col(text), 1, 4 * most)
    bytes_ = F.encode(held, "UTF-8")
    cut = F.substring(bytes_, 1, 4 * most)
    whole = F.regexp_replace(cut.cast("string"), r"\x{FFFD}+$", "")
    return F.when(F.octet_length(col(text)) <= 4 * most, col(text)).otherwise(whole)


def bpe_count(text: Column | str, path: str) -> Column:
    """Tokens of a vocabulary, of which `path` is a file of the tokenizers library on every executor; null for null."""
    return _bpe(path, lambda own, texts: [len(e.ids) for e in own.encode_batch(texts, add_special_tokens=False)], "int")(col(text))


def bpe_truncated(text: Column | str, most: int, path: str) -> Column:
    """The text's beginning of `most` tokens, cut between characters; a text that has no more stays as it is."""

    def cut(own, texts: list[str]) -> list[str]:
        return [t if len(e.ids) <= most else t[: e.offsets[most][0]] for t, e in zip(texts, own.encode_batch(texts, add_special_tokens=False), strict=True)]

    return _bpe(path, cut, "string")(col(text))


def _bpe(path: str, work: Callable, kind: str):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        for batch in batches:
            known = batch.notna()
            out = pd.Series([None] * len(batch), dtype=object)
            out[known.to_numpy()] = work(own, batch[known].tolist())
            yield out.astype("Int32") if kind == "int" else out

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, kind)


def context_limit(model: Column | str) -> Column:
    """Tokens that a model takes: by name, else by family, else 32768."""
    names = F.create_map(*(F.lit(x) for pair in LIMITS.items() for x in pair))
    family = F.lit(OTHER)
    for prefix, limit in FAMILIES.items():
        family = F.when(col(model).startswith(prefix), limit).otherwise(family)
    return F.coalesce(F.try_element_at(names, col(model)), family)


def safe_limit(model: Column | str) -> Column:
    """Four fifths of the context less 1600 tokens for prompt and reply, 1000 at least."""
    return F.greatest(F.lit(1000), (F.floor(context_limit(model) * 80 / 100) - 1600).cast("int"))


def batch_plan(nodes: Column | str, tokens: Column | str) -> Column:
    """How many nodes and tokens a batch of summaries takes."""
    n, t = col(nodes), col(tokens)
    size = F.greatest(F.lit(5), F.least(F.lit(50), F.floor(n / 10).cast("int")))
    most = F.greatest(F.lit(10_000), F.least(F.lit(100_000), (F.floor(t / F.greatest(n, F.lit(1))) * size).cast("int")))
    return F.struct(F.when(n <= 5, n).otherwise(size).cast("int").alias("size"), F.when(n <= 5, 100_000).otherwise(most).cast("int").alias("tokens"))


def retry_delay(attempt: Column | str, first: float = 1.0, factor: float = 2.0, most: float = 32.0) -> Column:
    """Seconds to wait before a further attempt (0 is the first)."""
    return F.least(F.lit(first) * F.pow(F.lit(factor), col(attempt)), F.lit(most))
