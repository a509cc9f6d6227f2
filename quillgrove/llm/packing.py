"""Best-two-fit packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrove.llm.store import lean, spread_number, stored

#: The white space of the tokenizer's split pattern.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A run without white space and one space before it is split off by the tokenizer's pattern too,
#: so it can be encoded by itself; so can white space, but for the last of it before a word.
UNIT = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def byte_symbols() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: itself if it can be printed, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Units(dict):
    """Ids of units as unsigned 32-bit little-endian bytes. It keeps at most `most` short units.

    The vocabulary is a file of `tokenizers`. As its merges are in the order of ids, merging by id gives
    the ids that `tokenizers` gives, which tests compare; it takes half of the time on words not met before.
    Added tokens of the file (as <|endoftext|>) are found in a text before its units are.
    """

    def __init__(self, path: str, pattern: str, most: int = 150_000):
        import tiktoken
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        added = tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError(f"{path}: added tokens that take in what is around them are not known here")
        self.added = {t.content: array("I", [k]).tobytes() for k, t in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if added else lambda text: [text]
        of = byte_symbols()
        ranks = {bytes(of[c] for c in token): k for token, k in tokenizer.get_vocab(with_added_tokens=False).items() if k not in added}
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.most = most

    def __missing__(self, unit: str) -> bytes:
        ids = array("I", self.encode(unit)).tobytes()
        if len(unit) < 40:
            if len(self) >= self.most:
                self.clear()
            self[unit] = ids
        return ids

    def ids(self, text: str) -> bytes:
        parts = self.cut(text)
        if len(parts) == 1:
            return b"".join(map(self.__getitem__, UNIT.findall(text)))
        return b"".join(self.added[x] if k % 2 else b"".join(map(self.__getitem__, UNIT.findall(x))) for k, x in enumerate(parts))


_units: dict[str, Units] = {}


def units(vocabulary: str) -> Units:
    """The encoder of this process, kept between tasks."""
    import public_tokenizers

    if vocabulary not in _units:
        _units[vocabulary] = Units(public_tokenizers.path(vocabulary), public_tokenizers.PATTERN)
    return _units[vocabulary]


def pieces(docs: DataFrame, capacity: int = 2048, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """Token pieces of documents(doc_id, text): doc_id, piece, start, length, ids_crc32.

    A document is its ids and then id 0. One of more than `capacity` tokens is cut into pieces of
    `capacity`, the first being what is left over. A null or empty text gives the one piece of id 0.
    Ids are those that `tokenizers` gives for the whole text, added tokens in it included.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = units(vocabulary).ids
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + b"\0\0\0\0"
                n, piece, start = len(ids) // 4, 0, 0
                end = n % capacity or capacity
                while start < n:
                    rows.append((doc, piece, start, end - start, zlib.crc32(ids[4 * start : 4 * end])))
                    piece, start, end = piece + 1, end, end + capacity
            if rows:
                columns = zip(*rows, strict=True)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select("doc_id", "text").mapInArrow(lean(run), PIECES)


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Bins as (lengths, how many such bins), from counts[length] pieces of each length.

    A bin takes the longest piece left, then the longest that fits, and so on. If a gap is left,
    its smallest piece gives way to the two unpacked pieces that fill the widened gap best, where
    they fill it better. As pieces of a length are alike, the same bin is made as often as they last.
    """
    left, bins = counts.astype(np.int64).copy(), []
    lengths = np.arange(capacity + 1)

    def at_most() -> np.ndarray:
        return np.maximum.accumulate(np.where(left > 0, lengths, 0))

    below = at_most()
    while below[capacity]:
        filled: list[int] = []
        gap = capacity
        while gap and (x := int(below[gap])):
            filled.append(x)
            gap -= x
            left[x] -= 1
            if not left[x]:
                below = at_most()
        if gap and len(filled) > 1:
            smallest = filled[-1]
            left[smallest] += 1
            below = at_most()
            room = gap + smallest
            first = np.flatnonzero(left[: room + 1])
            second = below[room - first]
            alone = (second == first) & (left[first] < 2)
            if alone.any():  # the only piece of its length can't be both
                second[alone] = [int(below[min(x - 1, room - x)]) if x > 0 else 0 for x in first[alone]]
            sums = np.where(second > 0, first + second, 0)
            swap = [smallest]
            if len(sums) and sums[best := int(sums.argmax())] > smallest:
                swap = [int(first[best]), int(second[best])]
            filled[-1:] = swap
            for x in swap:
                left[x] -= 1
        of = {x: filled.count(x) for x in filled}
        more = min(int(left[x]) // k for x, k in of.items())
        for x, k in of.items():
            left[x] -= more * k
        below = at_most()
        bins.append((sorted(filled, reverse=True), 1 + more))
    return bins


def pack(docs: DataFrame, capacity: int = 2048, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """Packs all documents(doc_id, text) into sequences of at most `capacity` tokens.

    Returns per piece doc_id, piece, start, length, ids_crc32, sequence_id, offset. Every document
    is packed: null and empty texts are one token, repeated rows are packed each, an empty table
    gives no rows; other columns are ignored.

    Only how many pieces there are of each length (at most `capacity` numbers) goes to the driver.
    It makes the bins in terms of lengths. Pieces get numbers within their length, by cells so that
    a common length is no task of its own, and the number tells bin and place.
    """
    spark = docs.sparkSession
    made = stored(pieces(docs, capacity, vocabulary).withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in made.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[row.length] = row.n
    taken, first_bin, plan = np.zeros(capacity + 1, np.int64), 0, []
    for lengths, times in best_two_fit(counts, capacity):
        offset = 0
        for x in dict.fromkeys(lengths):
            k = lengths.count(x)
            plan.append((x, int(taken[x]), k, first_bin, offset))
            taken[x] += k * times
            offset += k * x
        first_bin += times
    table = np.array(sorted(plan) or np.zeros((0, 5)), np.int64).reshape(-1, 5)
    held = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = held.value
        keys = (plan[:, 0] << 44) + plan[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = plan[np.searchsorted(keys, (length << 44) + rank, "right") - 1]
            nth = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(5)), pa.array(row[:, 3] + nth // row[:, 2]), pa.array(row[:, 4] + nth % row[:, 2] * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = spread_number(made, "length", ["row"], "rank")
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        lean(run), PIECES + ", sequence_id long, offset long"
    )
