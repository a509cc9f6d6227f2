"""Removal of repeated byte strings by suffix arrays, at any distance and across shards.

How equal strings of `length` bytes meet in one shard. Every such string is led by the smallest
of its `GRAM`-byte hashes, its anchor. Equal strings have equal anchors, so it is enough to compare
strings of the same anchor. The starts of one document that share an anchor occurrence lie side by
side: a run, whose text is theirs together. Anchors that occur once need nothing more. Runs of the
others go to shards by anchor, each distinct run text once with the number of its occurrences; each
shard sorts the suffixes of its runs and finds the starts that share `length` bytes with a neighbour.
An anchor with too many distinct runs is spread over shards of its own, which are merged pair by
pair: the starts of one are looked up in the suffix array of the other by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrove.llm.store import keyed, lean, named, sorted_groups, stored

GRAM = 32
#: Bytes of text hashed at a time, and of run text in a shard.
BUFFER, SHARD = 1 << 20, 1 << 19
U = np.uint64


def _constants() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte; powers of an odd base and of its inverse mod 2**64."""
    random = np.random.default_rng(20240229)
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    powers = np.full((2, BUFFER + 1), 1, U)
    powers[0, 1:], powers[1, 1:] = base, inverse
    return random.integers(0, 1 << 64, 256, U), *np.multiply.accumulate(powers, axis=1)


_kept: list = []


def _hashing() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not _kept:
        _kept.extend(_constants())
    return tuple(_kept)


def runs_of(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of the texts that lie one after the other in data and end at `ends`.

    Returns for each run the anchor's hash, its text's hash, and its first and last start.
    data holds at most BUFFER bytes.
    """
    of_byte, power, inverse = _hashing()
    n, window = len(data), length - GRAM + 1
    if n < length:
        return (np.zeros(0, U),) * 2 + (np.zeros(0, np.int64),) * 2
    sums = np.zeros(n + 1, U)
    np.cumsum(of_byte[data] * power[:n], out=sums[1:])
    grams = (sums[GRAM:] - sums[: n + 1 - GRAM]) * inverse[: n + 1 - GRAM]
    key = grams ^ (grams >> U(31))
    key *= U(0xD6E8FEB86659FD93)
    key = (key >> U(24) << U(24)) | np.arange(len(key), dtype=U)
    blocks = -(-len(key) // window)
    padded = np.full(blocks * window, U(0xFFFFFFFFFFFFFFFF))
    padded[: len(key)] = key
    square = padded.reshape(blocks, window)
    forth = np.minimum.accumulate(square, axis=1).ravel()
    back = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    last = n - length  # of the starts
    anchor = (np.minimum(back[: last + 1], forth[window - 1 : last + window]) & U(0xFFFFFF)).astype(np.int64)
    begins = np.concatenate([[0], ends[:-1]])
    whole = np.zeros(last + 2, np.int8)  # +1 where a text's starts begin, -1 after them
    long = ends - begins >= length
    np.add.at(whole, begins[long], 1)
    np.add.at(whole, ends[long] - length + 1, -1)
    valid = np.cumsum(whole[:-1]) > 0
    new = np.empty(last + 1, bool)
    new[0] = True
    np.not_equal(anchor[1:], anchor[:-1], out=new[1:])
    new[begins[long]] = True
    new[1:] |= ~valid[:-1]
    first = np.flatnonzero(new & valid)
    stop = np.zeros(last + 2, bool)
    stop[:-1] = new | ~valid
    stop[-1] = True
    stops = np.flatnonzero(stop)
    end = stops[np.searchsorted(stops, first, "right")]
    texts = (sums[end - 1 + length] - sums[first]) * inverse[first]
    return grams[anchor[first]], texts * U(0xD6E8FEB86659FD93) + (end - first).astype(U), first, end - 1


def _texts(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where each row's begin; null has none."""
    column = batch.column(name).cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    return np.frombuffer(buffer, np.uint8) if buffer and buffer.size else np.zeros(0, np.uint8), offsets


def anchored(docs: DataFrame, length: int) -> DataFrame:
    """Per document its size, SHA-256 and runs, as packed numbers: anchor, run text, and first << 32 | last start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = _texts(batch, "text")
            n = batch.num_rows
            found: list[list] = [[] for _ in range(n)]
            k = 0
            while k < n:
                if at[k + 1] - at[k] > BUFFER:  # in steps that overlap by a string's other bytes
                    for a in range(at[k], at[k + 1] - length + 1, BUFFER - length + 1):
                        part = data[a : min(a + BUFFER, at[k + 1])]
                        f, t, s, e = runs_of(part, np.array([len(part)]), length)
                        found[k].append((f, t, s + (a - at[k]), e + (a - at[k])))
                    k += 1
                    continue
                stop = max(k + 1, int(np.searchsorted(at[: n + 1], at[k] + BUFFER, "right")) - 1)
                f, t, s, e = runs_of(data[at[k] : at[stop]], at[k + 1 : stop + 1] - at[k], length)
                cut = np.searchsorted(s, at[k : stop + 1] - at[k])
                for i in range(k, stop):
                    a, b = cut[i - k], cut[i - k + 1]
                    if b > a:
                        begin = at[i] - at[k]
                        found[i].append((f[a:b], t[a:b], s[a:b] - begin, e[a:b] - begin))
                k = stop
            packed: list[list[bytes]] = [[], [], []]
            for parts in found:
                for c in range(2):
                    packed[c].append(b"".join(x[c].tobytes() for x in parts))
                packed[2].append(b"".join((x[2] << 32 | x[3]).tobytes() for x in parts))
            view = memoryview(data)
            digests = [hashlib.sha256(view[at[i] : at[i + 1]]).digest() for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("doc"), pa.array(np.diff(at)), pa.array(digests, pa.binary()), *(pa.array(p, pa.binary()) for p in packed)],
                names=["doc_id", "doc", "n_bytes", "sha", "anchor", "run", "span"],
            )

    return docs.mapInArrow(lean(run), "doc_id long, doc long, n_bytes long, sha binary, anchor binary, run binary, span binary")


def _numbers(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Packed numbers of all rows of a binary column, and the row of each."""
    parts = [x.as_buffer() for x in column]
    counts = np.fromiter((len(p) for p in parts), np.int64, len(parts)) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(parts), kind), np.repeat(np.arange(len(parts)), counts)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values, _ = _numbers(batch.column(0), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(values)], names=["anchor"])


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        (anchor, row), (own, _), (span, _) = (_numbers(batch.column(c), np.int64) for c in ("anchor", "run", "span"))
        docs = batch.column("doc").to_numpy()[row]
        for a in range(0, len(anchor), 50_000):
            some = slice(a, a + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (anchor, own, docs, span)], names=["anchor", "run", "doc", "span"])


class Suffixes:
    """The sorted suffixes of byte strings, set apart by zeros, and the bytes that neighbours share."""

    def __init__(self, strings: list[bytes], length: int):
        self.length = length
        sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        self.begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        n = int((sizes + 1).sum())
        flat = np.zeros(n + 16, np.uint8)
        flat[:n] = np.frombuffer(b"\xff".join([*strings, b""]), np.uint8) + np.uint8(1)  # 0xff is in no UTF-8: it turns to 0
        self.n, self.flat = n, flat
        self.string = np.repeat(np.arange(len(strings)), sizes + 1)
        self.valid = np.arange(n) - self.begins[self.string] <= (sizes - length)[self.string]
        words = np.zeros(n + 8, U)
        for k in range(8):
            words = (words << U(8)) | flat[k : k + n + 8].astype(U)
        self.words = words

    def sort(self) -> None:
        """Larsson and Sadakane: groups of equal prefixes are refined by the ranks that lie as far ahead as these are long."""
        n = self.n
        order = np.argsort(self.words[:n])
        place = np.arange(n)
        rank = np.zeros(n, np.int64)
        same = self.words[order]
        unsorted, ahead = place, 8
        while True:
            new = np.empty(len(unsorted), bool)
            new[:1] = True
            np.not_equal(same[1:], same[:-1], out=new[1:])
            heads = np.maximum.accumulate(np.where(new, np.arange(len(unsorted)), 0))
            rank[order[unsorted]] = unsorted[heads]
            alone = new & np.append(new[1:], True)
            unsorted = unsorted[~alone]
            if not len(unsorted):
                break
            suffix = order[unsorted]
            further = np.where(suffix + ahead < n, rank[np.minimum(suffix + ahead, n - 1)] + 1, 0)
            keys = (rank[suffix] << 32) | further
            by = np.argsort(keys)
            order[unsorted], same = suffix[by], keys[by]
            ahead *= 2
        self.order = order

    def shared(self) -> np.ndarray:
        """Kasai's common prefixes: bytes that each suffix in order shares with the one before it.

        Where the bytes before a suffix and before its predecessor are equal, its prefix is the
        text's previous one less 1; only the others are compared, 8 bytes at a time.
        """
        n, order, flat = self.n, self.order, self.flat
        before = np.full(n, -1)
        before[order[1:]] = order[:-1]
        at = np.arange(n)
        led = (at > 0) & (before > 0)
        led[led] = flat[at[led] - 1] == flat[before[led] - 1]
        led[before < 0] = False
        own = np.flatnonzero(~led)
        prefix = np.zeros(n, np.int64)
        todo = own[before[own] >= 0]
        prefix[todo] = self.common(todo, before[todo])
        source = np.maximum.accumulate(np.where(led, 0, at))
        prefix = np.maximum(prefix[source] - (at - source), 0)
        return prefix[order]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at a and b share, up to the end of the text."""
        out, todo, done, n = np.zeros(len(a), np.int64), np.arange(len(a)), 0, self.n
        while len(todo):
            x, y = a[todo] + done, b[todo] + done
            inside = (x < n) & (y < n)
            todo, x, y = todo[inside], x[inside], y[inside]
            differ = self.words[x] ^ self.words[y]
            equal = np.full(len(todo), 8)
            for k in range(1, 9):
                equal -= differ >= (U(1) << U(64 - 8 * k))
            out[todo] += np.where(differ == 0, 8, equal)
            todo = todo[differ == 0]
            done += 8
        return np.minimum(out, n - np.maximum(a, b))

    def repeated(self) -> np.ndarray:
        """For each position, whether `length` bytes that begin there also begin elsewhere."""
        self.sort()
        enough = np.append(self.shared() >= self.length, False)
        marks = np.zeros(self.n, bool)
        marks[self.order] = enough[:-1] | enough[1:]
        return marks & self.valid

    def search(self, other: Suffixes) -> tuple[np.ndarray, np.ndarray]:
        """Which positions of this text, and of the other, begin `length` bytes that both hold.

        The other's are looked up in this one's sorted suffixes by binary search.
        """
        self.sort()
        starts = np.flatnonzero(other.valid)
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), self.n)

        def order_of(query: np.ndarray, suffix: np.ndarray) -> np.ndarray:
            """-1, 0 or 1 as the suffix is before, equal to or after the query's first `length` bytes."""
            out, todo = np.zeros(len(query), np.int64), np.arange(len(query))
            for done in range(0, self.length, 8):
                keep = min(8, self.length - done)
                x = other.words[query[todo] + done] >> U(64 - 8 * keep)
                y = np.where(suffix[todo] + done < self.n, self.words[np.minimum(suffix[todo] + done, self.n)], U(0)) >> U(64 - 8 * keep)
                out[todo] = np.where(y < x, -1, (y > x).astype(np.int64))
                todo = todo[x == y]
                if not len(todo):
                    break
            return out

        while (open_ := low < high).any():
            k = np.flatnonzero(open_)
            middle = (low[k] + high[k]) // 2
            less = order_of(starts[k], self.order[middle]) < 0
            low[k[less]], high[k[~less]] = middle[less] + 1, middle[~less]
        there = low < self.n
        there[there] = order_of(starts[there], self.order[low[there]]) == 0
        theirs = np.zeros(other.n, bool)
        theirs[starts[there]] = True
        group = np.cumsum(self.shared() < self.length)
        hit = np.zeros(self.n + 2, bool)
        hit[group[low[there]]] = True
        mine = np.zeros(self.n, bool)
        mine[self.order] = hit[group]
        return mine & self.valid, theirs


def _ranges(marks: np.ndarray) -> np.ndarray:
    """First and last (pairs) of the stretches that are marked."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marks.view(np.int8), [0]])))
    edge[1::2] -= 1
    return edge


def _shard(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for group in sorted_groups(batches, ["shard", "i", "j"]):
        anchor, own = (group.column(c).to_numpy() for c in ("anchor", "run"))
        once = np.append(True, (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1]))  # copies of a row bring a text again
        group = group.filter(pa.array(once))
        anchor, own, often, side = (group.column(c).to_numpy() for c in ("anchor", "run", "often", "side"))
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        texts = group.column("text").to_pylist()
        parts = [np.arange(len(texts))] if i == j else [np.flatnonzero(side == i), np.flatnonzero(side == j)]
        if not all(map(len, parts)):
            continue
        made = [Suffixes([texts[x] for x in part], length) for part in parts]
        marks = [made[0].repeated()] if i == j else made[0].search(made[1])
        rows: list[tuple] = []
        for part, suffixes, found in zip(parts, made, marks, strict=True):
            ends = np.append(suffixes.begins[1:], suffixes.n) - 1
            found[np.repeat(often[part] > 1, ends - suffixes.begins + 1) & suffixes.valid] = True
            flat = _ranges(found)
            of = suffixes.string[flat[::2]]
            cut = np.searchsorted(of, np.arange(len(part) + 1))
            for x in np.unique(of):
                own_ranges = flat[2 * cut[x] : 2 * cut[x + 1]] - suffixes.begins[x]
                rows.append((int(anchor[part[x]]), int(own[part[x]]), own_ranges.astype(np.uint32).tobytes()))
        if rows:
            a, r, m = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(r, pa.int64()), pa.array(m, pa.binary())], names=["anchor", "run", "marks"])


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The texts of runs: rows (doc, runs) joined with the document's text."""
    for batch in batches:
        data, at = _texts(batch, "text")
        view, lists = memoryview(data), batch.column("runs")
        offsets, flat = lists.offsets.to_numpy(), lists.flatten()
        offsets = offsets - offsets[0]
        values = [flat.field(k).to_numpy(zero_copy_only=False) for k in range(5)]
        row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        begin, end = at[row] + (values[4] >> 32), at[row] + (values[4] & 0xFFFFFFFF) + length
        for a in range(0, len(row), 20_000):
            some = slice(a, a + 20_000)
            texts = pa.array([view[x:y].tobytes() for x, y in zip(begin[some].tolist(), end[some].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(pa.array(v[some]) for v in values[:4]), texts], names=["anchor", "run", "often", "blocks", "text"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes covered in a document, as maximal stretches (pairs of begin and end)."""
    for batch in batches:
        lists = batch.column("stretches")
        offsets, flat = lists.offsets.to_numpy(), lists.flatten()
        offsets = offsets - offsets[0]
        begin, end = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(2))
        spans, removed, count = [], [], []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            by = np.argsort(begin[a:b], kind="stable")
            x, y = begin[a:b][by], np.maximum.accumulate(end[a:b][by])
            new = np.append(True, x[1:] > y[:-1])
            first, last = x[new], y[np.append(np.flatnonzero(new)[1:] - 1, b - a - 1)]
            spans.append(np.stack([first, last], 1).astype(np.uint32).tobytes())
            removed.append(int((last - first).sum()))
            count.append(len(first))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(spans, pa.binary())],
            names=["doc", "n_removed", "n_spans", "spans"],
        )


def _kept_bytes(text: memoryview, spans: bytes) -> bytes:
    pairs = np.frombuffer(spans, np.uint32).tolist()
    edges = [0, *pairs, len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _stretches(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Covered bytes of a document from the marks of its runs."""
    for batch in batches:
        marks, row = _numbers(batch.column("marks"), np.uint32)
        marks, row = marks.astype(np.int64), row[::2]
        first = batch.column("span").to_numpy()[row] >> 32
        yield pa.RecordBatch.from_arrays(
            [pa.array(batch.column("doc").to_numpy()[row]), pa.array(first + marks[::2]), pa.array(first + marks[1::2] + length)], names=["doc", "a", "b"]
        )


def repeats(docs: DataFrame, length: int = 200) -> tuple[DataFrame, DataFrame]:
    """Which bytes of documents(doc_id, text) lie in strings of `length` bytes that also start elsewhere.

    Returns two tables. The first has a row for each input row: doc_id, doc (a hash of id and text),
    n_bytes, sha (of the text), n_removed, n_spans, spans (packed begin and end of maximal
    stretches; null if none). The second has doc and text of the documents that share any anchor,
    all those with spans among them. Ids here are keyed().

    Null and empty texts, and those shorter than `length`, have no spans. Rows that are equal in
    everything are documents of their own, so a text of `length` bytes in both goes from both.
    """
    docs = keyed(docs).select("doc_id", F.xxhash64("doc_id", "text").alias("doc"), "text")
    base = stored(anchored(docs, length), "runs")
    often = base.select("anchor").mapInArrow(lean(_anchors), "anchor long").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    places = base.select("doc", "anchor", "run", "span").mapInArrow(lean(_occurrences), "anchor long, run long, doc long, span long")
    places = stored(places.join(stored(often.select("anchor"), "anchors"), "anchor"), "places")
    distinct = places.groupBy("anchor", "run").agg(F.count(F.lit(1)).alias("often"), F.min(F.struct("doc", "span")).alias("p"))
    distinct = stored(distinct.select("anchor", "run", "often", "p.*"), "distinct")
    size = F.expr(f"(span & 4294967295L) - shiftright(span, 32) + {length + 1}")
    total = distinct.agg(F.sum(size)).first()[0] or 0
    shards = max(1, -(-total // SHARD))
    blocks = stored(distinct.groupBy("anchor").agg(F.ceil(F.sum(size) / SHARD).alias("blocks")).where("blocks > 1"), "blocks")
    wanted = distinct.join(blocks, "anchor", "left").groupBy("doc").agg(F.collect_list(F.struct("anchor", "run", "often", F.coalesce("blocks", F.lit(1)).alias("blocks"), "span")).alias("runs"))
    # Texts are joined by sorting at every size: what fits into a broadcast here won't on a large corpus.
    ids = stored(places.select("doc").distinct(), "ids")
    texts = stored(docs.select("doc", "text").join(ids.hint("merge"), "doc"), "texts")
    cut = wanted.hint("merge").join(texts, "doc").mapInArrow(lean(lambda b: _cut(b, length)), "anchor long, run long, often long, blocks long, text binary")
    cut = cut.withColumn("side", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("run"), "blocks")).otherwise(-1).cast("int"))
    light = cut.where("side < 0").select(F.pmod("anchor", F.lit(shards)).alias("shard"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), "side", "anchor", "run", "often", "text")
    heavy = cut.where("side >= 0").withColumn("k", F.explode(F.expr("sequence(0, cast(blocks as int) - 1)")))
    heavy = heavy.select(F.col("anchor").alias("shard"), F.least("side", "k").alias("i"), F.greatest("side", "k").alias("j"), "side", "anchor", "run", "often", "text")
    # Few anchors, if any, are spread; without them the texts of runs are cut once.
    both = light if blocks.isEmpty() else light.unionByName(heavy)
    dealt = both.repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j", "anchor", "run")
    found = stored(dealt.mapInArrow(lean(lambda b: _shard(b, length)), "anchor long, run long, marks binary"), "marks")
    marked = places.join(found, ["anchor", "run"]).mapInArrow(lean(lambda b: _stretches(b, length)), "doc long, a long, b long")
    covered = marked.groupBy("doc").agg(F.collect_set(F.struct("a", "b")).alias("stretches"))
    spans = stored(covered.mapInArrow(lean(_merge), "doc long, n_removed long, n_spans long, spans binary"), "spans")
    return base.select("doc_id", "doc", "n_bytes", "sha").join(spans, "doc", "left"), texts


def removed(docs: DataFrame, length: int = 200) -> DataFrame:
    """Per document what `repeats` removes: doc_id, doc, n_bytes, n_removed, n_spans, kept_sha256, kept.

    `kept` is the remaining text if some bytes are removed and some remain, less the bytes of
    characters cut in two; null otherwise: then either all bytes remain or none does. kept_sha256 is
    of all remaining bytes. Every input row gives a row.
    """
    spans, texts = repeats(docs, length)
    spans = stored(spans, "decided")
    plain = spans.where("n_removed is null or n_removed = n_bytes").select(
        "doc_id", "doc", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.when(F.col("n_removed").isNull(), F.lower(F.hex("sha"))).otherwise(F.lit(hashlib.sha256(b"").hexdigest())).alias("kept_sha256"),
        F.lit(None).cast("string").alias("kept"),
    )
    partly = spans.where("n_removed < n_bytes").drop("sha").dropDuplicates(["doc"])  # each copy of a row meets one

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = _texts(batch, "text")
            view = memoryview(data)
            kept = [_kept_bytes(view[at[i] : at[i + 1]], own.as_py()) for i, own in enumerate(batch.column("spans"))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "doc", "n_bytes", "n_removed", "n_spans")), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string())],
                names=["doc_id", "doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    cut = partly.hint("merge").join(texts, "doc").mapInArrow(lean(run), "doc_id long, doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")
    return named(plain.unionByName(cut))
