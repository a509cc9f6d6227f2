"""Near-duplicate join on the Jaccard similarity of word n-grams, with Bayesian candidate pruning.

Texts that share a band of MinHash values are candidates. They are compared within the band's bucket
by one byte of each MinHash value, a few at a time: a pair is dropped as soon as the posterior
probability that it reaches the threshold is below the tolerance. What the pairs left tie together is a
component. Its texts of comparable size are compared block by block, with whole MinHash values first;
the pairs left then are verified on their whole n-gram sets. Pairs never become rows: a bucket returns
which of its texts hang together, a block that and each text's number of links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrove.llm.store import NO_ID, components, keyed, lean, named, sorted_groups, stored, whole_groups

U = np.uint64
GRAM, THRESHOLD = 5, Fraction(8, 10)
#: A pair at the threshold shares none of the bands with a probability of 1.3e-7.
BANDS, ROWS = 40, 5
HASHES = BANDS * ROWS
#: MinHash values compared between two prunings, and the probability under which a pair is dropped.
STEP, TOLERANCE = 25, 1e-7
#: Texts on one side of a block, texts of a bucket that are tied together at once, and in a bucket of
#: which all pairs are looked at.
BLOCK, BUCKET, FEW = 64, 2048, 8

_made: dict = {}


def _fixed() -> tuple[np.ndarray, ...]:
    """Numbers for bytes, n-gram places and hash functions; the table that lowers A-Z; white space."""
    if not _made:
        random = np.random.default_rng(20240307)
        draw = lambda n: random.integers(0, 1 << 64, n, U) | U(1)
        lower = np.arange(256)
        lower[65:91] += 32
        space = np.zeros(256, bool)
        space[[32, *range(9, 14)]] = True
        _made["fixed"] = draw(256)[lower], draw(64), draw(HASHES)[:, None], draw(HASHES)[:, None], space
    return _made["fixed"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of an odd base, and of its inverse, mod 2**64."""
    if len(_made.get("powers", [[]])[0]) < n:
        base = 0x9E3779B97F4A7C15
        powers = np.full((2, max(n, 1 << 18)), 1, U)
        powers[0, 1:], powers[1, 1:] = base, pow(base, -1, 1 << 64)
        _made["powers"] = np.multiply.accumulate(powers, axis=1)
    return tuple(_made["powers"])


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(29))


def grams(data: np.ndarray, n: int = GRAM) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's n-grams of words; all its words are one if they are fewer.

    Words are what white space (space, \\t to \\r) sets apart, with A-Z lowered.
    """
    of_byte, of_place, _, _, space = _fixed()
    gap = space[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]])))
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return np.zeros(0, U)
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(of_byte[data] * power[: len(data)], out=sums[1:])
    words = _mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(U))
    width = min(n, len(words))
    out = np.full(len(words) - width + 1, U(width))
    for k in range(width):
        out += words[k : len(words) - width + 1 + k] * of_place[k]
    return np.unique(_mix(out))


def signature(found: np.ndarray) -> np.ndarray:
    """HASHES MinHash values of a set of hashes, 32 bits each."""
    _, _, factor, addend, _ = _fixed()
    least = np.full(HASHES, U(0xFFFFFFFFFFFFFFFF))
    for a in range(0, len(found), 512):
        np.minimum(least, (factor * found[a : a + 512] + addend).min(axis=1), out=least)
    return (least >> U(32)).astype(np.uint32)


def bands(values: np.ndarray) -> np.ndarray:
    _, of_place, _, _, _ = _fixed()
    rows = values.reshape(BANDS, ROWS).astype(U)
    return _mix((rows * of_place[:ROWS]).sum(axis=1, dtype=U) + np.arange(BANDS, dtype=U) * of_place[9])


def least_matches(compared: int, threshold: float, tolerance: float) -> int:
    """Fewest equal values among those compared that keep a pair.

    With a uniform prior, the similarity after m equal values of n has the distribution
    Beta(m + 1, n - m + 1), whose tail from the threshold on is a sum of binomial terms.
    """
    tail = 0.0
    for m in range(compared + 1):
        tail += math.comb(compared + 1, m) * threshold**m * (1 - threshold) ** (compared + 1 - m)
        if tail >= tolerance:
            return m
    return compared


def linked(left: list, right: list | None, threshold: Fraction, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (indices into left and right, or into left alone) of at least the threshold.

    Each side: a matrix of MinHash values and a list of sorted n-gram hashes.
    """
    own = right is None
    (a, x), (b, y) = left, left if own else right
    steps = _steps(threshold, tolerance)
    same = np.zeros((len(a), len(b)), np.int16)
    for k in range(STEP):
        same += a[:, k, None] == b[None, :, k]
    keep = same >= steps[0]
    i, j = np.nonzero(np.triu(keep, 1) if own else keep)
    count = same[i, j]
    for at, least in enumerate(steps[1:], 1):
        part = slice(at * STEP, (at + 1) * STEP)
        count = count + (a[i, part] == b[j, part]).sum(axis=1)
        stay = count >= least
        i, j, count = i[stay], j[stay], count[stay]
    if not len(i):
        return i, j
    p, q = threshold.numerator, threshold.denominator
    if len(i) < 16:
        both = np.array([len(np.intersect1d(x[s], y[t], assume_unique=True)) for s, t in zip(i, j, strict=True)])
    else:
        both = _intersections(x, x if own else y, own)[i, j]
    union = np.array([len(s) for s in x])[i] + np.array([len(t) for t in y])[j] - both
    good = both * q >= p * union
    return i[good], j[good]


def _intersections(x: list, y: list, own: bool) -> np.ndarray:
    """Sizes of the intersections of all sets of x with all of y, by products of incidence matrices."""
    sets = x if own else [*x, *y]
    sizes = [len(s) for s in sets]
    values, index, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = np.flatnonzero(often > 1)
    column = np.full(len(values), -1)
    column[shared] = np.arange(len(shared))
    column = column[index]
    out = np.zeros((len(x), len(x) if own else len(y)), np.float64)
    by = np.argsort(column, kind="stable")
    column, row = column[by], row[by]
    for a in range(0, len(shared), 4096):
        s = slice(*np.searchsorted(column, [a, a + 4096]))
        matrix = np.zeros((len(sets), min(4096, len(shared) - a)), np.float32)
        matrix[row[s], column[s] - a] = 1
        out += matrix[: len(x)] @ (matrix if own else matrix[len(x) :]).T
    return out.astype(np.int64)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n, the least index that pairs tie it to."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            return root


def _column_bytes(column: pa.Array) -> Iterator[np.ndarray]:
    for x in column.cast(pa.large_binary()).fill_null(b""):
        buffer = x.as_buffer()
        yield np.frombuffer(buffer, np.uint8) if buffer.size else np.zeros(0, np.uint8)


def _steps(threshold: Fraction, tolerance: float) -> list[int]:
    return [least_matches(k, float(threshold), tolerance) for k in range(STEP, HASHES + 1, STEP)]


def alike(low: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: Fraction, steps: list[int]) -> np.ndarray:
    """Which pairs of rows a and b may reach the threshold, by their numbers of n-grams and single bytes of MinHash values."""
    stay = np.flatnonzero(np.minimum(sizes[a], sizes[b]) * threshold.denominator >= np.maximum(sizes[a], sizes[b]) * threshold.numerator)
    count = np.zeros(len(stay), np.int64)
    for at, least in enumerate(steps):
        part = slice(at * STEP, (at + 1) * STEP)
        count = count + (low[a[stay], part] == low[b[stay], part]).sum(axis=1)
        own = count >= least
        stay, count = stay[own], count[own]
    out = np.zeros(len(a), bool)
    out[stay] = True
    return out


def _spanning(low: np.ndarray, sizes: np.ndarray, first: int, end: int, threshold: Fraction, steps: list[int]) -> tuple[list, list]:
    """Pairs that tie together what hangs together among rows first..end: what is reached is not compared again."""
    out: tuple[list, list] = [], []
    left = np.arange(first, end)
    ahead: list[int] = []
    while len(left):
        if not ahead:
            ahead, left = [int(left[0])], left[1:]
        x = ahead.pop()
        hit = alike(low, sizes, np.full(len(left), x), left, threshold, steps)
        ahead += left[hit].tolist()
        out[0].append(np.full(hit.sum(), x))
        out[1].append(left[hit])
        left = left[~hit]
    return out


def _tied(batches: Iterator[pa.RecordBatch], threshold: Fraction, tolerance: float) -> Iterator[pa.RecordBatch]:
    """(node, root) of the texts of a bucket that hang together."""
    steps = _steps(threshold, tolerance)
    for table in whole_groups(batches, ["band", "i", "j"], 20_000):
        node, sizes, band, one, two = (table.column(c).to_numpy() for c in ("node", "n_grams", "band", "i", "j"))
        low = np.frombuffer(b"".join(x.as_buffer() for x in table.column("low")), np.uint8).reshape(-1, HASHES)
        begin = np.flatnonzero(np.append(True, (band[1:] != band[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
        many = np.diff(np.append(begin, len(node)))
        of = np.repeat(np.arange(len(begin)), many)
        i, j = [], []
        for d in range(1, FEW):
            a = np.flatnonzero((of[d:] == of[:-d]) & (many[of[d:]] <= FEW)) if len(of) > d else np.zeros(0, np.int64)
            a = a[alike(low, sizes, a, a + d, threshold, steps)]
            i.append(a)
            j.append(a + d)
        for g in np.flatnonzero(many > FEW).tolist():
            a, b = _spanning(low, sizes, int(begin[g]), int(begin[g] + many[g]), threshold, steps)
            i += a
            j += b
        root = _roots(len(node), np.concatenate(i).astype(np.int64), np.concatenate(j).astype(np.int64))
        k = np.flatnonzero(root != np.arange(len(node)))
        if len(k):
            yield pa.RecordBatch.from_arrays([pa.array(node[k]), pa.array(node[root[k]])], names=["a", "b"])


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, packed, low = [], [], []
        for text in _column_bytes(batch.column("text")):
            found = grams(text)
            values = signature(found) if len(found) else None
            sizes.append(len(found))
            packed.append(bands(values).tobytes() if len(found) else None)
            low.append(values.astype(np.uint8).tobytes() if len(found) else None)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in KEYS), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary()), pa.array(low, pa.binary())],
            names=[*KEYS, "n_grams", "bands", "low"],
        )


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.frombuffer(b"".join(x.as_buffer() for x in batch.column("bands")), np.int64)
        nodes = batch.column("node").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(np.repeat(nodes, BANDS))], names=["band", "node"])


def _payload(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed, values = [], []
        for text in _column_bytes(batch.column("text")):
            found = grams(text)
            packed.append(found.tobytes())
            values.append(signature(found).tobytes())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("part", "cell", "block", "blocks", "above", "below", "node")), pa.array(values, pa.binary()), pa.array(packed, pa.binary())],
            names=["part", "cell", "block", "blocks", "above", "below", "node", "hashes", "grams"],
        )


def _compare(batches: Iterator[pa.RecordBatch], threshold: Fraction, tolerance: float) -> Iterator[pa.RecordBatch]:
    for group in sorted_groups(batches, ["part", "cell", "other", "i", "j"]):
        if group.num_rows < 2:
            continue
        node, side = (group.column(c).to_numpy() for c in ("node", "side"))
        once = np.append(True, node[1:] != node[:-1])  # copies of a row bring a text again
        if not once.all():
            group = group.filter(pa.array(once))
            node, side = node[once], side[once]
        values = np.frombuffer(b"".join(x.as_buffer() for x in group.column("hashes")), np.uint32).reshape(-1, HASHES)
        sets = [np.frombuffer(x.as_buffer(), U) for x in group.column("grams")]
        if (side == side[0]).all():
            if group.column("i")[0].as_py() != group.column("j")[0].as_py() or group.column("cell")[0].as_py() != group.column("other")[0].as_py():
                continue
            i, j = linked([values, sets], None, threshold, tolerance)
        else:
            one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            i, j = linked([values[one], [sets[k] for k in one]], [values[two], [sets[k] for k in two]], threshold, tolerance)
            i, j = one[i], two[j]
        if len(i):
            links = np.bincount(i, minlength=len(node)) + np.bincount(j, minlength=len(node))
            root = node[_roots(len(node), i, j)]
            k = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(node[k]), pa.array(links[k]), pa.array(root[k])], names=["node", "links", "root"])


#: A row's id, and two hashes that stand for its text.
KEYS = ("doc_id", "h1", "h2")


def text_keys() -> tuple:
    """Two independent 64-bit hashes of a text."""
    return F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(29), "text").alias("h2")


def candidates(texts: DataFrame, threshold: Fraction, tolerance: float) -> DataFrame:
    """(a, b) that tie together all texts(node, n_grams, bands, low) that may be links: they share a bucket and pass its pruning.

    A bucket of more than BUCKET texts is cut into parts, of which any two meet.
    """
    rows = texts.select("node", "bands").mapInArrow(lean(_spread), "band long, node long")
    shared = stored(rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    met = rows.join(shared, "band").withColumn("parts", F.ceil(F.col("n") / BUCKET).cast("int"))
    met = stored(met.withColumn("part", F.pmod(F.xxhash64(F.lit(5), "node"), "parts").cast("int")), "buckets")
    pairs = F.expr("if(parts = 1, array(struct(0 as i, 0 as j)), transform(filter(sequence(0, parts - 1), k -> k <> part), k -> struct(least(k, part) as i, greatest(k, part) as j)))")
    # By sorting at every size: what fits into a broadcast here won't on a large corpus.
    dealt = met.hint("merge").join(texts.select("node", "n_grams", "low"), "node").select("band", "node", "n_grams", "low", F.explode(pairs).alias("p")).select("band", "p.*", "node", "n_grams", "low")
    dealt = dealt.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "node")
    return dealt.mapInArrow(lean(lambda b: _tied(b, threshold, tolerance)), "a long, b long").distinct()


def join(docs: DataFrame, threshold: Fraction = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """Classes of near-duplicates among documents(doc_id, text).

    Returns for each row doc_id, h1 and h2 (hashes of the text), n_grams, class_node (the same for all of
    a class, null for a class of one text), class_id, n_links, n_copies. A link is
    between two different texts whose sets of 5-grams of words have at least the Jaccard
    similarity `threshold`; n_links counts the texts that a row's text is linked to, n_copies the
    rows that hold this text. A class is what links and copies tie together; class_id is its
    smallest doc_id that is not null. A text of fewer than five words has all its words as its one n-gram. Null
    texts and those without words are classes of their own, and repeated rows copies. An empty table gives
    no rows; other columns are not looked at.
    """
    docs = keyed(docs).select("doc_id", *text_keys(), "text")
    base = stored(docs.mapInArrow(lean(_banded), "doc_id long, h1 long, h2 long, n_grams long, bands binary, low binary"), "bands")
    texts = base.where("n_grams > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.min(F.nullif("doc_id", F.lit(NO_ID))).alias("known_id"), F.count(F.lit(1)).alias("n_copies"), *(F.first(c).alias(c) for c in ("n_grams", "bands", "low")))
    texts = stored(texts.withColumn("node", F.monotonically_increasing_id()), "texts")
    parts = components(candidates(texts, threshold, tolerance))
    # A similarity of t needs sizes that differ by no more than a factor of t: cells of sizes, of
    # which only equal and neighbouring ones are compared.
    cell = F.floor(F.log(F.col("n_grams").cast("double")) / math.log(1 / threshold) + 1e-9).cast("int")
    members = stored(texts.join(parts, "node").select("node", *KEYS, F.col("root").alias("part"), cell.alias("cell")), "members")
    cells = stored(members.groupBy("part", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "cells")
    around = lambda by, name: cells.select("part", (F.col("cell") + by).alias("cell"), F.col("blocks").alias(name))
    members = members.join(cells.join(around(-1, "above"), ["part", "cell"], "left").join(around(1, "below"), ["part", "cell"], "left").fillna(0), ["part", "cell"])
    members = members.withColumn("block", F.pmod(F.xxhash64(F.lit(3), "node"), "blocks").cast("int"))
    active = stored(members, "active").hint("merge").join(docs, list(KEYS))
    payload = active.select("part", "cell", "block", "blocks", "above", "below", "node", "text").mapInArrow(
        lean(_payload), "part long, cell int, block int, blocks int, above int, below int, node long, hashes binary, grams binary"
    )
    meets = F.expr(
        """concat(
            transform(sequence(0, blocks - 1), k -> struct(cell as cell, cell as other, least(k, block) as i, greatest(k, block) as j, int(block > k) as side)),
            transform(filter(sequence(0, above), k -> k < above), k -> struct(cell as cell, cell + 1 as other, block as i, k as j, 0 as side)),
            transform(filter(sequence(0, below), k -> k < below), k -> struct(cell - 1 as cell, cell as other, k as i, block as j, 1 as side)))"""
    )
    dealt = payload.select("part", "node", "hashes", "grams", F.explode(meets).alias("m")).select("part", "node", "hashes", "grams", "m.*")
    dealt = dealt.repartition("part", "cell", "other", "i", "j").sortWithinPartitions("part", "cell", "other", "i", "j", "node")
    found = stored(dealt.mapInArrow(lean(lambda b: _compare(b, threshold, tolerance)), "node long, links long, root long"), "links")
    classes = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    tied = texts.select("node", "h1", "h2", "known_id", "n_copies").join(classes, "node", "left").join(found.groupBy("node").agg(F.sum("links").alias("n_links")), "node", "left")
    tied = stored(tied.where("n_copies > 1 or root is not null").withColumn("root", F.coalesce("root", "node")), "tied")
    ids = stored(tied.groupBy("root").agg(F.min("known_id").alias("class_id")), "ids")
    known = stored(tied.join(ids, "root").select("h1", "h2", F.col("root").alias("class_node"), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies"), "known")
    own = named(base.select(*KEYS, "n_grams").join(known, ["h1", "h2"], "left"))
    copies = F.when(F.col("n_grams") > 0, F.coalesce("n_copies", F.lit(1))).otherwise(1).cast("long")
    alone = F.col("class_node").isNull()
    return own.select(*KEYS, "n_grams", "class_node", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), copies.alias("n_copies"))
