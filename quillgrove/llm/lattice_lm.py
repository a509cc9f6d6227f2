"""Likelihood of whole texts under a unigram model of subwords, over all segmentations.

A word's lattice has an edge for every piece of an existing vocabulary that matches there. Its
probability is the sum over all paths, by forward recursion in log space. A word of the training
texts is one more edge, over all of its lattice: it weighs what is left of the word's share after
an absolute discount, and the paths through pieces divide what was discounted. As no edge reaches
over a word's end, a text's log probability is the sum of its words' and of the end's. Texts are
of classes (languages, in training) with shares and scores of their own; a text's probability is
the sum over the classes it may be of.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrove.llm.store import stored

U = np.uint64
#: Most frequent words that each executor knows by heart, and their bytes at most; others are joined.
HEAD, HEAD_BYTES = 1 << 18, 1 << 23
#: Passes of expectation maximisation, and what each piece's count is raised by.
PASSES, FLOOR = 2, 0.01
#: Classes of texts at most.
CLASSES = 6
#: Words of more bytes are scored one by one.
LONG = 64
#: Distinct words that a task counts before it hands them on.
HELD = 150_000
_random = np.random.default_rng(20240401)
OF_BYTE = _random.integers(0, 1 << 64, 256, U) | U(1)
BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.full((2, n + 1), 1, U)
    both[0, 1:], both[1, 1:] = BASE, pow(BASE, -1, 1 << 64)
    return tuple(np.multiply.accumulate(both, axis=1))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(29))


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes, a word's begin written as a space, and their scores as log probabilities.

    Scores that are ranks (merge order) become a Zipf distribution. Pieces that can't match a
    lower-cased word are left out, and all single bytes are there.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scores: dict[bytes, float] = {bytes([b]): math.inf for b in range(256)}
    worst = 1.0
    for k in range(model.get_piece_size()):
        if model.is_unknown(k) or model.is_control(k) or model.is_byte(k):
            continue
        piece = model.id_to_piece(k).replace("▁", " ").encode()
        if b" " in piece[1:] or piece != piece.lower():
            continue
        rank = max(1.0, -model.get_score(k))
        worst = max(worst, rank)
        scores[piece] = min(scores.get(piece, math.inf), rank)
    rank = np.array([2 * worst if r == math.inf else r for r in scores.values()])
    share = 1 / (rank + 10)
    return list(scores), np.log(share / share.sum())


class Lattice:
    """Forward and backward recursions over the lattices of many words, for several sets of scores at once."""

    def __init__(self, pieces: list[bytes], scores: np.ndarray):
        self.scores = scores  # a row for each class of texts
        self.size = len(pieces)
        self.lengths = sorted({len(p) for p in pieces})
        powers, _ = _powers(self.lengths[-1])
        keys = np.array([int((OF_BYTE[np.frombuffer(p, np.uint8)] * powers[: len(p)]).sum(dtype=U)) + len(p) & (1 << 64) - 1 for p in pieces], U)
        keys = _mix(keys)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order
        self.taken = np.zeros(1 << 18, bool)  # most substrings are told apart from pieces by this alone
        self.taken[(keys >> U(46)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are pieces', and these pieces."""
        maybe = np.flatnonzero(self.taken[(hashes >> U(46)).view(np.int64)])
        own = hashes[maybe]
        place = np.minimum(np.searchsorted(self.keys, own), self.size - 1)
        hit = self.keys[place] == own
        return maybe[hit], self.ids[place[hit]]

    def _edges(self, words: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(begin, end, words, pieces) of words (rows) of one length, by end."""
        n, size = words.shape
        powers, inverse = _powers(size)
        sums = np.zeros((size + 1, n), U)
        np.cumsum((OF_BYTE[words] * powers[:size]).T, axis=0, out=sums[1:])
        edges = []
        for end in range(1, size + 1):
            for length in self.lengths:
                begin = end - length
                if begin < 0:
                    break
                rows, ids = self.find(_mix((sums[end] - sums[begin]) * inverse[begin] + U(length)))
                if len(rows):
                    edges.append((begin, end, rows, ids))
        return edges

    def forward(self, edges: list, size: int, n: int, scores: np.ndarray) -> np.ndarray:
        """Log probabilities of the paths up to each place: place, class, word."""
        ahead = np.full((size + 1, len(scores), n), -np.inf)
        ahead[0] = 0
        for end, own in groupby(edges, key=lambda e: e[1]):
            parts = [(rows, ahead[begin][:, rows] + scores[:, ids]) for begin, _, rows, ids in own]
            top = np.full((len(scores), n), -np.inf)
            for rows, value in parts:
                top[:, rows] = np.maximum(top[:, rows], value)
            total = np.zeros_like(top)
            for rows, value in parts:
                total[:, rows] += np.exp(value - top[:, rows])
            ahead[end] = top + np.log(total)
        return ahead

    def _grouped(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of equal length, a space before each word, and their indices."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        ends = np.append(np.flatnonzero(np.diff(sizes[order])) + 1, len(order))
        begin = 0
        for end in ends.tolist():
            size = int(sizes[order[begin]]) if end > begin else 0
            step = max(1, 100_000 // (size + 1))
            for a in range(begin, end, step):
                own = order[a : min(a + step, end)]
                flat = b"".join(b" " + words[k] for k in own.tolist())
                yield own, np.frombuffer(flat, np.uint8).reshape(len(own), size + 1)
            begin = end

    def marginal(self, words: list[bytes]) -> np.ndarray:
        """Log probability of each word (column) in each class (row), over all its segmentations."""
        out = np.zeros((len(self.scores), len(words)))
        for own, rows in self._grouped(words):
            if rows.shape[1] > LONG:
                for k, r in zip(own.tolist(), rows, strict=True):
                    out[:, k] = self._long(r)
            else:
                out[:, own] = self.forward(self._edges(rows), rows.shape[1], len(own), self.scores)[-1]
        return out

    def _long(self, word: np.ndarray) -> np.ndarray:
        """The same for one long word: its pieces are found at all places at once."""
        size = len(word)
        powers, inverse = _powers(size)
        sums = np.zeros(size + 1, U)
        np.cumsum(OF_BYTE[word] * powers[:size], out=sums[1:])
        at: list[list] = [[] for _ in range(size + 1)]
        for k in self.lengths:
            if k <= size:
                begins, ids = self.find(_mix((sums[k:] - sums[:-k]) * inverse[: size + 1 - k] + U(k)))
                for b, i in zip(begins.tolist(), ids.tolist(), strict=True):
                    at[b + k].append((b, i))
        ahead = np.zeros((size + 1, len(self.scores)))
        for end in range(1, size + 1):
            begins, ids = zip(*at[end], strict=True)
            ahead[end] = np.logaddexp.reduce(ahead[list(begins)] + self.scores[:, list(ids)].T, axis=0)
        return ahead[-1]

    def expected(self, words: list[bytes], k: int) -> np.ndarray:
        """Expected number of each piece in these words, each once, with the scores of class k."""
        total, scores = np.zeros(self.size), self.scores[k : k + 1]
        for own, rows in self._grouped(words):
            n, size = rows.shape
            edges = self._edges(rows)
            ahead = self.forward(edges, size, n, scores)[:, 0]
            behind = np.full((size + 1, n), -np.inf)
            behind[size] = 0
            whole = ahead[-1]
            for begin, end, some, ids in reversed(edges):
                through = scores[0, ids] + behind[end, some]
                behind[begin, some] = np.logaddexp(behind[begin, some], through)
                total += np.bincount(ids, np.exp(ahead[begin, some] + through - whole[some]), self.size)
        return total


@dataclass
class Model:
    """What was learnt. Texts fall into classes; each has its words, piece scores and share of texts."""

    pieces: list[bytes]
    scores: np.ndarray  # class, piece
    words: np.ndarray  # of each class: tokens that are words, distinct ones, texts, and the discount
    train_words: int
    word_types: int

    @property
    def train_docs(self) -> int:
        return int(self.words[:, 2].sum())

    @property
    def train_tokens(self) -> int:
        return self.train_words + self.train_docs

    def base(self, count):
        """log10 of the smoothed share of tokens that occur so often in training."""
        types = self.word_types + (self.train_docs > 0)
        return np.log10((np.asarray(count, float) + 0.1) / (self.train_tokens + 0.1 * (types + 1)))

    def word(self, counts: np.ndarray, lattice: np.ndarray) -> np.ndarray:
        """log10 probability of words (columns) in classes (rows), from their counts there and their lattices."""
        tokens, types, texts, discount = self.words[:, :, None].transpose(1, 0, 2)
        whole = np.maximum(counts - discount, 0) / np.maximum(tokens + texts, 1)
        rest = np.where(types > 0, discount * types / np.maximum(tokens + texts, 1), 1.0)
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(whole), np.log(rest) + lattice) / math.log(10)

    def end(self) -> np.ndarray:
        """log10 of each class's share of texts and of the probability of a text's end in it."""
        tokens, _, texts, _ = self.words.T
        if not self.train_docs:
            return np.full(len(tokens), -math.log10(len(tokens)))
        with np.errstate(divide="ignore"):
            return np.log10(texts / texts.sum()) + np.log10(texts / np.maximum(tokens + texts, 1))


def _words(text: pa.Scalar) -> list[bytes]:
    """Words with A-Z lowered: what space and \t to \r set apart."""
    return text.as_buffer().to_pybytes().lower().split() if text.is_valid else []


def _larger(batches: Iterator[pa.RecordBatch], least: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Batches put together: words of one length are worked on at once, and a batch alone has few of each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= least:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def counted(docs: DataFrame, classes: int) -> DataFrame:
    """(word, c0, c1, ..., c_all) over documents(text, class, held_out): occurrences in training by class, and in all."""
    names = [*(f"c{k}" for k in range(classes)), "c_all"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[dict[bytes, int]] = [{} for _ in range(classes + 1)]  # the last: texts held out

        def out() -> Iterator[pa.RecordBatch]:
            for k, own in enumerate(counts):
                if own:
                    n = pa.array(list(own.values()), pa.int64())
                    zero = pa.array(np.zeros(len(own), np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), *(n if j == k else zero for j in range(classes)), n], names=["word", *names])
                    own.clear()

        for batch in batches:
            kinds, helds = batch.column("class").to_pylist(), batch.column("held_out").to_pylist()
            for text, kind, held in zip(batch.column("text").cast(pa.large_binary()), kinds, helds, strict=True):
                own = counts[classes if held else kind]
                for w, n in Counter(_words(text)).items():
                    own[w] = own.get(w, 0) + n
                if sum(map(len, counts)) > HELD:
                    yield from out()
        yield from out()

    found = docs.select("text", "class", "held_out").mapInArrow(run, ", ".join(["word binary", *(f"{c} long" for c in names)]))
    return found.groupBy("word").agg(*(F.sum(c).alias(c) for c in names))


def fit(words: DataFrame, texts: list[int], path: str) -> Model:
    """Piece probabilities of each class by expectation maximisation over its training words, from the vocabulary's scores on.

    Paths through pieces speak for words that are rare or unseen, so each distinct word counts once.
    Of each pass only the expected counts, one a class and piece, go to the driver.
    """
    spark, classes = words.sparkSession, len(texts)
    pieces, first = vocabulary(path)
    scores = np.stack([first] * classes)
    columns = [f"c{k}" for k in range(classes)]
    every = sum((F.col(c) for c in columns), F.lit(0))
    sums = words.agg(F.count_if(every > 0), *(f(c) for c in columns for f in (F.sum, lambda c: F.count_if(F.col(c) > 0), lambda c: F.count_if(F.col(c) == 1), lambda c: F.count_if(F.col(c) == 2)))).first()
    table = np.zeros((classes, 4))
    for k in range(classes):
        total, types, once, twice = (x or 0 for x in sums[1 + 4 * k : 5 + 4 * k])
        table[k] = total, types, texts[k], min(max(once / max(once + 2 * twice, 1), 0.1), 0.95)
    for _ in range(PASSES if table[:, 1].any() else 0):
        held = spark.sparkContext.broadcast((pieces, scores))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(*held.value)
            sums = np.zeros((classes, lattice.size))
            for batch in _larger(batches):
                listed = batch.column("word").to_pylist()
                for k in range(classes):
                    own = np.flatnonzero(batch.column(f"c{k}").to_numpy())
                    if len(own):
                        sums[k] += lattice.expected([listed[i] for i in own.tolist()], k)
            k = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(sums.ravel()[k])], names=["piece", "n"])

        known = words.where(every > 0).select("word", *columns)
        found = known.mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        counts = np.full(scores.size, FLOOR)
        counts[found.column("piece").to_numpy()] += found.column("n").to_numpy()
        counts = counts.reshape(scores.shape)
        scores = np.log(counts / counts.sum(axis=1, keepdims=True))
    return Model(pieces, scores, table, int(table[:, 0].sum()), sums[0])


def head(words: DataFrame, most: int = HEAD, most_bytes: int = HEAD_BYTES) -> DataFrame:
    """The commonest of words(word, c_all, ...), as many as fit: those from a count on that a histogram of counts gives.

    The histogram has eight steps for each doubling of the count; all words of a step are taken or none.
    """
    step = F.floor(F.log2("c_all") * 8).cast("int")
    found = words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("word")).alias("bytes")).collect()
    least, n, size = None, 0, 0
    for r in sorted(found, key=lambda r: -r.step):
        n, size = n + r.n, size + r.bytes
        if n > most or size > most_bytes:
            break
        least = r.step
    return words.where(step >= least) if least is not None else words.limit(0)


def score(docs: DataFrame, path: str | None = None, part: int = 10, most: int = CLASSES) -> DataFrame:
    """Scores documents(doc_id, text, lang); learns from those whose crc32(doc_id as text) mod `part` is not 0.

    Returns per row doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Tokens are
    words and one end a text. base_score is the smoothed share of whole tokens; score the log10
    probability over all segmentations, summed over the classes that a text may be of. Classes are
    learnt from `lang` (the `most` - 1 commonest, the rest one) of training texts; a text is scored
    without it. Null and empty texts are their end alone; a null doc_id counts as the text "".
    Repeated rows are trained on and scored each.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    spark = docs.sparkSession
    text_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    lang = F.coalesce(F.col("lang"), F.lit("")) if "lang" in docs.columns else F.lit("")
    rows = docs.select("doc_id", "text", lang.alias("lang"), (F.crc32(text_id.cast("binary")) % part == 0).alias("held_out"))
    common = [r.lang for r in rows.where("not held_out").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most - 1).collect()]
    kind = F.coalesce(F.array_position(F.array(*map(F.lit, common)), F.col("lang")) - 1, F.lit(0)) if common else F.lit(0)
    rows = rows.withColumn("class", F.when(kind < 0, len(common)).otherwise(kind).cast("int")).drop("lang")
    texts = {r["class"]: r.n for r in rows.where("not held_out").groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    classes = max(texts, default=0) + 1
    columns = [f"c{k}" for k in range(classes)]
    rows = rows.withColumn("class", F.least("class", F.lit(classes - 1)))  # a class of held-out texts alone is none
    words = stored(counted(rows, classes), "words")
    model = fit(words, [texts.get(k, 0) for k in range(classes)], path)
    held = spark.sparkContext.broadcast(model)
    numbers = ["known", "base", *(f"p{k}" for k in range(classes))]

    def marginals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(held.value.pieces, held.value.scores)
        for batch in _larger(batches):
            counts = np.stack([batch.column(c).to_numpy() for c in columns]).astype(float)
            found = held.value.word(counts, lattice.marginal(batch.column("word").to_pylist()))
            whole = counts.sum(axis=0)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c_all"), *map(pa.array, ((whole > 0).astype(float), held.value.base(whole), *found))], names=["word", "c_all", *numbers])

    scored = words.mapInArrow(marginals, "word binary, c_all long, " + ", ".join(f"{c} double" for c in numbers))
    scored = stored(scored, "scored")
    top = head(scored).drop("c_all").toArrow()
    by_heart = spark.sparkContext.broadcast((top.column("word").to_pylist(), np.stack([top.column(c).to_numpy() for c in numbers], 1)))
    names = ["row", "word", "doc_id", "held_out", "n_tokens", *(f"_{c}" for c in numbers)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, (listed, values) = held.value, by_heart.value
        place = {w: k for k, w in enumerate(listed)}.get
        values = np.concatenate([values, np.zeros((1, len(numbers)))])
        end = np.array([model.train_docs > 0, model.base(model.train_docs), *model.end()], float)
        for batch in batches:
            keys, parts, tail = batch.column("row").to_numpy(), [], []
            for row, text in zip(keys.tolist(), batch.column("text").cast(pa.large_binary()), strict=True):
                words = _words(text)
                at = np.fromiter(map(place, words, repeat(-1)), np.int64, len(words))
                parts.append((len(words) + 1, *(values[at].sum(axis=0) + end)))
                tail += [(row, words[k]) for k in np.flatnonzero(at < 0).tolist()]
            table = np.array(parts, float).reshape(-1, 1 + len(numbers))
            # 0xff is in no text: these rows, of which each has a key of its own, meet no word.
            own = [b"\xff%d" % k for k in keys.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(own, pa.binary()), batch.column("doc_id"), batch.column("held_out"), pa.array(table[:, 0].astype(np.int64)), *(pa.array(c.copy()) for c in table[:, 1:].T)], names=names
            )
            for a in range(0, len(tail), 100_000):
                some = tail[a : a + 100_000]
                none = [pa.nulls(len(some), k) for k in (pa.int64(), pa.bool_(), pa.int64(), *[pa.float64()] * len(numbers))]
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in some], pa.int64()), pa.array([w for _, w in some], pa.binary()), *none], names=names)

    kinds = "row long, word binary, doc_id long, held_out boolean, n_tokens long, " + ", ".join(f"_{c} double" for c in numbers)
    read_rows = rows.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text").mapInArrow(read, kinds)
    met = read_rows.join(scored.drop("c_all"), "word", "left").select("row", "doc_id", "held_out", "n_tokens", *(F.coalesce(f"_{c}", c).alias(c) for c in numbers))
    summed = met.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), *(F.sum(c).alias(c) for c in numbers))
    likely = [F.col(f"p{k}") for k in range(classes)]
    top = F.greatest(*likely) if classes > 1 else likely[0]
    total = top + F.log10(sum((F.pow(F.lit(10.0), F.greatest(p - top, F.lit(-300.0))) for p in likely), F.lit(0.0)))
    return summed.select(
        "doc_id", "held_out", "n_tokens", F.round("known").cast("long").alias("n_known"), F.lit(model.train_tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), total.alias("score")
    )
