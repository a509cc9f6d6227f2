"""Toxicity by a chain of linear classifiers over words and word beginnings."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrove.llm.store import keyed, lean, stored

#: Labelled documents that a model is fitted on at most, and features of a category.
SAMPLE, FEATURES = 12_000, 2048
FOLDS, PENALTY, ROUNDS = 5, 1.0, 120
#: Bytes of a word's beginnings that are features, beside the word itself.
BEGINNINGS = (4, 5, 6, 7, 8)
#: A-Z lowered; ASCII other than letters and digits splits words.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER).split()


def features_of(word: bytes) -> list[bytes]:
    return [word[:k] for k in BEGINNINGS if k < len(word)] + [word + b"$"]


@dataclass
class Chain:
    """Linear models, one a category; each has a weight for the probability of every earlier category."""

    categories: tuple[str, ...]
    vocabulary: dict[bytes, int]
    weights: np.ndarray  # category, feature
    links: np.ndarray  # category, earlier category
    biases: np.ndarray

    def probabilities(self, ids: np.ndarray, values: np.ndarray) -> list[float]:
        found: list[float] = []
        for k in range(len(self.categories)):
            score = self.biases[k] + float(self.weights[k, ids] @ values) + float(self.links[k, :k] @ np.array(found))
            found.append(float(1 / (1 + np.exp(-np.clip(score, -40, 40)))))
        return found


class Reader:
    """Features of texts as ids in a vocabulary, with a bounded memory of words."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self.vocabulary, self.known = vocabulary, {}

    def ids_of(self, word: bytes) -> tuple[int, ...]:
        own = tuple(self.vocabulary[f] for f in features_of(word) if f in self.vocabulary)
        if len(self.known) > 400_000:
            self.known.clear()
        if len(word) <= 64:  # longer ones are read anew, as they could fill the memory
            self.known[word] = own
        return own

    def read(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = words_of(text)
        counts: Counter[int] = Counter()
        known = self.known
        for word, n in Counter(words).items():
            own = known.get(word)
            if own is None:
                own = self.ids_of(word)
            for i in own:
                counts[i] += n
        ids = np.fromiter(sorted(counts), np.int64, len(counts))
        density = np.fromiter((counts[i] for i in ids.tolist()), np.float64, len(counts)) / max(len(words), 1)
        return ids, np.log1p(200 * density)


def _logistic(rows: tuple[np.ndarray, np.ndarray, np.ndarray], extra: np.ndarray, target: np.ndarray, width: int) -> np.ndarray:
    """Weights of an L2-penalised logistic regression by accelerated gradient steps; the last is the bias.

    rows: row, column and value of sparse features; extra: dense ones, a column each.
    """
    row, column, value = rows
    n, more = len(target), extra.shape[1]
    weight = np.zeros(width + more + 1)
    look, momentum = weight.copy(), 1.0
    if not n:
        return weight
    # Power iterations find the largest curvature, which bounds the step.
    ahead = np.ones(width + more + 1)
    for _ in range(8):
        ahead /= np.linalg.norm(ahead)
        moved = np.bincount(row, value * ahead[column], n) + extra @ ahead[width : width + more] + ahead[-1]
        ahead = np.concatenate([np.bincount(column, value * moved[row], width), extra.T @ moved, [moved.sum()]])
    step = 4 * n / (1.2 * np.linalg.norm(ahead) + 4 * PENALTY)
    for _ in range(ROUNDS):
        score = np.bincount(row, value * look[column], n) + extra @ look[width : width + more] + look[-1]
        error = (1 / (1 + np.exp(-np.clip(score, -40, 40))) - target) / n
        gradient = np.concatenate([np.bincount(column, value * error[row], width), extra.T @ error, [error.sum()]])
        gradient[:-1] += PENALTY / n * look[:-1]
        after = look - step * gradient
        faster = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        look = after + (momentum - 1) / faster * (after - weight)
        weight, momentum = after, faster
    return weight


def fit(docs: DataFrame, labels: DataFrame, categories: Sequence[str], sample: int = SAMPLE) -> Chain:
    """A chain for 0/1 columns of labels(doc_id, ...), in this order.

    Fitted on `sample` labelled documents at most, those of the smallest hashes of doc_id; labels
    that are null count as 0. A later model is fitted on the probabilities that models of the other
    folds gave for the earlier categories, so that it knows them as they will be on unseen texts.
    """
    spark = docs.sparkSession
    chosen = keyed(labels).groupBy("doc_id").agg(*(F.max(F.coalesce(F.col(c).cast("int"), F.lit(0))).alias(f"_{k}") for k, c in enumerate(categories)))
    chosen = chosen.orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(sample)
    own = stored(keyed(docs).select("doc_id", "text").join(stored(chosen, "sample"), "doc_id").dropDuplicates(["doc_id"]).repartition(12), "fit")
    flags = [f"_{k}" for k in range(len(categories))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: dict[tuple, Counter[bytes]] = {}  # documents with a feature, by their labels
        for batch in batches:
            labels = zip(*(batch.column(c).to_pylist() for c in flags), strict=True)
            for kind, text in zip(labels, batch.column("text").to_pylist(), strict=True):
                kinds.setdefault(kind, Counter()).update({f for w in set(words_of(text)) for f in features_of(w)})
        for kind, counts in kinds.items():
            n = np.fromiter(counts.values(), np.int64, len(counts))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(n), *(pa.array(n * k) for k in kind)], names=["feature", "n", *flags])

    found = own.mapInArrow(lean(count), "feature binary, n long, " + ", ".join(f"{c} long" for c in flags))
    found = stored(found.groupBy("feature").agg(*(F.sum(c).alias(c) for c in ("n", *flags))).where("n >= 3"), "features")
    totals = own.agg(F.count(F.lit(1)), *(F.sum(c) for c in flags)).first()
    vocabulary: dict[bytes, int] = {}
    for k, c in enumerate(flags):
        rate = (totals[1 + k] or 0) / max(totals[0], 1)
        ahead = (F.col(c) - F.col("n") * rate) / F.sqrt(F.col("n") * max(rate * (1 - rate), 1e-9))
        for r in found.orderBy(F.abs(ahead).desc(), "feature").limit(FEATURES).select("feature").collect():
            vocabulary.setdefault(bytes(r.feature), len(vocabulary))
    held = spark.sparkContext.broadcast(vocabulary)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(held.value)
        for batch in batches:
            pairs = [reader.read(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(batch.column(c) for c in flags), pa.array([i.astype(np.int32).tobytes() for i, _ in pairs], pa.binary()), pa.array([v.tobytes() for _, v in pairs], pa.binary())],
                names=["doc_id", *flags, "ids", "vals"],
            )

    rows = own.mapInArrow(lean(read), "doc_id long, " + ", ".join(f"{c} int" for c in flags) + ", ids binary, vals binary").collect()
    rows.sort(key=lambda r: r.doc_id)
    ids = [np.frombuffer(r.ids, np.int32) for r in rows]
    column = np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int64)
    value = np.concatenate([np.zeros(0), *(np.frombuffer(r.vals) for r in rows)])
    row = np.repeat(np.arange(len(rows)), [len(x) for x in ids])
    fold = np.array([hash_fold(r.doc_id) for r in rows], int)
    width, k_all = len(vocabulary), len(categories)
    weights, links, biases = np.zeros((k_all, width)), np.zeros((k_all, k_all)), np.zeros(k_all)
    earlier = np.zeros((len(rows), 0))
    for k, c in enumerate(flags):
        target = np.array([r[c] for r in rows], float)
        made = _logistic((row, column, value), earlier, target, width)
        weights[k], links[k, :k], biases[k] = made[:width], made[width:-1], made[-1]
        if k + 1 < k_all:
            unseen = np.zeros(len(rows))
            for f in range(FOLDS):
                inside = fold != f
                place = np.cumsum(inside) - 1
                part = inside[row]
                made = _logistic((place[row[part]], column[part], value[part]), earlier[inside], target[inside], width)
                score = np.bincount(row, value * made[column], len(rows)) + earlier @ made[width:-1] + made[-1]
                unseen[~inside] = 1 / (1 + np.exp(-np.clip(score[~inside], -40, 40)))
            earlier = np.column_stack([earlier, unseen])
    return Chain(tuple(categories), vocabulary, weights, links, biases)


def hash_fold(doc_id: int) -> int:
    return (doc_id * 0x9E3779B97F4A7C15 % (1 << 64) >> 40) % FOLDS


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """Adds to docs(text, ...) a column p_<category> each: the chain's probabilities.

    Every row is scored on its whole text. Null and empty texts have no features, so they get what
    the biases give. A column of docs with such a name is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.categories]
    rest = docs.drop(*names)
    kept = rest.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(held.value.vocabulary)
        for batch in batches:
            found = [held.value.probabilities(*reader.read(x.as_py())) for x in batch.column("text")]
            table = np.array(found, float).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(table[:, k].copy()) for k in range(len(names)))], names=[*kept, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields), *(f"`{n}` double" for n in names)])
    return rest.mapInArrow(lean(run), schema)


#: Above this probability a document is toxic.
LIMIT = 0.5


def chain_for(docs: DataFrame, labels: DataFrame) -> Chain:
    """The chain of this corpus: low quality (quality 0), then toxic."""
    flags = labels.select("doc_id", (1 - F.coalesce("quality", F.lit(1))).alias("low_quality"), "toxic")
    return fit(docs, flags, ("low_quality", "toxic"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, p_low_quality, p_toxic and toxic (above LIMIT) of each row of documents(doc_id, text).

    Null and empty texts get what the biases say; repeated rows get a row each, all the same; a document
    without a label is judged like the others; an empty table gives no rows; other columns are not looked at.
    """
    found = score(docs.select("doc_id", "text"), chain_for(docs, labels))
    return found.select("doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") > LIMIT).alias("toxic"))
