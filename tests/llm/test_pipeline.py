import random
from pathlib import Path

import pyarrow as pa
import pytest
from test_jaccard_join import brute as classes_of
from test_suffix_dedup import brute as cut_of

import corpus_pipeline
from quillgrove.llm import store
from quillgrove.llm.store import stored

INSULTS = ["zzgrr", "zzgrrx", "zzugh"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    docs, labels = [], []
    for k in range(300):
        words = text(rng.randint(20, 80)).split()
        if k % 6 == 0:
            for _ in range(5):
                words[rng.randrange(len(words))] = rng.choice(INSULTS)
        docs.append([k, " ".join(words), "en", "s", 0])
        if k < 200:
            labels.append((k, 1, int(k % 6 == 0)))
    passage, item = text(60), text(14)
    for k in (1, 7, 25):
        docs[k][1] += " " + passage
    for k in (2, 8):
        docs[k][1] += " " + item.upper()
    for k in (300, 301, 302):  # an exact copy, a near one, and one more without words
        docs.append([k, {300: docs[3][1], 301: docs[4][1] + " x", 302: " "}[k], "fr", None, 1])
    docs += [[303, None, None, None, None], [303, None, None, None, None], [11, docs[11][1], "en", "s", 0]]
    top = tmp_path_factory.mktemp("sf")
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"file://{top}/{name}.parquet")
    write(docs, "doc_id long, text string, lang string, source string, n_chars long", "documents")
    write(labels, "doc_id long, quality int, toxic int", "labels")
    write([(0, item), (1, text(30))], "item_id long, text string", "benchmark")
    return f"file://{top}", item, passage


def test_stages(spark, sf_dir):
    top, _, passage = sf_dir
    docs = spark.read.parquet(f"{top}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        docs = stored(stage(spark, docs, top), name)
        after = [tuple(r) for r in docs.collect()]
        kept[name] = (before, after)
        if name != "packing":
            assert docs.columns == columns
    before, after = kept["toxicity"]
    gone = {r[0] for r in before} - {r[0] for r in after}
    assert gone == {k for k in range(0, 300, 6)} and len(after) == len(before) - len(gone)
    before, after = kept["jaccard_join"]
    of = classes_of([(r[0], r[1]) for r in before])
    blank = [r[0] for r in before if not (r[1] or "").strip()]
    worded = {r[0] for r, c in zip(before, of, strict=True) if r[0] == c[0] and (r[1] or "").strip()}
    assert sorted(r[0] for r in after) == sorted([*worded, *blank])
    assert {300, 301}.isdisjoint(r[0] for r in after) and [r[0] for r in after].count(11) == 1 and [r[0] for r in after].count(303) == 2
    before, after = kept["suffix_dedup"]
    left = dict((r[0], r[1]) for r in after)
    for r, (n, removed, _, _) in zip(before, cut_of([r[1] for r in before]), strict=True):
        if removed:
            assert len(left[r[0]].encode()) == n - removed
        else:
            assert left[r[0]] == r[1]
    assert len(after) == len(before) and all(passage[20:-20] not in (left[k] or "") for k in (1, 7, 25))
    before, after = kept["decontamination"]
    gone = {r[0] for r in before} - {r[0] for r in after}
    assert gone == {2, 8}
    before, after = kept["packing"]
    assert {r[0] for r in after} == {r[0] for r in before}


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir[0]).count() > 0
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_workers_give_memory_back():
    """A worker that lives on is no larger than before a task, though a block above what the task freed is still in use."""
    kept: list[bytes] = []

    def held() -> int:
        return int(Path("/proc/self/statm").read_text().split()[1]) * 4096 // 1_000_000

    def run(batches):
        blocks = [bytes(4096 + k % 7) for k in range(50_000)]
        kept.append(bytes(5000))
        yield from batches
        del blocks

    batch = pa.RecordBatch.from_arrays([pa.array([1])], names=["x"])
    before = held()
    assert [b.num_rows for b in store.lean(run)(iter([batch]))] == [1]
    assert held() - before < 60


def test_small_batches(spark):
    """Python gets a stage's texts in batches of a bounded number of rows."""
    docs = spark.range(3 * corpus_pipeline.BATCH_ROWS).coalesce(1).selectExpr("id as doc_id", "'a b' as text")
    corpus_pipeline.pack(spark, docs, "")
    sizes = docs.mapInArrow(lambda b: (pa.RecordBatch.from_arrays([pa.array([x.num_rows])], names=["n"]) for x in b), "n long")
    assert max(r.n for r in sizes.collect()) <= corpus_pipeline.BATCH_ROWS
