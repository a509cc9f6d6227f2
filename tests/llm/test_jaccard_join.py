import random
import re
from fractions import Fraction

import numpy as np
import pytest

from quillgrove.llm import jaccard_join as J


def sets_of(texts):
    out = []
    for x in texts:
        words = re.findall(rb"[^\x20\x09-\x0d]+", (x or "").encode().lower())
        n = min(5, len(words))
        out.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set())
    return out


def brute(rows, threshold=Fraction(8, 10)):
    """(class id, links, copies) of each row."""
    sets, texts = sets_of([t for _, t in rows]), sorted({t for _, t in rows if t})
    first = {t: next(k for k, r in enumerate(rows) if r[1] == t) for t in texts}
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = dict.fromkeys(texts, 0)
    for a in range(len(texts)):
        for b in range(a):
            x, y = sets[first[texts[a]]], sets[first[texts[b]]]
            if x and y and len(x & y) >= threshold * len(x | y):
                links[texts[a]] += 1
                links[texts[b]] += 1
                root[find(first[texts[a]])] = find(first[texts[b]])
    out = []
    for k, (i, t) in enumerate(rows):
        if not sets[k]:
            out.append((i, 0, 1))
            continue
        of = find(first[t])
        mates = [r[0] for m, r in enumerate(rows) if sets[m] and find(first[r[1]]) == of]
        out.append((min(mates), links[t], sum(r[1] == t for r in rows)))
    return out


def corpus(seed, n=120):
    rng = random.Random(seed)
    word = lambda: rng.choice(["Foo", "bär", "x", "lorem", "ipsum", "dolor"]) + str(rng.randint(0, 200))
    rows = [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "One  TWO"), (1005, "one two"), (1006, "a b c d e")]
    bases = [[word() for _ in range(rng.randint(6, 150))] for _ in range(12)]
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 8])):
            words[rng.randrange(len(words))] = word()
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize(("seed", "block", "bucket"), [(1, 64, 2048), (2, 7, 4)])
def test_against_brute_force(spark, monkeypatch, seed, block, bucket):
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "BUCKET", bucket)
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, node int")
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in J.join(docs).collect()}
    assert [got[i] for i, _ in rows] == brute(rows)


def test_repeated_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "other text"), (None, "a b c d e f")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links, r.n_copies) for r in J.join(docs).collect())
    assert got == [("1", "1", 0, 3), ("1", "1", 0, 3), ("2", "2", 0, 1), ("None", "1", 0, 3)]
    assert J.join(docs.limit(0)).count() == 0


def test_pruning_keeps_what_may_reach_the_threshold():
    assert J.least_matches(25, 0.8, 1e-7) < 12 < J.least_matches(200, 0.8, 1e-7) < 140
    rng = np.random.default_rng(0)
    lost = total = 0
    for _ in range(60):
        pool = rng.integers(0, 1 << 62, 110).astype(np.uint64)
        x, y = np.unique(pool[:100]), np.unique(pool[10:])  # 90 of 110
        values = np.stack([J.signature(x), J.signature(y)])
        i, _ = J.linked([values, [x, y]], None, Fraction(8, 10), 1e-7)
        total, lost = total + 1, lost + (len(i) == 0)
    assert lost == 0


def test_recall_at_the_threshold(spark):
    """Pairs of a similarity of 0.8 to 0.83, each of words of its own."""
    rng, rows = random.Random(3), []
    for k in range(300):
        words = [f"w{k}x{m}" for m in range(rng.randint(80, 200))]
        # n - 4 grams; a word appended adds one and takes none: (n - 4) / (n - 4 + m)
        more = int((len(words) - 4) * rng.uniform(0.2, 0.25))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words, *(f"v{k}x{m}" for m in range(more))]))]
    sets = sets_of([t for _, t in rows])
    assert all(0.8 <= len(a & b) / len(a | b) < 0.84 for a, b in zip(sets[::2], sets[1::2], strict=True))
    got = {r.doc_id: r.class_id for r in J.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * k + 1] == 2 * k for k in range(300)) == 300


def test_bucket_is_tied_as_by_all_pairs():
    rng = np.random.default_rng(1)
    pools = [np.unique(rng.integers(0, 1 << 62, 120).astype(np.uint64)) for _ in range(3)]
    sets = [np.unique(rng.permutation(pools[rng.integers(3)])[:110]) for _ in range(40)]
    low = np.stack([J.signature(x) for x in sets]).astype(np.uint8)
    sizes, steps = np.array([len(x) for x in sets]), J._steps(J.THRESHOLD, 1e-7)
    a, b = np.triu_indices(40, 1)
    keep = J.alike(low, sizes, a, b, J.THRESHOLD, steps)
    i, j = (np.concatenate(x) for x in J._spanning(low, sizes, 0, 40, J.THRESHOLD, steps))
    assert (J._roots(40, i, j) == J._roots(40, a[keep], b[keep])).all() and len(set(J._roots(40, i, j).tolist())) < 10
