import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quillgrove.llm import suffix_dedup


def brute(texts, length=200):
    data = [(x or "").encode() for x in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        cover = np.zeros(len(d) + 1, int)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                cover[i : i + length] = 1
        kept = bytes(b for b, c in zip(d, cover, strict=False) if not c)
        out.append((len(d), int(cover.sum()), int((np.diff(np.append(0, cover)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(rng.randint(38, 90)) for _ in range(6)]
    out = [None, "", "x" * 199, "y" * 200, "y" * 201, "ab" * 700, "z" * 5000, "\0" * 300, "\0" * 250]
    for _ in range(60):
        parts = [text(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, 60)
            parts += [s[a:], text(rng.randint(0, 30))]
        out.append(rng.choice(["", " "]).join(parts))
    out += out[20:30] + [out[40][:-1] + "?", "é" + out[41]]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(texts)], "doc_id long, text string, anchor string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removed(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_repeated_rows_null_ids_and_shards(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD", 700)  # most anchors are spread over shards and merged pair by pair
    texts = corpus(3)
    ids = [7 if i in (12, 13) else None if i in (14, 15) else i for i in range(len(texts))]
    rows = [*zip(ids, texts, strict=True), (30, texts[30]), (30, texts[30])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removed(docs).collect())
    assert got == Counter((i, *x) for (i, _), x in zip(rows, brute([t for _, t in rows]), strict=True))


def test_empty(spark):
    assert suffix_dedup.removed(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_search_and_repeated(seed):
    rng = random.Random(seed)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(5, 90))) for _ in range(40)]
    strings += [strings[3][5:] + b"a", b"c" * 70]
    seen = Counter(s[i : i + 12] for s in strings for i in range(len(s) - 11))
    a = suffix_dedup.Suffixes(strings, 12)
    marks = a.repeated()
    for k, s in enumerate(strings):
        for i in range(len(s) - 11):
            assert marks[a.begins[k] + i] == (seen[s[i : i + 12]] > 1)
    x, y = suffix_dedup.Suffixes(strings[:20], 12), suffix_dedup.Suffixes(strings[20:], 12)
    mine, theirs = x.search(y)
    grams = [{s[i : i + 12] for s in part for i in range(len(s) - 11)} for part in (strings[:20], strings[20:])]
    for made, part, found in ((x, strings[:20], mine), (y, strings[20:], theirs)):
        for k, s in enumerate(part):
            for i in range(len(s) - 11):
                assert found[made.begins[k] + i] == (s[i : i + 12] in grams[0] & grams[1])
