import random
import zlib
from collections import Counter

import regex

from quillgrove.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long"


def plain(docs):
    """By definition: words of all runs, near words by trying every edit."""
    words = Counter()
    for doc_id, text in docs:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            words[run] += 1
    words = {w: n for w, n in words.items() if len(w) >= 7 and n >= 2}
    letters = {c for w in words for c in w}
    out = {}
    for w, n in words.items():
        edits = {w[:k] + w[k + 1 :] for k in range(len(w))} | {w[:k] + c + w[k + 1 :] for k in range(len(w)) for c in letters} | {w[:k] + c + w[k:] for k in range(len(w) + 1) for c in letters}
        near = sorted((-words[x], x) for x in edits if x in words and x != w)
        form = near[0][1] if near and -near[0][0] >= 10 * n else None
        out[w] = [form, None, n, len(near), words[form] if form else None]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row[1] = root
    return sorted((w, *row) for w, row in out.items())


def found(spark, docs, crowd=spelling.CROWD):
    made = spelling.variants(spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA), crowd)
    assert made.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in made.collect())


def test_variants(spark):
    """Nulls, empty and very long texts, repeated rows, ties, chains of forms, letters that repeat; crowded bands too."""
    random.seed(3)
    stems = ["".join(random.choice("abé") for _ in range(random.randint(6, 9))) for _ in range(60)]
    docs = [(k, " ".join(random.choice(stems) + random.choice(["", "", "", "a", "É", "aa"]) for _ in range(40))) for k in range(80)]
    docs += [(None, None), (7, ""), (None, "Abcdefgh abcdefgh ABCDEFGH"), (8, "abcdefgh " * 4000), (8, "abcdefgh " * 4000), (9, "abcdefghi " * 300), (10, "abcdefghij " * 12), (11, "abcdefghijk " * 2 + "xyzxyz1xyzxyzx")]
    expected = plain(docs)
    assert any(r[1] and r[2] != r[1] for r in expected) and len(expected) > 100
    assert found(spark, docs) == expected
    assert found(spark, docs, crowd=0) == found(spark, docs, crowd=3) == expected


def test_no_words(spark):
    assert found(spark, []) == [] and found(spark, [(1, None), (2, "short words only")]) == []
