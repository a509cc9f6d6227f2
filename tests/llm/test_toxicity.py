"""The classifier chain against a plain version: dense features, Newton's method, folds one by one."""

import random

import numpy as np

from quillgrove.llm import toxicity


def plain_features(text):
    words = "".join(c.lower() if c.isascii() and c.isalpha() else c if c.isalnum() or ord(c) > 127 else " " for c in text or "").split()
    counts = {}
    for w in words:
        for f in [w[:k] for k in (4, 5, 6, 7, 8) if k < len(w)] + [w + "$"]:
            counts[f] = counts.get(f, 0) + 1
    return {f: np.log1p(200 * n / len(words)) for f, n in counts.items()}


def newton(rows, target):
    """Weights and, last, the bias of a logistic regression with the squared weights, but the bias, as penalty."""
    x = np.column_stack([rows, np.ones(len(rows))])
    penalty = np.diag([toxicity.PENALTY] * rows.shape[1] + [0.0])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (p - target) + penalty @ w
        w = w - np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty + 1e-9 * np.eye(len(w)), slope)
        if np.abs(slope).max() < 1e-9:
            break
    return w


def says(rows, w):
    return 1 / (1 + np.exp(-(rows @ w[:-1] + w[-1])))


def plain_chain(texts, labels):
    """p of both categories for texts {id: text}, from labels {id: (low, toxic)}."""
    found = {k: plain_features(t) for k, t in texts.items()}
    own = sorted(labels)
    names = sorted({f for k in own for f in found[k] if sum(f in found[j] for j in own) >= 3})
    matrix = lambda ids: np.array([[found[k].get(f, 0.0) for f in names] for k in ids])
    x, low, bad = matrix(own), np.array([labels[k][0] for k in own], float), np.array([labels[k][1] for k in own], float)
    fold, unseen = np.array([toxicity.hash_fold(k) for k in own]), np.zeros(len(own))
    for f in range(toxicity.FOLDS):
        unseen[fold == f] = says(x[fold == f], newton(x[fold != f], low[fold != f]))
    first, second = newton(x, low), newton(np.column_stack([x, unseen]), bad)
    every = matrix(sorted(texts))
    p_low = says(every, first)
    return dict(zip(sorted(texts), zip(p_low, says(np.column_stack([every, p_low]), second), strict=True), strict=True))


def test_against_a_plain_chain(spark, monkeypatch):
    """With rounds enough the models are the optima that Newton's method finds."""
    monkeypatch.setattr(toxicity, "ROUNDS", 3000)
    rng = random.Random(4)
    common = ["river", "mountain", "letters", "öl", "x1", "walking", "walked"]
    texts, labels = {}, {}
    for k in range(150):
        low, bad = k % 4 == 0, k % 4 in (0, 1) and k % 3 == 0
        words = [rng.choice(common) for _ in range(rng.randint(5, 40))] + ["Buynow!", "buying"] * (low and rng.random() < 0.9) + ["zzgrr", "ZZGRRS"] * (bad and rng.random() < 0.9)
        rng.shuffle(words)
        texts[k] = rng.choice([" ", "\n", ", "]).join(words)
        if k % 5:
            labels[k] = (int(low), int(bad))
    texts |= {200: "", 201: "zzgrr " + "river " * 30_000, 202: "zzgrr" * 20_000}
    expected = plain_chain(texts, labels)
    docs = spark.createDataFrame([*texts.items(), (7, texts[7]), (203, None)], "doc_id long, text string")
    told = spark.createDataFrame([(k, 1 - a, b) for k, (a, b) in labels.items()], "doc_id long, quality int, toxic int")
    got = toxicity.classify(docs, told).collect()
    assert len(got) == len(texts) + 2
    expected[203] = expected[200]
    for r in got:
        assert abs(r.p_low_quality - expected[r.doc_id][0]) < 0.02 and abs(r.p_toxic - expected[r.doc_id][1]) < 0.02, r
        assert r.toxic == (r.p_toxic > 0.5)
    seen = {(r.p_low_quality, r.p_toxic) for r in got if r.doc_id == 7}
    assert len(seen) == 1
