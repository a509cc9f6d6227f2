import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quillgrove.llm import decontaminate, html_main, lattice_lm, sharding, topk, toxicity, warc

# ---- main text


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a>menu</a></ul></nav><!-- c <p>x</p> -->
<div class="ad">buy</div><article><header><h1>Head &amp;  one</h1></header><p><b>First<br>line &lt;x&gt; &#233;<p>Second<script>var a="</p>";</script> part</p><aside>side</aside>
<ul><li>one<li>two</ul><form>f</form><section class="comments"><p>me too</p></section></article><footer>&copy; f</footer></body></html>"""


def test_main_text():
    assert html_main.main_text(PAGE) == "Head & one\n\nFirst line <x> é\n\nSecond part\n\none\n\ntwo"
    assert html_main.main_text(None) == html_main.main_text("") == html_main.main_text("<html><body></body></html>") == ""
    assert html_main.main_text("plain &amp; simple") == "plain & simple"
    assert html_main.main_text("<p>a<table><tr><td>x<td>y</table>") == "a\n\nx\n\ny"
    assert html_main.main_text("<article>" + "<div>" * 3000 + "deep") == "deep"


def test_main_text_is_whole():
    page = lambda body: html_main.main_text(f"<html><body>{body}</body></html>")
    assert page("<div><article><p>First part.</p></article><article><p>Second, longer part.</p></article></div>") == "First part.\n\nSecond, longer part."
    assert page("<article>One<article class=comment>me too</article></article><nav>menu</nav><article>Two</article>") == "One\n\nTwo"
    assert page("<h1>Head</h1><div><a>home</a></div><main><p>Text.</p></main>") == "Head\n\nText."
    long = "Words of the text that go on for more than half of it. " * 4
    assert page(f"<div><h1>Head</h1></div><div><p>{long}</p></div><div><p>Own words, fewer of them, and on.</p>Short.</div>") == f"Head\n\n{long.strip()}\n\nOwn words, fewer of them, and on.\n\nShort."


def test_templates(spark):
    body = lambda k: f"<html><body><div><span>Same top of the site</span></div><div><p>{'Own words of page ' + str(k) + ' and more of them, '} and on.</p></div><div><p>Read our terms everywhere and always, please do.</p></div></body></html>"
    rows = [(k, "http://a.example/x", body(k)) for k in range(12)] + [(100, "http://b.example/", body(100)), (101, None, body(1)), (102, "http://a.example/", None), (None, "http://A.example:80/y", "")]
    got = {r.page_id: (r.text, r.n_chars) for r in html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3][0] == "Own words of page 3 and more of them, and on." and got[3][1] == len(got[3][0])
    assert "terms" in got[100][0] and "terms" in got[101][0]
    assert got[102] == got[None] == ("", 0)
    assert html_main.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_names():
    page = lambda body: html_main.main_text(f"<html><body>{body}</body></html>")
    assert page("<article>Text.<div class='share-prices'>Up</div><div class=notice-of-motion>We move</div></article>") == "Text.\n\nUp\n\nWe move"
    assert page("<article>Text.<div class='ad-slot2'>a</div><div id=cookie-banner>b</div><div class='sidebar left'>c</div><div class=comment-list>d</div><div class=nav>e</div></article>") == "Text."


def plain_templates(rows, least, share, shape_share):
    """Counts subtrees of each host by nested tuples in place of hashes; gives texts by the same deletion."""

    def tree(e):
        return (e.tag, " ".join(e.attrs.split()), tuple(" ".join(c.split()) if isinstance(c, str) else tree(c) for c in e.children))

    def shape(e):
        return (e.tag, "" if e.tag == "a" else " ".join(e.attrs.split()), frozenset(shape(c) for c in e.children if not isinstance(c, str))) if e.tag == "a" or e.listed() else None

    sites = {}
    for url, page in rows:
        root = html_main.parse(page)
        html_main.digest(root)
        blocks = [e for e in html_main.walk(root) if e.tag in html_main.BLOCK and e.length and e.tag not in ("html", "body", "article", "main")]
        sites.setdefault(url, {})[tree(root)] = ({tree(e) for e in blocks}, {shape(e) for e in blocks if e.listed()}, {tree(e): e.digest for e in blocks} | {shape(e): e.shape for e in blocks if e.listed()})
    found = {}
    for url, pages in sites.items():
        exact, shapes = Counter(x for p in pages.values() for x in p[0]), Counter(x for p in pages.values() for x in p[1])
        named = {k: v for p in pages.values() for k, v in p[2].items()}
        found[url] = {named[x] for c, s in ((exact, share), (shapes, shape_share)) for x, n in c.items() if n >= least and n >= s * len(pages)}
    return found


def test_templates_against_plain_counts(spark):
    rng, rows = random.Random(9), []
    word = lambda: rng.choice("abcdefghij") * rng.randint(1, 3)
    for k in range(160):
        menu = "".join(f"<li><a href=/{word()}>{word()}</a>" for _ in range(rng.randint(2, 5)))
        notice = f"<div><span>Notice {rng.randrange(4)}</span></div>"  # four of them, in turn
        body = f"<p>{' '.join(word() for _ in range(30))}</p>" if k % 10 else "<p>the same page</p>"
        rows.append((f"http://h{k % 3}.example/{k}", f"<body><div><ul>{menu}</ul></div>{notice}<div><h1>T{k}</h1>{body}</div><section>See {word()}<ul>{menu}</ul></section></body>"))
    expected = plain_templates([(u.split("/")[2], p) for u, p in rows], 5, 0.1, 0.3)
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r.host: set(r.template) for r in html_main.templates(frame).collect()}
    assert got == {k: v for k, v in expected.items() if v} and len(got) == 3
    texts = {r.page_id: r.text for r in html_main.extract(frame).collect()}
    for k, (url, page) in enumerate(rows):
        assert texts[k] == html_main.main_text(page, frozenset(got[url.split("/")[2]]))
        if k % 10:  # the others' paragraph recurs
            assert re.fullmatch(rf"T{k}\n\n[a-j ]+(\n\nSee [a-j]+)?", texts[k])
        assert "Notice" not in texts[k] and len(texts[k]) < len(html_main.main_text(page))


# ---- toxicity


def test_chain(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    docs, labels = [], []
    for k in range(600):
        low, bad = k % 5 == 0, k % 7 == 0
        words = [word() for _ in range(60)] + ["#"] * 3
        for _ in range(4 if bad else 0):
            words[rng.randrange(60)] = rng.choice(["zzgrr", "zzgrrx", "Zzugh!"])
        words += ["spam", "spammy"] * 6 if low else []
        docs.append((k, " ".join(words), "p"))
        if k % 2:
            labels.append((k, int(not low), int(bad)))
    docs += [(1000, None, "p"), (1001, "", "p"), (None, "plain", "p")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, p_toxic string")
    got = {r.doc_id: r.toxic for r in toxicity.classify(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert sum(got[k] == (k % 7 == 0) for k in range(0, 600, 2)) >= 297  # held out
    assert not got[1000] and not got[1001] and not got[None]
    assert toxicity.classify(frame.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


# ---- lattice


def test_marginal_is_the_sum_over_segmentations():
    rng = np.random.default_rng(0)
    pieces = [bytes([b]) for b in range(256)] + [b" a", b"ab", b" ab", b"bc", b"abc", b" abcabc", "é".encode()]
    scores = np.log(rng.dirichlet(np.ones(len(pieces)), 2))
    lattice = lattice_lm.Lattice(pieces, scores)
    place = {p: k for k, p in enumerate(pieces)}

    def brute(word, k):
        ways = [1.0] + [0.0] * len(word)
        for end in range(1, len(word) + 1):
            ways[end] = sum(ways[b] * math.exp(scores[k][place[word[b:end]]]) for b in range(end) if word[b:end] in place)
        return math.log(ways[-1])

    words = [b"abc", b"abcabc", "éa".encode(), b"x", b"abc" * 40, b"abcab", b"b"]
    found = lattice.marginal(words)
    for k in range(2):
        assert np.allclose(found[k], [brute(b" " + w, k) for w in words])
    gained = lattice.expected(words[:3], 0)
    for p in (b" abcabc", b"bc"):  # the expected count is the derivative by the piece's score
        moved = scores.copy()
        moved[0, place[p]] += 1e-6
        change = lattice_lm.Lattice(pieces, moved).marginal(words[:3])[0].sum() - found[0][:3].sum()
        assert gained[place[p]] == pytest.approx(change / 1e-6, rel=1e-3, abs=1e-6)


def plain_scores(model, docs, train):
    """score of each text: sums over classes of products over words, each over all segmentations by a plain recursion."""
    place = {p: k for k, p in enumerate(model.pieces)}
    memory = {}

    def lattice(word, c):
        if (word, c) not in memory:
            text = b" " + word
            ways = [1.0] + [0.0] * len(text)
            for end in range(1, len(text) + 1):
                for begin in range(max(0, end - 24), end):
                    if text[begin:end] in place:
                        ways[end] += ways[begin] * math.exp(model.scores[c, place[text[begin:end]]])
            memory[word, c] = ways[-1]
        return memory[word, c]

    out = []
    for words in docs:
        likely = []
        for c, (tokens, types, texts, discount) in enumerate(model.words):
            held = tokens + texts
            rest = discount * types / held if types else 1.0
            log = math.log10(texts / model.train_docs) + math.log10(texts / held)
            for w in words:
                log += math.log10(max(train[c][w] - discount, 0) / held + rest * lattice(w, c))
            likely.append(log)
        out.append(max(likely) + math.log10(sum(10 ** max(x - max(likely), -300) for x in likely)))
    return out


def test_scores(spark, monkeypatch):
    rng = random.Random(2)
    models, fit = [], lattice_lm.fit
    monkeypatch.setattr(lattice_lm, "fit", lambda *a: models.append(fit(*a)) or models[-1])
    syllables = {"en": ["th", "er", "ing", "on"], "fr": ["eau", "é", "oi", "que"]}
    docs = []
    for k in range(300):
        lang = "en" if k % 3 else "fr"
        docs.append((k, " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))).capitalize() for _ in range(40)), lang))
    docs += [(900, None, None), (901, "", "en"), (902, "x" * 300 + "\t" + "y", "de"), (5, docs[5][1], "en")]
    got = lattice_lm.score(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(docs)
    words = lambda t: re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
    held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    train = Counter(w for d, t, _ in docs if not held(d) for w in [*words(t), b"\n"])
    total, types = sum(train.values()), len(train)
    own = {}
    for r in got:
        own.setdefault(r.doc_id, r)
    for d, t, _ in docs:
        tokens = [*words(t), b"\n"]
        r = own[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(d), len(tokens), sum(train[w] > 0 for w in tokens), total)
        assert r.base_score == pytest.approx(sum(math.log10((train[w] + 0.1) / (total + 0.1 * (types + 1))) for w in tokens), abs=1e-6)
        assert math.isfinite(r.score) and r.score < 0
    langs = Counter(l or "" for d, _, l in docs if not held(d))
    order = sorted(langs, key=lambda l: (-langs[l], l))[: lattice_lm.CLASSES - 1]
    by_class = [Counter(w for d, t, l in docs if not held(d) and (l or "") == o for w in words(t)) for o in order]
    short = [(d, words(t)) for d, t, _ in docs if max(map(len, words(t)), default=0) < 60]
    assert len(models[0].words) == len(order)
    for (d, _), expected in zip(short, plain_scores(models[0], [w for _, w in short], by_class), strict=True):
        assert own[d].score == pytest.approx(expected, abs=1e-5)
    unseen = [r for r in got if r.held_out and r.n_tokens > 10]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
    assert lattice_lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_head(spark):
    words = spark.createDataFrame([(b"w%d" % k, 1 + k // 10) for k in range(100)], "word binary, c_all long")
    assert lattice_lm.head(words).count() == 100 and lattice_lm.head(words.limit(0)).count() == 0
    for most in (5, 15, 50):
        found = lattice_lm.head(words, most).collect()
        assert len(found) <= most and (not found or min(r.c_all for r in found) == 11 - len(found) // 10)
    assert lattice_lm.head(words, 100, 60).count() == 20


# ---- top-k


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(3)
    rows = [(int(k), [float(np.float32(v)) for v in rng.normal(0, 0.3, 8)]) for k in range(700)]
    rows += [(700, rows[3][1]), (701, rows[3][1]), (702, None), (800, [1.0] * 7 + [None]), (801, [float("nan")] + [1.0] * 7), (900, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (0, rows[0][1]), (1000, []), (1100, [1.0, 2.0])]
    good = [(i, np.floor(1024 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    expected = []
    for a, (i, q) in enumerate(good):
        if i % 100 == 0:
            scored = sorted((-int(x @ q), j) for b, (j, x) in enumerate(good) if a != b and len(x) == len(q))[:10]
            expected += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scored)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted(tuple(r) for r in got) == sorted(expected)
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_lists_stop_early():
    rng = np.random.default_rng(4)
    vectors = np.floor(1024 * rng.normal(0, 0.02, (4000, 4))).astype(np.int64)
    vectors[7] = 900
    lists = topk.Lists(vectors)
    ((at, found, scores),) = lists.best(np.array([[5, 3, -2, 1]]), 1, np.full(1, -np.inf))
    assert at == 0 and scores.max() == (vectors @ [5, 3, -2, 1]).max() and lists.read < 0.5 * vectors.size
    assert not list(lists.best(np.array([[5, 3, 2, 1]]), 1, np.full(1, 1e6)))


def test_bounds_are_sound():
    rng = np.random.default_rng(5)
    for scale, width in ((3, 5), (1000, 64)):  # many ties, and none
        vectors = np.floor(scale * rng.normal(0, 1, (600, width))).astype(np.int64)
        queries = np.concatenate([vectors[:20], np.zeros((1, width), np.int64)])
        lists = topk.Lists(vectors)
        for i, rows, scores in lists.best(queries, 10, np.full(21, -np.inf)):
            every = vectors @ queries[i]
            assert set(np.flatnonzero(every >= np.sort(every)[-10])) <= set(rows.tolist()) and (every[rows] == scores).all()
        assert lists.read < 0.9 * vectors.size * 21


# ---- shards


def test_shards(spark):
    texts = [f"text {k % 40}" if k < 200 else f"own {k}" for k in range(900)] + ["hot"] * 300 + [None, ""]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    rows = sharding.shard_documents(docs).collect()
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r)
    sizes = [len(v) for v in by_shard.values()]
    assert len(rows) == len(texts) and len(sizes) == 24 and max(sizes) - min(sizes) <= 1
    for own in by_shard.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    of = {r.doc_id: r for r in rows}
    for k, t in enumerate(texts):
        body = (t or "").encode()
        assert (of[k].size, of[k].text_crc32, of[k].law, of[k].grown_shard) == (len(body) + 8, zlib.crc32(body), "rows", None)
    together = sum(len({of[k].shard for k in range(g, 200, 40)}) == 1 for g in range(40))
    assert together >= 34
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def cut_rows(rows, texts):
    """Rows that are not in the shard that holds most of their text's rows."""
    held = {}
    for r in rows:
        held.setdefault(texts[r.doc_id], Counter())[r.shard] += 1
    return sum(c.total() - max(c.values()) for c in held.values())


@pytest.mark.parametrize("texts, most", [([f"pair {k // 2}" for k in range(2400)], 0), ([f"five {k // 5}" for k in range(2280)] + [f"own {k}" for k in range(120)], 0), ([f"many {k // 240}" for k in range(2400)], 1400)])
def test_shards_of_copies(spark, texts, most):
    rows = sharding.shard_documents(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()
    assert sorted(Counter(r.shard for r in rows).values()) == [100] * 24
    assert cut_rows(rows, texts) <= most


def test_packed():
    rng = random.Random(7)
    for _ in range(200):
        sizes = {rng.randint(2, 60): rng.randint(1, 9) for _ in range(6)}
        total = sum(n * m for n, m in sizes.items()) + rng.randint(0, 20)
        rooms = [total // 8 + (s < total % 8) for s in range(8)]
        plan = sharding.packed(sizes, rooms)
        loads, parts = [0] * 8, {}
        for n, first, last, low, high, s in plan:
            loads[s] += (last - first) * (high - low)
            for g in range(first, last):
                parts.setdefault((n, g), []).append((low, high))
        assert all(a <= b for a, b in zip(loads, rooms, strict=True))
        assert set(parts) == {(n, g) for n, m in sizes.items() for g in range(m)}
        assert all(p[0][0] == 0 and p[-1][1] == n and all(a[1] == b[0] for a, b in zip(p, p[1:])) for (n, _), p in parts.items())
        assert sum(len(p) > 1 for p in parts.values()) <= 8


# ---- benchmark passages


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_decontaminate(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["Aé", "b", "c1", "dÉ", "rare"]) + str(rng.randint(0, 30))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([3, 10, 14, 25, 1, 2, 40])] + [(50, None), (51, "..."), (None, "the the the")]
    docs = []
    for k in range(120):
        parts = [word() for _ in range(rng.randint(0, 60))]
        if k % 3 == 0:
            own = words_of(items[rng.randrange(7)][1])
            a = rng.randint(0, max(0, len(own) - 10))
            parts[rng.randint(0, len(parts)) : 0] = [x.upper() if x.isascii() else x for x in own[a : a + rng.randint(8, 30)]]
        docs.append((k, ", ".join(parts)))
    docs += [(200, None), (201, ""), (3, docs[3][1]), (None, items[1][1]), (202, "the the the the")]
    got = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    wins = []
    for i, t in items:
        w = words_of(t)
        wins += [(i, tuple(w[k : k + 10])) for k in range(max(1, len(w) - 9))] if w else []
    expected = []
    for d, t in docs:
        w = words_of(t)
        hit, own = set(), set()
        for i, g in wins:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit.update(range(k, k + len(g)))
                    own.add(i)
        names = ",".join(sorted(str(i) for i in own if i is not None))
        expected.append((d, len(w), len(hit), len([i for i in own if i is not None]), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    assert Counter(tuple(r)[:6] for r in got) == Counter(expected)
    none = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string"))
    assert none.where("contaminated").count() == 0 and none.count() == len(docs)


def test_words_of_every_code_point(spark):
    """The class of the operator and the contract's say the same of each code point."""
    plain = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["a" + "".join(f"{chr(c)}b" for c in points[k : k + 4096]) for k in range(0, len(points), 4096)] + ["", None, "  ", "x" * 100_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string").select("k", decontaminate.words("text").alias("w")).collect()
    assert len(rows) == len(texts)
    assert all(row["w"] == plain.findall(texts[row["k"]] or "") for row in rows)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x x b x c"), (2, "c b a"), (3, "a x x x x x b c"), (4, "a b"), (5, "b a c b")], "doc_id long, text string")
    wanted = spark.createDataFrame([(9, "a"), (9, "b"), (9, "c")], "window long, term string")
    postings = decontaminate.index(docs, wanted)
    ids = {r.doc: r.doc_id for r in postings.select("doc", "doc_id").distinct().collect()}
    near = lambda k: {ids[r.doc] for r in decontaminate.proximity(postings, wanted, k).collect()}
    assert near(3) == {2, 5} and near(6) == {1, 2, 5}


# ---- WARC


def test_warc(spark):
    big, other = "é" * 3000, "<p>" * 400
    pages = [(1, "http://a/", big), (2, "http://a/x", big), (9, None, big), (3, "http://b/", other), (4, "http://b/", "small"), (5, "", "small"), (6, "u", None), (7, "u", "\r\n\r\nWARC/1.1\r\n" * 200), (None, "u", "x" * 2000)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: tuple(r)[1:] for r in warc.round_trip(frame, 700).collect()}
    for i, _, t in pages:
        body = (t or "").encode()
        kind = ("revisit", 9) if i in (1, 2) else ("response", None)
        assert got[i] == (len(body), hashlib.sha1(body).hexdigest(), *kind)
    table = warc.write(frame.where("page_id is not null"), 700).collect()
    assert max(len(r.data) for r in table) <= 1200
    stream = warc.as_stream(table)
    count = 0
    while stream:  # a plain reader of the format
        head, _, rest = stream.partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        n = int(fields[b"Content-Length"])
        assert rest[n : n + 4] == b"\r\n\r\n"
        stream, count = rest[n + 4 :], count + 1
    assert count == 8
    assert warc.round_trip(frame.limit(0)).count() == 0
    damaged = spark.createDataFrame([r.asDict() | {"data": bytes(r.data).replace(b"<p><p>", b"<p><b>", 1)} for r in table], "record string, page_id long, row long, chunk int, data binary, sha1_so_far string")
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read(damaged).collect()
