import random
import re

from quillgrove.llm import license_scan

WORD = re.compile(r"[a-z0-9\x80-\U0010ffff]+")


def cut(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(text, templates, threshold):
    """Every block against every template, and every place against every phrase."""
    w, base, own, share = cut(text), [], set(), 0.0
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        base += [(k, label) for k in range(len(w)) if w[k : k + len(p)] == p]
    for label, template in templates:
        t = cut(template)
        s, distinct = len(t), set(t)
        for k in range(0, len(w), s) if s else ():
            part = len(distinct & set(w[k : k + 2 * s])) / len(distinct)
            if part >= threshold:
                own.add(label)
                share = max(share, part)
    starts, labels = [k for k, _ in base], {x for _, x in base}
    return len(w), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | own)), 1.0 if base else share


def check(spark, docs, listed, threshold):
    frame = spark.createDataFrame([(d, t, "x", "y") for d, t in docs], "doc_id long, text string, token string, template string")
    own = None if listed == license_scan.TEMPLATES else license_scan.templates(spark, tuple(listed)) if listed else spark.createDataFrame([], "template int, label string, text string")
    made = license_scan.scan(frame, own, threshold)
    got = sorted(((r.doc_id, *tuple(r)[1:]) for r in made.collect()), key=repr)
    expected = sorted(((d, *plain(t, listed, threshold)) for d, t in docs), key=repr)
    assert [(*r[:-1], round(r[-1], 9)) for r in got] == [(*r[:-1], round(r[-1], 9)) for r in expected]
    return got


def test_notices(spark):
    """Nulls, empty and very long texts, repeated rows, wrapped and altered notices, phrases at either end."""
    mit = license_scan.TEMPLATES[1][1]
    docs = [(1, "Released under the\nMIT License."), (2, None), (None, ""), (3, "cc By x CC-BY"), (4, "x all Rights reserved all rights reserved"), (4, "x all Rights reserved all rights reserved")]
    docs += [(5, "lorem ipsum " * 9000 + mit.replace("person", "being").replace(" ", "\n  * ") + " dolor" * 30000), (6, mit[: len(mit) // 2]), (7, "This work is licensed under the GNU General Public License, version 3."), (8, "general public licence"), (9, "by cc"), (None, mit)]
    got = check(spark, docs, license_scan.TEMPLATES, license_scan.THRESHOLD)
    labels = {r[0]: r[6] for r in got if r[0]}
    assert labels[1] == "mit" and labels[5] == "mit" and labels[6] == "" and labels[7] == "gpl" and labels[4] == "reserved" and labels[3] == "cc-by"


def test_against_every_block(spark):
    random.seed(11)
    vocabulary = [f"w{k}" for k in range(30)]
    some = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    listed = [(f"l{k % 4}", some(random.randint(1, 12))) for k in range(7)] + [("none", " . "), ("l9", "w1 w1 w1 w2")]
    docs = [(k, some(random.randint(0, 60))) for k in range(60)]
    for threshold in (0.5, 0.8, 1.0):
        check(spark, docs, listed, threshold)
    check(spark, docs, [], 0.8)
    assert check(spark, [], listed, 0.8) == []
