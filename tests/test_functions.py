import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgrove.functions import jsonrepair, text, tokens
from quillgrove.operators import grouping, provider, summaries


def column(spark, rows, schema, made):
    return [r.x for r in spark.createDataFrame(rows, schema).select(made.alias("x")).collect()]


def test_dots(spark):
    lines = ["Text.....more", "Text. . . . . more", "Text. . . . .more", "Text....more", "A.....B.....C"]
    got = column(spark, [(x,) for x in lines], "a string", text.dots_to_colon("a"))
    assert got[0] == "Text: more" and got[3] == "Text....more" and got[4] == "A: B: C"


def test_physical_index(spark):
    marks = {"<physical_index_5>": 5, "physical_index_5": 5, " <physical_index_10> ": 10, "42": 42, "-5": -5, "0": 0, "【第7页开始】": 7, "【第8页结束】": 8, "【第100页开始】some text": 100, "abc": None, "": None}
    assert column(spark, [(x,) for x in marks], "a string", text.physical_index("a")) == list(marks.values())


def test_structure(spark):
    codes = {"321": "3.2.1", "100": "1.0.0", "31": "31", "01.02": "1.2", "1..": "1", " 1.1 ": "1.1", "": ""}
    assert column(spark, [(x,) for x in codes], "a string", text.normalize_structure("a")) == list(codes.values())


def test_titles(spark):
    pairs = [("Chapter 1", "Chapter 2"), ("Chapter 1.", "chapter 1"), ("abc", "xyz"), ("a12", "a34")]
    assert column(spark, pairs, "a string, b string", text.titles_match("a", "b")) == [False, True, True, False]
    assert column(spark, pairs, "a string, b string", text.titles_match("a", "b", fuzzy=True)) == [True, True, True, False]


def test_numerals(spark):
    numbers = {"1": "一", "10": "十", "12": "十二", "20": "二十", "99": "九十九", "100": "100", "x": "x"}
    assert column(spark, [(x,) for x in numbers], "a string", text.arabic_to_chinese("a")) == list(numbers.values())


@pytest.mark.parametrize(("sentence", "code"), [("你好世界", "zh"), ("Hello there", "en"), ("안녕하세요", "ko"), ("これは日本語です", "ja"), ("Привет мир", "ru"), ("مرحبا", "ar"), ("", "en"), ("mostly Latin 中", "en")])
def test_language(spark, sentence, code):
    found = column(spark, [(sentence,)], "a string", text.language(text.script_counts("a")))[0]
    assert found.code == code
    assert found.confidence == 0.0 if not sentence else found.confidence > 0.5


def test_limits(spark):
    models = {"gpt-4": (8192, 4953), "gpt-4-turbo": (128000, 100800), "Qwen-custom": (32768, 24614), "Llama-custom": (8192, 4953), "unknown": (32768, 24614)}
    found = column(spark, [(x,) for x in models], "a string", F.struct(tokens.context_limit("a"), tokens.safe_limit("a")))
    assert [tuple(x) for x in found] == list(models.values())
    plans = column(spark, [(3, 5000), (100, 100000), (1000, 100000)], "n int, t int", tokens.batch_plan("n", "t"))
    assert [tuple(x) for x in plans] == [(3, 100000), (10, 10000), (50, 10000)]


def test_truncated(spark):
    assert column(spark, [("abcdefghij",), ("éééé",), ("ab",)], "a string", tokens.truncated("a", 1)) == ["abcd", "éé", "ab"]


def test_json():
    assert json.loads(jsonrepair.strict('```json\n{"a": [1, 2,],}\n```')) == {"a": [1, 2]}
    assert json.loads(jsonrepair.strict('Here: {"a": "x\ny", "b": "C:\\q"} {"c": 1}')) == {"a": "x\ny", "b": "C:\\q"}
    assert jsonrepair.strict('[{"a": 1}, {"b": 2}]') == '{"a": 1}'
    assert jsonrepair.lenient("{'a': None, b: 2}") == '{"a":null,"b":2}'
    assert jsonrepair.lenient("text [1, 2,] more") == "[1,2]"
    assert jsonrepair.lenient("nothing") is None


def test_chunks():
    body = "line one\n" * 50 + "<p>x</p> " * 40
    parts = grouping.chunks(body, 20)
    assert "".join(parts) == body
    assert all(len(p.encode()) <= 160 for p in parts)
    assert "".join(grouping.chunks("é" * 100, 11)) == "é" * 100


def test_packing():
    cost = [100, 5000, 45000, 30000, 12000, 200, 300, 8000, 9000]
    batches = summaries.packed(cost, 20, 48000)
    assert sorted(k for b in batches for k in b) == list(range(len(cost)))
    assert [2] in batches and [3] in batches
    for b in batches:
        assert len(b) == 1 or sum(cost[k] + 200 for k in b) <= 48000 * 9 // 10


def packed_plainly(tokens, size, limit):
    """First fit by looking at every batch, then every pair of small ones."""
    batches = [[k] for k, t in enumerate(tokens) if t > limit * 8 // 10] + [[k] for k, t in enumerate(tokens) if limit // 2 < t <= limit * 8 // 10]
    closed, load = len(batches), lambda b: sum(tokens[k] + 200 for k in b)
    for k in sorted((k for k, t in enumerate(tokens) if t <= limit // 2), key=lambda k: -tokens[k]):
        room = [b for b in batches[closed:] if len(b) < size and load([*b, k]) <= limit * 9 // 10]
        if room:
            room[0].append(k)
        else:
            batches.append([k])
    for at, own in enumerate(batches):
        for other in batches[at + 1 :]:
            if own and other and len(own + other) <= 5 and load(own + other) <= limit * 8 // 10:
                own += other
                other.clear()
    return [b for b in batches if b]


@given(st.lists(st.integers(0, 1200), max_size=40), st.integers(1, 20), st.sampled_from([1000, 3000, 20_000]))
def test_packing_by_trees(tokens, size, limit):
    assert summaries.packed(tokens, size, limit) == packed_plainly(tokens, size, limit)


def test_limiter_and_retries():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    limiter = provider.Limiter(2, clock=lambda: now[0], sleep=sleep)
    for _ in range(4):
        limiter.take()
    assert sum(slept) == pytest.approx(1.0)
    limiter.left(0)
    assert limiter.rate == 1
    limiter.left(100)
    assert limiter.rate == 1.5
    tries = []

    def flaky(prompt):
        tries.append(prompt)
        if len(tries) < 3:
            raise provider.RetryableError
        return "ok"

    waits = []
    assert provider.with_retries(flaky, sleep=waits.append)("p") == "ok"
    assert waits == [1.0, 2.0]
    with pytest.raises(ValueError):
        provider.with_retries(lambda p: (_ for _ in ()).throw(ValueError()), sleep=waits.append)("p")


def test_cache(spark):
    asked = spark.createDataFrame([("k1", "summary\nT\nOne. Two."), ("k2", "summary\nT\nThree. Four."), ("k2", "summary\nT\nThree. Four.")], "key string, prompt string")
    cache = spark.createDataFrame([("k1", "held", 100.0), ("k3", "x", 100.0)], "key string, reply string, at double")
    fresh = sorted((r.key, r.reply, r.cached) for r in provider.completed(asked, cache, now=200.0, keep=3600.0, calls=2).collect())
    assert fresh == [("k1", "held", True), ("k2", "Three.", False), ("k2", "Three.", False)]
    old = sorted((r.key, r.cached) for r in provider.completed(asked, cache, now=1e6, keep=3600.0, calls=2).collect())
    assert old == [("k1", False), ("k2", False), ("k2", False)]
    assert provider.pruned(cache, 1).count() == 1
    failed = provider.complete(asked.limit(1), lambda p: 1 // 0, 1).first()
    assert failed.reply is None and "ZeroDivisionError" in failed.problem
