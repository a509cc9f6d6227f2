"""Clashing columns, repeated rows, nulls, very long texts and empty tables, for operators whose own tests lack them."""

import pytest

from quillgrove.llm import decontaminate, html_main, jaccard_join, sharding, toxicity, warc

LONG = "word after word, " * 20_000


def test_decontaminate(spark):
    schema = "doc_id long, text string, pos int, term string, w string, doc string"
    docs = [(1, LONG + "one two three four", 1, "a", "b", "c"), (1, LONG + "one two three four", 1, "a", "b", "c"), (None, None, None, None, None, None)]
    items = spark.createDataFrame([(7, "ONE two, three four", "x")], "item_id long, text string, term string")
    found = decontaminate.decontaminate(spark.createDataFrame(docs, schema), items).drop("doc").collect()
    assert sorted((r.doc_id or 0, r.n_hit, r.contaminated) for r in found) == [(0, 0, False), (1, 4, True), (1, 4, True)]
    assert decontaminate.decontaminate(spark.createDataFrame([], schema), items).count() == 0


def test_html(spark):
    pages = [(1, "http://a.example/x", "<p>Text</p>", "h", "t", 1), (1, "http://a.example/x", "<p>Text</p>", "h", "t", 1), (None, None, None, None, None, None)]
    found = html_main.extract(spark.createDataFrame(pages, "page_id long, url string, html string, host string, template string, n_chars int"))
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in found.collect()) == [(0, "", 0), (1, "Text", 4), (1, "Text", 4)]


def test_warc(spark):
    pages = [(1, None, "<p>Text</p>", 5, "x"), (1, None, "<p>Text</p>", 5, "x"), (None, "http://a.example/", None, None, None)]
    found = warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string, chunk int, record_type string"))
    assert sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in found.collect()) == [(0, 0, "response", None), (1, 11, "response", None), (1, 11, "response", None)]


def test_join(spark):
    schema = "doc_id long, text string, h1 string, class_id string"
    assert jaccard_join.join(spark.createDataFrame([], schema)).count() == 0
    found = jaccard_join.join(spark.createDataFrame([(1, LONG, "a", "b"), (2, LONG, "a", "b"), (None, None, None, None)], schema)).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0, r.n_links, r.n_copies) for r in found)[1:] == [(1, 1, 0, 2), (2, 1, 0, 2)]


def test_toxicity(spark):
    schema = "doc_id long, text string, p_toxic string, toxic int"
    docs = [(k, ("bad words here" if k % 2 else "good words there") + f" {k}", "x", 1) for k in range(40)]
    docs += [(40, "bad words here", "x", 1), (40, "bad words here", "x", 1), (41, "bad " * 50_000, "x", 1), (None, None, None, None), (42, "", "x", 1)]
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(40)], "doc_id long, quality int, toxic int")
    found = toxicity.classify(spark.createDataFrame(docs, schema), labels)
    by = {}
    for r in found.collect():
        by.setdefault(r.doc_id, []).append((r.p_toxic, r.toxic))
    assert len(by[40]) == 2 and by[40][0] == by[40][1] and by[40][0][0] > by[2][0][0]
    assert by[41][0][0] > by[2][0][0] and by[None][0] == by[42][0] and sum(map(len, by.values())) == len(docs)


@pytest.mark.parametrize("n", [0, 60])
def test_shards(spark, n):
    docs = [(k, f"text {k % 7}", "x", 3) for k in range(n)] + ([(5, "text 5", "x", 3), (5, "text 5", "x", 3), (None, None, None, None), (9, LONG, "x", 3)] if n else [])
    found = sharding.shard_documents(spark.createDataFrame(docs, "doc_id long, text string, law string, shard int")).collect()
    counts = [sum(r.shard == s for r in found) for s in range(24)]
    assert len(found) == len(docs) and (not n or max(counts) - min(counts) <= 1)
    for s in range(24):
        assert sorted(r.slot for r in found if r.shard == s) == list(range(counts[s]))
