"""Failures as rows, one rate for all partitions, replies that last, pages in any batch, the data source."""

import json
import pathlib
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from quillgrove.operators import model, provider, toc, tree
from quillgrove.operators.model import Model, ModelError, Replies
from quillgrove.plans import pipeline
from quillgrove.sources import pages_format
from quillgrove.streaming import gather

PAGES = "doc_id long, page_number int, text string"


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def book(spark, doc=1):
    return spark.createDataFrame([(doc, 1, "### 1.1 Scope\nAll about whales."), (doc, 2, "### 1.2 Method\nHow ships sail."), (doc, 3, "### 2.1 Results\nThey came back.")], PAGES)


def test_failures_are_rows(spark):
    def down(prompt):
        if prompt.startswith(("items", "more", "summary")):
            raise ValueError("the service is down")
        return provider.by_rule(prompt)

    own = Model(down, calls=2)
    nodes = pipeline.generate(book(spark), own, summarise=True)
    assert nodes.where("summary is not null").count() == 0
    found = own.problems(spark)
    assert {(r.document, r.step) for r in found.collect()} == {("1", "items"), ("1", "summary")}
    assert {r.problem for r in found.collect()} == {"ValueError: the service is down"}
    with pytest.raises(ModelError, match="items of 1"):
        pipeline.generate(book(spark), down, summarise=True, strict=True)
    asked = spark.createDataFrame([("q", 1, "whales")], "query_id string, doc_id long, query string")
    with pytest.warns(UserWarning, match="requests failed"):
        pipeline.search(asked, nodes, lambda prompt: 1 // 0)
    groups = Model(lambda prompt: 1 // 0)
    assert pipeline.grouped_trees(book(spark), groups).count() == 0 and rows(groups.problems(spark), "document", "step") == [("1", "structure")]


def test_only_failed_requests_are_asked_again(spark, tmp_path):
    folder = str(tmp_path)

    def flaky(prompt):
        seen = pathlib.Path(folder, prompt)
        before = seen.read_text() if seen.exists() else ""
        seen.write_text(before + "x")
        if prompt == "never" or prompt.startswith("odd") and not before:
            raise ValueError("not now")
        return prompt

    asked = spark.createDataFrame([(k, x) for k, x in enumerate(["odd1", "even", "odd2", "never"])], "doc_id int, prompt string")
    own = Model(flaky, calls=2)
    assert rows(own.ask(asked, "step").where("reply is not null"), "doc_id", "reply") == [(0, "odd1"), (1, "even"), (2, "odd2")]
    assert {x: len(pathlib.Path(folder, x).read_text()) for x in ("odd1", "even", "odd2", "never")} == {"odd1": 2, "even": 1, "odd2": 2, "never": 2}
    assert rows(own.problems(spark), "document", "problem") == [("3", "ValueError: not now")]


def test_a_document_is_the_same_in_company(spark):
    contents = "1 Alpha ...... 1\n2 Beta ...... 3\n3 Gamma ...... 4"
    body = ["Alpha opens.", "More.", "Beta here.", "Gamma begins."]
    small = spark.createDataFrame([(1, k + 1, t) for k, t in enumerate([contents, *body])], PAGES)
    large = spark.createDataFrame([(2, k + 1, t) for k, t in enumerate([contents, *(["filling"] * 60), *body])], PAGES)
    names = ("title", "start_page", "end_page", "depth")
    alone = rows(pipeline.generate(small), *names)
    assert rows(pipeline.generate(small.unionByName(large)).where("doc_id = 1"), *names) == alone


def test_rate_of_all_partitions(spark):
    """120 requests, all in one partition, at 10 a second: rounds of 50 that begin 5 seconds apart at least."""
    now, slept = [0.0], []

    def sleep(seconds):
        slept.append(seconds)
        now[0] += seconds

    asked = spark.range(120).coalesce(1).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("prompt"))
    own = Model(lambda prompt: prompt, calls=3, rate=10.0, every=5.0, clock=lambda: now[0], sleep=sleep)
    assert own.ask(asked, "step").where("reply = cast(doc_id as string)").count() == 120
    assert slept == [5.0, 5.0]

    class Quota:
        """Says that few calls are left, so that the rate is halved."""

        def __init__(self):
            self.listeners = []

        def __call__(self, prompt):
            for x in self.listeners:
                x(1)
            return prompt

    slept.clear()
    Model(Quota(), calls=3, rate=10.0, every=5.0, clock=lambda: now[0], sleep=sleep).ask(asked, "step")
    assert slept == [5.0, 5.0, 5.0]  # rounds of 50, 25, 25 and the last 20


def test_replies_that_last(spark, tmp_path):
    counts = str(tmp_path / "asked")
    pathlib.Path(counts).mkdir()

    def counted(prompt):
        import uuid

        pathlib.Path(counts, uuid.uuid4().hex).touch()
        return provider.by_rule(prompt)

    asked = lambda: len(list(pathlib.Path(counts).iterdir()))
    kept = Replies(spark, f"file://{tmp_path}/replies", keep=100.0)
    assert kept.version() == -1
    own = Model(counted, calls=2, replies=kept, now=lambda: 1000.0)
    first = rows(pipeline.generate(book(spark), own, summarise=True), "node_id", "summary")
    before = asked()
    assert before > 0 and own.remember() == 0
    again = Model(counted, calls=2, replies=kept, now=lambda: 1050.0)
    assert rows(pipeline.generate(book(spark), again, summarise=True), "node_id", "summary") == first and asked() == before
    assert again.remember() == 1 and rows(kept.read().select("at").distinct(), "at") == [(1050.0,)]
    late = Model(counted, calls=2, replies=kept, now=lambda: 1200.0)
    late.ask(spark.createDataFrame([(1, "contents\nx")], "doc_id long, prompt string"), "contents")
    assert asked() > before
    entries = spark.createDataFrame([(f"{k:03x}", "r", float(k % 7)) for k in range(500)], model.REPLIES)
    plain = sorted(((-(k % 7), f"{k:03x}") for k in range(500)))
    for most, cells in ((1, 4096), (100, 3), (143, 1), (499, 64), (600, 64)):
        assert rows(model.newest(entries, most, cells), "key") == sorted((k,) for _, k in plain[:most])


def test_carried_state(spark):
    """The model answers by what it was shown; replies of another length don't count."""
    pages = spark.createDataFrame([(1, k, f"page {k} " + "x" * 100) for k in range(1, 7)], PAGES)
    shown = []

    def told(prompt):
        head, _, matter = prompt.partition("\n")
        if head == "items":
            return '[{"structure": "1", "title": "first", "physical_index": "<physical_index_0>"}]'
        held = json.loads(matter.partition("\n")[0])
        shown.append(held)
        return json.dumps([{"structure": str(len(held) + 1), "title": f"{len(held)} {held[-1]['title'][:5]}", "physical_index": "?"}, {"structure": "1", "title": "known", "physical_index": 2}])

    found = pipeline.items_of(pages, told, 60)
    listed = sorted((r.list_index, r.structure, r.title, r.physical_index) for r in found.collect())
    assert listed[0] == (0, "1", "first", None) and listed[1] == (1, "2", "1 first", 0)
    assert [r[1] for r in listed] == [str(k + 1) for k in range(len(listed))] and len(listed) > 2
    assert pipeline.items_of(pages.limit(0), told).count() == 0


def test_verification(spark):
    """Early last index: taken as it is. Low accuracy: asked again, then the next way. Wrong and missing ones are found between their neighbours."""
    pages = spark.createDataFrame([(d, k, t) for d in (1, 2, 3) for k, t in enumerate(["one", "two", "three", "four"], 1)], PAGES)
    schema = "doc_id long, structure string, title string, list_index int, page int, physical_index int"
    items = spark.createDataFrame([(1, "1", "nowhere", 0, None, 1), (2, "1", "a", 0, None, 3), (2, "2", "b", 1, None, 4), (3, "1", "one", 0, None, 1), (3, "2", "three", 1, None, 2), (3, "3", "four", 2, None, 4)], schema)
    kept, routes = pipeline.checked(items, pages)
    assert rows(routes, "doc_id", "route") == [(1, "unverified"), (2, "fallback"), (3, "accept")]
    assert rows(kept, "doc_id", "title", "physical_index") == [(1, "nowhere", 1), (3, "four", 4), (3, "one", 1), (3, "three", 3)]
    assert rows(pipeline.checked(items, pages, repair=False)[0].where("doc_id = 3"), "physical_index") == [(1,), (2,), (4,)]
    holes = spark.createDataFrame([(1, "1", "one", 0, 1, 1), (1, "2", "two", 1, 9, None), (1, "3", "four", 2, 4, 4), (1, "4", "late", 3, None, None)], schema)
    assert [tuple(r) for r in pipeline.filled(holes, pages).orderBy("list_index").select("page", "physical_index").collect()] == [(1, 1), (None, 2), (4, 4), (None, None)]


def test_chapters_and_root_in_generate(spark):
    text = ["### 1.1 a\nx", "### 2.1 b\ny", "### 3.1 c\nz"]
    pages = spark.createDataFrame([(1, k + 1, t) for k, t in enumerate(text)], PAGES)
    told = lambda prompt: json.dumps([{"structure": s, "title": t, "physical_index": str(p)} for s, t, p in (("1", "第一章 起", 1), ("1.1", "a", 1), ("2", "第1章 缘起与背景", 2), ("2.1", "b", 2), ("3", "第二章", 3), ("3.1", "c", 3))]) if prompt.startswith("items") else provider.by_rule(prompt)
    nodes = pipeline.generate(pages, told, starts=True)
    assert rows(nodes.where("depth = 1"), "title", "start_page", "end_page", "ordinal") == [("第1章 缘起与背景", 1, 3, 1), ("第二章", 3, 3, 2)]
    below = {r.title: r.parent_id for r in nodes.where("depth = 2").collect()}
    assert below["a"] == below["b"] != below["c"]
    assert {r.title: r.appear_start for r in nodes.collect()}["Document"] == "no"
    assert rows(pipeline.with_starts(nodes.drop("appear_start"), pages, skip=True).select("appear_start").distinct(), "appear_start") == [("yes",)]


def test_long_documents(spark):
    """Windows over one document with many items take a frame each, not the rest of the document."""
    n = 200_000
    items = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("list_index"), (F.floor(F.col("id") / 2) + 1).cast("int").alias("physical_index"))
    found = toc.end_pages(items, 100_001)
    assert found.where("end_page = physical_index + list_index % 2").count() == n
    bounds = toc.neighbour_bounds(items.withColumn("physical_index", F.when(F.col("list_index") % 5 == 0, F.col("physical_index"))), 0, n)
    assert bounds.where("list_index % 5 <> 0 and after < before").count() == 0 and bounds.where(F.col("after") == n).count() == 5


def test_cycles(spark):
    schema = "doc_id int, node_id string, parent_id string, start_page int, end_page int"
    for nodes in ([(1, "a", "c", 1, 1), (1, "b", "a", 1, 1), (1, "c", "b", 1, 1), (1, "r", None, 1, 1)], [(1, "a", "a", 1, 1)]):
        own = spark.createDataFrame(nodes, schema)
        for walk in (tree.levelled, tree.subtrees):
            with pytest.raises(ValueError, match="no root"):
                walk(own)
    two = spark.createDataFrame([(1, "a", None, 1, 9), (1, "b", "a", 2, 3), (1, "c", "b", 4, 6), (2, "a", None, 5, 5)], schema)
    assert rows(tree.subtrees(two), "doc_id", "node_id", "size", "start_page", "end_page") == [(1, "a", 3, 4, 6), (1, "b", 2, 4, 6), (1, "c", 1, 4, 6), (2, "a", 1, 5, 5)]


def test_near_keys(spark):
    """Against every pair by plain edit distance."""
    import random

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    random.seed(5)
    words = {"".join(random.choice("abc1") for _ in range(random.randint(0, 12))) for _ in range(150)}
    left, right = sorted(words)[:80], sorted(words)[60:]
    changes = lambda a, b: sum(x != y and x.isdigit() and y.isdigit() for x, y in zip(a, b, strict=False))
    expected = sorted((1, a, b) for a in left for b in right if a != b and distance(a, b) <= 3 and changes(a, b) <= 1)
    found = toc.near_keys(spark.createDataFrame([(1, x) for x in left], "doc_id int, k string"), spark.createDataFrame([(1, x) for x in right] + [(2, "abc")], "doc_id int, key string"))
    assert rows(found, "doc_id", "k", "key") == expected and len(expected) > 100


def test_pages_in_any_batch(spark, tmp_path):
    """A document over three batches is one tree; a page that comes late makes it anew; one that never ends is made when its time is up."""
    schema = f"{PAGES}, total_pages int, minute int"
    batches = [[(1, 2, "### 1.2 Method\nb", 3, 0), (2, 1, "### 9.1 Only\nx", None, 0)], [(1, 1, "### 1.1 Scope\na", 3, 1)], [(1, 3, "### 2.1 End\nc", 3, 2)], [(1, 4, "### 2.2 More\nd", 4, 90), (1, 1, "### 1.1 Scope\na", 4, 90)]]
    folder, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    seen = []
    for batch in batches:
        own = spark.createDataFrame(batch, schema).withColumn("arrived_at", F.timestamp_seconds(F.col("minute") * 60 + 1_700_000_000)).drop("minute")
        own.coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(own.schema).parquet(folder)
        query = gather.follow(stream, out, f"file://{tmp_path}/check", wait=timedelta(hours=1))
        if not query.awaitTermination(150):
            query.stop()
            raise AssertionError("the stream did not end")
        made = (tmp_path / "out").exists() and gather.trees(spark, out).where("depth > 0 and not title like '第%'")
        seen.append(rows(made, "doc_id", "title") if made else [])
    first = [(1, "End"), (1, "Method"), (1, "Scope")]
    assert seen[0] == seen[1] == [] and seen[2] == first
    assert seen[3] == [(1, "End"), (1, "Method"), (1, "More"), (1, "Scope"), (2, "Only")]
    assert tree.as_json(gather.trees(spark, out)).count() == 2


def test_data_source(spark, tmp_path):
    (tmp_path / "a.md").write_text("# One\n\ntext")
    (tmp_path / "b.txt").write_text("no")
    (tmp_path / "c.pdf").write_bytes(b"not a pdf")
    pages_format.register(spark)
    found = spark.read.format(pages_format.NAME).load(str(tmp_path))
    assert found.rdd.getNumPartitions() == 3
    listed = {r.source_path.rsplit("/", 1)[1]: (r.kind, r.page_number, r.text and r.text.split(), r.problem) for r in found.collect()}
    assert listed == {"a.md": ("markdown", 1, ["One", "text"], None), "b.txt": (None, None, None, "ValueError: unsupported file type"), "c.pdf": ("pdf", None, None, "ValueError: not a PDF, or too large")}
    only = spark.read.format(pages_format.NAME).schema("source_path string, page_number int").load(str(tmp_path))
    assert sorted(r.page_number or 0 for r in only.collect()) == [0, 0, 1]
    assert spark.read.format(pages_format.NAME).load(str(tmp_path)).where("kind = 'markdown'").count() == 1


def test_outlines_of_any_depth(spark):
    reply = '```json\n{"title": "G", "children": [{"title": "A", "physical_index": 1, "children": [{"title": "A1", "physical_index": 1}, {"title": "A2", "physical_index": "2", "children": [{"title": "deep"}]}]}, {"title": "B", "physical_index": 9}]}\n```'
    pages = spark.createDataFrame([(1, k, f"page {k} with some words") for k in (1, 2, 3)] + [(2, 1, "no json for this one")], PAGES)
    told = lambda prompt: "sorry" if "no json" in prompt else reply
    nodes = pipeline.grouped_trees(pages, told)
    assert rows(nodes, "doc_id", "depth", "title", "start_page", "end_page") == [(1, 0, "G", 1, 3), (1, 1, "A", 1, 3), (1, 1, "B", 3, 3), (1, 2, "A1", 1, 2), (1, 2, "A2", 2, 3), (1, 3, "deep", 2, 3), (2, 0, "Document", 1, 1)]


def test_groups_by_a_vocabulary(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    from quillgrove.operators import grouping

    own = Tokenizer(models.WordLevel({"?": 0}, unk_token="?"))
    own.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    own.save(path := str(tmp_path / "t.json"))
    pages = spark.createDataFrame([(1, k, "a b c d e f " + "x" * 50) for k in range(1, 9)] + [(2, 1, "a b c d e f g h i j k l m n o p q r s t u v w"), (2, 2, "aaa bbb ccc ddd")], PAGES)
    found = grouping.greedy_groups(pages, 20, vocabulary=path).orderBy("doc_id", "group_no").collect()
    assert all(len(r.text.split()) == r.token_count <= 21 for r in found) and found[-1].end_page == 2  # two pages of overlap and one more
    assert [r.token_count for r in found if r.doc_id == 2][0] == 20
    assert all(r.token_count <= 40 for r in grouping.balanced_groups(pages, 20, vocabulary=path).collect())


def test_command_line_with_a_service(tmp_path, spark, capsys):
    """A service on this machine: one that refuses ends the run with a message, one that answers is asked."""
    import http.server
    import threading

    from quillgrove import cli

    asked = []

    class Service(http.server.BaseHTTPRequestHandler):
        status = 400

        def do_POST(self):
            asked.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            body = json.dumps({"choices": [{"message": {"content": '[{"structure": "1", "title": "Told", "physical_index": "1"}]'}}]}).encode()
            self.send_response(self.status)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *told):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    (tmp_path / "a.md").write_text("# Whales\n\nAll about whales.\n")
    (tmp_path / "key").write_text("secret")
    out = str(tmp_path / "i.json")
    how = ["generate", "--md", str(tmp_path / "a.md"), "-o", out, "--model", "m", "--base-url", f"http://127.0.0.1:{server.server_port}/v1", "--key-file", str(tmp_path / "key")]
    assert cli.main(how) == 1 and "requests failed" in capsys.readouterr().err
    Service.status = 200
    assert cli.main(how) == 0 and json.loads((tmp_path / "i.json").read_text())["root"]["title"] == "Told"
    assert asked[-1]["model"] == "m" and asked[-1]["messages"][0]["role"] == "system"
    server.shutdown()
