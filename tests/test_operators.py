import json
import random
import time

import pytest

from quillgrove.operators import grouping, provider, toc, tree
from quillgrove.plans import pipeline
from quillgrove.sources import adapters, readers, sinks


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_page_groups(spark):
    pages = spark.createDataFrame([(1, n, "word " * 20) for n in range(1, 4)] + [(2, 1, "w" * 4000)] + [(3, n, f"{n} " + "x" * 38) for n in range(1, 10)] + [(4, 1, "tiny")], "doc_id int, page_number int, text string")
    assert rows(grouping.greedy_groups(pages.where("doc_id = 1"), 1000), "start_page", "end_page") == [(1, 3)]
    cut = grouping.greedy_groups(pages.where("doc_id = 2"), 100).collect()
    assert [(r.token_count, len(r.text)) for r in cut] == [(100, 400)]
    many = grouping.greedy_groups(pages.where("doc_id = 3"), 40).orderBy("group_no").collect()
    assert len(many) >= 2 and all(r.token_count <= 40 for r in many)
    assert many[0].start_page == 1 and many[-1].end_page == 9
    assert all(r.text.count("\n") == r.end_page - r.start_page for r in many)
    assert grouping.greedy_groups(pages.where("doc_id = 4"), 100).count() == 0


def test_end_pages(spark):
    items = spark.createDataFrame([(1, "1", 1, 0), (1, "1.1", 1, 1), (1, "2", 5, 2), (1, "3", None, 3)], "doc_id int, structure string, physical_index int, list_index int")
    assert rows(toc.end_pages(items, 9).fillna(0), "structure", "end_page") == [("1", 1), ("1.1", 5), ("2", 9), ("3", 0)]


@pytest.mark.parametrize(("verdicts", "limit", "found"), [("yyy", 20, [0, 1, 2]), ("yynn", 20, [0, 1]), ("yyyyynn", 3, [0, 1, 2, 3, 4]), ("nnny", 3, []), ("ny?yn", 20, [1, 3])])
def test_toc_run(spark, verdicts, limit, found):
    told = spark.createDataFrame([(1, k, {"y": True, "n": False}.get(v)) for k, v in enumerate(verdicts)], "doc_id int, page int, is_toc boolean")
    assert rows(toc.toc_run(told, limit), "page") == [(x,) for x in found]


def test_offsets(spark):
    made = {1: [(10, 15)], 2: [(10, 15), (20, 25), (30, 35)], 3: [(10, 15), (20, 22), (30, 35)], 4: [(1, 90), (2, 91), (3, 92)]}
    pairs = spark.createDataFrame([(d, p, i) for d, own in made.items() for p, i in own], "doc_id int, page int, physical_index int")
    assert rows(toc.page_offsets(pairs, 100), "doc_id", "page_offset") == [(1, 5), (2, 5), (3, 5), (4, 89)]


def test_merge_items(spark):
    schema = "doc_id long, structure string, title string, list_index int"
    old = spark.createDataFrame([(1, "1", "A", 0), (1, "2", "B", 1)], schema)
    new = spark.createDataFrame([(1, "02", "C", 2), (1, "3", " B ", 3), (1, "3", "D", 4), (1, "4", "E", 5)], schema)
    assert rows(toc.merge_items(old, new), "structure", "title") == [("1", "A"), ("2", "B"), ("4", "E")]
    # The code of an item that goes for its title is known from then on: there the two ways differ.
    assert rows(toc.merge_new_items(old, new), "structure", "title") == [("1", "A"), ("2", "B"), ("3", "D"), ("4", "E")]


def test_with_ancestors(spark):
    items = [(1, "1.2.3", "deep", 4, 6), (1, "1.2", "mid", 1, 9), (1, "10", "ten", 7, 8), (1, "1.10", "b", 9, 9), (2, "3.1", "x", 2, 5)]
    ranged = spark.createDataFrame(items, "doc_id int, structure string, title string, start_page int, end_page int")
    names = ("doc_id", "structure", "title", "start_page", "end_page", "size")
    fast = rows(tree.with_ancestors(ranged), *names)
    assert fast == rows(tree.rolled_up(ranged.unionByName(tree.placeholders(ranged, 9))), *names)
    assert (1, "1", "第1章", 4, 9, 4) in fast and (1, "1.2", "mid", 4, 6, 2) in fast


def test_overlap(spark):
    nodes = spark.createDataFrame([(1, "root", 1, 20), (1, "a", 1, 5), (1, "b", 6, 15), (1, "c", 16, 20)], "doc_id int, node_id string, start_page int, end_page int")
    wanted = {(6, 10): 2, (3, 12): 3, (6, 6): 2, (25, 30): 0, (1, 20): 4}
    ranges = spark.createDataFrame([(k, 1, a, b) for k, (a, b) in enumerate(wanted)], "range_id int, doc_id int, first_page int, last_page int")
    for span in (1, 4, 64):
        found = {r.range_id: r["count"] for r in tree.overlapping(nodes, ranges, span).groupBy("range_id").count().collect()}
        assert [found.get(k, 0) for k in range(5)] == list(wanted.values())


def test_merge_items_one_by_one(spark):
    """Against a fold over each document's items in order."""
    rng = random.Random(3)
    made = lambda n: [(rng.randrange(40), rng.choice([None, "", "1", "1.1", "2", "3", "4"]), rng.choice([None, "", "A", " A", "B", "C", "D"]), k) for k in range(n)]
    old, new = made(60), made(400)
    schema = "doc_id long, structure string, title string, list_index int"
    want, seen = [], {}
    for added, row in [(False, r) for r in old] + [(True, r) for r in new]:
        codes, names = seen.setdefault(row[0], (set(), set()))
        code, name = row[1] or "", (row[2] or "").strip()
        known = added and code != "" and code in codes
        codes.add(code)
        if not known:
            known = added and name != "" and name in names
            names.add(name)
        if not known:
            want.append((row[0], row[3], added))
    got = toc.merge_items(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema))
    assert rows(got, "doc_id", "list_index", "added") == sorted(want)
    assert toc.merge_items(spark.createDataFrame([], schema), spark.createDataFrame([], schema)).count() == 0


def test_groups_merged(spark):
    schema = "doc_id int, group_no int, node_id string, parent_id string, title string, start_page int, end_page int"
    groups = spark.createDataFrame([(1, 1, "g1", None, "G1", 1, 5), (1, 1, "s1", "g1", "S1", 1, 3), (1, 2, "g2", None, "G2", 6, 10), (1, 2, "s2", "g2", "S2", 6, 8), (2, 1, "h1", None, "H1", 1, 10), (2, 2, "h2", None, "H2", 5, 15)], schema)
    assert rows(tree.groups_merged(groups), "doc_id", "depth", "title", "start_page", "end_page") == [
        (1, 0, "Document", 1, 10), (1, 1, "S1", 1, 3), (1, 1, "S2", 6, 8), (2, 0, "Document", 1, 15), (2, 1, "H1", 1, 4), (2, 1, "H2", 5, 15)
    ]


def test_appended(spark):
    schema = "tree_id int, node_id string, parent_id string, title string, start_page int, end_page int"
    a = spark.createDataFrame([(1, "a", None, "A", 1, 10)], schema)
    b = spark.createDataFrame([(1, "b", None, "B", 1, 3), (2, "c", None, "C", 1, 5)], schema)
    about = "tree_id int, total_pages int, document_info string, version int"
    nodes, trees = tree.appended(a, spark.createDataFrame([(1, 10, "x", 0)], about), b, spark.createDataFrame([(1, 3, "y", 0), (2, 5, "z", 0)], about))
    assert rows(nodes, "tree_id", "title", "start_page", "end_page") == [(1, "A", 1, 10), (1, "B", 11, 13), (1, "Combined Document", 1, 13), (2, "C", 1, 5)]
    assert rows(trees, "tree_id", "total_pages", "document_info", "version") == [(1, 13, "Combined document: x + y", 1), (2, 5, "z", 0)]


def test_markdown(tmp_path, spark):
    (tmp_path / "a.md").write_text("# Acme公司\n\nSome **bold** [link](http://x) text\n\n```\ncode\n```\n- item\n## Next\n", encoding="utf-8")
    (tmp_path / "b.txt").write_text("no")
    (tmp_path / "c.pdf").write_bytes(b"not a pdf")
    (tmp_path / "d.pdf").write_bytes(b"%PDF-1.4 x")
    found = adapters.files(spark, f"file://{tmp_path}")
    problems = {r.source_path.rsplit("/", 1)[1]: r.problem for r in found.collect()}
    assert problems == {"a.md": None, "b.txt": "unsupported file type: txt", "c.pdf": "not a PDF, or too large", "d.pdf": None}
    page = adapters.markdown_pages(found).collect()
    assert len(page) == 1 and page[0].page_number == 1
    assert page[0].text.split() == ["Acme公司", "Some", "bold", "link", "text", "item", "Next"]
    assert [r.text for r in adapters.pdf_pages(found, lambda b: ["one", None]).orderBy("page_number").collect()] == ["one", ""]
    images = adapters.rendered(found, 72, lambda b, dpi: [b[:4], str(dpi).encode()])
    assert rows(images.withColumn("image", images["image"].cast("string")), "page_number", "image") == [(1, "%PDF"), (2, "72")]
    pages, problems = adapters.recognised(images, lambda b: b.decode() if b.startswith(b"%") else 1 // 0)
    assert pages.count() == 0 and problems.first().problem.startswith("ZeroDivisionError")
    assert rows(adapters.recognised(images, lambda b: b.decode())[0], "page_number", "text") == [(1, "%PDF"), (2, "72")]
    made, problems = readers.READERS.pages(spark, f"file://{tmp_path}/*.[mt][dx]*")
    assert [r.text.split()[0] for r in made.collect()] == ["Acme公司"] and problems.count() == 1
    own = readers.Readers().add("pdf", [".PDF"], lambda docs: adapters.pdf_pages(docs, lambda b: ["", ""]))
    read, problems = own.pages(spark, f"file://{tmp_path}/d.pdf", lambda b: "seen " + b.decode(), lambda b, dpi: [b"1", b"2"])
    assert rows(read, "page_number", "text") == [(1, "seen 1"), (2, "seen 2")] and problems.count() == 0
    with pytest.raises(ValueError, match="unsupported"):
        own.reader("md")
    assert adapters.by_rows([(9, 700.2, "b"), (1, 699.9, "a "), (1, 650, "c"), (2, 640, " ")]) == "a b\nc"


BOOK = """Order *5*
on two lines
===

By [me](http://x "t") <http://y> and `*code*` a_b_c *open [x] **over
lines**.

- one
- [![in](a.png)](b)

    of the second item

        no text
1. next
   - deep
---
<div>
raw

~~~
fenced
~~~
### A # b ###
> said __so__
> twice

    code
[ref]: http://x 'of'
***
<!-- a
b -->
Last
---
"""


def test_markdown_blocks():
    text = "Order 5 on two lines By me  and *code* a_b_c *open [x] over lines. one in of the second item next deep \n\nA # b said so twice \n\nLast"
    assert adapters.markdown_text(BOOK) == text
    assert [adapters.markdown_text(x) for x in ("", "\r\n", "#", "* * *", "- - x", "```\nopen")] == ["", "", "", "", "x", ""]
    for x in ("*a _b ", "[", "`x``y", "<!-- ", "> ", "1. ", "a](x \""):
        begun = time.perf_counter()
        adapters.markdown_text(x * 20_000)
        assert time.perf_counter() - begun < 5


def test_generate_search_update(spark, tmp_path):
    text = ["### 1.1 Scope\nAll about whales.", "more", "### 1.2 Method\nHow ships sail.", "### 2.1 Results\nThe whales came back."]
    pages = spark.createDataFrame([(7, k + 1, t) for k, t in enumerate(text)] + [(8, 1, "你好，世界，这里没有标题")], "doc_id long, page_number int, text string")
    nodes = pipeline.generate(pages, verify=True, summarise=True)
    found = {(r.doc_id, r.title): (r.start_page, r.end_page, r.depth) for r in nodes.collect()}
    assert found[7, "Document"] == (1, 4, 0)
    assert found[7, "Scope"] == (1, 3, 2) and found[7, "Method"] == (3, 4, 2) and found[7, "Results"] == (4, 4, 2)
    assert found[7, "第1章"] == (1, 4, 1)
    asked = spark.createDataFrame([("q", 7, "whales results"), ("e", 7, "  ")], "query_id string, doc_id long, query string")
    answers, listed = pipeline.search(asked, nodes)
    assert [r.query_id for r in answers.collect()] == ["q"]
    assert listed.orderBy("rank").first().title == "Results"
    held = json.loads(tree.as_json(nodes).where("doc_id = 7").first().tree)
    assert held["title"] == "Document" and [c["title"] for c in held["children"]] == ["第1章", "第2章"]
    assert rows(tree.from_json(tree.as_json(nodes)), "doc_id", "node_id", "parent_id", "depth", "summary") == rows(nodes, "doc_id", "node_id", "parent_id", "depth", "summary")
    sinks.save_nodes(nodes, f"file://{tmp_path}/nodes")
    assert spark.read.parquet(f"file://{tmp_path}/nodes").count() == nodes.count()
    sinks.save_results(answers, listed, f"file://{tmp_path}/results")
    sinks.save_json(nodes, f"file://{tmp_path}/json")
    assert spark.read.json(f"file://{tmp_path}/json").count() == 2


def test_stream(spark, tmp_path):
    from quillgrove.streaming import ingest

    schema = "doc_id long, page_number int, text string"
    for k, rows_ in enumerate([[(1, 1, "### 1.1 One\nfirst words here")], [(1, 1, "### 2.1 Two\nsecond words here"), (2, 1, "### 1.1 Other\nthird words here")]]):
        spark.createDataFrame(rows_, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
        stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in/*")
        ingest.follow(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/check").awaitTermination()
    _, trees = ingest.read_trees(spark, f"file://{tmp_path}/out", 1)
    assert rows(trees, "tree_id", "total_pages", "version") == [(1, 2, 1), (2, 1, 0)]


def test_ocr_trigger(spark):
    pages = spark.createDataFrame([(1, k, "x" if k > 3 else " ") for k in range(10)] + [(2, k, "x" if k > 4 else "") for k in range(10)] + [(3, 1, "")], "doc_id int, page_number int, text string")
    assert rows(adapters.needs_ocr(pages), "doc_id", "needs_ocr") == [(1, True), (2, True), (3, True)]
    assert provider.scripted({"a": "b"}, "c")("a") == "b"
