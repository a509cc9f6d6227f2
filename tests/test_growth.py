"""What only larger tables showed."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quillgrove.functions import jsonrepair, text
from quillgrove.operators import model, summaries, toc, tree
from quillgrove.plans import catalog, model_catalog, pipeline
from quillgrove.sources import adapters


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_valid_json_stays():
    assert json.loads(jsonrepair.lenient('{"title": "Onha ofononedan， none’s"}')) == {"title": "Onha ofononedan， none’s"}
    assert json.loads(jsonrepair.lenient('{"title": "nonen", "page": None,}')) == {"title": "nonen", "page": None}
    assert jsonrepair.lenient("{'a': None, b: 2}") == '{"a":null,"b":2}'


def test_valid_json_is_parsed_only(monkeypatch):
    monkeypatch.setattr(jsonrepair, "NONE", None)
    assert jsonrepair.lenient('{"title": "None"}') == '{"title":"None"}'
    assert jsonrepair.lenient('[{"title": "None"}, {"title": "b"}]') == '[{"title":"None"},{"title":"b"}]'


def test_titles_of_two_lines(spark):
    nodes = spark.createDataFrame([(1, "a", "Ershin.\nInin", 1), (1, "b", "Ershin.\nOther", 1)], "doc_id long, node_id string, title string, start_page int")
    pages = spark.createDataFrame([(1, 1, "Ershin.\nInin and more")], "doc_id long, page_number int, text string")
    assert rows(pipeline.with_starts(nodes, pages), "node_id", "appear_start") == [("a", "yes"), ("b", "no")]
    items = nodes.select("doc_id", F.lit(0).alias("list_index"), "title", F.lit(1).alias("physical_index"))
    assert rows(pipeline.verified(items.where("title like '%Inin'"), pages), "appears") == [(True,)]


def test_batches_of_documents_of_any_id(spark):
    nodes = spark.createDataFrame([(d, f"n{k}", 1000 * (k + 1)) for d in ("a", "b") for k in range(30)], "doc_id string, node_id string, tokens int")
    names = sorted(f"n{k}" for k in range(30))
    batches = summaries.packed([1000 * (int(x[1:]) + 1) for x in names], 20, 48_000)
    expected = sorted((d, names[k], n + 1) for d in ("a", "b") for n, batch in enumerate(batches) for k in batch)
    assert rows(summaries.summary_batches(nodes), "doc_id", "node_id", "batch_no") == expected


def test_copies_of_titles_are_compared_once(spark, monkeypatch):
    seen = []
    near = toc.near_keys
    monkeypatch.setattr(toc, "near_keys", lambda left, right: seen.append((left.count(), right.count())) or near(left, right))
    left = spark.createDataFrame([(1, "Whales", k, k + 10) for k in range(50)], "doc_id long, title string, list_index int, physical_index int")
    right = spark.createDataFrame([(1, "whales." if k % 2 else "Whale", k, k) for k in range(50, 0, -1)], "doc_id long, title string, list_index int, page int")
    assert rows(toc.title_pairs(left, right, fuzzy=True), "title", "page", "physical_index") == [("whales.", 1, k + 10) for k in range(50)]
    assert seen == [(1, 2)]


def test_scripts_are_looked_up(spark, monkeypatch):
    texts = ["", None, "Abc 12!", "漢字かなカ한글", "Привет مرحبا नमस्ते สวัสดี", "×÷^_\x85\u3000é", "😀a" * 5]
    found = text.with_scripts(spark.createDataFrame(list(enumerate(texts)), "k int, text string"))
    assert [r.scripts.total for r in found.orderBy("k").collect()] == [0, 0, 5, 7, 23, 1, 5]
    assert [(r.scripts.Han, r.scripts.Latin) for r in found.orderBy("k").collect()] == [(0, 0), (0, 0), (0, 3), (2, 0), (0, 0), (0, 1), (0, 5)]
    assert "regexp_replace" not in found._jdf.queryExecution().toString()


def test_items_of_large_tables_are_dealt(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    before = catalog.nodes(spark, sf).collect()
    monkeypatch.setattr(adapters, "CELL_ROWS", 500)
    assert adapters.toc_items(spark, sf).rdd.getNumPartitions() > 8
    assert sorted(map(str, catalog.nodes(spark, sf).collect())) == sorted(map(str, before))


def test_rounds_read_their_own_requests(spark, monkeypatch):
    plans = []
    complete = model.complete
    monkeypatch.setattr(model, "TASK_ROWS", 3)
    monkeypatch.setattr(model, "complete", lambda own, *more, **named: plans.append(own._jdf.queryExecution().toString()) or complete(own, *more, **named))
    asked = spark.createDataFrame([(k, f"p{k}") for k in range(10)], "doc_id long, prompt string")
    told = model.Model(lambda prompt: prompt.upper(), calls=1).ask(asked, "step")
    assert rows(told, "doc_id", "reply") == [(k, f"P{k}") for k in range(10)]
    assert len(plans) == 4 and all("PartitionFilters: [isnotnull(_cell" in x for x in plans)


def test_subtrees_keep_the_last_rounds_only(spark, monkeypatch):
    made = []
    monkeypatch.setattr(tree, "Rounds", lambda own: made.append(tree_rounds(own)) or made[-1])
    chain = [(1, str(k), str(k - 1) if k else None, k, k) for k in range(40)] + [(1, f"{k}.", str(k), k, k + 5) for k in range(40)]
    found = tree.subtrees(spark.createDataFrame(chain, "doc_id long, node_id string, parent_id string, start_page int, end_page int"))
    expected = [(str(k), 2 * (40 - k), k, 44) for k in range(40)] + [(f"{k}.", 1, k, k + 5) for k in range(40)]
    assert rows(found, "node_id", "size", "start_page", "end_page") == sorted(expected)
    assert made[0].made > 10 and len(os.listdir(made[0].root.removeprefix("file:"))) <= 4


tree_rounds = tree.Rounds


def test_trees_are_built_once(spark, monkeypatch):
    """What a tree's nodes are made of is computed once, for JSON as for levels."""
    seen = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda x: seen.add(1) or x, "string").asNondeterministic()
    made = [(1, "a", None, 1, "A", 1, 3, 2), (1, "b", "a", 1, "B", 2, 3, 1), (1, "c", None, 2, "C", 4, 5, 1)]
    own = spark.createDataFrame(made, "doc_id long, node_id string, parent_id string, ordinal int, title string, start_page int, end_page int, size long")
    monkeypatch.setattr(model_catalog, "nodes", lambda *_: own.withColumn("parent_id", counted("parent_id")))
    found = model_catalog.tree_json_read(spark, "")
    assert rows(found, "node_id", "depth", "ordinal", "summary") == [("a", 1, 1, "on A"), ("b", 2, 1, None), ("c", 1, 2, None), ("root", 0, 1, None)]
    assert seen.value == 3


def test_rounds_read_their_own_groups(spark, monkeypatch):
    """The n-th round reads the n-th groups only, and carries items of the documents that have one."""
    carried, plans = [], []
    as_list, dealt = pipeline._as_list, pipeline._rounds
    monkeypatch.setattr(pipeline, "_as_list", lambda items: carried.append(rows(items.select("doc_id").distinct(), "doc_id")) or as_list(items))
    monkeypatch.setattr(pipeline, "_rounds", lambda groups: ((k, group) for k, group in dealt(groups) if plans.append(group._jdf.queryExecution().toString()) or True))
    pages = spark.createDataFrame([(d, k + 1, "word " * 60) for d, n in ((1, 1), (2, 6)) for k in range(n)], "doc_id long, page_number int, text string")
    found = pipeline.items_of(pages, model_catalog.adds_up, 200)
    assert all("PartitionFilters: [isnotnull(group_no" in x for x in plans)
    assert len(plans) > 2 and carried == [[(2,)]] * (len(plans) - 1)
    assert [r for r in rows(found, "doc_id", "list_index") if r[0] == 1] == [(1, 0)]


def test_contents_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda x: seen.add(1) or x, "string").asNondeterministic()
    contents = spark.createDataFrame([(1, "1 Alpha ..... 2\n2 Beta ..... 3")], "doc_id long, text string").withColumn("text", counted("text"))
    assert rows(pipeline.contents_items(contents), "title", "page") == [("Alpha", 2), ("Beta", 3)]
    assert seen.value == 1


def test_plain_replies_need_no_python(spark, monkeypatch):
    monkeypatch.setattr(jsonrepair, "lenient", lambda reply: "by Python")
    told = ['{"answer": "yes"}', '{"answer":"é, {x}"}', '{"answer": "a\\"b"}', '{"answer": "`"}', '{"answer": "a"}\n', '{"a": "b", "c": "d"}', '[{"a": "b"}]', None]
    found = spark.createDataFrame([(k, x) for k, x in enumerate(told)], "k int, reply string").select("k", jsonrepair.lenient_json("reply").alias("json"))
    assert [r.json for r in found.orderBy("k").collect()] == ['{"answer":"yes"}', '{"answer":"é, {x}"}', *["by Python"] * 5, None]


def test_texts_of_summaries_are_put_together_once(spark):
    seen = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda x: seen.add(1) or x, "string").asNondeterministic()
    nodes = spark.createDataFrame([(1, "a", "A", 1, 2), (1, "b", "B", 3, 3)], "doc_id long, node_id string, title string, start_page int, end_page int").withColumn("summary", F.lit(None).cast("string"))
    pages = spark.createDataFrame([(1, k, f"Page {k}. More.") for k in (1, 2, 3)], "doc_id long, page_number int, text string").withColumn("text", counted("text"))
    assert rows(summaries.summarised(nodes, pages), "node_id", "summary") == [("a", "Page 1."), ("b", "Page 3.")]
    assert seen.value == 3


def test_items_without_a_title_keep_none(spark):
    ranged = spark.createDataFrame([(1, "1", None, 1, 3), (1, "1.1", "B", 2, 3), (1, "2.1", "C", 4, 5)], "doc_id long, structure string, title string, start_page int, end_page int")
    assert rows(tree.with_ancestors(ranged), "structure", "title", "size") == [("1", None, 2), ("1.1", "B", 1), ("2", "第2章", 2), ("2.1", "C", 1)]


def test_verdicts_are_joined_to_nothing(spark, monkeypatch):
    """An item takes its verdict along, so two of one place in the list have one each; one on no page is not asked about."""
    items = spark.createDataFrame([(1, 0, "A", 1), (1, 0, "B", 1), (1, 1, "C", None)], "doc_id long, list_index int, title string, physical_index int")
    pages = spark.createDataFrame([(1, 1, "A page")], "doc_id long, page_number int, text string")
    assert rows(pipeline.verified(items, pages), "title", "appears") == [("A", True), ("B", False), ("C", False)]


def test_only_titles_that_may_pair_are_compared(spark):
    items = spark.createDataFrame([(1, k, t, 10 + k) for k, t in enumerate(["Whales!", "Dolphins", "Seal", "Sharks"])], "doc_id long, list_index int, title string, page int")
    found = spark.createDataFrame([(1, 0, "whales", 3), (1, 2, "Seals", 5)], "doc_id long, list_index int, title string, physical_index int")
    assert rows(toc.may_pair(found, items), "title") == [("Seal",), ("Whales!",)]
    assert rows(toc.title_pairs(found, toc.may_pair(found, items)), "title", "page") == rows(toc.title_pairs(found, items), "title", "page")


def test_children_of_chapters_that_are_one(spark):
    made = [(1, "a", None, "1", "第一章", 1, 4, 2, 1), (1, "b", None, "2", "第1章 xyz", 3, 6, 2, 1), (1, "c", None, "3", "第3章", 7, 8, 2, 1), (1, "d", "b", "2.1", "D", 3, 6, 1, 2), (1, "e", "a", "1.1", "E", 4, 4, 1, 2), (1, "f", "c", "3.1", "F", 7, 8, 1, 2)]
    own = spark.createDataFrame([(*r, 1 if r[1] in "adef" else "_bc".index(r[1]) + 1) for r in made], "doc_id long, node_id string, parent_id string, structure string, title string, start_page int, end_page int, size long, depth int, ordinal int")
    assert rows(tree.chapters_joined(own), "node_id", "ordinal") == [("b", 1), ("c", 2), ("d", 1), ("e", 2), ("f", 1)]
    assert rows(tree.chapters_joined(own).where("depth = 2"), "node_id", "parent_id") == [("d", "b"), ("e", "b"), ("f", "c")]


def test_deep_trees_take_one_round_of_all_rows(spark, monkeypatch):
    seen = []
    moved = tree._moved
    monkeypatch.setattr(tree, "_moved", lambda open_, state, key: seen.append((open_.count(), state.count())) or moved(open_, state, key))
    near = [(1, f"{k:04}", f"{k - 1:04}" if k else None) for k in range(3000)]
    mixed = [(2, str(k * 997 % 1009), str((k - 1) * 997 % 1009) if k else None) for k in range(1009)]
    found = tree.levelled(spark.createDataFrame(near + mixed, "doc_id long, node_id string, parent_id string"))
    expected = [(1, f"{k:04}", k, f"{min(k, 1):04}", k == 2999) for k in range(3000)] + [(2, str(k * 997 % 1009), k, str(min(k, 1) * 997 % 1009), k == 1008) for k in range(1009)]
    assert rows(found, "doc_id", "node_id", "level", "top", "leaf") == sorted(expected)
    assert [n for n, _ in seen[:1]] == [4005] and all(of < 1100 for _, of in seen[1:])


@pytest.mark.parametrize("bad", [[("x", "y"), ("y", "z"), ("z", "x")], [("x", "gone")]])
def test_deep_trees_with_nodes_of_no_root(spark, bad):
    made = [(1, f"{k:04}", f"{k - 1:04}" if k else None) for k in range(50)] + [(1, *r) for r in bad]
    with pytest.raises(ValueError, match=tree.NO_ROOT):
        tree.levelled(spark.createDataFrame(made, "doc_id long, node_id string, parent_id string"))


def test_groups_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda x: seen.add(1) or x, "string").asNondeterministic()
    made = [(1, 1, "a", None, "A", 1, 4), (1, 1, "b", "a", "B", 1, 4), (1, 1, "c", "b", "C", 2, 4), (1, 2, "d", None, "D", 3, 6), (2, 1, "e", None, "E", 1, 2), (2, 1, "f", "e", "F", 2, 2)]
    groups = spark.createDataFrame(made, "doc_id long, group_no int, node_id string, parent_id string, title string, start_page int, end_page int")
    found = rows(tree.groups_merged(groups.withColumn("title", counted("title"))), "doc_id", "depth", "ordinal", "title", "start_page", "end_page")
    assert found == [(1, 0, 1, "Document", 1, 6), (1, 1, 1, "B", 1, 2), (1, 1, 2, "D", 3, 6), (1, 2, 1, "C", 2, 2), (2, 0, 1, "E", 1, 2), (2, 1, 1, "F", 2, 2)]
    assert seen.value == 6


def test_near_titles_are_not_broadcast(spark):
    """Files of titles are small beside the pieces and pairs made of them."""
    left = spark.createDataFrame([(1, f"old bolt {k}", k, k) for k in range(0, 40, 2)], "doc_id long, title string, list_index int, physical_index int")
    right = spark.createDataFrame([(1, f"old bolt {k}", k, k) for k in range(39, 0, -2)], "doc_id long, title string, list_index int, page int")
    found = toc.title_pairs(left, right, fuzzy=True)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    near = lambda a, b: sum(x != y for x, y in zip(f"{a}", f"{b}", strict=False)) <= 1
    assert rows(found, "physical_index", "page") == [(k, next(x for x in range(1, 40, 2) if near(k, x))) for k in range(0, 40, 2)]
    changes = spark.createDataFrame([("a1b2", "a2b3"), ("12", "1"), ("", "1"), ("é1", "é2"), ("é1", "e12"), (None, "1")], "a string, b string")
    assert [r.n for r in changes.select(text.digit_changes("a", "b").alias("n")).collect()] == [2, 0, 0, 1, 1, None]


def test_subtrees_double_between_cells_only(spark, monkeypatch):
    """Chains of near ids are added up in their cells; ids in any order, several roots, no pages and lone parents give the same as before."""
    seen = []
    summed = tree._summed
    monkeypatch.setattr(tree, "_summed", lambda tops, *more: seen.append(tops.count()) or summed(tops, *more))
    chain = [(1, f"{k:04}", f"{k - 1:04}" if k else None, k, k) for k in range(3000)] + [(1, "leaf", "2999", 7, 9)]
    mixed = [(2, str(k * 997 % 1009), str((k - 1) // 3 * 997 % 1009) if k else None, None if k % 2 else k, k) for k in range(1009)] + [(3, "a", "gone", 1, 2), (3, "b", "a", None, None)]
    found = tree.subtrees(spark.createDataFrame(chain + mixed, "doc_id long, node_id string, parent_id string, start_page int, end_page int"))
    below = {k: [1, None, None] for k in range(1009)}
    for k in reversed(range(1009)):
        if 3 * k + 1 >= 1009:
            below[k][1:] = [None if k % 2 else k, k]
        if k:
            up = below[(k - 1) // 3]
            up[0] += below[k][0]
            up[1] = min((x for x in (up[1], below[k][1]) if x is not None), default=None)
            up[2] = max((x for x in (up[2], below[k][2]) if x is not None), default=None)
    expected = [(1, f"{k:04}", 3001 - k, 7, 9) for k in range(3000)] + [(1, "leaf", 1, 7, 9)] + [(2, str(k * 997 % 1009), *v) for k, v in below.items()] + [(3, "a", 2, None, None), (3, "b", 1, None, None)]
    assert sorted(map(str, rows_of(found))) == sorted(map(str, expected))
    assert seen[0] < 600


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("bad", [[("x", "y"), ("y", "z"), ("z", "x")], [(f"{k:04}z", f"{(k + 1) % 40:04}z") for k in range(40)]])
def test_subtrees_of_cycles(spark, bad):
    made = [(1, f"{k:04}", f"{k - 1:04}" if k else None, 1, 2) for k in range(50)] + [(1, *r, 1, 2) for r in bad]
    with pytest.raises(ValueError, match=tree.NO_ROOT):
        tree.subtrees(spark.createDataFrame(made, "doc_id long, node_id string, parent_id string, start_page int, end_page int"))


def kept(monkeypatch):
    """The folders of Rounds that a tree operator makes from now on."""
    made = []
    monkeypatch.setattr(tree, "Rounds", lambda own: made.append(tree_rounds(own)) or made[-1])
    return lambda: [sorted(map(int, os.listdir(x.root.removeprefix("file:")))) for x in made]


def test_json_keeps_its_last_table_only(spark, monkeypatch):
    own = spark.createDataFrame([(1, str(k), str(k - 1) if k else None, 1, f"T{k}", k, 9, None) for k in range(4)], "doc_id long, node_id string, parent_id string, ordinal int, title string, start_page int, end_page int, summary string")
    folders = kept(monkeypatch)
    trees = tree.as_json(own)
    assert len(folders()) == 1 and len(folders()[0]) == 1
    assert rows(tree.from_json(trees), "node_id", "depth", "title") == [(str(k), k, f"T{k}") for k in range(4)]
    assert len(folders()) == 2 and len(folders()[1]) == 4  # a table of nodes a level, none of what they come out of


def test_merged_groups_keep_one_table(spark, monkeypatch):
    made = [(1, 1, "a", None, "A", 1, 4), (1, 1, "b", "a", "B", 1, 4), (1, 2, "d", None, "D", 3, 6)]
    folders = kept(monkeypatch)
    found = tree.groups_merged(spark.createDataFrame(made, "doc_id long, group_no int, node_id string, parent_id string, title string, start_page int, end_page int"))
    assert rows(found, "depth", "ordinal", "title", "start_page", "end_page") == [(0, 1, "Document", 1, 6), (1, 1, "B", 1, 2), (1, 2, "D", 3, 6)]
    assert [len(x) for x in folders()] == [1]


def test_texts_are_put_together_for_summaries_only(spark, monkeypatch):
    seen = []
    text_of = summaries.node_text
    monkeypatch.setattr(summaries, "node_text", lambda nodes, pages: seen.append(rows(nodes, "title")) or text_of(nodes, pages))
    nodes = spark.createDataFrame([(1, "r", "Document", 1, 2, None), (1, "a", "A", 1, 1, None), (1, "b", "B", 2, 2, "known")], "doc_id long, node_id string, title string, start_page int, end_page int, summary string")
    pages = spark.createDataFrame([(1, k, f"Page {k}. More.") for k in (1, 2)], "doc_id long, page_number int, text string")
    assert rows(summaries.summarised(nodes, pages).where("summary is not null"), "node_id", "summary") == [("a", "Page 1."), ("b", "known")]
    assert seen == [[("A",)]]
