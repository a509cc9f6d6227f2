"""Ways to find items, batches of summaries, retries, trees of any depth, and the command line."""

import io
import json
import urllib.error

import pytest

from quillgrove import cli
from quillgrove.functions import prompts, tokens
from quillgrove.operators import chat, provider, summaries, tree
from quillgrove.operators.model import Model, ModelError
from quillgrove.plans import pipeline


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


BODY = ["Alpha opens the book.", "More on it.", "Beta goes on here.", "Gamma part begins.", "The end of gamma."]


def pages_of(spark, doc, contents):
    return spark.createDataFrame([(doc, k + 1, t) for k, t in enumerate([contents, *BODY])], "doc_id long, page_number int, text string")


def test_modes(spark):
    numbered = pages_of(spark, 1, "1 Alpha ...... 1\n2 Beta ...... 3\n3 Gamma part ...... 4")
    bare = pages_of(spark, 2, "1 Alpha\n2 Beta\n3 Gamma part")
    other = spark.createDataFrame([(3, 1, "1. First thing\ntext of it"), (3, 2, "2. Second thing\nmore")], "doc_id long, page_number int, text string")

    def told(prompt):  # the second document's contents page has no numbers to tell it by
        return '{"toc_detected": "yes"}' if prompt.startswith("contents\n1 Alpha") else provider.by_rule(prompt)

    nodes = pipeline.generate(numbered.unionByName(bare).unionByName(other), told, verify=True)
    found = rows(nodes.where("depth = 1"), "doc_id", "title", "start_page")
    assert found == [(1, "Alpha", 2), (1, "Beta", 4), (1, "Gamma part", 5), (1, "Preface", 1), (2, "Alpha", 2), (2, "Beta", 4), (2, "Gamma part", 5), (2, "Preface", 1), (3, "First thing", 1), (3, "Second thing", 2)]


def test_way_that_fails_leads_to_the_next(spark):
    """Contents whose titles are nowhere, then a text without headings: a node for each page."""
    pages = spark.createDataFrame([(1, 1, "1 Nowhere ...... 1\n2 Neither ...... 2\n3 Missing ...... 3"), (1, 2, "plain words")], "doc_id long, page_number int, text string")
    silent = lambda prompt: "" if prompt.startswith("items\n") else provider.by_rule(prompt)
    nodes = pipeline.generate(pages, silent, verify=True)
    assert rows(nodes.where("depth = 1"), "title") == [("Page 1",), ("Page 2",)]


def test_batched_summaries(spark):
    nodes = spark.createDataFrame([(1, f"n{k}", None, f"T{k}", k, k, None) for k in range(1, 7)], "doc_id long, node_id string, parent_id string, title string, start_page int, end_page int, summary string")
    pages = spark.createDataFrame([(1, k, f"Sentence {k}. And more.") for k in range(1, 7)], "doc_id long, page_number int, text string")
    expected = [(f"n{k}", f"Sentence {k}.") for k in range(1, 7)]
    assert rows(summaries.summarised(nodes, pages, batched=True), "node_id", "summary") == expected
    odd = lambda prompt: '[{"node_id": "n1", "summary": "wrong"}]' if prompt.startswith("summaries") else provider.by_rule(prompt)
    assert rows(summaries.summarised(nodes, pages, odd, batched=True), "node_id", "summary") == expected  # one by one


def test_contents_are_asked_for_until_complete(spark):
    """One document's entries come one at a time; of another the rest never comes; a third one can't be asked."""

    def told(prompt):
        task, _, rest = prompt.partition("\n")
        if "broken" in rest and task == "complete":
            raise ValueError("no")
        held = json.loads(rest.partition("\n")[0]) if task in ("complete", "continue") else []
        lines = rest.split("\n")[0 if task == "listed" else 1 :]
        if task == "complete":
            return json.dumps({"completed": "yes" if len(held) == len(lines) else "no"})
        more = lines[len(held) : len(held) + 1] if task == "listed" or "stuck" not in rest else []
        return json.dumps([{"structure": x.split()[0], "title": x.split()[1], "page": int(x.split()[2])} for x in more])

    contents = spark.createDataFrame([(1, "1 a 3\n2 b 4\n3 c 9"), (2, "1 stuck 3\n2 d 4"), (3, "1 broken 3\n2 e 5")], "doc_id long, text string")
    found = rows(pipeline.contents_items(contents, told), "doc_id", "list_index", "structure", "title", "page")
    assert found == [(1, 0, "1", "a", 3), (1, 1, "2", "b", 4), (1, 2, "3", "c", 9), (2, 0, "1", "stuck", 3), (3, 0, "1", "broken", 3)]
    assert rows(pipeline.contents_items(contents, told, rounds=1).where("doc_id = 1"), "title") == [("a",), ("b",)]
    own = Model(told)
    pipeline.contents_items(contents, own, rounds=1)
    assert rows(own.problems(spark), "document", "step", "problem") == [
        ("1", "continue", "contents incomplete after 1 rounds"), ("2", "continue", "contents incomplete, and nothing more was listed"), ("3", "complete", "ValueError: no")
    ]
    with pytest.raises(ModelError, match="continue of 2"):
        pipeline.contents_items(contents.where("doc_id = 2"), Model(told, strict=True))


def test_prompts_name_the_language(spark):
    seen = lambda prompt: prompt.partition("\n")[0] if prompt.startswith("summary") else provider.by_rule(prompt)
    pages = spark.createDataFrame([(1, 1, "第一页的正文，没有标题。"), (2, 1, "1234 5678")], "doc_id long, page_number int, text string")
    nodes = pipeline.generate(pages, seen, summarise=True, name_language=True).where("structure in ('1', '1.2.3.4') and summary is not null").dropDuplicates(["doc_id"])
    assert rows(nodes, "doc_id", "summary") == [(1, "summary Chinese (中文)"), (2, "summary")]
    batched = pipeline.generate(pages, summarise=True, batched=True, name_language=True).where("depth = 0 and doc_id = 1")
    assert batched.first().summary.startswith("第一页的正文")


class Service:
    """Stands for a chat completions service; `status` is what it answers with."""

    def __init__(self, reply, status=200):
        self.reply, self.status, self.asked = reply, status, []

    def __call__(self, request, timeout):
        self.asked.append(request)
        if self.status != 200:
            raise urllib.error.HTTPError(request.full_url, self.status, "", {}, None)
        held = io.BytesIO(json.dumps({"choices": [{"message": {"content": self.reply}}]}).encode())
        held.headers = {chat.LEFT: "7"}
        return held


def test_chat():
    service, left = Service("fine"), []
    ask = chat.chat("http://host/v1/", "m", "secret", opener=service)
    ask.listeners.append(left.append)
    assert ask("summary Chinese (中文)\nTitle\ntext") == "fine" and left == [7]
    sent = json.loads(service.asked[0].data)
    assert service.asked[0].full_url == "http://host/v1/chat/completions" and service.asked[0].get_header("Authorization") == "Bearer secret"
    system, user = (m["content"] for m in sent["messages"])
    assert system.startswith(prompts.DIRECT) and "Chinese" in system and user.endswith("Title\ntext") and user != "Title\ntext"
    assert prompts.rendered("other\nx") == "other\nx" and not sent["stream"]
    for status, kind in ((429, provider.RetryableError), (503, provider.RetryableError), (400, urllib.error.HTTPError)):
        with pytest.raises(kind):
            chat.chat("http://host", "m", opener=Service("", status))("x")
    assert chat.recogniser("https://host", "m", opener=Service("read"))(b"png") == "read"
    for url, model in (("host", "m"), ("http://host", "")):
        with pytest.raises(ValueError):
            chat.recogniser(url, model)


def test_bpe(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    own = Tokenizer(models.WordLevel({"a": 0, "b": 1, "?": 2}, unk_token="?"))
    own.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    own.save(path := str(tmp_path / "t.json"))
    texts = spark.createDataFrame([("a b c",), ("",), (None,)], "text string")
    found = texts.select("text", tokens.bpe_count("text", path).alias("n"), tokens.bpe_truncated("text", 2, path).alias("cut")).collect()
    assert [tuple(r) for r in found] == [("a b c", 3, "a b "), ("", 0, ""), (None, None, None)]


def test_retries_and_cache(spark):
    def flaky(prompt):
        flaky.calls = getattr(flaky, "calls", 0) + 1
        if flaky.calls % 2:
            raise provider.RetryableError("429")
        return prompt.upper()

    slept = []
    assert provider.with_retries(flaky, sleep=slept.append)("a") == "A" and slept == [1.0]
    asked = spark.createDataFrame([("k1", "a"), ("k2", "b")], "key string, prompt string")
    cache = spark.createDataFrame([("k1", "old", 1.0), ("k1", "new", 2.0), ("k9", "z", 0.5)], "key string, reply string, at double")
    told = provider.completed(asked, cache, provider.scripted({"b": "B"}))
    assert rows(told, "key", "reply", "cached") == [("k1", "new", True), ("k2", "B", False)]
    assert rows(provider.remembered(cache, told, 9.0, 2), "key", "reply", "at") == [("k1", "new", 9.0), ("k2", "B", 9.0)]
    clock = iter(range(100))
    limiter = provider.Limiter(1.0, clock=lambda: next(clock) * 0.25, sleep=slept.append)
    for _ in range(3):
        limiter.take()
    assert len(slept) > 1


def deep(spark, key="doc_id", prefix="", depth=5, shift=0):
    """Two groups of trees that are `depth` levels deep."""
    out = []
    for g in (1, 2):
        for level in range(depth):
            parent = f"{prefix}g{g}.{level - 1}" if level else None
            out.append((1, g, f"{prefix}g{g}.{level}", parent, 1, f"G{g} L{level}", 10 * g - 9 + shift, 10 * g + 3 + shift, f"s{g}{level}"))
    return spark.createDataFrame(out, f"{key} int, group_no int, node_id string, parent_id string, ordinal int, title string, start_page int, end_page int, summary string")


def test_groups_of_any_depth(spark):
    merged = tree.groups_merged(deep(spark))
    found = {r.title: (r.depth, r.start_page, r.end_page, r.summary) for r in merged.collect()}
    assert len(found) == 9 and found["Document"] == (0, 1, 23, None)
    assert [found[f"G1 L{k}"] for k in range(1, 5)] == [(k, 1, 10, f"s1{k}") for k in range(1, 5)]
    assert [found[f"G2 L{k}"] for k in range(1, 5)] == [(k, 11, 23, f"s2{k}") for k in range(1, 5)]
    alone = tree.groups_merged(deep(spark).where("group_no = 1"))
    assert rows(alone, "title", "depth", "end_page") == [(f"G1 L{k}", k, 13) for k in range(5)]
    assert tree.from_json(tree.as_json(merged)).count() == 9
    with pytest.raises(ValueError, match="no root"):
        tree.as_json(deep(spark).where("node_id <> 'g1.2'"))


def test_appended_keeps_columns(spark):
    about = "tree_id int, total_pages int, document_info string, version int"
    one = deep(spark, "tree_id").where("group_no = 1").drop("group_no")
    nodes, trees = tree.appended(one, spark.createDataFrame([(1, 13, "x", 0)], about), one, spark.createDataFrame([(1, 13, "y", 0)], about))
    assert trees.first().total_pages == 26
    found = nodes.withColumnRenamed("tree_id", "doc_id")
    held = json.loads(tree.as_json(found).first().tree)
    listed = tree.from_json(tree.as_json(found)).collect()
    assert len(listed) == 11 and sum(r.summary is not None for r in listed) == 10  # the same ids came twice, and no node is lost
    assert [(c["title"], c["start_page"], c["end_page"]) for c in held["children"]] == [("G1 L0", 1, 13), ("G1 L0", 14, 26)]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.md").write_text("# Whales\n\nAll about whales.\n\n## Ships\n\nHow ships sail.\n")
    (tmp_path / "b.md").write_text("# Storms\n\nWind and rain.\n")
    index, merged, found = (str(tmp_path / x) for x in ("i.json", "m.json", "r.json"))
    assert cli.main(["generate", "--md", str(tmp_path / "a.md"), "-o", index, "--summaries"]) == 0
    held = json.loads((tmp_path / "i.json").read_text())
    assert held["total_pages"] == 1 and held["root"]["title"].startswith("Whales") and held["root"]["summary"]  # one section is the root itself
    assert cli.main(["search", "--index", index, "-q", "whales", "-o", found]) == 0
    assert json.loads((tmp_path / "r.json").read_text())["nodes"][0]["start_page"] == 1
    assert "page 1" in capsys.readouterr().out
    for k, source in enumerate((index, merged)):  # the second time the same file comes again
        assert cli.main(["update", "--existing", source, "--md", str(tmp_path / "b.md"), "-o", merged]) == 0
        both = json.loads((tmp_path / "m.json").read_text())
        assert (both["total_pages"], both["version"], len(both["root"]["children"])) == (k + 2, k + 1, 2)
    first = both["root"]["children"][0]["children"][0]
    assert first["summary"] == held["root"]["summary"]
    with pytest.raises(SystemExit):
        cli.main(["generate", "--md", "x", "--pdf", "y"])
