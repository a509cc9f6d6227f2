"""The seam to language models: providers, retries, rate limits, the response cache.

A provider turns a prompt into a reply. `complete` runs one over a column of prompts, a batch at a
time, in as many partitions as calls may be under way. The default needs no network: it follows
simple rules, so its replies are this library's, not a model's.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrove.functions.text import HEADING, col

Provider = Callable[[str], str]


class RetryableError(Exception):
    """A failure that a further attempt may not meet: status 429 or 5xx, or the transport's."""


@dataclass
class Limiter:
    """A token bucket of calls a second, which adapts to what the service says is left."""

    rate: float
    least: float = 0.0
    most: float = 0.0
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    held: float = field(default=0.0, init=False)
    at: float | None = field(default=None, init=False)

    def __post_init__(self) -> None:
        self.least, self.most, self.held = self.least or self.rate / 2, self.most or self.rate * 4, self.rate

    def take(self) -> None:
        now = self.clock()
        self.held = min(self.rate, self.held + (now - (now if self.at is None else self.at)) * self.rate)
        self.at = now
        if self.held < 1:
            wait = (1 - self.held) / self.rate
            self.sleep(wait)
            self.held, self.at = 1.0, self.clock()
        self.held -= 1

    def left(self, calls: int) -> None:
        """Halves the rate where fewer than half of it are left, raises it by half where over twice as many are."""
        if calls < self.rate / 2:
            self.rate = max(self.least, self.rate / 2)
        elif calls > self.rate * 2:
            self.rate = min(self.most, self.rate * 1.5)


def with_retries(provider: Provider, attempts: int = 5, first: float = 1.0, most: float = 32.0, sleep: Callable[[float], None] = time.sleep) -> Provider:
    """A provider that tries again after RetryableError, each time twice as late."""

    def run(prompt: str) -> str:
        for k in range(attempts + 1):
            try:
                return provider(prompt)
            except RetryableError:
                if k == attempts:
                    raise
                sleep(min(first * 2**k, most))
        raise AssertionError

    return run


def scripted(replies: dict[str, str], other: str = "") -> Provider:
    """Fixed replies by prompt, for tests."""
    return lambda prompt: replies.get(prompt, other)


def by_rule(prompt: str) -> str:
    """The offline provider: the task is the prompt's first line, its matter what follows.

    contents: whether at least three lines end in leaders or a number; numbered: whether most lines of
    a contents page end in a number; listed: its items; complete: yes, as those are all; place: the page that holds each of the items in
    the first line; locate: the same list as in the first line, with the pages that it lacks and the text
    has; more: items, those that the first line holds left out; appears: whether the first line of the matter occurs in the rest; starts: whether the
    rest begins with it; summary: the first sentence; summaries: that of each of several nodes;
    structure: a node for each heading, or one for the text; items: the headings; search: all nodes that
    share words with the query, those that share the most first.
    """
    head, _, matter = prompt.partition("\n")
    task = head.partition(" ")[0]
    if task == "contents":
        lines = [x for x in matter.split("\n") if re.search(r"(\.{3,}|\s)\d+\s*$", x)]
        return json.dumps({"toc_detected": "yes" if len(lines) >= 3 else "no"})
    if task in ("numbered", "listed"):
        items = [m.groups() for x in matter.split("\n") if (m := LISTED.match(x))]
        if task == "numbered":
            return json.dumps({"page_index_given_in_toc": "yes" if sum(bool(n) for *_, n in items) * 2 > len(items) else "no"})
        return json.dumps([{"structure": code, "title": title.strip(), "page": int(n) if n else None} for code, title, n in items], ensure_ascii=False)
    if task == "complete":
        return json.dumps({"completed": "yes"})
    if task == "place":
        items, _, text = matter.partition("\n")
        pages = [(int(n), _flat(body)) for n, body in re.findall(r"【第(\d+)页开始】(.*?)【第\d+页结束】", text, re.S)]
        at = lambda title: next((n for n, body in pages if title and title in body), None)
        return json.dumps([{**x, "physical_index": f"<physical_index_{n}>"} for x in json.loads(items) if (n := at(_flat(x.get("title") or ""))) is not None], ensure_ascii=False)
    if task == "locate":
        items, _, text = matter.partition("\n")
        pages = [(int(n), _flat(body)) for n, body in re.findall(r"【第(\d+)页开始】(.*?)【第\d+页结束】", text, re.S)]
        at = lambda x: x.get("physical_index") or next((n for n, body in pages if _flat(x.get("title") or "") and _flat(x["title"]) in body), None)
        return json.dumps([{**x, "physical_index": at(x)} for x in json.loads(items)], ensure_ascii=False)
    if task == "more":
        held, _, text = matter.partition("\n")
        known = {x.get("title") for x in json.loads(held)}
        return json.dumps([x for x in json.loads(_structure(text, "items")) if x["title"] not in known], ensure_ascii=False)
    if task in ("appears", "starts"):
        title, _, text = matter.partition("\n")
        found = _flat(text).startswith(_flat(title)) if task == "starts" else _flat(title) in _flat(text)
        return json.dumps({"answer": "yes" if found and _flat(title) else "no"})
    if task == "summary":
        return _first_sentence(matter.partition("\n")[2] or matter)
    if task == "summaries":
        return json.dumps([{"node_id": x["node_id"], "summary": _first_sentence(x["text"])} for x in json.loads(matter)], ensure_ascii=False)
    if task in ("structure", "items"):
        return _structure(matter, task)
    if task == "search":
        query, _, tree = matter.partition("\n")
        return _search(query, tree)
    return ""


#: Rules need no network: they may be applied in whatever partitions there are.
by_rule.local = True

MARK = re.compile(r"【第(\d+)页开始】")
#: A line of a contents page: code, title and, after leaders, a colon or spaces, a page.
LISTED = re.compile(r"\s*(\d+(?:\.\d+)*)[.)]?\s+(\S.*?)(?:(?:\s*[:：]\s*|\s*\.{3,}\s*|\s+)(\d+))?\s*$")


def _flat(text: str) -> str:
    return re.sub(r"\W+", "", text).lower()


def _first_sentence(text: str) -> str:
    return re.split(r"(?<=[.!?。！？])\s*", text.strip(), maxsplit=1)[0]


def _structure(text: str, task: str) -> str:
    page, items = 1, []
    for line in text.split("\n"):
        if found := MARK.match(line):
            page = int(found.group(1))
        elif found := re.match(HEADING, line) or re.match(r"(\d+(?:\.\d+)*)[.)]?\s+(\S.{2,80})$", line):
            items.append({"structure": found.group(1), "title": found.group(2).strip(), "physical_index": page})
    if not items:
        pages = [int(x) for x in MARK.findall(text)] or [1]
        first = next((x.strip() for x in MARK.sub("", text).split("\n") if x.strip() and not x.startswith("【")), "Text")
        items = [{"structure": "1", "title": first[:30], "physical_index": pages[0]}]
    return json.dumps(items if task == "items" else {"title": "Document", "children": items}, ensure_ascii=False)


def _search(query: str, tree: str) -> str:
    words = set(re.findall(r"\w+", query.lower()))
    found: list[tuple[int, int, str, str]] = []
    stack = [json.loads(tree)] if tree.strip() else []
    while stack:
        node = stack.pop()
        text = f"{node.get('title') or ''} {node.get('summary') or ''}"
        shared = len(words & set(re.findall(r"\w+", text.lower())))
        if shared:
            found.append((-shared, node["start_page"], node["node_id"], node.get("title") or ""))
        stack += node.get("children") or []
    found.sort()
    answer = f"See {found[0][3]}." if found else "Nothing was found."
    return json.dumps({"answer": answer, "node_ids": [x[2] for x in found]}, ensure_ascii=False)


def key(*parts: Column | str) -> Column:
    """The cache key of a request: SHA-256 over its parts, the kind of task first."""
    return F.sha2(F.concat_ws("\x1f", *(col(p) for p in parts)), 256)


def complete(requests: DataFrame, provider: Provider = by_rule, calls: int | None = 20, prompt: str = "prompt", attempts: int = 5) -> DataFrame:
    """Adds `reply`, `problem` and `left` to requests: one call for each row; a call that fails has its problem, and no reply.

    There are as many partitions as calls may be under way; with None those that there are. A call that
    fails with RetryableError is tried `attempts` times more. `left` is how many calls the service said
    were left, null where it didn't.
    """

    @F.pandas_udf("reply string, problem string, left int")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        heard: list[int] = []
        if hasattr(provider, "listeners"):
            provider.listeners.append(heard.append)
        ask = with_retries(provider, attempts)
        for batch in texts:
            replies: list[str | None] = []
            problems: list[str | None] = []
            left: list[int | None] = []
            for text in batch:
                heard.clear()
                try:
                    replies.append(ask(text))
                    problems.append(None)
                except Exception as problem:  # noqa: BLE001  reported as the row's
                    replies.append(None)
                    problems.append(f"{type(problem).__name__}: {problem}")
                left.append(heard[-1] if heard else None)
            yield pd.DataFrame({"reply": pd.Series(replies, dtype=object), "problem": pd.Series(problems, dtype=object), "left": pd.array(left, "Int32")})

    # Prompts alone go to Python.
    dealt = requests if calls is None else requests.repartition(calls)
    return dealt.select("*", run.asNondeterministic()(prompt).alias("_told")).select("*", "_told.*").drop("_told")


def completed(requests: DataFrame, cache: DataFrame | None = None, provider: Provider = by_rule, now: float | None = None, keep: float = 3600.0, calls: int = 20) -> DataFrame:
    """complete() for requests(key, prompt, ...) that the cache(key, reply, at) doesn't answer; adds `cached`.

    Replies older than `keep` seconds don't count; of several the last one does. Equal requests are asked once.
    """
    if cache is None:
        fresh, hits = requests, None
    else:
        valid = latest(cache if now is None else cache.where(F.col("at") >= F.lit(now - keep)))
        hits = requests.join(valid.select("key", "reply"), "key").withColumns({"problem": F.lit(None).cast("string"), "cached": F.lit(True)})
        fresh = requests.join(valid.select("key"), "key", "left_anti")
    asked = complete(fresh.select("key", "prompt").dropDuplicates(["key"]), provider, calls).drop("prompt", "left")
    made = fresh.join(asked, "key").withColumn("cached", F.lit(False))
    return made if hits is None else made.unionByName(hits.select(made.columns))


def remembered(cache: DataFrame, told: DataFrame, now: float, most: int = 10_000) -> DataFrame:
    """The cache(key, reply, at) after the replies told(key, reply): used entries are as of now, the oldest beyond `most` go."""
    used = told.where("reply is not null").select("key", "reply").withColumn("at", F.lit(now)).dropDuplicates(["key"])
    return pruned(latest(cache.select("key", "reply", "at").unionByName(used)), most)


def split(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests with `cached`: whether the cache has their key."""
    known = cache.select("key").distinct().withColumn("cached", F.lit(True))
    return requests.join(known, "key", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def pruned(cache: DataFrame, most: int = 10_000) -> DataFrame:
    """The cache's most recently used entries, of cache(key, reply, at): their number is what is bounded."""
    return cache.orderBy(F.desc("at"), "key").limit(most)


def latest(cache: DataFrame) -> DataFrame:
    """One entry for a key, the last one written."""
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("at"), "reply"))
    return cache.withColumn("nth", nth).where("nth = 1").drop("nth")
