"""generate, update and search over many documents at once.

Every step asks through a Model, given as such or as a plain provider: what fails is asked for again,
and what stays failed is in the model's problems (strict: an error), while the document goes on with
what it has.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrove.functions.jsonrepair import lenient_json, strict_json
from quillgrove.functions.prompts import task_line
from quillgrove.functions.text import clean_title, dots_to_colon, language, node_id, normalize_structure, one_line, page_tags, physical_index, with_scripts
from quillgrove.operators import grouping, summaries, toc, tree
from quillgrove.operators.model import Model
from quillgrove.operators.provider import Provider, by_rule
from quillgrove.plans.lineage import Rounds, settled

SAMPLE_PAGES, SAMPLE_CHARACTERS = 20, 2000


def languages(pages: DataFrame) -> DataFrame:
    """(doc_id, language) from each document's text."""
    return with_scripts(grouping.full_text(pages), "text", SAMPLE_CHARACTERS).select("doc_id", language("scripts").alias("language"))


def contents_pages(pages: DataFrame, provider: Provider | Model = by_rule, limit: int = SAMPLE_PAGES, calls: int = 20) -> DataFrame:
    """(doc_id, page) of the first run of contents pages; what the model can't be asked has no verdict.

    The first `limit` pages are asked about; the others only where the run reaches that far.
    """
    model = Model.of(provider, calls)

    def verdicts(own: DataFrame) -> DataFrame:
        asked = own.withColumn("prompt", F.concat(F.lit("contents\n"), F.col("text")))
        told = model.ask(asked.select("doc_id", "page", "prompt"), "contents")
        verdict = F.lower(F.get_json_object(lenient_json("reply"), "$.toc_detected")) == "yes"
        return told.select("doc_id", "page", F.when(F.col("problem").isNull(), F.coalesce(verdict, F.lit(False))).alias("is_toc"))

    placed = pages.select("doc_id", (F.col("page_number") - 1).alias("page"), "text")
    first = verdicts(placed.where(F.col("page") < limit))
    reaching = settled(toc.toc_run(first, limit).where(F.col("page") == limit - 1).select("doc_id"))
    if not reaching.isEmpty():
        first = first.unionByName(verdicts(placed.where(F.col("page") >= limit).join(reaching, "doc_id", "left_semi")))
    return toc.toc_run(first, limit)


def contents_text(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, last, text) of the contents pages and the number of the last one, with leaders as colons. Pages that don't exist are left out."""
    met = pages.join(found.select("doc_id", (F.col("page") + 1).alias("page_number")), ["doc_id", "page_number"])
    listed = F.array_sort(F.collect_list(F.struct("page_number", "text")))
    return met.groupBy("doc_id").agg(F.max("page_number").alias("last"), dots_to_colon(F.array_join(F.transform(listed, lambda p: p["text"]), "\n")).alias("text"))


def contents_modes(contents: DataFrame, provider: Provider | Model = by_rule, calls: int = 20) -> DataFrame:
    """(doc_id, mode): whether a document's contents pages give page numbers."""
    told = Model.of(provider, calls).ask(contents.select("doc_id", F.concat(F.lit("numbered\n"), F.col("text")).alias("prompt")), "numbered")
    given = F.lower(F.get_json_object(lenient_json("reply"), "$.page_index_given_in_toc")) == "yes"
    return told.select("doc_id", F.when(given, "numbered").otherwise("unnumbered").alias("mode"))


LISTED = "array<struct<structure: string, title: string, page: string>>"


def contents_items(contents: DataFrame, provider: Provider | Model = by_rule, calls: int = 20, rounds: int = 5) -> DataFrame:
    """(doc_id, list_index, structure, title, page) that contents pages list.

    The model is asked whether it has listed all, and for the rest where it hasn't, `rounds` times at
    most. What it can't be asked is taken to be complete; a round that adds nothing is the last one. A
    list that the model still calls incomplete is kept as it is, and is one of the model's problems.
    """
    model = Model.of(provider, calls)

    def replies(asked: DataFrame, task: str) -> DataFrame:
        return model.ask(asked.select("doc_id", "prompt"), task)

    def listed(told: DataFrame) -> DataFrame:
        return told.select("doc_id", F.coalesce(F.from_json(lenient_json("reply"), LISTED), F.array().cast(LISTED)).alias("more"))

    about = lambda task: F.concat(F.lit(f"{task}\n"), F.to_json("held"), F.lit("\n"), F.col("text"))
    contents = settled(contents.select("doc_id", "text"))
    begun = listed(replies(contents.withColumn("prompt", F.concat(F.lit("listed\n"), F.col("text"))), "listed"))
    open_ = settled(contents.join(begun.withColumnRenamed("more", "held"), "doc_id"))
    done = open_.limit(0)
    for turn in range(rounds + 1):
        said = replies(open_.withColumn("prompt", about("complete")), "complete")
        lacking = settled(said.where(F.lower(F.get_json_object(lenient_json("reply"), "$.completed")) == "no").select("doc_id"))
        done = done.unionByName(open_.join(lacking, "doc_id", "left_anti"))
        open_ = settled(open_.join(lacking, "doc_id", "left_semi"))
        if open_.isEmpty():
            break
        if turn == rounds:
            model.report(open_, "continue", f"contents incomplete after {rounds} rounds")
            break
        told = replies(open_.withColumn("prompt", about("continue")), "continue")
        more = settled(listed(told).where(F.size("more") > 0))
        stuck = settled(open_.join(more, "doc_id", "left_anti"))
        model.report(stuck.join(told.where("problem is not null"), "doc_id", "left_anti"), "continue", "contents incomplete, and nothing more was listed")
        done = done.unionByName(stuck)
        open_ = settled(open_.join(more, "doc_id").select("doc_id", "text", F.concat("held", "more").alias("held")))
    rows = done.unionByName(open_).select("doc_id", F.posexplode("held").alias("list_index", "i"))
    return rows.select("doc_id", "list_index", normalize_structure("i.structure").alias("structure"), clean_title("i.title").alias("title"), F.col("i.page").try_cast("int").alias("page"))


def placed_items(items: DataFrame, texts: DataFrame, provider: Provider | Model = by_rule, calls: int = 20) -> DataFrame:
    """(doc_id, title, physical_index): the first page of texts(doc_id, part, text), tagged ones, that the model finds an item on."""
    listed = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("list_index", "structure", "title"))), lambda x: F.struct(x["structure"].alias("structure"), x["title"].alias("title"))))
    asked = texts.join(items.groupBy("doc_id").agg(listed.alias("items")), "doc_id").select("doc_id", "part", F.concat(F.lit("place\n"), F.col("items"), F.lit("\n"), F.col("text")).alias("prompt"))
    told = Model.of(provider, calls).ask(asked, "place")
    rows = toc.parse_items(told.select("doc_id", "part", lenient_json("reply").alias("json")))
    return rows.withColumn("at", physical_index("physical_index")).where("at > 0").groupBy("doc_id", "title").agg(F.min("at").alias("physical_index"))


def page_counts(pages: DataFrame) -> DataFrame:
    """(doc_id, total_pages)"""
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("total_pages"))


def numbered_items(pages: DataFrame, contents: DataFrame, provider: Provider | Model = by_rule, calls: int = 20) -> DataFrame:
    """Items of contents pages with page numbers: where some of them are found in the pages after gives the offset of all.

    Items that the offset gives no page, as their contents line has none, are looked for between their
    neighbours.
    """
    model = Model.of(provider, calls)
    items = settled(contents_items(contents, model))
    after = pages.join(contents.select("doc_id", "last"), "doc_id").where(F.col("page_number").between(F.col("last") + 1, F.col("last") + 1 + SAMPLE_PAGES))
    listed = F.array_sort(F.collect_list(F.struct("page_number", page_tags("text", "page_number").alias("t"))))
    texts = after.groupBy("doc_id").agg(F.lit(1).alias("part"), F.array_join(F.transform(listed, lambda p: p["t"]), "").alias("text"))
    found = settled(items.join(placed_items(items, texts, model), ["doc_id", "title"]).select("doc_id", "title", "list_index", "physical_index"))
    pairs = toc.title_pairs(found, settled(toc.may_pair(found, items))).join(page_counts(pages), "doc_id")
    offsets = settled(toc.page_offsets(pairs, F.col("total_pages")).select("doc_id", "page_offset"))
    met = items.join(offsets, "doc_id").withColumn("physical_index", F.col("page") + F.col("page_offset"))
    placed = met.select("doc_id", "structure", "title", "list_index", "page", F.when(F.col("physical_index") > 0, F.col("physical_index")).alias("physical_index"))
    return filled(settled(placed), pages, model)


def filled(items: DataFrame, pages: DataFrame, provider: Provider | Model = by_rule, calls: int = 20) -> DataFrame:
    """Items without a physical index get the first page between their neighbours' that has their title; those after the last known one stay."""
    bounded = toc.neighbour_bounds(items, 0).where(F.col("physical_index").isNull() & F.col("after").isNotNull())
    found = found_between(bounded, pages, Model.of(provider, calls), "fill")
    met = items.join(found, ["doc_id", "list_index"], "left")
    return met.withColumns({"page": F.when(F.col("found").isNull(), F.col("page")), "physical_index": F.coalesce("found", "physical_index")}).drop("found")


def found_between(bounded: DataFrame, pages: DataFrame, model: Model, step: str) -> DataFrame:
    """(doc_id, list_index, found): the first page from `before` to `after`, both included, that the model finds a title on."""
    wide = bounded.where("before <= after").select("doc_id", "list_index", "title", F.explode(F.sequence(F.greatest("before", F.lit(1)), F.greatest("after", F.lit(1)))).alias("page_number"))
    asked = wide.join(pages, ["doc_id", "page_number"]).withColumn("prompt", F.concat(F.lit("appears\n"), one_line("title"), F.lit("\n"), F.col("text")))
    told = model.ask(asked.select("doc_id", "list_index", "page_number", "prompt"), step)
    return told.where(F.lower(F.get_json_object(lenient_json("reply"), "$.answer")) == "yes").groupBy("doc_id", "list_index").agg(F.min("page_number").alias("found"))


def _as_list(items: DataFrame) -> DataFrame:
    """(doc_id, held): items as the JSON that a prompt shows, in the order of the list."""
    shown = F.struct("list_index", "structure", "title", "physical_index")
    listed = F.transform(F.array_sort(F.collect_list(shown)), lambda x: F.struct(x["structure"].alias("structure"), x["title"].alias("title"), F.when(x["physical_index"].isNotNull(), F.concat(F.lit("<physical_index_"), x["physical_index"], F.lit(">"))).alias("physical_index")))
    return items.groupBy("doc_id").agg(F.to_json(listed).alias("held"))


def _rounds(groups: DataFrame):
    """The groups of pages as rounds: the first one of every document, the second one, and so on, each with `group_no`.

    A round reads its own groups: those of each number have a folder of their own.
    """
    held = Rounds(groups.sparkSession).put(groups, "group_no")
    for k in range(1, (held.agg(F.max("group_no")).first()[0] or 0) + 1):
        yield k, held.where(F.col("group_no") == k)


def _still_asked(items: DataFrame, group: DataFrame, done: list[DataFrame]) -> DataFrame:
    """Items of the documents that have a group in this round; those of the others go to `done`, as no later round has one."""
    here = group.select("doc_id").distinct().withColumn("here", F.lit(True))
    met = settled(items.join(here, "doc_id", "left"))
    done.append(met.where("here is null").drop("here"))
    return met.where("here").drop("here")


def _every(items: DataFrame, done: list[DataFrame]) -> DataFrame:
    out = items
    for rows in done:
        out = out.unionByName(rows)
    return out


def unnumbered_items(pages: DataFrame, contents: DataFrame, provider: Provider | Model = by_rule, tokens: int = 16_000, calls: int = 20, vocabulary: str | None = None) -> DataFrame:
    """Items of contents pages without page numbers: each is looked for in the groups of the pages after.

    A round for each group, over all documents at once: the model is shown the items with the pages
    found so far, and its reply counts only if it is as long as the list. What it gives a page for, again
    or for the first time, has that page from then on.
    """
    model = Model.of(provider, calls)
    items = settled(contents_items(contents, model).select("doc_id", "structure", "title", "list_index", F.lit(None).cast("int").alias("physical_index")))
    after = pages.join(contents.select("doc_id", "last"), "doc_id").where("page_number > last").drop("last")
    done: list[DataFrame] = []
    for _, group in _rounds(grouping.balanced_groups(after, tokens, vocabulary)):
        items = _still_asked(items, group, done)
        asked = group.join(_as_list(items), "doc_id").select("doc_id", F.concat(F.lit("locate\n"), F.col("held"), F.lit("\n"), F.col("text")).alias("prompt"))
        rows = toc.parse_items(model.ask(asked, "locate").select("doc_id", lenient_json("reply").alias("json")))
        replies = rows.select("doc_id", F.col("list_index").alias("nth"), physical_index("physical_index").alias("physical_index"))
        items = settled(toc.assign_pages(items, replies))
    return _every(items, done).select("doc_id", "structure", "title", "list_index", F.lit(None).cast("int").alias("page"), "physical_index")


def items_of(pages: DataFrame, provider: Provider | Model = by_rule, tokens: int = 16_000, calls: int = 20, spoken: DataFrame | None = None, vocabulary: str | None = None) -> DataFrame:
    """Contents items (doc_id, structure, title, list_index, page, physical_index) that a model finds in the text.

    A document's text is asked for group by group, a round for each over all documents at once: the
    model is shown the items found so far, and what it adds is merged. Of the first group an index below
    1 is none; of the later ones an index that can't be read is 0, so the first page.
    `spoken`, languages() of the documents, makes prompts name the language.
    """
    model = Model.of(provider, calls)
    groups = grouping.balanced_groups(pages, tokens, vocabulary)
    groups = groups if spoken is None else groups.join(spoken, "doc_id", "left")
    spoken_in = None if spoken is None else "language"
    shape = "array<struct<structure: string, title: string, physical_index: string>>"
    items: DataFrame | None = None
    done: list[DataFrame] = []
    for k, group in _rounds(groups):
        items = items if items is None else _still_asked(items, group, done)
        if k == 1:
            asked = group.select("doc_id", F.concat(task_line("items", spoken_in), F.col("text")).alias("prompt"))
        else:
            held = F.coalesce("held", F.lit("[]"))
            asked = group.join(_as_list(items), "doc_id", "left").select("doc_id", F.concat(task_line("more", spoken_in), held, F.lit("\n"), F.col("text")).alias("prompt"))
        told = model.ask(asked, "items")
        rows = told.select("doc_id", F.posexplode(F.from_json(lenient_json("reply"), shape)).alias("pos", "i"))
        at = physical_index("i.physical_index")
        index = F.when(at > 0, at) if k == 1 else F.when(F.coalesce("i.physical_index", F.lit("")) != "", F.coalesce(at, F.lit(0)))
        rows = rows.select("doc_id", "pos", normalize_structure("i.structure").alias("structure"), clean_title("i.title").alias("title"), index.alias("physical_index"))
        if items is None:
            items = settled(rows.withColumnRenamed("pos", "list_index"))
            continue
        sizes = items.groupBy("doc_id").agg((F.max("list_index") + 1).alias("size"))
        new = settled(rows.join(sizes, "doc_id", "left").select("doc_id", "structure", "title", (F.coalesce("size", F.lit(0)) + F.col("pos")).alias("list_index"), "physical_index"))
        names = ["doc_id", "structure", "title", "list_index"]
        asked_now = new.select("doc_id").distinct()
        added = toc.merge_items(items.join(asked_now, "doc_id", "left_semi").select(names), new.select(names)).where("added")
        items = settled(items.unionByName(added.select(names).join(new.select("doc_id", "list_index", "physical_index"), ["doc_id", "list_index"]).select(items.columns)))
    if items is None:
        return pages.limit(0).select("doc_id", *(F.lit(None).cast(t).alias(c) for c, t in (("structure", "string"), ("title", "string"), ("list_index", "int"), ("page", "int"), ("physical_index", "int"))))
    return _every(items, done).select("doc_id", "structure", "title", "list_index", F.lit(None).cast("int").alias("page"), "physical_index")


def verified(items: DataFrame, pages: DataFrame, provider: Provider | Model = by_rule, task: str = "appears", skip: bool = False, fresh: bool = False) -> DataFrame:
    """Adds `appears`: whether the model finds the title on its page (task starts: at its beginning); false without one.

    Where the model could not be asked it is null. With `skip` nothing is asked and all do; with `fresh`
    no cache is.
    """
    if skip:
        return items.withColumn("appears", F.lit(True))
    met = items.join(pages.select("doc_id", F.col("page_number").alias("physical_index"), "text"), ["doc_id", "physical_index"], "left")
    met = Rounds(items.sparkSession).put(met.select(*items.columns, F.concat(F.lit(f"{task}\n"), one_line("title"), F.lit("\n"), F.col("text")).alias("prompt"), F.col("text").isNotNull().alias("asked")), "asked")
    # Items go through the request with all their columns, so nothing is joined to its replies.
    told = Model.of(provider).ask(met.where("asked").select(*items.columns, "prompt"), task, fresh=fresh)
    yes = F.coalesce(F.lower(F.get_json_object(lenient_json("reply"), "$.answer")) == "yes", F.lit(False))
    said = told.select(*items.columns, F.when(F.col("problem").isNull(), yes).alias("appears"))
    return said.unionByName(met.where("not asked").select(*items.columns, F.lit(False).alias("appears")))


def repaired(items: DataFrame, pages: DataFrame, provider: Provider | Model = by_rule) -> DataFrame:
    """Items whose title is not on their page move to the first page between their right neighbours that has it."""
    last = pages.groupBy("doc_id").agg(F.max("page_number").alias("last"))
    bounded = toc.neighbour_bounds(items.join(last, "doc_id"), 0, F.col("last"), F.col("appears"))
    found = found_between(bounded.where("not appears"), pages, Model.of(provider), "repair")
    return items.join(found, ["doc_id", "list_index"], "left").withColumn("physical_index", F.coalesce("found", "physical_index")).withColumn("appears", F.col("appears") | F.col("found").isNotNull()).drop("found")


def checked(items: DataFrame, pages: DataFrame, provider: Provider | Model = by_rule, repair: bool = True) -> tuple[DataFrame, DataFrame]:
    """Items after verification, and (doc_id, route): accept, repair, fallback or unverified.

    Documents whose last known index is before the middle are taken as they are. Documents of which
    fewer than half of the titles are on their pages are verified once more. From a half on, items that
    are wrong are looked for again; of documents below three tenths no items are left.
    """
    model = Model.of(provider)
    total = page_counts(pages).withColumnRenamed("total_pages", "in_all")
    ends = settled(toc.last_index(items.join(total, "doc_id"), F.col("in_all")).select("doc_id", "verify"))
    asked = items.join(ends.where("verify"), "doc_id", "left_semi")
    told = settled(verified(asked, pages, model))
    routes = settled(toc.accuracy(told.where("appears is not null and physical_index is not null")).select("doc_id", "route"))
    again = settled(routes.where("route <> 'accept'").select("doc_id"))
    if not again.isEmpty():
        second = verified(asked.join(again, "doc_id", "left_semi"), pages, model, fresh=True)
        told = settled(told.join(again, "doc_id", "left_anti").unionByName(second))
        routes = settled(toc.accuracy(told.where("appears is not null and physical_index is not null")).select("doc_id", "route"))
    every = settled(ends.join(routes, "doc_id", "left").select("doc_id", F.coalesce("route", F.when(F.col("verify"), F.lit("fallback")).otherwise(F.lit("unverified"))).alias("route")))
    failed = told.groupBy("doc_id").agg(F.max(F.col("appears").isNotNull()).alias("any")).where("not any").select("doc_id")
    every = settled(every.join(failed.withColumn("f", F.lit(True)), "doc_id", "left").select("doc_id", F.when(F.col("f"), "unverified").otherwise(F.col("route")).alias("route")))
    sound = told.join(every.where("route = 'accept'"), "doc_id", "left_semi")
    fixed = (repaired(sound, pages, model) if repair else sound).drop("appears")
    rest = items.join(every.where("route in ('repair', 'unverified')"), "doc_id", "left_semi")
    return settled(fixed.select(items.columns).unionByName(rest)), every


def headed_items(items: DataFrame, pages: DataFrame, last: DataFrame) -> DataFrame:
    """Valid items within their document's pages, with the headings of its pages, and total_pages."""
    own = toc.valid_items(items).join(last, "doc_id")
    own = own.withColumn("physical_index", toc.clamp(F.coalesce("physical_index", "page"), "total_pages"))
    return settled(toc.upsert_headings(own.drop("total_pages"), pages.join(own.select("doc_id").distinct(), "doc_id", "left_semi")).join(last, "doc_id"))


def generate(pages: DataFrame, provider: Provider | Model = by_rule, tokens: int = 16_000, verify: bool = False, summarise: bool = False, cache: DataFrame | None = None, calls: int = 20, batched: bool = False, name_language: bool = False, strict: bool = False, repair: bool = True, starts: bool = False, vocabulary: str | None = None) -> DataFrame:
    """nodes(doc_id, node_id, parent_id, ordinal, depth, structure, title, start_page, end_page, summary) of pages.

    Items come from contents pages with page numbers, else from contents pages without, else from the
    text. A document for which a way gives nothing goes on to the next one. So does, with `verify`, one
    with fewer than three tenths of its titles on their pages (checked()). Documents that no way serves
    get a node for each page. Chapters of one number become one. A single section that is no chapter is
    the root, else the root is "Document". With `name_language` the model is told which language a
    document is in; with `starts` a column `appear_start` says whether a title begins its page.
    Page groups have as many `tokens` at most, estimated or counted by a `vocabulary` (a file).
    A plain provider's failures are warned of; pass a Model to have them as rows, or strict for an error.
    """
    model = Model.of(provider, calls, strict, cache)
    out = _generated(pages, model, tokens, verify, batched if summarise else None, name_language, repair, starts, vocabulary)
    if model is not provider:
        _warn(model, pages)
    return out


def _warn(model: Model, pages: DataFrame) -> None:
    if model.failed:
        warnings.warn(f"{model.problems(pages.sparkSession).count()} requests failed; pass a Model to see which", stacklevel=3)


def _generated(pages: DataFrame, model: Model, tokens: int, verify: bool, batched: bool | None, name_language: bool, repair: bool, starts: bool, vocabulary: str | None = None) -> DataFrame:
    spoken = settled(languages(pages)) if name_language else None
    last = settled(page_counts(pages))
    contents = settled(contents_text(pages, contents_pages(pages, model)))
    modes = settled(contents_modes(contents, model))
    ways = {
        "numbered": lambda own: numbered_items(own, contents.join(own.select("doc_id").distinct(), "doc_id", "left_semi"), model),
        "unnumbered": lambda own: unnumbered_items(own, contents.join(own.select("doc_id").distinct(), "doc_id", "left_semi"), model, tokens, vocabulary=vocabulary),
        "text": lambda own: items_of(own, model, tokens, spoken=spoken, vocabulary=vocabulary),
    }
    done: list[DataFrame] = []
    waiting = last.join(modes, "doc_id", "left").select("doc_id", F.coalesce("mode", F.lit("text")).alias("mode"))
    tried: list[str] = []
    for mode, way in ways.items():
        tried.append(mode)
        asked = waiting.where(F.col("mode").isin(tried))
        for made in done:
            asked = asked.join(made.select("doc_id").distinct(), "doc_id", "left_anti")
        asked = settled(asked.select("doc_id"))
        if asked.isEmpty():
            continue
        own = pages.join(asked, "doc_id", "left_semi")
        items = headed_items(way(own), own, last)
        if verify:
            items = checked(items, own, model, repair)[0]
        done.append(items)
    columns = ["doc_id", "structure", "title", "list_index", "page", "physical_index", "total_pages"]
    items = done[0].select(columns) if done else last.limit(0).select("doc_id", *(F.lit(None).cast(k).alias(c) for c, k in zip(columns[1:], ("string", "string", "int", "int", "int", "int"), strict=True)))
    for made in done[1:]:
        items = items.unionByName(made.select(columns))
    plain = pages.join(items, "doc_id", "left_anti")
    chinese = languages(plain).select("doc_id", (F.col("language.code") == "zh").alias("chinese"))
    rest = toc.fallback_items(plain.join(chinese, "doc_id"), F.col("chinese")).withColumn("list_index", F.lit(None).cast("int")).join(last, "doc_id")
    front = toc.preface(items).withColumn("list_index", F.lit(-1)).join(last, "doc_id")
    columns = ["doc_id", "structure", "title", "physical_index", "list_index", "total_pages"]
    every = items.select(columns).unionByName(front.select(columns)).unionByName(rest.select(columns)).where(F.coalesce("structure", F.lit("")) != "")
    ranged = tree.first_wins(toc.end_pages(settled(every), F.col("total_pages"), ("title",))).select("doc_id", "structure", "title", F.col("physical_index").alias("start_page"), "end_page")
    nodes = settled(tree.chapters_joined(settled(tree.linked(tree.with_ancestors(ranged)))))
    out = settled(tree.rooted(nodes, last).withColumn("summary", F.lit(None).cast("string")))
    if starts:
        out = settled(with_starts(out, pages, model))
    return out if batched is None else settled(summaries.summarised(out, pages, model, batched=batched, spoken=spoken))


def with_starts(nodes: DataFrame, pages: DataFrame, provider: Provider | Model = by_rule, skip: bool = False) -> DataFrame:
    """Nodes with `appear_start`: yes where the title begins its first page, no where it doesn't, is nowhere or can't be asked about. `skip`: yes."""
    own = nodes.select("doc_id", F.col("node_id").alias("list_index"), "title", F.col("start_page").alias("physical_index"))
    told = verified(own, pages, provider, "starts", skip).select("doc_id", F.col("list_index").alias("node_id"), F.when(F.col("appears"), "yes").otherwise("no").alias("appear_start"))
    return nodes.join(told, ["doc_id", "node_id"], "left")


def grouped_trees(pages: DataFrame, provider: Provider | Model = by_rule, tokens: int = 16_000, calls: int = 20, vocabulary: str | None = None) -> DataFrame:
    """nodes of documents by page groups: the model's structure of each group, at any depth, and all of them merged.

    A group that can't be asked for is left out; one whose reply is no JSON is a bare root.
    """
    groups = grouping.greedy_groups(pages, tokens, vocabulary=vocabulary)
    tagged = pages.withColumn("tagged", page_tags("text", "page_number"))
    met = groups.select("doc_id", "group_no", "start_page", "end_page").join(tagged, "doc_id").where(F.col("page_number").between(F.col("start_page"), F.col("end_page")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "tagged"))), lambda p: p["tagged"]), "")
    asked = met.groupBy("doc_id", "group_no", "start_page", "end_page").agg(F.concat(F.lit("structure\n"), text).alias("prompt"))
    told = Model.of(provider, calls).ask(asked, "structure").where("problem is null")
    outlined = told.select("doc_id", "group_no", "start_page", "end_page", F.try_parse_json(strict_json("reply")).alias("v"))
    return settled(tree.groups_merged(tree.outlines(outlined)))


def update(nodes: DataFrame, trees: DataFrame, pages: DataFrame, provider: Provider | Model = by_rule, tokens: int = 16_000, calls: int = 20, info: Column | None = None, by_groups: bool = True, summarise: bool = False, batched: bool = False, verify: bool = False, name_language: bool = False, strict: bool = False, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Trees with new documents behind them; pages.doc_id names the tree, `info` the new document. See tree.appended.

    The new document's tree is made by page groups, or else as generate() makes it, with verification;
    with `summarise` its nodes get summaries. Columns that only one side's nodes have are null on the other.
    """
    model = Model.of(provider, calls, strict)
    if by_groups:
        spoken = settled(languages(pages)) if name_language else None
        new = grouped_trees(pages, model, tokens, vocabulary=vocabulary)
        if summarise:
            new = settled(summaries.summarised(new.withColumn("summary", F.lit(None).cast("string")), pages, model, batched=batched, spoken=spoken))
    else:
        new = _generated(pages, model, tokens, verify, batched if summarise else None, name_language, True, False, vocabulary)
    new = new.withColumnRenamed("doc_id", "tree_id")
    missing = {c: F.lit(None).cast(t) for c, t in new.dtypes if c not in nodes.columns}
    counts = pages.groupBy(F.col("doc_id").alias("tree_id")).agg(F.count(F.lit(1)).cast("int").alias("total_pages"))
    about = F.concat(F.lit("document "), F.col("tree_id").cast("string")) if info is None else info
    out = tree.appended(nodes.withColumns(missing) if missing else nodes, trees, new, counts.withColumns({"document_info": about, "version": F.lit(0)}))
    if model is not provider:
        _warn(model, pages)
    return out


def search(queries: DataFrame, nodes: DataFrame, provider: Provider | Model = by_rule, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Answers (query_id, query, answer) and referenced nodes (query_id, rank, node_id, ...) of queries(query_id, doc_id, query).

    The model sees the query and the document's tree; ids that it names and the tree hasn't are
    left out. Empty queries, and documents without a tree, give no answer.
    """
    model = Model.of(provider, cache=cache)
    trees = tree.as_json(nodes)
    asked = queries.where(F.trim("query") != "").join(trees, "doc_id")
    asked = asked.withColumn("prompt", F.concat(F.lit("search\n"), one_line("query"), F.lit("\n"), F.col("tree")))
    told = model.ask(asked.select("query_id", "doc_id", "query", "prompt"), "search", unique=True)
    if model is not provider:
        _warn(model, nodes)
    shape = "struct<answer: string, node_ids: array<string>>"
    parsed = told.select("query_id", "doc_id", "query", F.from_json(strict_json("reply"), shape).alias("r"))
    wanted = parsed.select("query_id", "doc_id", F.coalesce("r.node_ids", F.array().cast("array<string>")).alias("node_ids"))
    return parsed.select("query_id", "query", F.col("r.answer").alias("answer")), tree.looked_up(wanted, nodes)
