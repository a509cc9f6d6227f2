"""Contents items: detection, reconciliation of page numbers, merging, ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrove.functions.text import HEADING, bounded_distance, col, digit_changes, normalize_structure, normalize_title, page_tags, strip, titles_match


def valid_items(items: DataFrame) -> DataFrame:
    """Items that have a page of either kind."""
    return items.where(F.col("physical_index").isNotNull() | F.col("page").isNotNull())


def clamp(index: Column | str, pages: Column | str) -> Column:
    """Into 1..pages; null stays null."""
    return F.when(col(index).isNotNull(), F.greatest(F.lit(1), F.least(col(index), col(pages))))


def toc_run(verdicts: DataFrame, limit: int = 20) -> DataFrame:
    """The first run of contents pages, of verdicts(doc_id, page, is_toc), as (doc_id, page).

    It must begin before page `limit` (pages count from 0). Pages without a verdict end no run.
    """
    told = verdicts.where(F.col("is_toc").isNotNull())
    by_page = Window.partitionBy("doc_id").orderBy("page")
    run = F.sum(F.when(F.col("is_toc"), 0).otherwise(1)).over(by_page)
    runs = told.withColumn("run", run).where("is_toc").withColumn("begins", F.min("page").over(Window.partitionBy("doc_id", "run")))
    first = runs.where(F.col("begins") < limit).withColumn("first", F.min("run").over(Window.partitionBy("doc_id")))
    return first.where("run = first").select("doc_id", "page")


#: Edits that two titles may be apart, and the pieces that a title is cut into: one more, so that edits leave one whole.
EDITS, PIECES = 3, 4


#: Characters whose presence in a title is a bit of letters().
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


def letters(title: Column | str) -> Column:
    """A bit for each of LETTERS that occurs in a title. An edit takes one away and adds one at most."""
    own = F.split(F.regexp_replace(col(title), f"[^{LETTERS}]", ""), "")
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.instr(F.lit(LETTERS), c))
    return F.aggregate(F.transform(own, bit), F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))


def near_keys(left: DataFrame, right: DataFrame) -> DataFrame:
    """(doc_id, k, key): different titles of left(doc_id, k) and right(doc_id, key) that titles_match()'s loose rule takes for one.

    Three edits leave one of four pieces of a title as it is. So a title meets those that have one of its
    pieces near the piece's place: a join on document, length, piece and text, in place of comparing
    all titles of a document. Both sides are taken once for each document and title. Pieces are many
    more than a plan expects of titles, so they are sorted, not broadcast; titles that meet are compared
    by their letters, then by their edits, before pairs are made distinct.
    """
    one, other = left.select("doc_id", "k").distinct(), right.select("doc_id", "key").distinct()
    # Piece i of a title of n characters: n div 4 of them, one more in the last n mod 4 pieces.
    size = lambda n, i: F.floor(n / PIECES).cast("int") + F.when(i >= PIECES - n % PIECES, 1).otherwise(0)
    begin = lambda n, i: i * F.floor(n / PIECES).cast("int") + F.greatest(F.lit(0), i - (PIECES - n % PIECES))
    n, i = F.col("n"), F.col("i")
    pieces = F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1)))
    cut = one.select("doc_id", "k", letters("k").alias("k_letters"), F.length("k").alias("n"), pieces.alias("i"))
    cut = cut.select("doc_id", "k", "k_letters", "n", "i", F.col("k").substr(begin(n, i) + 1, size(n, i)).alias("piece"))
    lengths = F.explode(F.sequence(F.greatest(F.lit(0), F.length("key") - EDITS), F.length("key") + EDITS))
    wide = other.select("doc_id", "key", letters("key").alias("letters"), F.length("key").alias("m"), lengths.alias("n")).select("*", pieces.alias("i"))
    # A piece moves by the edits before it at most, and by those after it when counted from the end.
    grown = F.col("m") - n
    low = F.greatest(F.lit(0), begin(n, i) - i, begin(n, i) + grown - (EDITS - i))
    high = F.least(F.col("m") - size(n, i), begin(n, i) + i, begin(n, i) + grown + (EDITS - i))
    places = wide.withColumns({"low": low, "high": high}).where("low <= high")
    texts = F.array_distinct(F.transform(F.sequence("low", "high"), lambda at: F.col("key").substr(at + 1, size(n, i))))
    parts = places.select("doc_id", "key", "letters", "n", "i", F.explode(texts).alias("piece"))
    met = cut.join(parts.hint("merge"), ["doc_id", "n", "i", "piece"]).where(F.col("k") != F.col("key"))
    lacking = lambda a, b: F.bit_count(F.col(a).bitwiseAND(F.bitwise_not(F.col(b))))
    alike = (lacking("letters", "k_letters") <= EDITS) & (lacking("k_letters", "letters") <= EDITS)
    near = met.where(alike & (bounded_distance("k", "key", EDITS) <= EDITS)).groupBy("doc_id", "k", "key").agg(F.count(F.lit(1)).alias("times"))
    # `times` keeps the dearer test behind the grouping: it is for pairs that passed the others, once each.
    return near.where(F.when(F.col("times") > 0, digit_changes("k", "key") <= 1)).select("doc_id", "k", "key")


def title_pairs(physical: DataFrame, logical: DataFrame, fuzzy: bool = False) -> DataFrame:
    """(doc_id, title, page, physical_index): for each item with a physical index the first with a logical page and its title.

    Both sides: (doc_id, title, list_index, and the one or the other page). Equal titles meet by a
    hash join; those that may differ a little (of up to four characters, or all with `fuzzy`) by their
    pieces, see near_keys(). Copies of a title are compared once. What joins has as many rows as there
    are titles or pairs, whatever the tables' files hold, so that all joins are sorted.
    """
    left = physical.where("physical_index is not null").select("doc_id", "physical_index", normalize_title("title").alias("key"))
    right = logical.where("page is not null").select("doc_id", "title", "list_index", "page").withColumn("key", normalize_title("title"))
    # Of titles that are equal when normalised one is compared: the first of the right, any of the left.
    firsts = right.groupBy("doc_id", "key").agg(F.min_by(F.struct("list_index", "title", "page"), F.struct("list_index", "title")).alias("r"))
    one = left.select("doc_id", F.col("key").alias("k")).distinct()
    met = one.join(firsts.withColumnRenamed("key", "k").hint("merge"), ["doc_id", "k"])
    near = one if fuzzy else one.where(F.length("k") <= 4)
    other = firsts if fuzzy else firsts.where(F.length("key") <= 4)
    loose = near_keys(near, other).join(other.hint("merge"), ["doc_id", "key"])
    loose = loose if fuzzy else loose.where(titles_match("k", "key"))
    found = met.unionByName(loose.select(met.columns)).groupBy("doc_id", F.col("k").alias("key")).agg(F.min(F.struct("r.list_index", "r.title", "r.page")).alias("r"))
    return left.join(found.hint("merge"), ["doc_id", "key"]).select("doc_id", "r.title", "r.page", "physical_index")


def may_pair(physical: DataFrame, logical: DataFrame) -> DataFrame:
    """The items of `logical` that title_pairs() can find for `physical`: those with one of its titles, and short ones."""
    wanted = physical.select("doc_id", normalize_title("title").alias("key")).distinct().withColumn("wanted", F.lit(True))
    keyed = logical.withColumn("key", normalize_title("title"))
    return keyed.join(wanted, ["doc_id", "key"], "left").where(F.col("wanted") | (F.length("key") <= 4)).select(logical.columns)


def page_offsets(pairs: DataFrame, total_pages: Column | int) -> DataFrame:
    """(doc_id, pairs, median_offset, mode_offset, page_offset) of title pairs; total_pages is a number, or a column of each document's own.

    The offset is the median difference, of three pairs at least, unless it is more than half the
    pages; else the commonest, the smallest of equally common ones. The mean of the middle two is
    cut towards 0.
    """
    differences = F.sort_array(F.collect_list(F.col("physical_index") - F.col("page")))
    found = pairs.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("pairs"), differences.alias("d"), F.mode(F.col("physical_index") - F.col("page"), True).alias("mode_offset"), F.max(total_pages if isinstance(total_pages, Column) else F.lit(total_pages)).alias("total"))
    median = F.expr("if(pairs % 2 = 1, d[int(pairs div 2)], cast((d[int(greatest(pairs div 2, 1)) - 1] + d[int(least(pairs div 2, pairs - 1))]) div 2 as int))")
    own = F.when((F.col("pairs") >= 3) & (F.abs(median) <= F.floor(F.col("total") / 2)), median)
    return found.withColumn("median_offset", own.cast("int")).select("doc_id", "pairs", "median_offset", "mode_offset", F.coalesce("median_offset", "mode_offset").alias("page_offset"))


def merge_items(existing: DataFrame, additional: DataFrame) -> DataFrame:
    """Contents items with those of `additional` that are new: (doc_id, structure, title, list_index, added).

    An additional item goes if its normalised code or its trimmed title is known. Its code is known
    from then on even if it goes for its title; its title is not if it goes for its code. So what counts
    for a code are all items before, and for a title those that did not go for their codes: two windows,
    on document and code and on document and title. Empty codes and titles are never known.
    """
    both = existing.withColumn("added", F.lit(False)).unionByName(additional.withColumn("structure", normalize_structure("structure")).withColumn("added", F.lit(True)))
    own = both.withColumns({"code": normalize_structure(F.coalesce("structure", F.lit(""))), "name": strip(F.coalesce("title", F.lit("")))})
    before = ("added", F.asc_nulls_last("list_index"), "title", "structure")
    first = lambda by: ~F.col("added") | (F.col(by) == "") | (F.row_number().over(Window.partitionBy("doc_id", by).orderBy(*before)) == 1)
    for by in ("code", "name"):
        own = own.withColumn("first", first(by)).where("first")
    return own.select("doc_id", "structure", "title", "list_index", "added")


def merge_new_items(existing: DataFrame, additional: DataFrame) -> DataFrame:
    """merge_items where no additional item has the code of one and the title of another: two anti-joins and a first-wins."""
    code, name = normalize_structure("structure"), strip("title")
    known = existing.select("doc_id", code.alias("code"), name.alias("name"))
    new = additional.withColumns({"code": code, "name": name})
    new = new.join(known.where("code <> ''").select("doc_id", "code"), ["doc_id", "code"], "left_anti").join(known.where("name <> ''").select("doc_id", "name"), ["doc_id", "name"], "left_anti")
    first = lambda by: F.when(F.col(by) == "", 1).otherwise(F.row_number().over(Window.partitionBy("doc_id", by).orderBy("list_index")))
    new = new.withColumn("n", first("code")).where("n = 1").withColumn("n", first("name")).where("n = 1")
    own = existing.select("doc_id", "structure", "title", "list_index").withColumn("added", F.lit(False))
    return own.unionByName(new.select("doc_id", F.col("code").alias("structure"), "title", "list_index").withColumn("added", F.lit(True)))


def headings(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, pos, structure, title) of `### 1.2 Title` lines in pages."""
    codes, names = F.regexp_extract_all("text", F.lit(HEADING), F.lit(1)), F.regexp_extract_all("text", F.lit(HEADING), F.lit(2))
    found = pages.select("doc_id", "page_number", F.posexplode(F.arrays_zip(codes.alias("c"), names.alias("t"))).alias("pos", "h"))
    return found.select("doc_id", "page_number", "pos", F.col("h")["c"].alias("structure"), strip(F.col("h")["t"]).alias("title"))


def upsert_headings(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Items with the headings of pages: the last page of a code is its page, a new code takes the first heading's title.

    items(doc_id, structure, title, physical_index, page, list_index); codes are taken to be unique.
    """
    order = F.struct("page_number", "pos")
    found = headings(pages).groupBy("doc_id", "structure").agg(F.max_by("page_number", order).alias("at"), F.min_by("title", order).alias("heading"), F.min(order).alias("first"))
    last = items.groupBy("doc_id").agg(F.count(F.lit(1)).alias("items"))
    joined = items.withColumn("old", F.lit(True)).join(found, ["doc_id", "structure"], "full_outer").join(last, "doc_id", "left")
    nth = F.row_number().over(Window.partitionBy("doc_id", F.col("old").isNull()).orderBy("first")) - 1
    return joined.select(
        "doc_id", "structure", F.coalesce("title", "heading").alias("title"), F.coalesce("at", "physical_index").alias("physical_index"),
        F.when(F.col("at").isNotNull() & ~F.col("physical_index").eqNullSafe(F.col("at")), F.col("at")).otherwise(F.col("page")).alias("page"),
        F.when(F.col("old"), F.col("list_index")).otherwise(F.coalesce("items", F.lit(0)) + nth).cast("int").alias("list_index"),
    )


def sorted_rank(items: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds `nth`: by physical index, then place in the list, unknown ones last; `ties` make the order total."""
    order = [F.asc_nulls_last("physical_index"), F.asc_nulls_last("list_index"), *map(F.col, ties)]
    return items.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))


def end_pages(items: DataFrame, total_pages: Column | int, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds `end_page`: the next larger start (which belongs to both), a shared page's own, or the last page.

    Of several items on a page all but the last end there. Items without a page have no end.
    """
    ranked = sorted_rank(items, ties)
    beside = F.lead("physical_index").over(Window.partitionBy("doc_id").orderBy("nth"))
    last = total_pages if isinstance(total_pages, Column) else F.lit(total_pages)
    end = F.when(beside == F.col("physical_index"), F.col("physical_index")).otherwise(F.coalesce(beside, last))
    return ranked.withColumn("end_page", F.when(F.col("physical_index").isNotNull(), end))


def preface(items: DataFrame) -> DataFrame:
    """A row (doc_id, structure 0, title Preface, physical_index 1) for documents whose first listed item begins later."""
    first = items.groupBy("doc_id").agg(F.min_by("physical_index", "list_index").alias("first"))
    return first.where("first > 1").select("doc_id", F.lit("0").alias("structure"), F.lit("Preface").alias("title"), F.lit(1).alias("physical_index"))


def sample_text(pages: DataFrame, start: int, most: int) -> DataFrame:
    """(doc_id, pages, text): tagged pages start..start + most, both included."""
    inside = pages.where(F.col("page_number").between(start, start + most))
    listed = F.array_sort(F.collect_list(F.struct("page_number", page_tags("text", "page_number").alias("t"))))
    return inside.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.array_join(F.transform(listed, lambda p: p["t"]), "").alias("text"))


def neighbour_bounds(items: DataFrame, first: Column | int = 0, last: Column | int | None = None, known: Column | None = None) -> DataFrame:
    """Adds `before` and `after`: the nearest known physical indices in the list, or `first` and `last`.

    An index is known where it is not null and, if given, `known` holds (as for items verified to be right).
    """
    value = F.col("physical_index") if known is None else F.when(known, F.col("physical_index"))
    own = Window.partitionBy("doc_id").orderBy("list_index")
    before = F.last(value, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    back = Window.partitionBy("doc_id").orderBy(F.desc("list_index"))  # backwards, as a frame up to the end is read anew for each row
    after = F.last(value, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return items.withColumns({"before": F.coalesce(before, as_column(first)), "after": F.coalesce(after, as_column(last)) if last is not None else after})


def last_index(items: DataFrame, pages: Column | int) -> DataFrame:
    """(doc_id, last_index, verify): the last known physical index in the list; verification needs it to reach half the pages."""
    known = F.col("physical_index").isNotNull()
    total = F.max(pages if isinstance(pages, Column) else F.lit(pages)).alias("total")
    found = items.groupBy("doc_id").agg(F.max(F.when(known, F.struct("list_index", "physical_index"))).alias("m"), total)
    every = found.select("doc_id", F.coalesce("m.physical_index", F.lit(0)).alias("last_index"), "total")
    return every.withColumn("verify", (F.col("last_index") > 0) & (F.col("last_index") >= F.col("total") / 2)).drop("total")


def accuracy(verdicts: DataFrame, least: float = 0.5, warn: float = 0.3) -> DataFrame:
    """(doc_id, checked, correct, accuracy, route) of verdicts(doc_id, appears): accept, repair or fall back."""
    right = F.count_if(F.col("appears"))
    found = verdicts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("checked"), right.alias("correct"))
    share = F.col("correct") / F.col("checked")
    return found.withColumn("accuracy", share).withColumn("route", F.when(share >= least, "accept").when(share >= warn, "repair").otherwise("fallback"))


def fallback_items(pages: DataFrame, chinese: Column) -> DataFrame:
    """An item for each page, named after it: (doc_id, structure, title, physical_index)."""
    n = F.col("page_number").cast("string")
    title = F.when(chinese, F.concat(F.lit("第"), n, F.lit("页"))).otherwise(F.concat(F.lit("Page "), n))
    return pages.select("doc_id", n.alias("structure"), title.alias("title"), F.col("page_number").alias("physical_index"))


def assign_pages(items: DataFrame, replies: DataFrame) -> DataFrame:
    """Items with the pages of replies(doc_id, nth, physical_index), for documents whose reply has as many rows as items."""
    counts = items.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).join(replies.groupBy("doc_id").agg(F.count(F.lit(1)).alias("m")), "doc_id").where("n = m").select("doc_id")
    fits = replies.join(counts, "doc_id", "left_semi").select("doc_id", "nth", F.col("physical_index").alias("found"))
    placed = items.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("list_index")) - 1)
    return placed.join(fits, ["doc_id", "nth"], "left").withColumn("physical_index", F.coalesce("found", "physical_index")).drop("nth", "found")


def parse_items(replies: DataFrame, schema: str = "structure string, title string, physical_index string") -> DataFrame:
    """(doc_id, list_index, structure, title, physical_index) of replies(doc_id, json), an array of objects."""
    rows = replies.select("doc_id", F.posexplode(F.from_json("json", f"array<struct<{schema.replace(' string', ': string')}>>")).alias("list_index", "item"))
    return rows.select("doc_id", "list_index", "item.*")
