"""Benchmark passages in training documents, by a positional inverted index. DataFrame operations only.

The index holds the postings (term, document, position) of the terms that occur in test items.
The lists of a window's two rarest terms are read first: a posting less its term's offset is where
the window would start, and starts that both lists have are candidates. The postings of the
candidates' documents then confirm the window's other terms.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrove.llm.store import keyed, named, stored

#: Fixed value: what a word is made of, before A-Z are lowered. Java matches this much faster than
#: the equal class that names what is left out.
WORD = r"[a-z0-9A-Z\x80-\x{10FFFF}]+"
WINDOW = 10


def words(text: str) -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0))


def lowered(word: Column) -> Column:
    """A-Z lowered, other letters as they are."""
    return F.translate(word, string.ascii_uppercase, string.ascii_lowercase)


def windows(items: DataFrame, length: int = WINDOW) -> DataFrame:
    """(window, item_id, offset, term, size) of items(item_id, text).

    A window is `length` consecutive words; an item of fewer, but some, is one. Null texts, and
    those without words, have none.
    """
    listed = items.select("item_id", F.transform(words("text"), lowered).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - length, F.lit(0)))
    cut = listed.select("item_id", F.explode(F.transform(starts, lambda k: F.slice("w", k + 1, length))).alias("w")).distinct()
    return cut.select(
        F.xxhash64(F.col("item_id").cast("string"), F.to_json(F.struct("w"))).alias("window"), "item_id", F.size("w").alias("size"), F.posexplode("w").alias("offset", "term")
    )


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (term, doc, pos) of the given terms in documents(doc_id, text), stored.

    `doc` is a hash of id and text. A document's last word has a row in any case, with its position
    and a null term if it is none of the terms; one without words has a row with a null position.
    """
    keys = stored(terms.select(F.lower("term").alias("key"), "term").distinct(), "terms")
    placed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("doc"), words("text").alias("w")).select(
        "doc_id", "doc", F.size("w").alias("n_words"), F.posexplode_outer("w").alias("pos", "word")
    )
    same = (F.col("word") == F.col("term")) | (lowered(F.col("word")) == F.col("term"))
    met = placed.join(keys, (F.lower("word") == F.col("key")) & same, "left")
    met = met.where(F.col("term").isNotNull() | F.col("pos").isNull() | (F.col("pos") == F.col("n_words") - 1))
    return stored(met.select("doc_id", "doc", "n_words", "pos", "term"), "postings")


def phrases(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """Exact occurrences (doc, start, window) of windows(window, offset, term, size)."""
    lists = postings.where("term is not null").select("doc", "pos", "term")
    often = stored(lists.groupBy("term").agg(F.count(F.lit(1)).alias("often")), "often")
    ranked = wanted.join(often, "term", "left")
    missing = Window.partitionBy("window")
    ranked = ranked.withColumn("least", F.min(F.coalesce("often", F.lit(0))).over(missing)).where("least > 0")
    ranked = stored(ranked.withColumn("nth", F.row_number().over(missing.orderBy("often", "term", "offset"))).select("window", "offset", "term", "size", "nth"), "ranked")
    starts = lambda nth: (
        lists.join(ranked.where(F.col("nth") == nth).select("window", "offset", "term", "size"), "term").select("doc", (F.col("pos") - F.col("offset")).alias("start"), "window", "size").where("start >= 0")
    )
    first = starts(1)
    both = first.where("size > 1").join(starts(2).drop("size"), ["doc", "start", "window"], "left_semi")
    candidates = stored(first.where("size = 1").unionByName(both).distinct(), "candidates")
    probes = candidates.where("size > 2").join(ranked.where("nth > 2").drop("size", "nth"), "window").select("doc", "start", "window", "size", (F.col("start") + F.col("offset")).alias("pos"), "term")
    near = lists.join(stored(candidates.where("size > 2").select("doc").distinct(), "candidate-docs"), "doc", "left_semi").distinct()
    kept = probes.join(near, ["doc", "pos", "term"], "left_semi").groupBy("doc", "start", "window", "size").agg(F.count(F.lit(1)).alias("n")).where("n = size - 2")
    return candidates.where("size <= 2").select("doc", "start", "window", "size").unionByName(kept.drop("n"))


def proximity(postings: DataFrame, wanted: DataFrame, within: int) -> DataFrame:
    """Documents' stretches of at most `within` words that hold all terms of a query, in any order.

    wanted: (window, term). The rarest term's postings give the places to look at: (doc, pos,
    window), where every other term has a posting less than `within` words away, and all of them
    fit into one stretch that starts at one of these postings.
    """
    lists = postings.where("term is not null").select("doc", "pos", "term").distinct()
    often = lists.groupBy("term").agg(F.count(F.lit(1)).alias("often"))
    asked = wanted.select("window", "term").distinct().join(stored(often, "often"), "term", "left")
    whole = Window.partitionBy("window")
    asked = asked.withColumn("least", F.min(F.coalesce("often", F.lit(0))).over(whole)).where("least > 0")
    asked = stored(asked.withColumn("nth", F.row_number().over(whole.orderBy("often", "term"))).withColumn("terms", F.count(F.lit(1)).over(whole)).drop("least"), "asked")
    places = lists.join(asked.select("window", "term", "nth", "terms"), "term")
    # Buckets as wide as the stretch: what is near lies in the same or a neighbouring one.
    rare = places.where("nth = 1").select("doc", "window", F.col("pos").alias("at"), F.explode(F.array(*(F.floor(F.col("pos") / within) + k for k in (-1, 0, 1)))).alias("bucket"))
    all_near = places.withColumn("bucket", F.floor(F.col("pos") / within)).join(rare, ["doc", "window", "bucket"]).where(F.abs(F.col("pos") - F.col("at")) < within)
    own = Window.partitionBy("doc", "window", "at").orderBy("pos").rangeBetween(0, within - 1)
    full = all_near.withColumn("held", F.size(F.collect_set("nth").over(own))).where("held = terms")
    return full.select("doc", F.col("at").alias("pos"), "window").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, length: int = WINDOW) -> DataFrame:
    """Words of documents(doc_id, text) that lie in windows of items(item_id, text).

    Returns per row doc_id, n_words, n_hit, n_items, items_sha256, contaminated. Null texts have no
    words and are not contaminated; repeated rows get a row each; without items nothing is hit, and an
    empty table gives no rows; other columns are not looked at.
    """
    wanted = stored(windows(items, length), "windows")
    postings = index(keyed(docs), wanted)
    found = stored(phrases(postings, wanted), "phrases")
    positions = found.select("doc", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("pos")).distinct()
    hit = positions.groupBy("doc").agg(F.count(F.lit(1)).alias("n_hit"))
    owned = found.join(wanted.select("window", "item_id").distinct(), "window").select("doc", F.col("item_id").cast("string").alias("item")).distinct()
    listed = owned.groupBy("doc").agg(F.sort_array(F.collect_list("item")).alias("items"))
    marked = stored(hit.join(listed, "doc", "left"), "hits")
    # A row of a document: its last word's, or the one without words. Copies of a row have one each.
    rows = postings.where("pos is null or pos = n_words - 1").select("doc_id", "doc", F.greatest("n_words", F.lit(0)).alias("n_words"))
    joined = rows.join(marked, "doc", "left")
    names = F.coalesce("items", F.array().cast("array<string>"))
    return named(
        joined.select(
            "doc_id",
            F.col("n_words").cast("long"),
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.size(names).cast("long").alias("n_items"),
            F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
            F.col("n_hit").isNotNull().alias("contaminated"),
            "doc",
        )
    )
