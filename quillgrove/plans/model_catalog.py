"""Queries about asking models, trees without codes, JSON, chunks: each over a given table, with SQL for what it must return.

The models are scripts that answer by what they are shown, so that SQL can say what they find.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgrove.functions import chunking
from quillgrove.operators import grouping, model, provider, toc, tree
from quillgrove.operators.model import Model
from quillgrove.plans import pipeline
from quillgrove.plans.catalog import CONV, FLAT, LINES, NORMAL, PAGES, TREE, nodes, query
from quillgrove.plans.lineage import settled
from quillgrove.sources import adapters

#: Page groups as balanced_groups() makes them of `pages`, in SQL: g(doc_id, no, a, b).
GROUPS = """k as (select doc_id, page_number, (strlen('【第' || page_number || '页开始】' || text || '【第' || page_number || '页结束】') + 4) // 4 as tokens, row_number() over (partition by doc_id order by page_number) as nth from pages),
    d as (select doc_id, sum(tokens) as total, max(nth) as n, case when sum(tokens) > {0} then ((sum(tokens) // ((sum(tokens) + {0} - 1) // {0})) + {0} + 1) // 2 end as aim from k group by doc_id),
    walk as (select doc_id, 1::bigint as nth, 1::bigint as a, tokens::bigint as t, 0::bigint as fa, aim, n from k join d using (doc_id) where nth = 1
      union all select k.doc_id, k.nth, case when w.t + k.tokens > w.aim then k.nth - 1 else w.a end, case when w.t + k.tokens > w.aim then p.tokens + k.tokens else w.t + k.tokens end,
        case when w.t + k.tokens > w.aim then w.a else 0 end, w.aim, w.n from walk w join k on k.doc_id = w.doc_id and k.nth = w.nth + 1 join k p on p.doc_id = k.doc_id and p.nth = k.nth - 1),
    ends as (select doc_id, fa as a, nth - 1 as b from walk where fa > 0 union all select doc_id, a, nth from walk where nth = n),
    g as (select doc_id, row_number() over (partition by doc_id order by b) as no, a, b from ends)"""
MARK = re.compile(r"【第(\d+)页开始】")


def adds_up(prompt: str) -> str:
    """A model that lists one item for a group: its code and title tell how many items it was shown."""
    head, _, matter = prompt.partition("\n")
    held, text = [], matter
    if head.split(" ")[0] == "more":
        shown, _, text = matter.partition("\n")
        held = json.loads(shown)
    pages = MARK.findall(text)
    title = f"after {len(held)}" if len(pages) % 2 else "even"
    return json.dumps([{"structure": f"1.{len(held) + 1}", "title": title, "physical_index": f"<physical_index_{pages[0]}>"}])


@query(f"""with recursive {LINES}, {GROUPS.format(3000)},
    s as (select doc_id, no, a, (b - a + 1) % 2 = 1 as odd, 0::bigint as held, false as even_seen from g where no = 1),
    r as (select doc_id, no, a, odd, held, even_seen, case when odd then 'after ' || held when even_seen then null else 'even' end as title from s
      union all select g.doc_id, g.no, g.a, (g.b - g.a + 1) % 2 = 1, r.held + (r.title is not null)::int, r.even_seen or not r.odd,
        case when (g.b - g.a + 1) % 2 = 1 then 'after ' || (r.held + (r.title is not null)::int) when r.even_seen or not r.odd then null else 'even' end from r join g on g.doc_id = r.doc_id and g.no = r.no + 1)
    select doc_id, '1.' || (held + 1) as structure, title, held::int as list_index, a::int as physical_index from r where title is not null""")
def items_carried(spark, sf):
    """What a model is shown of earlier groups decides what it finds in the next one."""
    return pipeline.items_of(adapters.document_pages(spark, sf), adds_up, 3000).select("doc_id", "structure", "title", "list_index", "physical_index")


LISTED = ("Alpha", "Beta", "Gamma", "Delta", "Epsilon")


def places(prompt: str) -> str:
    """A model that places items by how many it was shown with a page; every fourth size of a group it forgets one."""
    task, _, matter = prompt.partition("\n")
    if task != "locate":
        return provider.by_rule(prompt)
    shown, _, text = matter.partition("\n")
    held, pages = json.loads(shown), MARK.findall(text)
    known = sum(1 for x in held if x.get("physical_index"))
    out = [{**x, "physical_index": f"<physical_index_{pages[0]}>" if (k + known) % 3 == 0 else x.get("physical_index")} for k, x in enumerate(held)]
    return json.dumps(out[1:] if len(pages) % 4 == 0 else out)


@query(f"""with recursive {LINES}, {GROUPS.format(3000)},
    r as (select doc_id, 0::bigint as no, [null, null, null, null, null]::bigint[] as held from (select distinct doc_id from g)
      union all select r.doc_id, g.no, case when (g.b - g.a + 1) % 4 = 0 then r.held else list_transform(r.held, lambda x, i: case when (i - 1 + len(list_filter(r.held, lambda y: y is not null))) % 3 = 0 then g.a else x end) end
      from r join g on g.doc_id = r.doc_id and g.no = r.no + 1),
    last as (select doc_id, arg_max(held, no) as held from r group by doc_id), t as (select unnest(range(1, {len(LISTED) + 1})) as i, unnest([{', '.join(f"'{x}'" for x in LISTED)}]) as title)
    select doc_id, i::varchar as structure, title, (i - 1)::int as list_index, held[i]::int as physical_index from last, t""")
def items_located(spark, sf):
    """Items of a contents page without numbers, placed group by group; replies of another length than the list don't count."""
    pages = adapters.document_pages(spark, sf)
    listed = "\n".join(f"{k + 1} {x}" for k, x in enumerate(LISTED))
    contents = pages.select("doc_id").distinct().select("doc_id", F.lit(0).alias("last"), F.lit(listed).alias("text"))
    return pipeline.unnumbered_items(pages, contents, places, 3000).select("doc_id", "structure", "title", "list_index", "physical_index")


def fails_on_five(prompt: str) -> str:
    if len(prompt) % 5 == 0:
        raise ValueError("a length of fives")
    return str(len(prompt))


@query("""with p as (select doc_id, 'summary' || chr(10) || text as prompt from documents)
    select doc_id::varchar as document, 'summary' as step, sha256('summary' || chr(31) || prompt) as key, case when length(prompt) % 5 = 0 then 'ValueError: a length of fives' end as problem,
    case when length(prompt) % 5 <> 0 then length(prompt)::varchar end as reply from p""")
def model_problems(spark, sf):
    """Requests with their replies, and what stayed without one, as the table of problems has it."""
    own = Model(fails_on_five, calls=4)
    told = own.ask(adapters.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("summary\n"), "text").alias("prompt")), "summary")
    found = own.problems(spark)
    replied = told.where("problem is null").select(F.col("doc_id").cast("string").alias("document"), F.lit("summary").alias("step"), "key", "problem", "reply")
    return replied.unionByName(found.withColumn("reply", F.lit(None).cast("string")))


@query("""with e as (select sha256(doc_id::varchar) as key, lang as reply, (doc_id * 37 % 101)::double as "at" from documents), n as (select count(*) // 3 as most from e)
    select key, reply, "at" from (select *, row_number() over (order by "at" desc, key) as nth from e), n where nth <= most""")
def replies_kept(spark, sf):
    """The third of the replies that was used last."""
    entries = settled(adapters.table(spark, sf, "documents").select(F.sha2(F.col("doc_id").cast("string"), 256).alias("key"), F.col("lang").alias("reply"), (F.col("doc_id") * 37 % 101).cast("double").alias("at")))
    return model.newest(entries, entries.count() // 3, 64)


# ---- trees without codes


@query("""with o as (select o_orderkey, o_orderkey % 15 as doc_id from orders), l as (select l_orderkey, count(*) as lines, min(l_linenumber)::int as low, max(l_quantity)::int as high from lineitem group by l_orderkey),
    m as (select doc_id, o_orderkey, coalesce(lines, 0) as lines, case when lines > 0 then low when row_number() over (partition by doc_id order by o_orderkey desc) = 1 then 1 end as low,
        case when lines > 0 then high when row_number() over (partition by doc_id order by o_orderkey desc) = 1 then 1 end as high from o left join l on l_orderkey = o_orderkey)
    select doc_id, o_orderkey::varchar as node_id, (count(*) over w + sum(lines) over w)::bigint as size, min(low) over w as start_page, max(high) over w as end_page from m window w as (partition by doc_id order by o_orderkey desc)
    union all select o_orderkey % 15, o_orderkey::varchar || '.' || l_linenumber::varchar || '.' || l_partkey::varchar || '.' || l_suppkey::varchar || '.' || l_extendedprice::varchar, 1, l_linenumber::int, l_quantity::int from lineitem join orders on l_orderkey = o_orderkey""")
def chain_sizes(spark, sf):
    """Orders as chains, each the parent of the next, with their lineitems as leaves: sizes and ranges of subtrees."""
    chain = adapters.table(spark, sf, "orders").select((F.col("o_orderkey") % 15).alias("doc_id"), "o_orderkey")
    before = F.lag("o_orderkey").over(Window.partitionBy("doc_id").orderBy("o_orderkey"))
    own = chain.select("doc_id", F.col("o_orderkey").cast("string").alias("node_id"), before.cast("string").alias("parent_id"), F.lit(1).alias("start_page"), F.lit(1).alias("end_page"))
    names = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = adapters.table(spark, sf, "lineitem").join(chain, F.col("l_orderkey") == F.col("o_orderkey"))
    leaves = lines.select("doc_id", F.concat_ws(".", *(F.col(c).cast("string") for c in names)).alias("node_id"), F.col("l_orderkey").cast("string").alias("parent_id"), F.col("l_linenumber").cast("int").alias("start_page"), F.col("l_quantity").cast("int").alias("end_page"))
    return tree.subtrees(own.unionByName(leaves))


@query("""select o_orderkey % 15 as doc_id, o_orderkey::varchar as node_id, (row_number() over (partition by o_orderkey % 15 order by o_orderkey) - 1)::int as level,
    coalesce(nth_value(o_orderkey, 2) over (partition by o_orderkey % 15 order by o_orderkey), o_orderkey)::varchar as top, lead(o_orderkey) over (partition by o_orderkey % 15 order by o_orderkey) is null as leaf from orders""")
def chain_levels(spark, sf):
    """Levels in chains of orders, and the node below the root."""
    before = F.lag("o_orderkey").over(Window.partitionBy("doc_id").orderBy("o_orderkey"))
    own = adapters.table(spark, sf, "orders").withColumn("doc_id", F.col("o_orderkey") % 15).select("doc_id", F.col("o_orderkey").cast("string").alias("node_id"), before.cast("string").alias("parent_id"))
    return tree.levelled(own).select("doc_id", "node_id", "level", "top", "leaf")


def _whole_trees(spark, sf) -> DataFrame:
    own = nodes(spark, sf).select("doc_id", "node_id", "parent_id", "ordinal", "title", "start_page", "end_page", F.when(F.col("size") > 1, F.concat(F.lit("on "), "title")).alias("summary"))
    # The root comes out of its first child's row, so that the trees are built once.
    root = F.struct("doc_id", F.lit("root").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(1).alias("ordinal"), F.lit("All").alias("title"), F.lit(1).alias("start_page"), F.lit(PAGES).alias("end_page"), F.lit(None).cast("string").alias("summary"))
    below = F.struct("doc_id", "node_id", F.coalesce("parent_id", F.lit("root")).alias("parent_id"), "ordinal", "title", "start_page", "end_page", "summary")
    first = F.col("parent_id").isNull() & (F.col("ordinal") == 1)
    return own.select(F.inline(F.when(first, F.array(root, below)).otherwise(F.array(below))))


@query(f"""with {TREE} select doc_id, node_id, coalesce(parent_id, 'root') as parent_id, ordinal, depth, title, start_page, end_page, case when size > 1 then 'on ' || title end as summary from nodes
    union all select distinct doc_id, 'root', null, 1, 0, 'All', 1, {PAGES}, null from nodes""")
def tree_json_read(spark, sf):
    """Trees written as JSON and read back by levels."""
    return tree.from_json(tree.as_json(_whole_trees(spark, sf)))


# ---- titles, chunks


NAMED = f"n as (select p_size as doc_id, p_partkey as list_index, p_name || ' ' || p_partkey % 100 as title, {NORMAL.format(chr(39).join(['p_name || ', ' ', ' || p_partkey % 100']))} as k, p_partkey % 2 = 0 as even from part)"


@query(f"""with {NAMED}, m as (select a.doc_id, a.list_index as nth, b.list_index, b.title, b.list_index as page, a.list_index as physical_index from n a join n b on a.doc_id = b.doc_id and a.even and not b.even
      where a.k = b.k or (levenshtein(a.k, b.k) <= 3 and len(list_filter(range(1, least(length(a.k), length(b.k)) + 1), lambda i: regexp_matches(a.k[i], '[0-9]') and regexp_matches(b.k[i], '[0-9]') and a.k[i] <> b.k[i])) <= 1))
    select doc_id, title, page::int as page, physical_index::int as physical_index from m qualify row_number() over (partition by doc_id, nth order by list_index) = 1""")
def title_pairs_fuzzy(spark, sf):
    """Of parts of a size: for each even one the first odd one whose name is within three edits."""
    own = adapters.table(spark, sf, "part").select(F.col("p_size").alias("doc_id"), F.col("p_partkey").cast("int").alias("list_index"), F.concat("p_name", F.lit(" "), (F.col("p_partkey") % 100).cast("string")).alias("title"))
    even = own.where("list_index % 2 = 0").withColumn("physical_index", F.col("list_index"))
    return toc.title_pairs(even, own.where("list_index % 2 = 1").withColumn("page", F.col("list_index")), fuzzy=True)


@query("select doc_id, text as joined, 0::bigint as too_long, strlen(text) > 900 as cut from documents where text <> ''")
def text_chunks(spark, sf):
    """Chunks by the table function in SQL, put together again: nothing is lost, none is longer than its limit and the tag that ends it."""
    chunking.register(spark)
    adapters.table(spark, sf, "documents").createOrReplaceTempView("chunked_documents")
    return spark.sql("""
        select doc_id, array_join(transform(array_sort(collect_list(struct(chunk_no, chunk))), c -> c.chunk), '') as joined, count_if(octet_length(chunk) > 1000) as too_long, count(*) > 1 as cut
        from chunked_documents, lateral text_chunks(text, 300) group by doc_id""")


# ---- where titles are


@query(f"""with {CONV}, i as (select doc_id, page_number::varchar as node_id, split_part(text, ' ', case when page_number % 2 = 0 then 1 else 2 end) as title, (page_number + doc_id % 2)::int as start_page from pages)
    select i.doc_id, node_id, title, start_page, case when {FLAT.format('title')} <> '' and starts_with({FLAT.format('text')}, {FLAT.format('title')}) then 'yes' else 'no' end as appear_start
    from i left join pages p on p.doc_id = i.doc_id and p.page_number = i.start_page""")
def title_starts(spark, sf):
    """Whether first or second words of turns begin their own turn or the next one; one behind the last is nowhere."""
    pages = adapters.conversation_pages(spark, sf)
    word = F.split_part("text", F.lit(" "), F.when(F.col("page_number") % 2 == 0, 1).otherwise(2))
    own = pages.select("doc_id", F.col("page_number").cast("string").alias("node_id"), word.alias("title"), (F.col("page_number") + F.col("doc_id") % 2).cast("int").alias("start_page"))
    return pipeline.with_starts(own, pages)


#: Orders as pages of 50 documents: the k-th order is page k, and an item of its own.
ORDERS = "b as (select o_custkey % 50 as doc_id, 'x' || o_orderkey || 'x' as title, row_number() over (partition by o_custkey % 50 order by o_orderkey)::int as k, count(*) over (partition by o_custkey % 50)::int as n from orders)"


def _orders(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(doc_id, title, k, n), and pages."""
    own = adapters.table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("doc_id"), "o_orderkey", F.concat(F.lit("x"), F.col("o_orderkey").cast("string"), F.lit("x")).alias("title"))
    by = Window.partitionBy("doc_id")
    listed = settled(own.withColumns({"k": F.row_number().over(by.orderBy("o_orderkey")), "n": F.count(F.lit(1)).over(by).cast("int")}))
    pages = listed.select("doc_id", F.col("k").alias("page_number"), F.concat("title", F.lit("\nWords on "), F.col("o_orderkey").cast("string"), F.lit(".")).alias("text"))
    return listed.drop("o_orderkey"), settled(pages)


@query(f"""with {ORDERS}, i as (select *, case when k % 3 = 1 and k < n then k end as idx, k * 10 as page from b), l as (select *, max(case when idx is not null then k end) over (partition by doc_id) as last from i)
    select doc_id, title, k - 1 as list_index, case when idx is null and k < last then null else page end as page, case when k < last then k else idx end as physical_index from l""")
def items_filled(spark, sf):
    """Items without an index, looked for between their neighbours; those after the last known one stay without."""
    listed, pages = _orders(spark, sf)
    at = F.when((F.col("k") % 3 == 1) & (F.col("k") < F.col("n")), F.col("k"))
    items = listed.select("doc_id", "title", (F.col("k") - 1).alias("list_index"), (F.col("k") * 10).alias("page"), at.alias("physical_index"))
    return pipeline.filled(items, pages).select("doc_id", "title", "list_index", "page", "physical_index")


@query(f"""with {ORDERS}, w as (select *, case when k > 1 then k - 1 else 2 end as off from b),
    i as (select *, case doc_id % 4 when 0 then off when 1 then case when k % 5 < 3 then off else k end when 2 then case when k % 5 = 0 then off else k end else case when k <= n // 3 then k end end as idx from w),
    r as (select doc_id, coalesce(arg_max(idx, k) filter (idx is not null), 0) * 2 as reach, max(n) as n, count(*) filter (idx = k) / count(idx) as share from i group by doc_id),
    t as (select doc_id, case when reach = 0 or reach < n then 'unverified' when share >= 0.5 then 'accept' when share >= 0.3 then 'repair' else 'fallback' end as route from r)
    select doc_id, route, title, k - 1 as list_index, case when route = 'accept' then k else idx end as physical_index from t join i using (doc_id) where route <> 'fallback'
    union all select doc_id, route, null, null, null from t where route = 'fallback'""")
def verification_routes(spark, sf):
    """Documents whose items are all on a wrong page, mostly, seldom, or known for the first third only: what checked() makes of them."""
    listed, pages = _orders(spark, sf)
    k, kind = F.col("k"), F.col("doc_id") % 4
    off = F.when(k > 1, k - 1).otherwise(2)
    seldom, mostly = F.when(k % 5 == 0, off).otherwise(k), F.when(k % 5 < 3, off).otherwise(k)
    at = F.when(kind == 0, off).when(kind == 1, mostly).when(kind == 2, seldom).otherwise(F.when(k <= F.floor(F.col("n") / 3), k))
    items = listed.select("doc_id", "title", (k - 1).alias("list_index"), at.cast("int").alias("physical_index"))
    kept, routes = pipeline.checked(settled(items), pages)
    return routes.join(kept, "doc_id", "left").select("doc_id", "route", "title", "list_index", "physical_index")


#: Markdown of an order, and its text; {} are the order's key, customer, status and priority.
MARKDOWN = (
    "Order {0}\n===\n\nPlaced by *customer {1}* on [a day](http://orders/{0}) <http://orders> now.\n\n- code `*{2}*`\n- **two\n  lines**\n\n    of {1}\n\n~~~\nfenced {0}\n~~~\n<div>\nraw {0}\n\n"
    "### Priority {3} ###\n> quoted __{1}__ line\n\n[ref]: http://orders/{0}\n***\nEnd <b>of</b> a_{1}_b\n\n    set off {0}\n"
)
SPOKEN = "Order {0} Placed by customer {1} on a day  now. code *{2}* two lines of {1} \n\nPriority {3} quoted {1} line End of a_{1}_b"
FIELDS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


def _filled(form: str) -> str:
    """A form as a SQL expression, for Spark and DuckDB alike."""
    parts = re.split(r"(\{\d\})", form)
    return " || ".join(FIELDS[int(x[1])] if x.startswith("{") else " || ".join("chr(10)" if y == "\n" else f"'{y}'" for y in re.split("(\n)", x) if y) for x in parts if x)


@query(f"select o_orderkey::varchar as doc_id, 1 as page_number, {_filled(SPOKEN)} as text from orders")
def markdown_orders(spark, sf):
    """Orders as Markdown documents, read to pages."""
    own = adapters.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("doc_id"), F.lit("markdown").alias("kind"), F.encode(F.expr(_filled(MARKDOWN)), "UTF-8").alias("content"))
    return adapters.markdown_pages(own)


# ---- whole runs


BOOK = """o as (select o_custkey % 50 as doc_id, o_orderkey, row_number() over (partition by o_custkey % 50 order by o_orderkey)::int as k, count(*) over (partition by o_custkey % 50)::int as n from orders),
    leaf as (select doc_id, ((k - 1) // 50 + 1) as a, ((k - 1) // 50 + 1)::varchar || '.' || ((k - 1) % 50 + 1)::varchar as structure, 'x' || o_orderkey || 'x' as title, k + 1 as start_page, least(k + 2, n + 1) as end_page, 2 as depth,
        'x' || o_orderkey || 'x' || chr(10) || 'Words on ' || o_orderkey || '.' as summary, n from o),
    upper as (select doc_id, a::varchar as structure, '第' || a || '章' as title, min(start_page) as start_page, max(end_page) as end_page, 1 as depth, arg_min(summary, start_page) as summary from leaf group by doc_id, a),
    every as (select doc_id, structure, title, start_page, end_page, depth, summary from leaf union all select * from upper
        union all select distinct doc_id, '0', 'Preface', 1, 2, 1, '1.' from leaf),
    book as (select distinct doc_id, '' as structure, 'Document' as title, 1 as start_page, n + 1 as end_page, 0 as depth, null as summary, 1 as ordinal, substr(sha256(doc_id::varchar || '|Document'), 1, 16) as node_id, null as parent_id from leaf
        union all select doc_id, structure, title, start_page, end_page, depth, summary, row_number() over (partition by doc_id, case when depth = 2 then split_part(structure, '.', 1) else '' end order by start_page, length(structure), structure)::int,
        substr(sha256(doc_id::varchar || '|' || structure), 1, 16), substr(sha256(doc_id::varchar || '|' || case when depth = 2 then split_part(structure, '.', 1) else 'Document' end), 1, 16) from every)"""


def books(spark, sf) -> DataFrame:
    """pages of documents with a contents page and a page for each order."""
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("o_orderkey"))
    own = adapters.table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("doc_id"), "o_orderkey").withColumn("k", nth)
    code = F.concat_ws(".", F.floor((F.col("k") - 1) / 50 + 1).cast("string"), ((F.col("k") - 1) % 50 + 1).cast("string"))
    title = F.concat(F.lit("x"), F.col("o_orderkey").cast("string"), F.lit("x"))
    named = own.select("doc_id", "k", code.alias("code"), title.alias("title"), F.concat(title, F.lit("\nWords on "), F.col("o_orderkey").cast("string"), F.lit(". More.")).alias("text"))
    line = F.concat("code", F.lit(" "), "title", F.lit(" ..... "), F.col("k").cast("string"))
    contents = named.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    return contents.select("doc_id", F.lit(1).alias("page_number"), "text").unionByName(named.select("doc_id", (F.col("k") + 1).cast("int").alias("page_number"), "text"))


NODE = "doc_id, node_id, parent_id, ordinal, depth, structure, title, start_page, end_page, summary"


@query(f"with {BOOK} select {NODE} from book")
def generate_contents(spark, sf):
    """Trees from contents pages with page numbers, verified and summarised."""
    return pipeline.generate(settled(books(spark, sf)), verify=True, summarise=True)


#: The tree of a conversation: one section, named after its first line, which is the root.
TALK = rf"""{CONV}, t as (select doc_id, count(*)::int as total, string_agg(text, chr(10) || chr(10) order by page_number) as text from pages group by doc_id),
    talk as (select doc_id, substr(sha256(doc_id::varchar || '|1'), 1, 16) as node_id, null::varchar as parent_id, 1 as ordinal, 0 as depth, '1' as structure, trim(regexp_replace(substr(trim(split_part(ltrim(text, chr(10) || ' '), chr(10), 1)), 1, 30), ':$', '')) as title,
        1 as start_page, total as end_page, case when regexp_matches(text, '[.!?。！？]') then regexp_extract(ltrim(text, chr(10) || ' '), '^[^.!?。！？]*[.!?。！？]') else trim(text, chr(10) || ' ') end as summary from t)"""


@query(f"with {TALK} select {NODE} from talk")
def generate_tree(spark, sf):
    return pipeline.generate(adapters.conversation_pages(spark, sf), tokens=400, verify=True, summarise=True)


@query(rf"""with {TALK}, q as (select doc_id || '-' || page_number as query_id, doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) as w from pages),
    m as (select query_id, talk.* from q join talk using (doc_id) where list_has_any(w, regexp_extract_all(lower(title || ' ' || summary), '[\p{{L}}\p{{N}}_]+')))
    select query_id, 1 as rank, node_id, title, start_page, end_page from m""")
def search_answers(spark, sf):
    """Every turn of a conversation as a question to the conversation's tree."""
    pages = adapters.conversation_pages(spark, sf)
    own = pipeline.generate(pages, tokens=400, summarise=True)
    asked = pages.select(F.concat_ws("-", F.col("doc_id").cast("string"), F.col("page_number").cast("string")).alias("query_id"), "doc_id", F.regexp_replace("text", "\\n", " ").alias("query"))
    return pipeline.search(asked, own)[1]


@query(f"""with {TALK}, again as (select doc_id as tree_id, total, node_id, title, summary from talk join t using (doc_id)), up as (select substr(sha256(tree_id::varchar || '|combined|1'), 1, 16) as top, substr(sha256(tree_id::varchar || '|1|' || node_id), 1, 16) as other, * from again)
    select tree_id, node_id, top as parent_id, 1 as ordinal, 1 as depth, '1' as structure, title, 1 as start_page, total as end_page, summary from up
    union all select tree_id, other, top, 2, 1, '1', title, total + 1, 2 * total, summary from up
    union all select tree_id, top, null, 1, 0, null, 'Combined Document', 1, 2 * total, null from up""")
def update_tree(spark, sf):
    """Each conversation's tree with the same conversation behind it, made as the first one was, with summaries."""
    pages = adapters.conversation_pages(spark, sf)
    made = pipeline.generate(pages, tokens=400, summarise=True).withColumnRenamed("doc_id", "tree_id")
    trees = pages.groupBy(F.col("doc_id").alias("tree_id")).agg(F.count(F.lit(1)).cast("int").alias("total_pages"), F.lit("first").alias("document_info"), F.lit(0).alias("version"))
    return pipeline.update(made, trees, pages, tokens=400, by_groups=False, summarise=True)[0]


@query(f"""with {TALK} select doc_id, '{{"node_id":"' || node_id || '","title":' || to_json(title)::varchar || ',"start_page":1,"end_page":' || end_page || '}}' as tree from talk""")
def tree_json(spark, sf):
    return tree.as_json(pipeline.generate(adapters.conversation_pages(spark, sf), tokens=400))


@query(f"""with recursive {LINES}, {GROUPS.format(3000)} select doc_id, no::int as group_no, a::int as start_page, b::int as end_page from g""")
def page_groups_of_lines(spark, sf):
    return grouping.balanced_groups(adapters.document_pages(spark, sf), 3000).select("doc_id", "group_no", "start_page", "end_page")
