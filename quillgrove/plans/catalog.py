"""Queries over the tables, one or more for each operator, and DuckDB SQL for what they must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgrove.functions import jsonrepair, prompts, text, tokens
from quillgrove.operators import grouping, provider, summaries, toc, tree
from quillgrove.plans import pipeline
from quillgrove.plans.lineage import settled
from quillgrove.sources import adapters

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
PAGES = adapters.TOTAL_PAGES
TIES = ("l_partkey", "l_suppkey", "l_extendedprice")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def values(name: str, rows: list[tuple], columns: str) -> str:
    """A common table expression of literal rows."""

    def show(x) -> str:
        if isinstance(x, str):
            return "'" + x.replace("'", "''") + "'"
        return "null" if x is None else str(x).lower() if isinstance(x, bool) else str(x)

    return f"{name} as (select * from (values {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) as t({columns}))"


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# The tables' adapters as SQL.
TOC = f"""
ch as (select o_orderkey, o_custkey, dense_rank() over (partition by o_custkey order by o_orderkey) as chapter from orders),
toc as (select o_custkey as doc_id, chapter::varchar || '.' || l_linenumber::varchar as structure, coalesce(p_name, '') as title,
    trunc(l_quantity)::int as physical_index, (chapter * 100 + l_linenumber)::int as list_index, l_partkey, l_suppkey, l_extendedprice
    from lineitem join ch on l_orderkey = o_orderkey left join part on l_partkey = p_partkey),
ranked as (select *, row_number() over (partition by doc_id order by physical_index nulls last, list_index nulls last, {', '.join(TIES)})::int as nth from toc),
ends as (select *, case when lead(physical_index) over (partition by doc_id order by nth) = physical_index then physical_index
    else coalesce(min(physical_index) over (partition by doc_id order by physical_index range between 1 following and unbounded following), {PAGES}) end as end_page from ranked),
firsts as (select * from ends qualify row_number() over (partition by doc_id, structure order by nth) = 1)
"""
TREE = f"""{TOC},
missing as (select distinct doc_id, split_part(structure, '.', 1) as structure from firsts),
every as (select doc_id, structure, title, physical_index as start_page, end_page from firsts
    union all select doc_id, structure, '第' || structure || '章', 1, {PAGES} from missing),
rolled as (select e.doc_id, e.structure, e.title, min(f.physical_index) as start_page, max(f.end_page) as end_page, count(distinct f.structure) + max((not contains(e.structure, '.'))::int) as size
    from every e join firsts f on f.doc_id = e.doc_id and (f.structure = e.structure or split_part(f.structure, '.', 1) = e.structure) group by all),
nodes as (select *, substr(sha256(doc_id::varchar || '|' || structure), 1, 16) as node_id,
    case when contains(structure, '.') then substr(sha256(doc_id::varchar || '|' || split_part(structure, '.', 1)), 1, 16) end as parent_id,
    len(string_split(structure, '.'))::int as depth,
    row_number() over (partition by doc_id, case when contains(structure, '.') then split_part(structure, '.', 1) else '' end order by start_page, length(structure), structure)::int as ordinal from rolled)
"""
CONV = "pages as (select conv_id as doc_id, (turn + 1)::int as page_number, text from conversations)"
LINES = """pages as (select doc_id, unnest(range(1, len(l) + 1))::int as page_number, unnest(l) as text from (select doc_id, string_split(text, chr(10)) as l from documents))"""


def items(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.toc_items(spark, sf)


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    return tree.built(items(spark, sf), PAGES, TIES)


# ---- building and ranges


@query(f"with {TOC} select doc_id, structure, title, physical_index, list_index, nth from ranked")
def toc_sorted_rank(spark, sf):
    return toc.sorted_rank(items(spark, sf), TIES).select("doc_id", "structure", "title", "physical_index", "list_index", "nth")


@query(f"with {TOC} select doc_id, structure, physical_index, nth, end_page from ends")
def toc_end_page(spark, sf):
    return toc.end_pages(items(spark, sf), PAGES, TIES).select("doc_id", "structure", "physical_index", "nth", "end_page")


@query(f"with {TOC} select doc_id, structure, title, physical_index, end_page from firsts")
def toc_first_wins(spark, sf):
    return tree.first_wins(toc.end_pages(items(spark, sf), PAGES, TIES)).select("doc_id", "structure", "title", "physical_index", "end_page")


@query(f"with {TREE} select doc_id, structure, '第' || structure || '章' as title, 1 as start_page, {PAGES} as end_page from missing")
def toc_placeholders(spark, sf):
    return tree.placeholders(items(spark, sf).select("doc_id", "structure"), PAGES)


@query(f"with {TREE} select doc_id, structure, title, start_page, end_page, size, node_id, parent_id, depth, ordinal from nodes")
def tree_nodes(spark, sf):
    return nodes(spark, sf)


@query(f"with {TREE} select doc_id, structure, title, start_page, end_page from rolled where not contains(structure, '.')")
def tree_parent_rollup(spark, sf):
    return nodes(spark, sf).where("depth = 1").select("doc_id", "structure", "title", "start_page", "end_page")


@query(f"with {TREE} select doc_id, max(c) as largest, sum(c)::bigint as nodes from (select doc_id, split_part(structure, '.', 1), count(*) as c from every group by all) group by doc_id")
def tree_subtree_count(spark, sf):
    return nodes(spark, sf).where("depth = 1").groupBy("doc_id").agg(F.max("size").alias("largest"), F.sum("size").alias("nodes"))


@query(f"""with {TREE}, top as (select doc_id, count(*) as n, min(start_page) as s, max(end_page) as e, any_value(title) as title from rolled where not contains(structure, '.') group by doc_id),
    deep as (select doc_id, max(end_page) as last from rolled group by doc_id), w as (select *, n > 1 or regexp_matches(title, '^第[零一二三四五六七八九十百千万0-9]+章') as wrapped from top join deep using (doc_id))
    select doc_id, case when wrapped then 'Document' else title end as title, case when wrapped then least(1, s) else s end as start_page,
    case when wrapped then greatest({PAGES}, e) else last end as end_page, wrapped from w""")
def tree_root_choice(spark, sf):
    return tree.roots(nodes(spark, sf), PAGES)


@query(f"""with {TOC} select doc_id, 0 as ordinal, 'Document' as title, 1 as start_page, {PAGES} as end_page from (select distinct doc_id from ends)
    union all select doc_id, row_number() over (partition by doc_id order by nth)::int, title, physical_index, end_page from ends""")
def tree_flat(spark, sf):
    return tree.flat(toc.end_pages(items(spark, sf), PAGES, TIES), PAGES)


@query(f"with {CONV} select doc_id, page_number::varchar as structure, case when doc_id % 2 = 0 then '第' || page_number || '页' else 'Page ' || page_number end as title, page_number as physical_index from pages")
def tree_page_fallback(spark, sf):
    pages = adapters.conversation_pages(spark, sf)
    return toc.fallback_items(pages, F.col("doc_id") % 2 == 0)


def _trees_of(spark, sf) -> list[DataFrame]:
    """Trees of a customer's chapters with codes of an odd length, then of an even one: nodes and trees of each."""
    every = settled(nodes(spark, sf))
    return [x for odd in (1, 0) for x in _tree_of(every, odd)]


def _tree_of(every: DataFrame, odd: int) -> tuple[DataFrame, DataFrame]:
    own = every.where(F.col("structure").like("%.%") == F.lit(False)).where((F.length("structure") % 2) == odd)
    own = own.select(F.col("doc_id").alias("tree_id"), "node_id", F.lit(None).cast("string").alias("parent_id"), "title", "start_page", "end_page")
    trees = own.groupBy("tree_id").agg(F.max("end_page").alias("total_pages")).withColumns({"document_info": F.concat(F.lit(f"part {odd} of "), F.col("tree_id").cast("string")), "version": F.lit(0)})
    return own, trees


@query(f"""with {TREE}, own as (select doc_id as tree_id, node_id, title, start_page, end_page, length(structure) % 2 as odd from nodes where not contains(structure, '.')),
    t as (select tree_id, max(case when odd = 1 then end_page end) as a, max(case when odd = 0 then end_page end) as b from own group by tree_id)
    select tree_id, title, case when odd = 0 then start_page + coalesce(a, 0) else start_page end as start_page, case when odd = 0 then end_page + coalesce(a, 0) else end_page end as end_page from own join t using (tree_id)
    union all select tree_id, 'Combined Document', 1, a + b from t where a is not null and b is not null""")
def tree_merge_offset(spark, sf):
    return tree.appended(*_trees_of(spark, sf))[0].select("tree_id", "title", "start_page", "end_page")


@query(f"""with {TREE}, own as (select doc_id as tree_id, end_page, length(structure) % 2 as odd from nodes where not contains(structure, '.')),
    t as (select tree_id, max(case when odd = 1 then end_page end) as a, max(case when odd = 0 then end_page end) as b from own group by tree_id)
    select tree_id, coalesce(a, 0) + coalesce(b, 0) as total_pages, case when a is not null and b is not null then 'Combined document: part 1 of ' || tree_id || ' + part 0 of ' || tree_id
    when a is null then 'part 0 of ' || tree_id else 'part 1 of ' || tree_id end as document_info, (a is not null and b is not null)::int as version from t""")
def tree_merge_versions(spark, sf):
    return tree.appended(*_trees_of(spark, sf))[1]


@query(f"""with {TREE}, n as (select doc_id, count(*) as groups from nodes where not contains(structure, '.') group by doc_id), g as (select * from nodes join n using (doc_id)),
    tops as (select *, lead(start_page) over (partition by doc_id order by start_page, node_id) - 1 as lim, row_number() over (partition by doc_id order by start_page, node_id)::int as o from g where contains(structure, '.') and groups > 1)
    select doc_id, 0 as depth, 1 as ordinal, 'Document' as title, min(start_page) as start_page, max(end_page) as end_page from g where not contains(structure, '.') and groups > 1 group by doc_id
    union all select doc_id, 1, o, title, start_page, case when lim is null then end_page else least(end_page, lim) end from tops
    union all select doc_id, depth - 1, row_number() over (partition by doc_id, parent_id order by ordinal)::int, title, start_page, end_page from g where groups = 1""")
def tree_group_merge(spark, sf):
    groups = nodes(spark, sf).select("doc_id", "node_id", "parent_id", "ordinal", "title", "start_page", "end_page")
    return tree.groups_merged(groups).select("doc_id", "depth", "ordinal", "title", "start_page", "end_page")


@query("""with o as (select o_custkey as doc_id, o_orderkey as id, row_number() over (partition by o_custkey order by o_orderkey) as ordinal from orders),
    t as (select doc_id, id, ordinal, ordinal % 5 as n, case when ordinal % 5 = 4 then 'Appendix ' || id else '第' || case when id % 2 = 0 then (ordinal % 5 + 1)::varchar else ['一', '二', '三', '四'][(ordinal % 5 + 1)::int] end || '章' || repeat('x', (id % 4)::int) end as title, (id % 40)::int as start_page, (id % 40 + id % 7)::int as end_page from o),
    k as (select *, case when n = 4 then id::varchar else n::varchar || ' ' end as key from t)
    select doc_id, id::varchar as node_id, first_value(id) over (partition by doc_id, key order by strlen(title) desc, ordinal rows between unbounded preceding and unbounded following)::varchar as "into", title,
    min(start_page) over (partition by doc_id, key) as start_page, max(end_page) over (partition by doc_id, key) as end_page from k""")
def chapter_dedup(spark, sf):
    """A customer's orders as chapters whose numbers are written in one way or the other, and appendices without a number."""
    own = adapters.table(spark, sf, "orders").withColumn("ordinal", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    n, id_ = F.col("ordinal") % 5, F.col("o_orderkey")
    number = F.when(id_ % 2 == 0, (n + 1).cast("string")).otherwise(F.element_at(F.array(*map(F.lit, "一二三四五")), n + 1))
    title = F.when(n == 4, F.concat(F.lit("Appendix "), id_)).otherwise(F.concat(F.lit("第"), number, F.lit("章"), F.repeat(F.lit("x"), (id_ % 4).cast("int"))))
    return tree.chapters_merged(own.select(F.col("o_custkey").alias("doc_id"), id_.cast("string").alias("node_id"), "ordinal", title.alias("title"), (id_ % 40).cast("int").alias("start_page"), (id_ % 40 + id_ % 7).cast("int").alias("end_page")))


@query("""with o as (select o_custkey as doc_id, o_orderkey as id, row_number() over (partition by o_custkey order by o_orderkey) as ordinal from orders),
    t as (select *, first_value(id) over (partition by doc_id, ordinal % 3 order by id % 4 desc, ordinal rows between unbounded preceding and unbounded following) as "into" from o)
    select doc_id, l_orderkey::varchar || '.' || l_linenumber::varchar as node_id, "into"::varchar as parent_id from lineitem join t on l_orderkey = id""")
def chapter_children(spark, sf):
    """A customer's orders are top nodes of three chapters; where chapters are one, their lineitems move."""
    ordinal = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    title = F.concat(F.lit("第"), (ordinal % 3 + 1).cast("string"), F.lit("章"), F.repeat(F.lit("x"), (F.col("o_orderkey") % 4).cast("int")))
    tops = adapters.table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").cast("string").alias("node_id"), ordinal.alias("ordinal"), title.alias("title"), F.lit(1).alias("start_page"), F.lit(2).alias("end_page"))
    below = adapters.table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("node_id"), "l_linenumber").join(tops.select("doc_id", "node_id"), "node_id")
    children = below.select("doc_id", F.concat_ws(".", "node_id", F.col("l_linenumber").cast("string")).alias("node_id"), F.col("node_id").alias("parent_id"))
    return tree.reparented(children, tree.chapters_merged(tops)).select("doc_id", "node_id", "parent_id")


# ---- lookups


RANGES = [(k, a, b) for k, (a, b) in enumerate([(1, 3), (6, 10), (25, 30), (48, 60), (60, 70), (1, 50), (17, 17)])]


@query(f"with {TREE}, {values('r', RANGES, 'range_id, first_page, last_page')} select doc_id, structure, start_page, end_page, range_id from nodes, r where doc_id % 7 = range_id and start_page <= last_page and end_page >= first_page")
def nodes_overlapping_pages(spark, sf):
    own = settled(nodes(spark, sf))
    ranges = literal(spark, RANGES, "range_id int, first_page int, last_page int")
    asked = own.select("doc_id").distinct().withColumn("range_id", (F.col("doc_id") % 7).cast("int")).join(F.broadcast(ranges), "range_id")
    return tree.overlapping(own, asked).select("doc_id", "structure", "start_page", "end_page", "range_id")


@query(f"""with {CONV}, n as (select doc_id, 'n' || k as node_id, k as start_page, k + 2 as end_page from (select distinct doc_id from pages), range(1, 8) t(k))
    select n.doc_id, node_id, string_agg(text, chr(10) || chr(10) order by page_number) || chr(10) || chr(10) as text from n join pages p on p.doc_id = n.doc_id and page_number between start_page and end_page group by all""")
def node_text(spark, sf):
    pages = adapters.conversation_pages(spark, sf)
    own = pages.select("doc_id").distinct().select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("start_page"))
    own = own.withColumns({"node_id": F.concat(F.lit("n"), F.col("start_page").cast("string")), "end_page": F.col("start_page") + 2})
    return tree.node_text(own, pages)


@query(f"""with {TREE}, w as (select doc_id as query_id, doc_id, unnest([doc_id::varchar || '|2.1', doc_id::varchar || '|none', doc_id::varchar || '|1', doc_id::varchar || '|2.1']) as t, unnest([0, 1, 2, 3]) as pos from (select distinct doc_id from nodes)),
    m as (select query_id, pos, n.* from w join nodes n on n.doc_id = w.doc_id and n.node_id = substr(sha256(t), 1, 16))
    select query_id, row_number() over (partition by query_id order by pos)::int as rank, node_id, title, start_page, end_page from m""")
def node_lookup_ordered(spark, sf):
    own = settled(nodes(spark, sf))
    ids = F.array(*(text.node_id("doc_id", F.lit(code)) for code in ("2.1", "none", "1", "2.1")))
    wanted = own.select("doc_id").distinct().select(F.col("doc_id").alias("query_id"), "doc_id", ids.alias("node_ids"))
    return tree.looked_up(wanted, own)


# ---- pages


TRIM = r"regexp_replace(text, '^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$', '', 'g')"
KEPT = f"kept as (select *, (strlen(text) // 4)::int as tokens from pages where strlen({TRIM}) >= 10 and strlen(text) // 4 >= 3)"


@query(f"with {LINES}, {KEPT} select doc_id, page_number, tokens from kept")
def pages_meaningful(spark, sf):
    return grouping.meaningful(adapters.document_pages(spark, sf)).select("doc_id", "page_number", "tokens")


@query(f"with {CONV} select doc_id, count(*) as total_pages, string_agg(text, chr(10) || chr(10) order by page_number) || chr(10) || chr(10) as text from pages group by doc_id")
def doc_full_text(spark, sf):
    return grouping.full_text(adapters.conversation_pages(spark, sf))


@query(f"""with {LINES} select doc_id, count(*) as pages, count(*) filter (not regexp_matches(coalesce(text, ''), '[^\\s\\p{{Z}}\\x{{85}}]')) as empty_pages,
    empty_pages = count(*) or empty_pages > count(*) * 3 // 10 as needs_ocr from pages group by doc_id""")
def empty_page_ocr_trigger(spark, sf):
    return adapters.needs_ocr(adapters.document_pages(spark, sf))


@query(f"""with {LINES}, n as (select doc_id, count(*) as pages, count(*) filter (not regexp_matches(coalesce(text, ''), '[^\\s\\p{{Z}}\\x{{85}}]')) as e from pages group by doc_id),
    sound as (select doc_id from n where not (e = pages or e > pages * 3 // 10))
    select doc_id, page_number, text from pages where doc_id in (from sound)
    union all select doc_id, 1, 'scan of ' || doc_id from documents where doc_id not in (from sound) and doc_id % 7 <> 0""")
def ocr_pages(spark, sf):
    """Documents with too little text are read from images, of which every seventh can't be."""

    def recognise(image: bytes) -> str:
        if int(image.split()[-1]) % 7 == 0:
            raise ValueError("unreadable")
        return image.decode()

    images = adapters.table(spark, sf, "documents").select("doc_id", F.lit(1).alias("page_number"), F.encode(F.concat(F.lit("scan of "), F.col("doc_id")), "UTF-8").alias("image"))
    return adapters.with_ocr(adapters.document_pages(spark, sf), images, recognise)[0]


@query(f"with {CONV} select doc_id, page_number, '【第' || page_number || '页开始】' || chr(10) || text || chr(10) || '【第' || page_number || '页结束】' || chr(10) || chr(10) as tagged from pages")
def page_tags(spark, sf):
    return adapters.conversation_pages(spark, sf).select("doc_id", "page_number", text.page_tags("text", "page_number").alias("tagged"))


@query(f"""with recursive {LINES}, {KEPT}, k as (select *, row_number() over (partition by doc_id order by page_number) as nth from kept),
    d as (select doc_id, count(*) as pages, min(page_number) as lo, max(page_number) as hi from pages group by doc_id),
    small as (select doc_id from k join d using (doc_id) group by doc_id, pages having pages <= 4 and max(tokens) <= 100),
    walk as (
      select doc_id, 1::bigint as nth, case when tokens > 100 then -1 else 1 end::bigint as a, case when tokens > 100 then 0 else tokens end::int as t, case when tokens > 100 then 0 else 1 end::int as held,
        0::bigint as fa, 0::bigint as fb, 0 as ft, tokens > 100 as alone from k where nth = 1 and doc_id not in (select doc_id from small)
      union all
      select k.doc_id, k.nth,
        case when k.tokens > 100 then -1 when w.a > 0 and w.t + k.tokens > 100 then k.nth - least(w.held, 2) when w.a > 0 then w.a else k.nth end,
        case when k.tokens > 100 then 0 when w.a > 0 and w.t + k.tokens > 100 then k.tokens + case when least(w.held, 2) >= 1 then p1.tokens else 0 end + case when least(w.held, 2) >= 2 then p2.tokens else 0 end else w.t + k.tokens end,
        case when k.tokens > 100 then case when w.a > 0 then 0 else w.held end when w.a > 0 and w.t + k.tokens > 100 then 1 else w.held + 1 end,
        case when w.a > 0 and (k.tokens > 100 or w.t + k.tokens > 100) then w.a else 0 end,
        case when w.a > 0 and (k.tokens > 100 or w.t + k.tokens > 100) then k.nth - 1 else 0 end,
        case when w.a > 0 and (k.tokens > 100 or w.t + k.tokens > 100) then w.t else 0 end, k.tokens > 100
      from walk w join k on k.doc_id = w.doc_id and k.nth = w.nth + 1 left join k p1 on p1.doc_id = k.doc_id and p1.nth = k.nth - 1 left join k p2 on p2.doc_id = k.doc_id and p2.nth = k.nth - 2),
    g as (select doc_id, fa as a, fb as b, ft as t from walk where fa > 0 union all select doc_id, nth, nth, 100 from walk where alone
      union all select doc_id, a, nth, t from walk w where a > 0 and nth = (select max(nth) from k where k.doc_id = w.doc_id))
    select g.doc_id, x.page_number as start_page, y.page_number as end_page, t::int as token_count from g join k x on x.doc_id = g.doc_id and x.nth = a join k y on y.doc_id = g.doc_id and y.nth = b
    union all select doc_id, any_value(lo), any_value(hi), sum(tokens)::int from k join d using (doc_id) where doc_id in (select doc_id from small) group by doc_id""")
def page_groups_greedy(spark, sf):
    return grouping.greedy_groups(adapters.document_pages(spark, sf), 100).select("doc_id", "start_page", "end_page", "token_count")


@query(f"""with recursive {CONV}, k as (select doc_id, page_number, (strlen('【第' || page_number || '页开始】' || text || '【第' || page_number || '页结束】') + 4) // 4 as tokens, row_number() over (partition by doc_id order by page_number) as nth from pages),
    d as (select doc_id, sum(tokens) as total, max(nth) as n, case when sum(tokens) > 200 then ((sum(tokens) // ((sum(tokens) + 199) // 200)) + 201) // 2 end as aim from k group by doc_id),
    walk as (select doc_id, 1::bigint as nth, 1::bigint as a, tokens::bigint as t, 0::bigint as fa, 0::bigint as ft, aim, n from k join d using (doc_id) where nth = 1
      union all select k.doc_id, k.nth, case when w.t + k.tokens > w.aim then k.nth - 1 else w.a end, case when w.t + k.tokens > w.aim then p.tokens + k.tokens else w.t + k.tokens end,
        case when w.t + k.tokens > w.aim then w.a else 0 end, w.t, w.aim, w.n from walk w join k on k.doc_id = w.doc_id and k.nth = w.nth + 1 join k p on p.doc_id = k.doc_id and p.nth = k.nth - 1)
    select doc_id, fa::int as start_page, (nth - 1)::int as end_page, ft::int as token_count from walk where fa > 0
    union all select doc_id, a::int, nth::int, t::int from walk where nth = n""")
def page_groups_balanced(spark, sf):
    return grouping.balanced_groups(adapters.conversation_pages(spark, sf), 200).select("doc_id", "start_page", "end_page", "token_count")


@query(f"with {CONV} select doc_id, count(*) as pages, string_agg('【第' || page_number || '页开始】' || chr(10) || text || chr(10) || '【第' || page_number || '页结束】' || chr(10) || chr(10), '' order by page_number) as text from pages where page_number between 2 and 5 group by doc_id")
def page_sample(spark, sf):
    return toc.sample_text(adapters.conversation_pages(spark, sf), 2, 3)


# ---- contents items


@query(f"""with {LINES}, v as (select doc_id, page_number - 1 as page, strlen(text) % 3 > 0 as is_toc from pages where strlen(text) % 7 > 0),
    r as (select *, sum(case when is_toc then 0 else 1 end) over (partition by doc_id order by page) as run from v),
    b as (select *, min(page) over (partition by doc_id, run) as begins from r where is_toc), f as (select *, min(run) over (partition by doc_id) as first from b where begins < 5)
    select doc_id, page from f where run = first""")
def toc_run_detection(spark, sf):
    pages = adapters.document_pages(spark, sf).select("doc_id", (F.col("page_number") - 1).alias("page"), F.octet_length("text").alias("n"))
    return toc.toc_run(pages.select("doc_id", "page", F.when(F.col("n") % 7 > 0, F.col("n") % 3 > 0).alias("is_toc")), 5)


@query(f"with {TOC}, f as (select doc_id, arg_min(physical_index, list_index * 1000000000000 + l_partkey * 100000 + l_suppkey) as first from toc group by doc_id) select doc_id, '0' as structure, 'Preface' as title, 1 as physical_index from f where first > 1")
def preface_needed(spark, sf):
    own = items(spark, sf)
    return toc.preface(own.withColumn("list_index", F.col("list_index").cast("long") * 1_000_000_000_000 + F.col("l_partkey") * 100_000 + F.col("l_suppkey")))


HOLES = "case when (list_index + l_partkey) % 5 = 0 then null else physical_index end as physical_index, case when (list_index + l_partkey) % 3 = 0 then null else (physical_index * 2) end as page"


def holed(spark, sf) -> DataFrame:
    n = F.col("list_index") + F.col("l_partkey")
    return items(spark, sf).withColumns({"page": F.when(n % 3 != 0, F.col("physical_index") * 2), "physical_index": F.when(n % 5 != 0, F.col("physical_index"))})


@query(f"with {TOC}, h as (select doc_id, structure, {HOLES}, list_index, l_partkey from toc) select doc_id, structure, list_index, l_partkey, physical_index, page from h where physical_index is not null or page is not null")
def valid_items(spark, sf):
    return toc.valid_items(holed(spark, sf)).select("doc_id", "structure", "list_index", "l_partkey", "physical_index", "page")


@query(f"with {TOC}, h as (select doc_id, structure, {HOLES}, list_index, l_partkey from toc) select doc_id, structure, list_index, l_partkey, case when coalesce(physical_index, page) is null then null else greatest(1, least(coalesce(physical_index, page), 40)) end as physical_index from h")
def clamp_index(spark, sf):
    return holed(spark, sf).select("doc_id", "structure", "list_index", "l_partkey", toc.clamp(F.coalesce("physical_index", "page"), F.lit(40)).alias("physical_index"))


UNIQUE = "select * from h qualify row_number() over (partition by doc_id, list_index order by l_partkey, l_suppkey, l_extendedprice) = 1"


def unique(df: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("doc_id", "list_index").orderBy(*TIES))
    return df.withColumn("n", n).where("n = 1").drop("n")


BOUNDS = "rows between unbounded preceding and 1 preceding), {0}) as before, coalesce(first_value({1} ignore nulls) over (partition by doc_id order by list_index rows between 1 following and unbounded following), {2}) as after"


@query(f"with {TOC}, h as (select doc_id, structure, {HOLES}, list_index, {', '.join(TIES)} from toc), u as ({UNIQUE}) select doc_id, list_index, physical_index, coalesce(last_value(physical_index ignore nulls) over (partition by doc_id order by list_index {BOUNDS.format(0, 'physical_index', PAGES)} from u")
def neighbour_bounds(spark, sf):
    return toc.neighbour_bounds(unique(holed(spark, sf)), 0, PAGES).select("doc_id", "list_index", "physical_index", "before", "after")


RIGHT = "case when (list_index * 7 + l_suppkey) % 4 > 0 then physical_index end"


@query(f"with {TOC}, h as (select doc_id, structure, {HOLES}, list_index, {', '.join(TIES)} from toc), u as ({UNIQUE}), c as (select *, {RIGHT} as ok from u) select doc_id, list_index, physical_index, coalesce(last_value(ok ignore nulls) over (partition by doc_id order by list_index {BOUNDS.format(0, 'ok', PAGES)} from c")
def neighbour_bounds_correct(spark, sf):
    right = (F.col("list_index") * 7 + F.col("l_suppkey")) % 4 > 0
    return toc.neighbour_bounds(unique(holed(spark, sf)), 0, PAGES, right).select("doc_id", "list_index", "physical_index", "before", "after")


NORMAL = r"trim(regexp_replace(regexp_replace(lower({0}), '\p{{P}}', '', 'g'), '[\s\p{{Z}}\x{{85}}]+', ' ', 'g'))"
PAIRS = f"""{TOC}, h as (select doc_id, structure, title, {HOLES}, list_index, {', '.join(TIES)} from toc), u as ({UNIQUE}),
    l as (select doc_id, list_index as nth, physical_index, {NORMAL.format('title')} as k from u where physical_index is not null),
    r as (select doc_id, list_index, title, page, {NORMAL.format('title')} as k from u where page is not null),
    pairs as (select doc_id, title, page, physical_index from l join r using (doc_id, k) qualify row_number() over (partition by doc_id, nth order by list_index) = 1)"""


@query(f"with {PAIRS} select * from pairs")
def title_pairs(spark, sf):
    own = unique(holed(spark, sf))
    return toc.title_pairs(own.drop("page"), own.drop("physical_index"))


@query(f"""with {PAIRS}, d as (select doc_id, list_sort(list(physical_index - page)) as d, count(*)::int as pairs from pairs group by doc_id),
    m as (select doc_id, x as mode_offset from (select doc_id, physical_index - page as x, count(*) as n from pairs group by all) qualify row_number() over (partition by doc_id order by n desc, x) = 1),
    o as (select *, (case when pairs % 2 = 1 then d[pairs // 2 + 1] else (d[pairs // 2] + d[pairs // 2 + 1]) // 2 end)::int as med from d)
    select doc_id, pairs, case when pairs >= 3 and abs(med) <= {PAGES} // 2 then med end as median_offset, mode_offset, coalesce(case when pairs >= 3 and abs(med) <= {PAGES} // 2 then med end, mode_offset) as page_offset from o join m using (doc_id)""")
def page_offsets(spark, sf):
    return toc.page_offsets(title_pairs(spark, sf), PAGES)


def _halves(spark, sf) -> tuple[DataFrame, DataFrame]:
    own = unique(items(spark, sf)).select("doc_id", "structure", "title", "list_index", (F.col("l_partkey") % 2).alias("half"))
    return own.where("half = 0").drop("half"), own.where("half = 1").drop("half")


@query(f"""with recursive {TOC}, h as (select * from toc), u as ({UNIQUE}), q as (select doc_id, structure, title, list_index, l_partkey % 2 = 1 as added, row_number() over (partition by doc_id order by l_partkey % 2, list_index) as k from u),
    w as (select q.*, [structure] as codes, case when trim(title) <> '' then [trim(title)] else []::varchar[] end as names, true as keep from q where k = 1
      union all select q.*, list_append(w.codes, q.structure), case when trim(q.title) <> '' and not (q.added and (list_contains(w.codes, q.structure) or list_contains(w.names, trim(q.title)))) then list_append(w.names, trim(q.title)) else w.names end,
        not (q.added and (list_contains(w.codes, q.structure) or (trim(q.title) <> '' and list_contains(w.names, trim(q.title))))) from w join q on q.doc_id = w.doc_id and q.k = w.k + 1)
    select doc_id, structure, title, list_index, added from w where keep""")
def merge_items_dedup(spark, sf):
    return toc.merge_items(*_halves(spark, sf))


@query(f"""with {TOC}, h as (select * from toc), u as ({UNIQUE}), e as (select * from u where l_partkey % 2 = 0), a as (select * from u where l_partkey % 2 = 1),
    n as (select * from a where not exists (select 1 from e where e.doc_id = a.doc_id and e.structure = a.structure) and not exists (select 1 from e where e.doc_id = a.doc_id and e.title = a.title and a.title <> '')),
    f as (select * from n qualify row_number() over (partition by doc_id, structure order by list_index) = 1),
    g as (select * from f qualify title = '' or row_number() over (partition by doc_id, title order by list_index) = 1)
    select doc_id, structure, title, list_index, false as added from e union all select doc_id, structure, title, list_index, true from g""")
def merge_new_items(spark, sf):
    return toc.merge_new_items(*_halves(spark, sf))


#: A page for each lineitem, with a heading or two.
HEADED = """concat('### ', l_suppkey % 4 + 1, '.', l_partkey % 3 + 1, case when l_linenumber % 2 = 0 then '  ' else '' end, ' Part ', l_partkey, '\\nbody\\n', case when l_linenumber % 3 = 0 then concat('x ###', l_suppkey % 4 + 1, '.', l_linenumber, 'Again ', l_suppkey, ' ') else '# 1.1 none' end)"""
PAPER = f"p as (select l_orderkey as doc_id, row_number() over (partition by l_orderkey order by l_linenumber, {', '.join(TIES)})::int as page_number, {HEADED.replace(chr(92) + chr(92) + 'n', chr(10)).replace(chr(92) + 'n', chr(10))} as text from lineitem)"
FOUND = f"""{PAPER}, x as (select doc_id, page_number, unnest(range(0, len(a)))::int as pos, unnest(a) as structure, trim(unnest(b)) as title
    from (select doc_id, page_number, regexp_extract_all(text, '###\\s*(\\d+\\.\\d+)\\s*(.+)', 1) as a, regexp_extract_all(text, '###\\s*(\\d+\\.\\d+)\\s*(.+)', 2) as b from p))"""
LISTED = "i as (select o_orderkey as doc_id, k::varchar || '.1' as structure, 'Listed ' || k as title, (k + 1)::int as physical_index, case when k > 1 then (k * 2)::int end as page, (k - 1)::int as list_index from orders, range(1, 4) t(k))"


def papers(spark, sf) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", *TIES))
    return adapters.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), nth.alias("page_number"), F.expr(HEADED).alias("text"))


@query(f"with {FOUND} select doc_id, page_number, pos, structure, title from x")
def heading_scan(spark, sf):
    return toc.headings(papers(spark, sf))


@query(f"""with {FOUND}, {LISTED},
    f as (select doc_id, structure, max(page_number) as found, arg_min(title, page_number * 100 + pos) as heading, min(page_number * 100 + pos) as first from x group by all),
    c as (select doc_id, count(*) as items from i group by doc_id)
    select coalesce(i.doc_id, f.doc_id) as doc_id, coalesce(i.structure, f.structure) as structure, coalesce(title, heading) as title, coalesce(found, physical_index) as physical_index,
    case when found is not null and found is distinct from physical_index then found else page end as page,
    (case when i.doc_id is not null then list_index else coalesce(items, 0) + row_number() over (partition by coalesce(i.doc_id, f.doc_id), i.doc_id is null order by first) - 1 end)::int as list_index
    from i full join f on i.doc_id = f.doc_id and i.structure = f.structure left join c on c.doc_id = coalesce(i.doc_id, f.doc_id)""")
def heading_upsert(spark, sf):
    k = F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k")
    own = adapters.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), k)
    listed = own.select("doc_id", F.concat("k", F.lit(".1")).alias("structure"), F.concat(F.lit("Listed "), "k").alias("title"), (F.col("k") + 1).alias("physical_index"), F.when(F.col("k") > 1, F.col("k") * 2).alias("page"), (F.col("k") - 1).alias("list_index"))
    return toc.upsert_headings(listed, papers(spark, sf))


@query(f"with {TOC}, v as (select doc_id, (l_partkey + list_index) % 4 > 0 as appears from toc) select doc_id, count(*) as checked, count(*) filter (appears) as correct, count(*) filter (appears) / count(*) as accuracy, case when accuracy >= 0.5 then 'accept' when accuracy >= 0.3 then 'repair' else 'fallback' end as route from v group by doc_id")
def verification_accuracy(spark, sf):
    return toc.accuracy(items(spark, sf).select("doc_id", ((F.col("l_partkey") + F.col("list_index")) % 4 > 0).alias("appears")))


@query(f"""with {TOC}, h as (select doc_id, {HOLES}, list_index, {', '.join(TIES)} from toc), u as ({UNIQUE}), m as (select doc_id, arg_max(physical_index, list_index) as x from u where physical_index is not null group by doc_id)
    select doc_id, coalesce(x, 0) as last_index, coalesce(x, 0) > 0 and coalesce(x, 0) >= {PAGES} / 2 as verify from (select distinct doc_id from u) left join m using (doc_id)""")
def last_known_index(spark, sf):
    return toc.last_index(unique(holed(spark, sf)), PAGES)


# ---- scalars


def scalar(name: str, rows: list[tuple], schema: str, sql: str, *columns, table: str, own: tuple[str, ...], extra: str = "", of: str | None = None) -> None:
    """A query over a whole table, whose rows `own` makes to the schema's columns, and over literal edge cases: these columns and those that `columns` adds.

    `own` are expressions that Spark's and DuckDB's SQL share; `of`, the query that `sql` reads in place of the rows v.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    made = ", ".join(f"{e} as {n}" for e, n in zip(own, names, strict=True))

    def run(spark: SparkSession, sf: str) -> DataFrame:
        derived = adapters.table(spark, sf, table).selectExpr(*(f"cast({e} as {x.split()[1]}) as {n}" for e, n, x in zip(own, names, schema.split(", "), strict=True)))
        return derived.unionByName(literal(spark, rows, schema)).select("*", *(c() for c in columns))

    run.__name__ = name
    kinds = {"string": "varchar", "int": "integer"}
    cast = ", ".join(f"cast({n} as {kinds[x.split()[1]]}) as {n}" for n, x in zip(names, schema.split(", "), strict=True))
    query(f"with {values('edge', rows, ', '.join(names))}, v as (select {cast} from edge union all select {cast} from (select {made} from {table})){extra} select {', '.join(names)}, {sql} from {of or 'v'}")(run)


CODES = ["3.2.1", "321", "100", "31", " 1.1 ", "01.02", "1..", "", "第3章", "12a.004", "..5..", "00", "٣.1", "99999999999999999999.1"]
DIGITS = "regexp_replace(code, '[^\\p{Nd}.]', '', 'g')"
scalar(
    "normalize_structure", [(x,) for x in CODES], "code string",
    f"""array_to_string(list_transform(list_filter(string_split(case when not contains({DIGITS}, '.') and strlen({DIGITS}) > 2 then array_to_string(string_split({DIGITS}, ''), '.') else {DIGITS} end, '.'), lambda p: p <> ''),
    lambda p: coalesce(case when regexp_matches(p, '^[0-9]+$') then try_cast(p as bigint)::varchar end, p)), '.') as normalised""",
    lambda: text.normalize_structure("code").alias("normalised"),
    table="lineitem", own=("concat('0', l_orderkey, case when l_linenumber % 3 = 0 then '.' when l_linenumber % 3 = 1 then '' else '..x' end, l_partkey % 1000)",),
)
scalar("parent_structure", [(x,) for x in ["1", "1.2", "1.2.3", "", "10.20"]], "code string", "case when contains(code, '.') then regexp_replace(code, '\\.[^.]*$', '') else '' end as parent", lambda: text.parent_structure("code").alias("parent"), table="lineitem", own=("case when l_linenumber % 4 = 0 then concat(l_orderkey, '') else concat(l_orderkey, '.', l_linenumber, case when l_linenumber % 2 = 0 then '' else concat('.', l_suppkey) end) end",))
DOTTED = ["Text.....more", "Text. . . . . more", "Text. . . . .more", "Text....more", "A.....B.....C", "1. Introduction.....1", "none", ". . . . . . . . 12", "a.......... . . . . . b"]
scalar("dots_to_colon", [(x,) for x in DOTTED], "line string", "regexp_replace(regexp_replace(line, '\\.{5,}', ': ', 'g'), '(?:\\. ){5,}\\.?', ': ', 'g') as plain", lambda: text.dots_to_colon("line").alias("plain"), table="documents", own=("concat(text, repeat('.', cast(doc_id % 9 as int)), ' ', repeat('. ', cast(doc_id % 8 as int)), doc_id)",))
MARKS = ["<physical_index_5>", "physical_index_5", "  <physical_index_10> ", "42", "0", "-5", "【第7页开始】", "【第8页结束】", "【第100页开始】some text", "【第 5 页开始】", "abc", "invalid", "", "<physical_index_x>", "+3", "99999999999"]
BARE = r"regexp_replace(regexp_replace(regexp_replace(m, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '^<physical_index_', ''), '>$', '')"
scalar(
    "parse_physical_index", [(x,) for x in MARKS], "m string",
    f"case when regexp_matches(m, '第\\d+页') then try_cast(regexp_extract(m, '第(\\d+)页', 1) as int) when regexp_matches({BARE}, '^(physical_index_)?[+-]?\\d+$') then try_cast(regexp_replace(regexp_replace({BARE}, '^physical_index_', ''), '^\\+', '') as int) end as page",
    lambda: text.physical_index("m").alias("page"),
    table="orders", own=("concat(case when o_orderkey % 5 = 0 then '<physical_index_' when o_orderkey % 5 = 1 then 'physical_index_' when o_orderkey % 5 = 2 then '【第' when o_orderkey % 5 = 3 then ' -' else 'p' end, o_orderkey, case when o_orderkey % 5 = 0 then '>' when o_orderkey % 5 = 2 then '页开始】' else ' ' end)",),
)
TITLES = ["  Chapter 1:  Intro ", "CHAPTER 1 — intro", "第一章、总则", "a.b,c", "", "Ünïcode Title!", "tab\tand　wide"]
scalar("normalize_title", [(x,) for x in TITLES], "title string", f"{NORMAL.format('title')} as normal", lambda: text.normalize_title("title").alias("normal"), table="documents", own=("text",))
LONG = ["A plain title", "Two\nlines\r\nhere", "Cut here - and not there", " - begins with one", "A — b", "x" * 40, "A rather long title that must be cut somewhere", "第一章、这是一个非常非常长的标题，需要在某个地方截断它：否则太长了", "ends with colon:", "ends：", "", "tab\there", "Wide　space", "trailing punctuation, here we go!!! more and more"]
ONE = "replace(replace(title, chr(10), ' '), chr(13), ' ')"
DASH1 = f"case when starts_with({ONE}, ' - ') then {ONE} else regexp_replace({ONE}, '(?s)^(.+?) - .*$', '\\1') end"
scalar(
    "clean_title", [(x,) for x in LONG], "title string",
    "trim(regexp_replace(regexp_replace(case when length(seen) > 30 then regexp_replace(case when regexp_extract(substr(seen, 1, 30), '^(.{16,29})[ 、，：]', 1) <> '' then regexp_extract(substr(seen, 1, 30), '^(.{16,29})[ 、，：]', 1) else substr(seen, 1, 30) end, '[\\p{P} ]+$', '') else seen end, ':$', ''), '：$', '')) as clean",
    lambda: text.clean_title("title").alias("clean"),
    table="conversations", own=("concat(text, case when turn % 3 = 0 then ' - ' when turn % 3 = 1 then '：' else ':' end)",), of="w",
    extra=f", one as (select title, {DASH1} as d from v), two as (select title, case when starts_with(d, ' — ') then d else regexp_replace(d, '(?s)^(.+?) — .*$', '\\1') end as e from one), w as (select title, trim(regexp_replace(e, '[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{P}}\\p{{S}} ]|\\x{{FFFD}}', '', 'g')) as seen from two)",
)
WORDS = [("kitten", "sitting"), ("abc", "abc"), ("Chapter 1", "Chapter 2"), ("", "abc"), ("abcdefgh", "zyxwvuts"), ("a1b2", "a2b3"), ("12", "1")]
NEAR = ("concat('Part ', l_partkey, case when l_linenumber % 2 = 0 then 'a' else '' end)", "concat('Part ', l_partkey + l_linenumber % 4 * 9, case when l_linenumber % 3 = 0 then 'b' else '' end)")
scalar("bounded_edit_distance", WORDS, "a string, b string", "least(levenshtein(a, b), 4)::int as distance", lambda: text.bounded_distance("a", "b").alias("distance"), table="lineitem", own=NEAR)
scalar(
    "digit_changes", WORDS, "a string, b string",
    "len(list_filter(range(1, least(length(a), length(b)) + 1), lambda k: regexp_matches(a[k], '[0-9]') and regexp_matches(b[k], '[0-9]') and a[k] <> b[k]))::int as changes",
    lambda: text.digit_changes("a", "b").alias("changes"),
    table="lineitem", own=NEAR,
)
PAIRED = [("Chapter 1", "chapter 1."), ("Chapter 1", "Chapter 2"), ("Ch 1", "Ch 2"), ("abcd", "abce"), ("abcd", "xbcd"), ("abc", "xyz"), ("ab", "ba"), ("a12", "a34"), ("Intro", "Intr"), ("1", "2")]
PLAIN = NORMAL.format("a"), NORMAL.format("b")
CHANGED = "len(list_filter(range(1, least(length(x), length(y)) + 1), lambda k: regexp_matches(x[k], '[0-9]') and regexp_matches(y[k], '[0-9]') and x[k] <> y[k]))"
scalar(
    "titles_match", PAIRED, "a string, b string",
    f"x = y or (levenshtein(x, y) <= 3 and {CHANGED} <= 1 and (greatest(length(x), length(y)) < 4 or (greatest(length(x), length(y)) = 4 and least(length(x), length(y)) > 0 and contains(case when length(x) <= length(y) then y else x end, substr(case when length(x) <= length(y) then x else y end, 1, 1))))) as matches",
    lambda: text.titles_match("a", "b").alias("matches"),
    table="lineitem", own=("concat(case when l_linenumber % 2 = 0 then 'C' else 'c.' end, l_partkey % 1000)", "concat(case when l_linenumber % 3 = 0 then 'c' else 'd' end, case when l_linenumber % 5 = 0 then ' ' else '' end, l_suppkey % 1000)"), of="w",
    extra=f", w as (select a, b, {PLAIN[0]} as x, {PLAIN[1]} as y from v)",
)
scalar(
    "arabic_to_chinese", [(str(n),) for n in [*range(1, 100), 100, "x", "0"]], "n string",
    "case when regexp_matches(n, '^[1-9]$') then translate(n, '123456789', '一二三四五六七八九') when regexp_matches(n, '^[1-9][0-9]$') then case when n[1] = '1' then '' else translate(n[1], '123456789', '一二三四五六七八九') end || '十' || case when n[2] = '0' then '' else translate(n[2], '123456789', '一二三四五六七八九') end else n end as chinese",
    lambda: text.arabic_to_chinese("n").alias("chinese"),
    table="orders", own=("concat(o_custkey % 120, '')",),
)
HEADS = ["第一章 总则", "第12章", " 第一章", "第a章", "Chapter 1", "第 3 章 x", "", "前言第二章"]
CHINESE = "case when regexp_matches(n, '^[1-9]$') then translate(n, '123456789', '一二三四五六七八九') when regexp_matches(n, '^[1-9][0-9]$') then case when n[1] = '1' then '' else translate(n[1], '123456789', '一二三四五六七八九') end || '十' || case when n[2] = '0' then '' else translate(n[2], '123456789', '一二三四五六七八九') end else n end"
scalar(
    "chapter_titles", [(x,) for x in HEADS], "title string", f"regexp_matches(title, '^第[零一二三四五六七八九十百千万0-9]+章') as is_chapter, {CHINESE} as number",
    lambda: text.is_chapter_title("title").alias("is_chapter"), lambda: text.chapter_number("title").alias("number"),
    table="orders", own=("concat(case when o_custkey % 4 = 0 then ' ' else '' end, '第', case when o_custkey % 3 = 0 then ' ' else '' end, o_orderkey % 130, '章 ', o_custkey)",), of="w",
    extra=", w as (select title, trim(regexp_extract(title, '第(.+?)章', 1)) as n from v)",
)
REPLIES = ['```json\n{"a": 1}\n```', '{"a": 1}', 'x ```json [1] ``` y', "plain", "```json {}"]
scalar("json_fence", [(x,) for x in REPLIES], "reply string", "regexp_replace(case when contains(reply, '```json') then regexp_extract(reply, '(?s)```json(.*?)(?:```|$)', 1) else reply end, '^\\s+|\\s+$', '', 'g') as inside", lambda: text.json_fence("reply").alias("inside"), table="orders", own=("concat(case when o_orderkey % 3 = 0 then 'Here: ```json' else '' end, ' [', o_orderkey, '] ', case when o_orderkey % 2 = 0 then '```' else '' end, ' end ')",))
scalar("page_range_display", [(1, 1), (2, 5)], "a int, b int", "case when a = b then 'page ' || a else 'pages ' || a || '-' || b end as shown", lambda: text.page_range("a", "b").alias("shown"), table="lineitem", own=("l_linenumber", "l_linenumber + l_partkey % 3"))
MODELS = [(m,) for m in ["gpt-4", "gpt-4o", "gpt-3.5-turbo", "claude-2.0", "Qwen-custom", "Qwen2.5-7B-Instruct", "Llama-custom", "Mixtral-8x22B-Instruct-v0.1", "unknown", "", "gpt-4-turbo"]]
LIMIT = "case model when 'gpt-4' then 8192 when 'gpt-4o' then 128000 when 'gpt-4-turbo' then 128000 when 'gpt-3.5-turbo' then 4096 when 'claude-2.0' then 100000 when 'Mixtral-8x22B-Instruct-v0.1' then 65536 else case when starts_with(model, 'Llama') then 8192 else 32768 end end"
scalar("batch_limits", MODELS, "model string", f"{LIMIT} as context, greatest(1000, {LIMIT} * 80 // 100 - 1600)::int as safe", lambda: tokens.context_limit("model").alias("context"), lambda: tokens.safe_limit("model").alias("safe"), table="part", own=("case when p_partkey % 5 = 0 then 'gpt-4' when p_partkey % 5 = 1 then concat('Llama-', p_size) when p_partkey % 5 = 2 then 'gpt-4-turbo' when p_partkey % 5 = 3 then p_brand else p_name end",))
scalar("optimal_batch", [(3, 5000), (5, 10), (6, 60000), (100, 100000), (1000, 100000), (200, 9000000)], "nodes int, total int", "case when nodes <= 5 then nodes else greatest(5, least(50, nodes // 10)) end::int as size, case when nodes <= 5 then 100000 else greatest(10000, least(100000, (total // nodes) * greatest(5, least(50, nodes // 10)))) end::int as tokens", lambda: tokens.batch_plan("nodes", "total")["size"].alias("size"), lambda: tokens.batch_plan("nodes", "total")["tokens"].alias("tokens"), table="orders", own=("1 + o_custkey % 1200", "o_orderkey * 31"))
scalar("backoff_schedule", [(k,) for k in range(8)], "attempt int", "least(pow(2, attempt), 32)::double as seconds", lambda: tokens.retry_delay("attempt").alias("seconds"), table="lineitem", own=("l_linenumber + l_partkey % 5",))
SPOKEN = ["你好，世界。这是一个测试", "Hello, world 123", "안녕하세요 세계", "これは日本語のテストです", "漢字かな", "Привет, мир", "مرحبا بالعالم", "नमस्ते", "สวัสดี", "", "12345 !!", "mostly Latin 中文", "×÷^_"]
CLASS = "regexp_replace({0}, '[\\p{{P}}\\p{{S}}\\p{{Z}}\\s\\x{{85}}]', '', 'g')"
RE2 = {name: ranges for name, (ranges, _, _) in text.SCRIPTS.items()}
COUNTS = ", ".join(f"(length(s) - length(regexp_replace(s, '[{ranges}]', '', 'g')))::int as {name}" for name, ranges in RE2.items())


@query(f"with s as (select doc_id, {CLASS.format('text')} as s from documents) select doc_id, length(s)::int as total, {COUNTS} from s")
def script_histogram(spark, sf):
    return text.with_scripts(adapters.table(spark, sf, "documents")).select("doc_id", "scripts.*")


BEST = "greatest(Han, Hangul, Hiragana, Katakana, Cyrillic, Arabic, Devanagari, Thai, Latin)"
CHOICE = " ".join(f"when {name} = {BEST} then '{code}'" for name, (_, code, _) in text.SCRIPTS.items() if name not in ("Han",))
LANGUAGE = f"case when total = 0 or {BEST} = 0 then 'en' when Han = {BEST} and Hiragana + Katakana > 0 then 'ja' when Han = {BEST} then 'zh' {CHOICE} end"
SURE = f"case when total = 0 or {BEST} = 0 then 0.0::double when {LANGUAGE} = 'en' then {BEST}::double / total * 0.8 else {BEST}::double / total end"


@query(f"with s as (select doc_id, {CLASS.format('text')} as s from documents), c as (select doc_id, length(s)::int as total, {COUNTS} from s) select doc_id, {LANGUAGE} as code, round({SURE}, 9) as confidence from c")
def detect_language(spark, sf):
    found = text.with_scripts(adapters.table(spark, sf, "documents")).select("doc_id", text.language("scripts").alias("l"))
    return found.select("doc_id", "l.code", F.round("l.confidence", 9).alias("confidence"))


SHOWN = f"case {LANGUAGE} when 'zh' then 'Chinese (中文)' when 'ja' then 'Japanese (日本語)' when 'ko' then 'Korean (한국어)' when 'ru' then 'Russian' when 'ar' then 'Arabic' when 'hi' then 'Hindi' when 'th' then 'Thai' else 'English' end"


@query(f"with s as (select doc_id, {CLASS.format('text')} as s from documents), c as (select doc_id, length(s)::int as total, {COUNTS} from s) select doc_id, 'items' || case when {LANGUAGE} = 'en' and {SURE} < 0.5 then '' else ' ' || {SHOWN} end || chr(10) as line from c")
def prompt_language(spark, sf):
    found = text.with_scripts(adapters.table(spark, sf, "documents")).select("doc_id", text.language("scripts").alias("l"))
    return found.select("doc_id", prompts.task_line("items", "l").alias("line"))


TOLD = values("t", [(k, x) for k, x in enumerate(SPOKEN)], "k, said")


@query(f"with {TOLD}, v as (select said as text from t union all select repeat(said, 1 + length(text)::int % 400) || text from documents join t on doc_id % 13 = k), s as (select text, {CLASS.format('text')} as s from v), c as (select text, length(s)::int as total, {COUNTS} from s) select text, {LANGUAGE} as code, round({SURE}, 9) as confidence, case {LANGUAGE} when 'zh' then 'Chinese (中文)' when 'ja' then 'Japanese (日本語)' when 'ko' then 'Korean (한국어)' when 'ru' then 'Russian' when 'ar' then 'Arabic' when 'hi' then 'Hindi' when 'th' then 'Thai' else 'English' end as shown from c")
def detect_language_scripts(spark, sf):
    """Every document after up to 400 repeats of a phrase of some script."""
    said = literal(spark, list(enumerate(SPOKEN)), "k int, said string")
    own = adapters.table(spark, sf, "documents").join(F.broadcast(said), F.col("doc_id") % 13 == F.col("k")).select(F.concat(F.repeat("said", 1 + F.length("text") % 400), "text").alias("text"))
    found = text.with_scripts(own.unionByName(said.select(F.col("said").alias("text")))).select("text", text.language("scripts").alias("l"))
    return found.select("text", "l.code", F.round("l.confidence", 9).alias("confidence"), text.language_name("l.code", "l.name").alias("shown"))


@query(r"select doc_id, regexp_replace(text, '[^\p{L}\p{M}\p{N}\p{P}\p{S}\p{Z}\t\n\x0B\f\r\x{85}]', '', 'g') as clean from documents")
def clean_text(spark, sf):
    return adapters.table(spark, sf, "documents").select("doc_id", text.clean_text("text").alias("clean"))


@query("select doc_id, (strlen(text) // 4)::int as tokens from documents")
def token_estimate(spark, sf):
    return adapters.table(spark, sf, "documents").select("doc_id", tokens.estimate("text").alias("tokens"))


@query("with v as (select doc_id, encode(text) as content from documents) select doc_id, octet_length(content) <= 52428800 and text[1:5] = '%PDF-' as ok from v join documents using (doc_id)")
def pdf_guard(spark, sf):
    return adapters.table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content")).select("doc_id", adapters.pdf_ok("content").alias("ok"))


# ---- the seam to models, with the offline provider


@query("select doc_id, sha256('summary' || chr(31) || lang || chr(31) || text) as key from documents")
def cache_key(spark, sf):
    return adapters.table(spark, sf, "documents").select("doc_id", provider.key(F.lit("summary"), "lang", "text").alias("key"))


@query("select doc_id, sha256('s' || chr(31) || text) in (select sha256('s' || chr(31) || text) from documents where doc_id % 3 = 0) as cached from documents")
def cache_split(spark, sf):
    asked = adapters.table(spark, sf, "documents").select("doc_id", provider.key(F.lit("s"), "text").alias("key"))
    return provider.split(asked, asked.where("doc_id % 3 = 0")).select("doc_id", "cached")


@query("""with r as (select o_custkey as batch_no, o_orderkey::varchar as node_id from orders), a as (select * from r where not (batch_no % 4 = 0 and node_id::bigint % 5 = 0)),
    m as (select coalesce(r.batch_no, a.batch_no) as batch_no, r.node_id as x, a.node_id as y from r full join a on r.batch_no = a.batch_no and r.node_id = a.node_id)
    select batch_no, count(x) as requested, count(y) as answered, count(*) filter (x is null or y is null) = 0 and count(x) = count(y) as fits from m group by batch_no""")
def batch_answers_fit(spark, sf):
    asked = adapters.table(spark, sf, "orders").select(F.col("o_custkey").alias("batch_no"), F.col("o_orderkey").cast("string").alias("node_id"))
    return summaries.answers_fit(asked, asked.where("not (batch_no % 4 = 0 and cast(node_id as bigint) % 5 = 0)"))


@query(f"with {TREE} select doc_id, node_id from nodes where start_page % 2 = 0 and title <> 'Document'")
def nodes_needing_summary(spark, sf):
    own = nodes(spark, sf).withColumn("summary", F.when(F.col("start_page") % 2 == 1, F.lit("done")))
    return summaries.needing(own).select("doc_id", "node_id")


@query(f"with {TREE} select doc_id, count(*) as total_nodes, max(end_page) as total_pages from nodes group by doc_id")
def run_stats(spark, sf):
    return nodes(spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_nodes"), F.max("end_page").alias("total_pages"))


#: Flaws of replies by the order's key, and what strict and lenient repair make of them.
FLAWS = (
    ("'```json' || chr(10) || '{\"a\": ' || k || ',}' || chr(10) || '```'", "'{\"a\": ' || k || '}'", "'{\"a\":' || k || '}'"),
    ("'Here: {\"a\": {\"b\": [' || k || ', 2,],},} and more'", "'{\"a\": {\"b\": [' || k || ', 2]}}'", "'{\"a\":{\"b\":[' || k || ',2]}}'"),
    ("'{\"a\": \"line' || chr(10) || 'break ' || k || '\"}'", "'{\"a\": \"line' || chr(92) || 'nbreak ' || k || '\"}'", "'{\"a\":\"line' || chr(92) || 'nbreak ' || k || '\"}'"),
    ("'{' || chr(39) || 'a' || chr(39) || ': None, b: ' || k || '}'", "'{' || chr(39) || 'a' || chr(39) || ': None, b: ' || k || '}'", "'{\"a\":null,\"b\":' || k || '}'"),
    ("'no json ' || k", "'no json ' || k", "null"),
    ("'[' || k || ', 2, 3,]'", "'[' || k || ', 2, 3]'", "'[' || k || ',2,3]'"),
)
CASES = ["case k % 6 " + " ".join(f"when {n} then {f[at]}" for n, f in enumerate(FLAWS)) + " end" for at in range(3)]


@query(f"with o as (select o_orderkey as k from orders) select {CASES[0]} as reply, {CASES[1]} as strict, {CASES[2]} as lenient from o")
def json_repair(spark, sf):
    own = adapters.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")).select(F.expr(CASES[0]).alias("reply"))
    return own.select("reply", jsonrepair.strict_json("reply").alias("strict"), jsonrepair.lenient_json("reply").alias("lenient"))


# Kinds first, then the nodes of a document go one by one into lists of batches; at last the small batches are joined, one by one.
@query(
    f"""with recursive {TREE},
    t as (select doc_id, node_id, ((end_page - start_page + 1) * 900)::int as tokens from nodes),
    k as (select *, case when tokens > 38400 then 0 when tokens > 24000 then 1 else 2 end as kind from t),
    o as (select *, row_number() over (partition by doc_id order by kind, case when kind = 2 then -tokens end, node_id) as nth from k),
    alone as (select doc_id, list([node_id] order by nth) filter (kind < 2) as bins, count(*) filter (kind < 2) as m, count(*) as n from o group by doc_id),
    fill as (select doc_id, m as nth, n, m, coalesce(bins, []) as bins, [0::bigint for b in coalesce(bins, [])] as loads from alone
      union all select doc_id, nth, n, m, case when spot is null then list_append(bins, [node_id]) else [case when i = spot then list_append(bins[i], node_id) else bins[i] end for i in range(1, len(bins) + 1)] end,
        case when spot is null then list_append(loads, cost) else [case when i = spot then loads[i] + cost else loads[i] end for i in range(1, len(bins) + 1)] end
      from (select f.doc_id, o.nth, f.n, f.m, f.bins, f.loads, o.node_id, o.tokens + 200 as cost,
          list_min([i for i in range(f.m + 1, len(f.bins) + 1) if len(f.bins[i]) < 20 and f.loads[i] + o.tokens + 200 <= 43200]) as spot
        from fill f join o on o.doc_id = f.doc_id and o.nth = f.nth + 1)),
    cost as (select doc_id, map(list(node_id), list(tokens + 200)) as c from t group by doc_id),
    few as (select f.doc_id, 1::bigint as spot, bins, c from fill f join cost using (doc_id) where nth = n
      union all select doc_id, spot + 1, list_concat(bins[1:spot - 1], list_prepend(r.own, r.rest)), c
      from (select doc_id, spot, bins, c, list_reduce(list_prepend({{'own': bins[spot], 'rest': []::varchar[][]}}, [{{'own': b, 'rest': []::varchar[][]}} for b in bins[spot + 1:]]),
          lambda a, x: case when len(a.own) + len(x.own) <= 5 and list_sum([c[i] for i in list_concat(a.own, x.own)]) <= 38400
            then {{'own': list_concat(a.own, x.own), 'rest': a.rest}} else {{'own': a.own, 'rest': list_append(a.rest, x.own)}} end) as r from few where spot <= len(bins))),
    last as (select doc_id, bins from few where spot > len(bins)),
    named as (select doc_id, unnest(range(1, len(bins) + 1))::int as batch_no, unnest(bins) as ids from last),
    flat as (select doc_id, batch_no, unnest(ids) as node_id from named)
    select doc_id, node_id, tokens, batch_no from flat join t using (doc_id, node_id)"""
)
def summary_batches(spark, sf):
    own = nodes(spark, sf).select("doc_id", "node_id", ((F.col("end_page") - F.col("start_page") + 1) * 900).alias("tokens"))
    return summaries.summary_batches(own)


@query(f"with {TOC}, c as (select doc_id, count(*) as n from toc group by doc_id) select doc_id, 0 as page from c where n >= 3")
def contents_detection(spark, sf):
    """Of each customer a contents page of all chapters, then one of plain words."""
    line = F.concat_ws(" ", "structure", "title", F.lit("....."), F.col("physical_index").cast("string"))
    contents = items(spark, sf).groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("text"))
    two = contents.select("doc_id", F.explode(F.array(F.struct(F.lit(1).alias("page_number"), "text"), F.struct(F.lit(2).alias("page_number"), F.lit("Plain words.").alias("text")))).alias("p")).select("doc_id", "p.*")
    return pipeline.contents_pages(two)


@query(f"""with {TOC}, l as (select doc_id, structure, title, physical_index, structure || ' ' || title || ' ..... ' || physical_index as line from toc where title <> '' and physical_index is not null)
    select doc_id, (row_number() over (partition by doc_id order by line) - 1)::int as list_index, structure, title, physical_index as page from l""")
def contents_listed(spark, sf):
    """The items that a contents page of each customer's chapters lists."""
    line = F.concat_ws(" ", "structure", "title", F.lit("....."), F.col("physical_index").cast("string"))
    own = items(spark, sf).where("title <> '' and physical_index is not null")
    return pipeline.contents_items(own.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("text")))


FLAT = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_]+', '', 'g')"


@query(f"""with {CONV}, i as (select doc_id, page_number as list_index, split_part(text, chr(10), 1) as title, (page_number + doc_id % 2)::int as physical_index from pages)
    select i.doc_id, list_index, title, physical_index, coalesce({FLAT.format('title')} <> '' and contains({FLAT.format('text')}, {FLAT.format('title')}), false) as appears
    from i left join pages p on p.doc_id = i.doc_id and p.page_number = i.physical_index""")
def title_appearance(spark, sf):
    pages = adapters.conversation_pages(spark, sf)
    own = pages.select("doc_id", F.col("page_number").alias("list_index"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), (F.col("page_number") + F.col("doc_id") % 2).cast("int").alias("physical_index"))
    return pipeline.verified(own, pages).select("doc_id", "list_index", "title", "physical_index", "appears")


from quillgrove.plans import model_catalog  # noqa: E402, F401  adds its queries
