"""The queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgrove.llm import attribution, decontaminate, html_main, jaccard_join, lattice_lm, license_scan, packing, sharding, spelling, suffix_dedup, topk, toxicity, warc
from quillgrove.llm.store import table


def op1_site_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"))


def op2_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score(table(spark, sf_dir, "documents"))


def op5_no_random_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op6_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(table(spark, sf_dir, "documents")).drop("tag", "kept")


def op8_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("doc")


def op9_chunked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_bayes_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


def op11_letter_parity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_license_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op13_eager_accumulators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.attribute(table(spark, sf_dir, "clicks"), table(spark, sf_dir, "sales"))


QUERIES = (
    op1_site_template_removal, op2_classifier_chain, op3_best_two_fit, op4_subword_lattice, op5_no_random_access,
    op6_label_propagation, op7_suffix_array_dedup, op8_positional_index, op9_chunked_records, op10_bayes_jaccard,
    op11_letter_parity_bands, op12_license_containment, op13_eager_accumulators,
)

_VECTORS = """
rows as (select row_number() over () as row, vec_id, list_transform(embedding, lambda v: floor(1024 * v::double)::bigint) as x
    from embeddings where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0)
"""
OP5 = f"""
with {_VECTORS}, scored as (
    select q.row, q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::bigint as score
    from rows q, rows c where q.vec_id % 100 = 0 and q.row <> c.row and len(q.x) = len(c.x))
select query_id, rank::integer as rank, vec_id, score
from (select *, row_number() over (partition by row order by score desc, vec_id) as rank from scored) where rank <= 10
"""

OP8 = r"""
with doc as (select row_number() over () as row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
item as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (select distinct item_id, list_slice(w, k, k + 9) as g from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as k from item where len(w) > 0)),
sizes as (select distinct len(g) as n from win),
spot as (select d.row, s.n, d.k, list_slice(d.w, d.k, d.k + s.n - 1) as g from (select row, w, unnest(range(1, len(w) + 1)) as k from doc) d, sizes s where d.k + s.n - 1 <= len(d.w)),
met as (select spot.row, spot.k, spot.n, win.item_id from spot join win using (g)),
hit as (select row, count(distinct p) as n_hit from (select row, unnest(range(k, k + n)) as p from met) group by row),
owned as (select row, count(*) as n_items, string_agg(i, ',' order by i) as names from (select distinct row, item_id::varchar as i from met) group by row)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
    sha256(coalesce(names, '')) as items_sha256, n_hit is not null as contaminated
from doc left join hit using (row) left join owned using (row)
"""

OP9 = """
with p as (select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
last as (select payload_digest, payload_bytes, max(page_id) as last from p where payload_bytes >= 1000 group by all)
select page_id, payload_bytes, payload_digest, case when last is null or last = page_id then 'response' else 'revisit' end as record_type,
    case when last <> page_id then last end as refers_to
from p left join last using (payload_digest, payload_bytes)
"""


def crc32(code_points: str) -> str:
    """SQL for the unsigned CRC-32 of the UTF-8 of a text of code points below 2048, given as a list: a bit at a time."""
    octets = f"flatten(list_transform({code_points}, lambda c: case when c < 128 then [c] else [192 + (c >> 6), 128 + (c & 63)] end))"
    bits = f"flatten(list_transform({octets}, lambda b: list_transform(range(8), lambda k: (b::bigint >> k::int) & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {bits}), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"


def code_points(text: str) -> str:
    return f"list_transform(string_split({text}, ''), lambda x: unicode(x))"


OP11 = f"""
with recursive found as (select coalesce(doc_id::varchar, '') as id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
each_run as (select id, run, count(*) as times from found where length(run) >= 7 group by all),
hashed as (select run, times, {crc32(code_points("id || ':' || run"))} as h from each_run),
cut as (select times, case when h % 31 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word from hashed),
w as (select word, sum(times)::bigint as n from cut where length(word) >= 7 group by word having sum(times) >= 2),
blank as (select word, n, left(word, k - 1) || '_' || substr(word, k + 1) as p from (select word, n, unnest(range(1, length(word) + 1)) as k from w)),
shorter as (select distinct word, n, left(word, k - 1) || substr(word, k + 1) as p from (select word, n, unnest(range(1, length(word) + 1)) as k from w)),
near as (select distinct a.word, b.word as other, b.n as m from blank a join blank b on a.p = b.p and a.word <> b.word
    union all select s.word, w.word, w.n from shorter s join w on s.p = w.word union all select w.word, s.word, s.n from shorter s join w on s.p = w.word),
best as (select word, count(*) as n_near from near group by word),
top as (select word, other, m from near qualify row_number() over (partition by word order by m desc, other) = 1),
formed as (select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when m >= 10 * w.n then other end as form, case when m >= 10 * w.n then m end as form_n
    from w left join best on best.word = w.word left join top on top.word = w.word),
walk as (select word, word as here, 0 as step from formed union all select walk.word, f.form, step + 1 from walk join formed f on f.word = walk.here where f.form is not null),
ends as (select word, arg_max(here, step) as root from walk group by word)
select f.word, form, root, n, n_near, form_n from formed f join ends using (word)
"""


def _batch(key: str) -> str:
    return f"(epoch_us(arrived_at) // 3600000000 + case when {crc32(code_points(f'{key}::varchar'))} % 4 = 0 then 240 else 0 end)"


OP13 = f"""
with c0 as (select distinct click_id as id, client_id as client, epoch_us(ts) as ts, {_batch('click_id')} as h from clicks where client_id is not null and ts is not null),
s0 as (select sale_id, client_id as client, epoch_us(sold_at) as sold, {_batch('sale_id')} as h from sales where client_id is not null and sold_at is not null),
edge as (select min(h) as lo, max(h) as hi from c0),
c as (select id, client, ts, (10 * (h - lo)) // (hi - lo + 1) as b from c0, edge),
s as (select sale_id, client, sold, greatest(0, least(9, (10 * (h - lo)) // (hi - lo + 1))) as b from s0, edge),
mark as (select k as b, least((select max(ts) from c where b < k), (select max(sold) from s where b < k)) - 172800000000 as w from range(0, 10) t(k)
    where (select max(ts) from c where b < k) is not null and (select max(sold) from s where b < k) is not null),
held as (select id, client, ts from c left join mark using (b) where w is null or ts >= w),
ends as (select s.*, coalesce(sold < w, false) as late, case when coalesce(sold < w, false) then b else coalesce((select min(m.b) from mark m where m.b > s.b and s.sold < m.w), 10) end as batch from s left join mark using (b)),
met as (select sale_id, count(*) as n, arg_min(id, (-ts, id)) as best from ends join held on held.client = ends.client and not late and ts between sold - 604800000000 and sold group by sale_id)
select sale_id, batch::integer as batch, late, best as click_id, coalesce(n, 0)::bigint as n_clicks from ends left join met using (sale_id)
"""


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_WORDS = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: Counts the shared tokens of every block and template, without any filter.
OP12 = f"""
with doc as (select row_number() over () as row, doc_id, {_WORDS.format('text')} as w from documents),
phrase as (select label, string_split(p, ' ') as p from (values {', '.join(f'({_text(p)}, {_text(x)})' for p, x in license_scan.PHRASES.items())}) t(p, label)),
base as (select row, label, k - 1 as start from (select row, w, unnest(range(1, len(w) + 1)) as k from doc where list_contains(w, 'by') or list_contains(w, 'public') or list_contains(w, 'rights')), phrase where w[k] = p[1] and list_slice(w, k, k + len(p) - 1) = p),
template as (select template, label, {_WORDS.format('t')} as w from (values {', '.join(f'({k}, {_text(x)}, {_text(t)})' for k, (x, t) in enumerate(license_scan.TEMPLATES))}) t(template, label, t)),
token as (select template, label, len(w) as span, len(list_distinct(w)) as size, ceil(len(list_distinct(w)) * {license_scan.THRESHOLD} - 1e-9) as need, unnest(list_distinct(w)) as token from template),
place as (select row, k - 1 as pos, w[k] as token from (select row, w, unnest(range(1, len(w) + 1)) as k from doc)),
block as (select row, template, any_value(label) as label, any_value(size) as size, any_value(need) as need, unnest([pos // span, pos // span - 1]) as block, token from place join token using (token) group by row, template, block, token),
held as (select row, template, any_value(label) as label, count(distinct token) / any_value(size) as share from block where block >= 0 group by row, template, block having count(distinct token) >= any_value(need)),
b as (select row, count(*) as n_base, min(start) as first_word, max(start) as last_word, list(distinct label) as labels from base group by row),
h as (select row, list(distinct label) as labels, max(share) as share from held group by row)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
    array_to_string(list_sort(coalesce(b.labels, [])), ',') as base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(h.labels, [])))), ',') as labels,
    case when n_base > 0 then 1.0 else coalesce(share, 0.0) end::double as score
from doc left join b using (row) left join h using (row)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op5_no_random_access": OP5, "op8_positional_index": OP8, "op9_chunked_records": OP9, "op11_letter_parity_bands": OP11, "op12_license_containment": OP12, "op13_eager_accumulators": OP13}
