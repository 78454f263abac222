"""Queries of this subpackage, each over its whole table, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, htmlextract, langid, licenses, neardup, packing, toxicity, urlfilter, warc
from .common import table


def op1_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits the WARC records of pages against a replica in which the records whose url's md5 starts with 07 have lost
    their last byte but one, and those with 0b are missing."""
    records = warc.as_records(table(spark, sf_dir, "pages"))
    mark = F.substring(F.md5("u"), 1, 2)
    hurt = F.concat(F.expr("substring(payload, 1, char_length(payload) - 2)"), F.lit("#\n"))
    replica = records.where(mark != "0b").withColumn("payload", F.when(mark == "07", hurt).otherwise(F.col("payload")))
    return warc.audit(records, replica)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_pages(table(spark, sf_dir, "pages"), langid.fit(table(spark, sf_dir, "documents")))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urlfilter.judge(pages, urlfilter.word_counts(pages, "html"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlextract.extract_pages(table(spark, sf_dir, "pages"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_merkle_fixity, op2_decontaminate, op3_toxicity, op4_language_id, op5_pack, op6_licenses, op7_neighbours, op8_url_filter, op9_main_text, op10_near_duplicates)}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op1_merkle_fixity": r"""
with r as (
  select coalesce('part-' || cast(cast(floor(page_id / 256) as bigint) as varchar), 'none-' || substr(md5(coalesce(url, '') || coalesce(html, '')), 1, 3)) as file,
         page_id, coalesce(url, '') as u,
         'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' ||
         cast(octet_length(encode(coalesce(html, ''))) as varchar) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) as payload
  from pages),
s as (select *, cast(octet_length(encode(payload)) as bigint) as length from r),
t as (select *, cast(sum(length) over (partition by file order by page_id, u, payload rows unbounded preceding) - length as bigint) as "offset" from s)
select file, "offset", length, case when substr(md5(u), 1, 2) = '07' then 'corrupt' else 'missing' end as status, sha256(payload) as expected,
       case when substr(md5(u), 1, 2) = '07' then sha256(substr(payload, 1, length(payload) - 2) || '#' || chr(10)) end as found
from t where substr(md5(u), 1, 2) in ('07', '0b')""",
    "op2_decontaminate": rf"""
with d as (select doc_id, row_number() over () as rid, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (select distinct cast(item_id as varchar) as item_id, least(10, len(w)) as n, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') as g
        from (select *, unnest(range(1, len(w) - least(10, len(w)) + 2)) as p from b where len(w) > 0)),
sizes as (select distinct n from win),
grams as (select rid, n, p, array_to_string(w[p : p + n - 1], ' ') as g from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as p from d, sizes where len(w) >= n)),
hits as (select rid, p, n, item_id from grams join win using (n, g)),
pos as (select rid, count(distinct q) as n_hit from (select rid, unnest(range(p, p + n)) as q from (select distinct rid, p, n from hits)) group by rid),
items as (select rid, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct rid, item_id from hits) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join pos using (rid) left join items using (rid)""",
    "op10_near_duplicates": rf"""
with recursive d as (select doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, g from (
        select doc_id, array_to_string(w[p : p + 4], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 3)) as p from d where len(w) >= 5)
        union all select doc_id, array_to_string(w, ' ') from d where len(w) between 1 and 4)),
n as (select doc_id, count(*) as n from s group by doc_id),
both_ as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
link as (select x, y from both_ join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 85 * (p.n + q.n - c)),
edge as (select x, y from link union select y, x from link),
reach as (select doc_id as x, doc_id as y from n union select r.x, e.y from reach r join edge e on e.x = r.y),
comp as (select x as doc_id, min(y) as c from reach group by x)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, coalesce(comp.c, d.doc_id) as component_id, coalesce(comp.c, d.doc_id) = d.doc_id as kept
from d left join n using (doc_id) left join comp using (doc_id)""",
}
