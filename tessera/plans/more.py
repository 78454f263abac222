"""Queries over tenants, several sources of contact and governed writes, with SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import apply, govern, lanes, ledger, paths, recall, resolve, structured, ties
from ..sources import graph as G
from ..sources import seeds
from ..sources.graph import NOW, Graph, key, now
from . import catalog
from .catalog import _LINKS, _NORM, _at, _values, query

YEAR_ON = "2025-06-01 00:00:00"
_PEOPLE = """(select 'C' || c_custkey as id, 'U' || (c_custkey % 4) as user_id, 'Person' as type, c_name as display_name,
 case when c_acctbal < 0 then timestamp '2024-01-01' end as deleted_at, case when c_custkey % 10 = 0 then 'satellite' end as graph_layer from customer)"""
_MINE = f"(select * from {_PEOPLE} where user_id = 'U1' and deleted_at is null)"
_OF = "(select 'C' || user_id as node_id, ts as tm from events where event_type = '{}')"
_MEET = f"(select * from {_OF.format('signup')} union all select 'C' || (user_id + 1), ts from events where event_type = 'signup')"
_STATUS = f"(select node_id, max(tm) as tm from {_OF.format('error')} group by 1)"
_COUNTER = f"(select node_id, count(*) as volume, min(tm) as sf, max(tm) as sl from {_OF.format('view')} group by 1)"
_TOUCH = f"""(select node_id, tm from {_OF.format('purchase')} union all select node_id, tm from {_STATUS} union all select * from {_OF.format('click')}
 union all select * from {_MEET} union all select node_id, sl from {_COUNTER})"""


def _signal_sql(at: str, dated: str = "true") -> str:
    now_, year = f"timestamp '{at}'", f"timestamp '{at}' - interval 365 day"
    return f"""(select node_id, coalesce(events, 0) as events, least(f, sf) as first_at, greatest(l, sl) as last_at, coalesce(ely, 0) as events_last_year, coalesce(am, 0) as active_months,
 coalesce(volume, 0) as volume, coalesce(judged, 0) as judged_contacts, coalesce(genuine, 0) as genuine_contacts from
 (select node_id, count(*) filter (tm <= {now_}) as events, min(tm) filter (tm <= {now_} or k <> 'status') as f, max(tm) as l, count(*) filter (tm <= {now_} and tm >= {year}) as ely,
   count(distinct case when tm <= {now_} and tm >= {year} then year(tm) * 12 + month(tm) end) as am
  from (select *, 'status' as k from {_STATUS} union all select *, 'touch' from {_OF.format('purchase')} union all select *, 'meeting' from {_MEET}) where (k <> 'meeting' or tm <= {now_}) and {dated} group by 1)
 full join {_COUNTER} using (node_id)
 full join (select 'C' || user_id as node_id, count(*) as judged, count(*) filter (value >= 50) as genuine from events where event_type = 'purchase' group by 1) using (node_id))"""


def _tie_sql(at: str, dated: str = "true") -> str:
    days = "(epoch_us(last_at) - epoch_us(first_at)) / 86400000000.0"
    rate = f"case when events_last_year = 0 and volume > 0 and first_at is not null and last_at is not null then least(volume, volume * 365 / greatest(1.0, {days})) else events_last_year end"
    spanned = f"case when volume > 1 and last_at > first_at then least(1.0, {days} / 365) * 0.5 else 0 end"
    return f"""select node_id, round((0.45 * r + 0.35 * f + 0.2 * c) * coalesce(0.4 + 0.6 * g, 1), 4) as score, round(r, 4) as recency, round(f, 4) as frequency, round(c, 4) as consistency, round(g, 4) as genuine_ratio, past_volume
from (select node_id, coalesce(pow(2.0, -greatest(0, epoch_us(timestamp '{at}') - epoch_us(last_at)) / 86400000000.0 / 60), 0) as r, least(1.0, ln(1 + {rate}) / ln(53.0)) as f,
 case when events > 0 then least(1.0, active_months / 12.0) else {spanned} end as c, case when judged_contacts > 0 then genuine_contacts / judged_contacts end as g, volume + events as past_volume from {_signal_sql(at, dated)})"""


@query(f"select id, display_name from {_PEOPLE} where user_id = 'U1' and deleted_at is null")
def tenant_live_nodes(g: Graph) -> DataFrame:
    return structured.scoped(g.people(), "U1").select("id", "display_name")


@query(f"select id, display_name from {_PEOPLE} where user_id = 'U2' and deleted_at is null")
def signed_in_tenant(g: Graph) -> DataFrame:
    return structured.scoped(g.people(), "U1", "U2").select("id", "display_name")


@query(f"select count(*) as n from {_MINE}")
def tenant_count(g: Graph) -> DataFrame:
    return structured.scoped(g.people(), "U1").agg(F.count("*").alias("n"))


@query(f"select id, display_name from {_MINE} where coalesce(graph_layer, '') <> 'satellite' and display_name like '%5%' order by id limit 1")
def first_on_main_graph(g: Graph) -> DataFrame:
    rows = resolve.on_main_graph(structured.scoped(g.people(), "U1"))
    return resolve.first_match(rows, F.col("display_name").contains("5"), "id").select("id", "display_name")


@query(f"""select id, display_name, type, round(s, 6) as similarity from (select 'C' || vec_id as id, list_cosine_similarity(cast(embedding as double[]), q) as s from embeddings,
 (select cast(embedding as double[]) as q from embeddings where vec_id = 0)) join {_MINE} using (id) order by s desc, id limit 8""")
def tenant_vector_recall(g: Graph) -> DataFrame:
    vectors = g.table("embeddings").select(key("C", "vec_id").alias("id"), "embedding")
    found = recall.vector_recall(structured.scoped(g.people(), "U1"), vectors, catalog._probe_vector(g))
    return found.withColumn("similarity", F.round("similarity", 6))


@query(f"select node_id, count(*) as n, max(tm) as latest from {_TOUCH} where tm >= timestamp '2024-01-10' and tm < timestamp '2024-01-17' group by 1 order by n desc, latest desc, node_id limit 120")
def temporal_lane_sources(g: Graph) -> DataFrame:
    return lanes.temporal(G.touches(g.contacts()), _at("2024-01-10 00:00:00"), _at("2024-01-17 00:00:00"))


@query(f"select * from {_signal_sql(NOW)}")
def interaction_signal_sources(g: Graph) -> DataFrame:
    s = g.contacts()
    return ties.gather(G.dated(s), s["source_contact_stats"], s["keep_in_touch_verdicts"], now())


@query(_tie_sql(NOW))
def tie_strength_sources(g: Graph) -> DataFrame:
    return ties.strength(interaction_signal_sources(g), now()).drop("last_at")


@query(_tie_sql(YEAR_ON, "cast(substr(node_id, 2) as bigint) % 3 <> 0"))
def tie_strength_by_counters(g: Graph) -> DataFrame:
    s, at = g.contacts(), _at(YEAR_ON)
    some = G.dated(s).where(F.substring("node_id", 2, 20).cast("long") % 3 != 0)
    return ties.strength(ties.gather(some, s["source_contact_stats"], s["keep_in_touch_verdicts"], at), at).drop("last_at")


@query(f"""select node_id as id, row_number() over (order by last desc, node_id) - 1 as rank from (select node_id, max(tm) as last from (select node_id, tm from {_STATUS} union all select node_id, sl from {_COUNTER})
 where tm >= timestamp '{NOW}' - interval 45 day and tm <= timestamp '{NOW}' group by 1 order by last desc, node_id limit 25)""")
def proximity_seeds(g: Graph) -> DataFrame:
    found = lanes.proximity(G.recent(g.contacts()), g.links().limit(0), now())
    return found.select("id", F.col("seed_rank").alias("rank"))


@query("""select id, industry, display_name from (select 'S' || s_suppkey as id, s_name as display_name, ['fintech', 'software', 'media', 'energy', 'legal'][s_suppkey % 5 + 1] as industry from supplier) where industry = 'media'""")
def organisations_in_industry(g: Graph) -> DataFrame:
    names = F.array(*map(F.lit, ["fintech", "software", "media", "energy", "legal"]))
    rows = g.table("supplier").select(key("S", "s_suppkey").alias("id"), F.get(names, (F.col("s_suppkey") % 5).cast("int")).alias("industry"), F.col("s_name").alias("display_name"))
    return rows.where("industry = 'media'")


@query(f"""with orgs as (select 'S' || s_suppkey as id, s_name as org from supplier where s_suppkey % 5 = 2), hit as (select distinct l.source as id, org from {_LINKS} l join orgs on orgs.id = l.target where l.type = 'customer' and l.source in ('C1', 'C2', 'C3', 'C4', 'C5'))
select id, min(org) as org from hit group by 1""")
def people_by_employer_industry(g: Graph) -> DataFrame:
    orgs = g.table("supplier").where("s_suppkey % 5 = 2").select(key("S", "s_suppkey").alias("id"), F.col("s_name").alias("display_name"))
    facts = orgs.select(F.col("id").alias("node_id"), F.lit("industry").alias("name"), F.lit("Media").alias("value"))
    people = g.table("customer").where("c_custkey between 1 and 5").select(key("C", "c_custkey").alias("id"), F.lit("Person").alias("type"), F.col("c_name").alias("display_name"))
    nodes = people.unionByName(orgs.select("id", F.lit("Organization").alias("type"), "display_name"))
    hits = structured.industry_hits(structured.Store(nodes, g.customers(), facts, g.ledger()), "media")
    first = hits.groupBy("id").agg(F.min("reason").alias("reason"))
    return first.select("id", F.regexp_extract("reason", r"works at (.*) \(media\)", 1).alias("org"))


@query("""select 'P' || p_partkey as id, case when p_partkey % 3 = 0 then 'fresh ' || p_partkey else p_name end as name, p_size + 0 as size from part
union all select 'Q' || p_partkey, 'new', p_partkey from part where p_partkey < 5""")
def upsert_latest(g: Graph) -> DataFrame:
    p = g.table("part")
    rows = p.select(key("P", "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("size"))
    some = p.where("p_partkey % 3 = 0").select(key("P", "p_partkey").alias("id"), F.explode(F.array(F.lit("stale"), F.concat(F.lit("fresh "), F.col("p_partkey").cast("string")))).alias("name"), F.col("p_size").cast("long").alias("size"))
    some = some.withColumn("o", F.when(F.col("name") == "stale", 1).otherwise(2))
    new = p.where("p_partkey < 5").select(key("Q", "p_partkey").alias("id"), F.lit("new").alias("name"), F.col("p_partkey").cast("long").alias("size"), F.lit(1).alias("o"))
    return govern.upsert(rows, some.unionByName(new), ["id"], "o")


@query("select 'T' || (p_partkey % 40) as id, min(p_size) as size from part where p_partkey % 40 >= 20 group by 1 union all select 'T' || n, -1 from range(20) r(n)")
def insert_or_ignore(g: Graph) -> DataFrame:
    held = g.spark.range(20).select(F.concat(F.lit("T"), F.col("id").cast("string")).alias("id"), F.lit(-1).cast("long").alias("size"))
    rows = g.table("part").select(F.concat(F.lit("T"), (F.col("p_partkey") % 40).cast("string")).alias("id"), F.col("p_size").cast("long").alias("size"))
    least = rows.groupBy("id").agg(F.min("size").alias("size"))
    return govern.insert_or_ignore(held, least, ["id"])


@query("select n_nationkey as id, case when n_nationkey % 2 = 0 then upper(n_name) || '!' else n_name end as name, n_regionkey as region from nation")
def update_by_id(g: Graph) -> DataFrame:
    rows = g.table("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    patches = rows.where("id % 2 = 0").select("id", F.concat(F.upper("name"), F.lit("!")).alias("name"), F.lit(None).cast("long").alias("region"))
    return govern.update_by_id(rows, patches)


@query("select 'N' || n_nationkey as id, case when n_regionkey = 1 then timestamp '2024-01-31' end as deleted_at from nation")
def tombstones(g: Graph) -> DataFrame:
    rows = g.table("nation").select(key("N", "n_nationkey").alias("id"), F.lit(None).cast("timestamp_ntz").alias("deleted_at"))
    gone = g.table("nation").where("n_regionkey = 1").select(key("N", "n_nationkey").alias("id"))
    return govern.tombstone(rows, gone, ["id"], now())


@query("""select 'N' || n_nationkey as id, 'patched' as op, n_name as was from nation where n_regionkey = 2 union all select 'X' || n_nationkey, 'created', null from nation where n_regionkey = 3""")
def write_journal(g: Graph) -> DataFrame:
    before = g.table("nation").select(key("N", "n_nationkey").alias("id"), F.col("n_name").alias("name"))
    after = g.table("nation").select(key("N", "n_nationkey").alias("id"), F.when(F.col("n_regionkey") == 2, F.upper(F.concat("n_name", F.lit("?")))).otherwise(F.col("n_name")).alias("name"))
    after = after.unionByName(g.table("nation").where("n_regionkey = 3").select(key("X", "n_nationkey").alias("id"), F.lit("new").alias("name")))
    return govern.journal(before, after, ["id"], "nodes").select("id", "op", F.get_json_object("previous", "$.name").alias("was"))


@query("""select 'O' || o_orderkey as id, case when o_custkey % 7 = 0 then 'not null: name' when o_orderkey % 5 = 0 then 'unique: id' when o_custkey % 11 = 0 then 'foreign key: customer' end as refused from orders where o_orderkey < 2000""")
def write_refusals(g: Graph) -> DataFrame:
    o = g.table("orders").where("o_orderkey < 2000")
    rows = o.select(key("O", "o_orderkey").alias("id"), F.when(F.col("o_custkey") % 7 != 0, "x").alias("name"), F.when(F.col("o_custkey") % 11 == 0, "C-1").otherwise(key("C", "o_custkey")).alias("customer"))
    held = o.where("o_orderkey % 5 = 0").select(key("O", "o_orderkey").alias("id"))
    people = g.table("customer").select(key("C", "c_custkey").alias("id")).unionByName(o.select(key("C", "o_custkey").alias("id")))
    return govern.refusals(held, rows, ["name"], ["id"], {"customer": people}).select("id", "refused")


@query(f"select type, norm, min(id) as id from (select id, type, {_NORM.format('display_name')} as norm from {_MINE} where coalesce(graph_layer, '') <> 'satellite') where norm <> '' group by 1, 2")
def confirm_cache(g: Graph) -> DataFrame:
    return resolve.confirm_cache(structured.scoped(g.people(), "U1"))


@query("""select o_orderkey as ord, count(c_custkey) = 2 as ok from (select o_orderkey, unnest([o_custkey, o_custkey + 100000 * (o_orderkey % 2)]) as c from orders where o_orderkey < 500) left join customer on c_custkey = c
group by 1""")
def all_ids_exist(g: Graph) -> DataFrame:
    wanted = g.table("orders").where("o_orderkey < 500").select(F.col("o_orderkey").alias("ord"), F.array(key("C", "o_custkey"), F.concat(F.lit("C"), (F.col("o_custkey") + 100000 * (F.col("o_orderkey") % 2)).cast("string"))).alias("ids"))
    return resolve.all_exist(g.table("customer").select(key("C", "c_custkey").alias("id")), wanted)


@query(f"""with n as (select distinct {_NORM.format('p_name')} as y from part), w as (select y as id, case when length(y) >= 5 then substr(y, 1, 2) || 'q' || substr(y, 4) else y || 'zzz' end as x from n),
d as (select w.id as ord, n.y as id, case when w.x = n.y then 1 else 2 end as tier, levenshtein(w.x, n.y) as d from w, n where w.x = n.y or (length(w.x) >= 5 and length(n.y) >= 5 and levenshtein(w.x, n.y) <= 2))
select ord, arg_min(id, (tier, d, id)) as id, min(tier) as tier from d group by ord""")
def fuzzy_lookup(g: Graph) -> DataFrame:
    n = g.table("part").select(T.normalize_for_match(F.col("p_name")).alias("id")).distinct()
    nodes = n.select("id", F.lit("Product").alias("type"), F.col("id").alias("display_name"))
    typo = F.when(F.length("id") >= 5, F.concat(F.substring("id", 1, 2), F.lit("q"), F.substring("id", 4, 99))).otherwise(F.concat("id", F.lit("zzz")))
    wanted = n.select(F.col("id").alias("ord"), F.lit("Product").alias("type"), typo.alias("display_name"))
    return resolve.existing(wanted, nodes, g.spark.createDataFrame([], "id string, node_id string, alias_text string"))


@query(f"select 'C' || c_custkey as user_id, v.* from customer, {_values([(d[0], d[1], d[3], d[4], d[5]) for d in {(x[0]): x for x in reversed(seeds.DETAIL_DEFINITIONS)}.values()], 'name, value_type, applies_to, is_default, multi_value')}")
def seed_detail_definitions(g: Graph) -> DataFrame:
    users = g.table("customer").select(key("C", "c_custkey").alias("user_id"))
    return seeds.detail_definitions(users).select("user_id", "name", "value_type", "applies_to", "is_default", "multi_value")


@query("""with r as (select *, 'O' || o_orderkey as id, 'C' || (o_custkey % 20) as node_id from orders where o_orderkey < 4000)
select id, o_totalprice as amount, o_orderdate as created_at from r where node_id = 'C3' order by o_orderdate desc, id limit 200""")
def ledger_of_a_person(g: Graph) -> DataFrame:
    o = g.table("orders").where("o_orderkey < 4000")
    rows = o.select(key("O", "o_orderkey").alias("id"), F.concat(F.lit("C"), (F.col("o_custkey") % 20).cast("string")).alias("node_id"), F.col("o_totalprice").alias("amount"), F.col("o_orderdate").alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("deleted_at"))
    return ledger.listed(rows, "C3").select("id", "amount", "created_at")


@query("select 'O' || o_orderkey as id, o_orderstatus = 'F' or o_orderkey % 4 = 0 as settled, case when o_orderkey % 4 = 0 then timestamp '2024-01-31' end as settled_at from orders where o_orderkey < 4000")
def settled_entries(g: Graph) -> DataFrame:
    o = g.table("orders").where("o_orderkey < 4000")
    rows = o.select(key("O", "o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("settled"))
    return ledger.settle(rows, o.where("o_orderkey % 4 = 0").select(key("O", "o_orderkey").alias("id")), now()).select("id", "settled", "settled_at")


@query("""with t as (select 'C' || c_custkey as node_id, unnest([lower(c_mktsegment), c_mktsegment]) as name from customer)
select distinct node_id, case when lower(name) = 'building' then 't1' else 'tag:' || lower(name) end as tag_id from t where not (node_id = 'C1' and lower(name) = 'building')""")
def tags_applied(g: Graph) -> DataFrame:
    wanted = g.table("customer").select(key("C", "c_custkey").alias("node_id"), F.array(F.lower("c_mktsegment"), F.col("c_mktsegment"), F.lit(" ")).alias("names"))
    tags = g.spark.createDataFrame([("t1", "Building")], "id string, name string")
    return apply.apply_tags(wanted, tags, g.spark.createDataFrame([("C1", "t1")], "node_id string, tag_id string"))[1]


@query("select 'U' || n as user_id, case when n % 2 = 0 then 'conv' || n else 'new:U' || n end as id, n % 2 = 1 as made from range(4) r(n)")
def agent_conversations(g: Graph) -> DataFrame:
    users = structured.scoped(g.people(), "U0").unionByName(g.people()).select("user_id")
    held = g.spark.createDataFrame([("conv0", "U0", "MCP"), ("conv9", "U0", "MCP"), ("conv2", "U2", "MCP"), ("c3", "U3", "other")], "id string, user_id string, title string")
    return apply.ensure_conversation(held, users)


@query(f"""with n as (select distinct p_name as id, string_split_regex(lower(trim(p_name)), '[^a-z0-9]+') as t from part union all select p_name || ' x' || (p_partkey % 3), string_split_regex(lower(p_name || ' x' || (p_partkey % 3)), '[^a-z0-9]+') from (select distinct on (p_name) * from part order by p_name, p_partkey)
 union all select distinct string_split(p_name, ' ')[1] || ' ' || substr(string_split(p_name, ' ')[2], 1, 1), [lower(string_split(p_name, ' ')[1]), lower(substr(string_split(p_name, ' ')[2], 1, 1))] from part)
select distinct a.id as a, b.id as b from n a join n b on a.t[1] = b.t[1] and a.id < b.id where a.t = b.t or (least(len(a.t), len(b.t)) >= 2 and a.t[1:least(len(a.t), len(b.t))] = b.t[1:least(len(a.t), len(b.t))])
or (len(a.t) = 2 and len(b.t) = 2 and ((length(a.t[2]) = 1 and a.t[2] = b.t[2][1]) or (length(b.t[2]) = 1 and b.t[2] = a.t[2][1])))""")
def likely_same_names(g: Graph) -> DataFrame:
    p = g.table("part").groupBy(F.col("p_name").alias("id")).agg(F.min("p_partkey").alias("k"))
    parts = F.split("id", " ")
    short = F.concat_ws(" ", F.get(parts, F.lit(0)), F.substring(F.get(parts, F.lit(1)), 1, 1))
    n = p.select("id").unionByName(p.select(F.concat("id", F.lit(" x"), (F.col("k") % 3).cast("string")).alias("id"))).unionByName(p.select(short.alias("id")).distinct())
    return paths.bridges(n.select("id", F.col("id").alias("display_name")))


@query("""with t as (select p_partkey as id, p_name, list_distinct(string_split(lower(p_name || ' ' || p_type || ' ' || case when p_partkey % 2 = 0 then 'item' else 'thing' end), ' ')) as t from part where p_partkey < 300),
p as (select a.id as a, b.id as b, len(list_intersect(a.t, b.t)) as i, len(a.t) as la, len(b.t) as lb from t a join t b on a.id < b.id)
select count(*) as pairs, cast(sum(a) as bigint) as a, cast(sum(b) as bigint) as b from p where i >= 2 and (i = least(la, lb) or i / (la + lb - i) >= 0.6)""")
def similar_wording_pairs(g: Graph) -> DataFrame:
    p = g.table("part").where("p_partkey < 300")
    last = F.when(F.col("p_partkey") % 2 == 0, "item").otherwise("thing")
    rows = p.select("p_partkey", F.concat_ws(" ", "p_name", "p_type", last, F.concat(F.lit("."), F.rpad(F.lit(""), 0, "x"))).alias("x"))
    texts = rows.select("x").distinct()
    pairs = resolve.similar_pairs(texts, "x")
    a, b = rows.select(F.col("p_partkey").alias("i"), F.col("x").alias("a")), rows.select(F.col("p_partkey").alias("j"), F.col("x").alias("b"))
    other = pairs.join(a, "a").join(b, "b").select("i", "j")
    same = a.join(b, F.col("a") == F.col("b")).where("i < j").select("i", "j")
    return other.unionByName(same).agg(F.count("*").alias("pairs"), F.sum(F.least("i", "j")).alias("a"), F.sum(F.greatest("i", "j")).alias("b"))
