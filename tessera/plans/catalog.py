"""Named queries over the driver's tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import facts as V
from ..functions import text as T
from ..operators import govern, lanes, paths, recall, resolve, ties
from ..sources import seeds
from ..sources.graph import NOW, Graph, key, now, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Graph(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _at(text: str):
    return F.expr(f"timestamp_ntz'{text}'")


_INTER = "(select 'C' || user_id as node_id, ts as tm, value, event_type in ('purchase', 'signup') as genuine from events)"
_NODES = """(select 'C' || c_custkey as id, 'Person' as type, c_name as display_name from customer union all select 'S' || s_suppkey, 'Organization', s_name from supplier
 union all select 'N' || n_nationkey, 'Country', n_name from nation union all select 'R' || r_regionkey, 'Region', r_name from region union all select 'P' || p_partkey, 'Product', p_name from part)"""
_BOUGHT = "(select distinct 'customer' as type, 'C' || o_custkey as source, 'S' || l_suppkey as target from orders join lineitem on o_orderkey = l_orderkey)"
_LINKS = f"""(select 'lives_in' as type, 'C' || c_custkey as source, 'N' || c_nationkey as target from customer union all select 'located_in', 'S' || s_suppkey, 'N' || s_nationkey from supplier
 union all select 'part_of', 'N' || n_nationkey, 'R' || n_regionkey from nation union all select * from {_BOUGHT})"""
_ATTR = """(select 'C' || c_custkey as node_id, 'industry' as name, c_mktsegment as value from customer union all select 'P' || p_partkey, 'brand', p_brand from part union all select 'P' || p_partkey, 'kind', p_type from part
 union all select 'C' || c_custkey, 'balance', cast(cast(c_acctbal as decimal(18,2)) as varchar) from customer)"""
_PRIO = """(select *, lead(valid_from) over (partition by node_id order by valid_from) as valid_until from
 (select 'C' || o_custkey as node_id, arg_max(o_orderpriority, o_orderkey) as value, o_orderdate as valid_from from orders group by o_custkey, o_orderdate))"""
_SIGNAL = f"""(select node_id, count(*) as events, min(tm) as first_at, max(tm) as last_at, count(*) filter (tm >= timestamp '{NOW}' - interval 365 day) as events_last_year,
 count(distinct case when tm >= timestamp '{NOW}' - interval 365 day then year(tm) * 12 + month(tm) end) as active_months, count(*) filter (genuine) as genuine_contacts, sum(value) as volume_value
 from {_INTER} where tm <= timestamp '{NOW}' group by node_id)"""
_TIE = f"""(select node_id, recency, frequency, consistency, genuine_ratio, last_at, past_volume, (0.45 * recency + 0.35 * frequency + 0.2 * consistency) * (0.4 + 0.6 * genuine_ratio) as score from
 (select node_id, pow(2.0, -greatest(0, epoch_us(timestamp '{NOW}') - epoch_us(last_at)) / 86400000000.0 / 60) as recency, least(1.0, ln(1 + events_last_year) / ln(53.0)) as frequency,
  least(1.0, active_months / 12.0) as consistency, genuine_contacts / events as genuine_ratio, last_at, events as past_volume from {_SIGNAL}))"""
LATER = "2024-09-30 00:00:00"


@query(f"select node_id, count(*) as n, max(tm) as latest from {_INTER} where tm >= timestamp '2024-01-10' and tm < timestamp '2024-01-17' group by node_id order by n desc, latest desc, node_id limit 120")
def temporal_lane_top(g: Graph) -> DataFrame:
    return lanes.temporal(g.interactions(), _at("2024-01-10 00:00:00"), _at("2024-01-17 00:00:00"))


@query(f"select node_id, events, first_at, last_at, events_last_year, active_months, genuine_contacts, round(volume_value, 2) as volume_value from {_SIGNAL}")
def interaction_signal(g: Graph) -> DataFrame:
    return ties.signal(g.interactions(), now()).withColumn("volume_value", F.round("volume_value", 2))


@query(f"select node_id, round(score, 4) as score, round(recency, 4) as recency, round(frequency, 4) as frequency, round(consistency, 4) as consistency, round(genuine_ratio, 4) as genuine_ratio, last_at, past_volume from {_TIE}")
def tie_strength(g: Graph) -> DataFrame:
    return ties.strength(ties.signal(g.interactions(), now()), now())


@query(f"""select node_id, case when past_volume >= 12 and s >= 60 then round(least(1.0, ln(1 + past_volume) / ln(501.0)) * (0.25 + 0.75 * least(1.0, (s - 60) / 305)), 4) else 0.0 end as dormancy
from (select *, (epoch_us(timestamp '{LATER}') - epoch_us(last_at)) / 86400000000.0 as s from {_TIE})""")
def dormant_ties(g: Graph) -> DataFrame:
    return ties.dormancy(ties.strength(ties.signal(g.interactions(), now()), now()), _at(LATER))


@query(f"""with t as (select node_id, count(distinct year(tm) * 12 + month(tm)) as active_months from {_INTER} where tm <= timestamp '{NOW}' and tm >= timestamp '{NOW}' - interval 365 day group by node_id)
select 'C' || c_custkey as node_id, coalesce(active_months, 0) as active_months from customer left join t on t.node_id = 'C' || c_custkey""")
def active_months(g: Graph) -> DataFrame:
    s = ties.signal(g.interactions(), now()).select("node_id", "active_months")
    people = g.nodes().where("type = 'Person'").select(F.col("id").alias("node_id"))
    return people.join(s, "node_id", "left").fillna(0, ["active_months"])


@query(f"""with s as (select node_id as id, row_number() over (order by last desc, node_id) - 1 as seed_rank from (select node_id, max(tm) as last from {_INTER} where tm >= timestamp '{NOW}' - interval 45 day and tm <= timestamp '{NOW}' group by 1 order by last desc, node_id limit 25)),
adj as (select source as a, target as b from {_LINKS} union select target, source from {_LINKS}),
h1 as (select b as id, min(seed_rank) as seed_rank from s join adj on a = id group by 1), n1 as (select * from h1 where id not in (select id from s)),
h2 as (select b as id, min(seed_rank) as seed_rank from n1 join adj on a = id group by 1), n2 as (select * from h2 where id not in (select id from s) and id not in (select id from n1))
select id, hop, seed_rank from (select id, 0 as hop, seed_rank from s union all select id, 1, seed_rank from n1 union all select id, 2, seed_rank from n2) order by hop, seed_rank, id limit 120""")
def proximity_two_hop(g: Graph) -> DataFrame:
    return lanes.proximity(g.interactions(), g.links(), now())


@query(f"select node_id, min(name) as name, min(value) as value from {_ATTR} where name = 'industry' and lower(value) = 'machinery' group by node_id")
def attribute_search_exact(g: Graph) -> DataFrame:
    return recall.attribute_search(g.attributes(), ["industry"], "machinery", True)


@query(f"select node_id, x.name as name, x.value as value from (select node_id, min({{'name': name, 'value': value}}) as x from {_ATTR} where name in ('brand', 'kind') and contains(lower(value), 'brand#1') group by node_id)")
def attribute_search_substring(g: Graph) -> DataFrame:
    return recall.attribute_search(g.attributes(), ["brand", "kind"], "brand#1", False)


@query(f"select node_id, min(name) as name, min(value) as value from {_ATTR} where name = 'industry' and contains(lower(value), 'mach') group by node_id")
def attribute_widen(g: Graph) -> DataFrame:
    return recall.exact_then_widen(g.attributes(), ["industry"], "mach")


@query(f"""with a as (select id, 0 as tier from {_NODES} where contains(lower(display_name), 'customer#00000001') order by id limit 8),
b as (select id, 1 as tier from (select distinct node_id as id from {_ATTR} where contains(lower(value), 'customer#00000001') or contains(lower(value), 'building')) order by id limit 24),
c as (select id, 0 as tier from {_NODES} where contains(lower(display_name), 'customer#00000001') or contains(lower(display_name), 'building') order by id limit 8)
select id, min(tier) as tier from (select * from c union all select * from b) group by id""")
def keyword_recall(g: Graph) -> DataFrame:
    return recall.keyword(g.nodes(), g.attributes(), ["customer#00000001", "building"])


@query(f"select id, display_name, case when lower(trim(display_name)) = 'asia' then 'exact' else 'weak_partial' end as quality from {_NODES} where contains(lower(display_name), 'asia') order by id limit 12")
def find_node_by_name(g: Graph) -> DataFrame:
    return recall.by_name(g.nodes(), "ASIA")


_Q0 = "(select cast(embedding as double[]) as q from embeddings where vec_id = 0)"


def _probe_vector(g: Graph) -> list[float]:
    return g.vectors().where("vec_id = 0").first()["embedding"]


@query(f"select id, round(similarity, 6) as similarity from (select 'E' || vec_id as id, list_cosine_similarity(cast(embedding as double[]), q) as similarity from embeddings, {_Q0}) order by similarity desc, id limit 8")
def vector_topk(g: Graph) -> DataFrame:
    return recall.vector_topk(g.vectors(), _probe_vector(g), digits=6)  # the SQL's order by is by its rounded column


_LANE_A = f"(select 'temporal' as lane, id, row_number() over (order by n desc, latest desc, id) - 1 as rank from (select node_id as id, count(*) as n, max(tm) as latest from {_INTER} where tm >= timestamp '2024-01-10' and tm < timestamp '2024-01-17' group by 1 order by n desc, latest desc, id limit 120))"
_LANE_B = f"(select 'strength' as lane, id, row_number() over (order by score desc, id) - 1 as rank from (select node_id as id, round(score, 4) as score from {_TIE} order by score desc, id limit 40))"


def _lanes(g: Graph) -> tuple[DataFrame, DataFrame]:
    a = lanes.temporal(g.interactions(), _at("2024-01-10 00:00:00"), _at("2024-01-17 00:00:00")).withColumnRenamed("node_id", "id")
    b = ties.strength(ties.signal(g.interactions(), now()), now()).select(F.col("node_id").alias("id"), "score").orderBy(F.desc("score"), "id").limit(40)
    return lanes.ranked(a, "temporal", F.desc("n"), F.desc("latest"), F.col("id")), lanes.ranked(b, "strength", F.desc("score"), F.col("id"))


@query(f"select id, round(sum(1.0 / (61 + rank)), 6) as score, string_agg(lane, '+' order by lane) as lanes from (select * from {_LANE_A} union all select * from {_LANE_B}) group by id")
def rrf_fusion(g: Graph) -> DataFrame:
    return lanes.fuse(list(_lanes(g))).withColumn("score", F.round("score", 6)).drop("appearance")


@query(f"select id, round(sum(1.0 / (61 + rank)), 6) as score, string_agg(lane, '+' order by lane) as lanes from (select * from {_LANE_A} union all select * from {_LANE_B} where id in (select id from {_LANE_A})) group by id")
def rrf_boost(g: Graph) -> DataFrame:
    a, b = _lanes(g)
    return lanes.fuse([a], [b]).withColumn("score", F.round("score", 6)).drop("appearance")


@query(f"""with v as (select 'E' || vec_id as id, list_cosine_similarity(cast(embedding as double[]), q) as s from embeddings, {_Q0} order by s desc, id limit 8), l as (select id, row_number() over (order by s desc, id) - 1 as rank from v)
select id, round(1.0 / (61 + rank), 6) as score, 'vector' as lanes from l order by score desc, id limit 8""")
def hybrid_recall(g: Graph) -> DataFrame:
    words = recall.keyword(g.nodes(), g.attributes(), ["building"])
    return recall.hybrid(g.vectors(), words, None, _probe_vector(g)).withColumn("score", F.round("score", 6))


@query(f"select target as id, n.display_name from {_LINKS} l join {_NODES} n on n.id = l.target where source = 'C1' and l.type = 'lives_in'")
def structured_self_edges(g: Graph) -> DataFrame:
    own = g.links().where("source = 'C1' and type = 'lives_in'").select(F.col("target").alias("id"))
    return own.join(g.nodes(), "id").select("id", "display_name")


@query(f"select distinct source as id from {_LINKS} l join {_NODES} n on n.id = l.target where lower(n.display_name) like '%supplier#000000003%' and n.type <> 'Person' and source like 'C%'")
def structured_org_members(g: Graph) -> DataFrame:
    org = recall.by_name(g.nodes().where("type != 'Person'"), "Supplier#000000003", limit=3).select(F.col("id").alias("target"))
    return g.links().join(F.broadcast(org), "target").where(F.col("source").startswith("C")).select(F.col("source").alias("id")).distinct()  # org: three rows at most


@query(f"""select distinct l.source as id from {_BOUGHT} l join part p on true join lineitem i on i.l_partkey = p.p_partkey and 'S' || i.l_suppkey = l.target where p.p_brand = 'Brand#11' and l.source in (select 'C' || c_custkey from customer)""")
def people_in_industry(g: Graph) -> DataFrame:
    brand = g.table("part").where("p_brand = 'Brand#11'").select("p_partkey")
    orgs = g.table("lineitem").select("l_partkey", "l_suppkey").join(brand, F.col("l_partkey") == F.col("p_partkey"), "left_semi").select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("target")).distinct()
    return g.customers().join(orgs, "target", "left_semi").select(F.col("source").alias("id")).distinct()


_LEDGER = "(select 'O' || o_orderkey as id, 'C' || o_custkey as node_id, o_totalprice as amount, o_orderstatus <> 'O' as settled, o_orderdate as date, case when o_orderpriority = '1-URGENT' then 'owed_by_me' else 'owed_to_me' end as direction from orders)"


@query(f"select id, node_id, amount, date from {_LEDGER} where not settled and direction = 'owed_by_me' order by amount desc, id limit 200")
def money_owed(g: Graph) -> DataFrame:
    own = g.ledger().where(~F.col("settled") & (F.col("direction").isNull() | (F.col("direction") == "owed_by_me")))
    return own.orderBy(F.col("amount").isNotNull().desc(), F.desc("amount"), "id").select("id", "node_id", "amount", "date").limit(200)


_BOTH = f"(select source as id, 'out' as direction, type, target as other from {_LINKS} union all select target, 'in', type, source from {_LINKS})"


@query(f"""select id, direction, b.type, other, display_name as other_name, greatest(0, total - 60) as omitted from (select *, row_number() over (partition by id, direction order by type, other) as n, count(*) over (partition by id, direction) as total from {_BOTH} where id in ('S1', 'N1', 'C1')) b
left join (select id as other, display_name from {_NODES}) using (other) where n <= 60""")
def expand_links_capped(g: Graph) -> DataFrame:
    ids = g.spark.createDataFrame([("S1",), ("N1",), ("C1",)], "id string")
    return recall.expand_links(g.links(), g.nodes(), ids)


@query(f"select node_id, value, valid_from from {_PRIO} where valid_from <= timestamp '1998-06-01' and (valid_until is null or valid_until > timestamp '1998-06-01')")
def details_as_of(g: Graph) -> DataFrame:
    return windows(g.priorities(), ["node_id"]).where(V.held_at(_at("1998-06-01 00:00:00"), F.col("valid_from"), F.col("valid_until"))).select("node_id", "value", "valid_from")


@query(f"select node_id, value, valid_from from {_PRIO} where valid_until is null")
def current_details(g: Graph) -> DataFrame:
    return windows(g.priorities(), ["node_id"]).where(V.held_at(now(), F.col("valid_from"), F.col("valid_until"))).select("node_id", "value", "valid_from")


@query(f"select node_id, value, valid_from, valid_until from {_PRIO} where valid_until is not null")
def detail_history(g: Graph) -> DataFrame:
    return windows(g.priorities(), ["node_id"]).where(F.col("valid_until").isNotNull()).select("node_id", "value", "valid_from", "valid_until")


@query(f"select node_id, value, valid_from, valid_until from {_PRIO}")
def supersession_chain(g: Graph) -> DataFrame:
    return windows(g.priorities(), ["node_id"]).select("node_id", "value", "valid_from", "valid_until")


_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower({})), '^(the|a|an)\\s+', ''), '\\b(inc|llc|ltd|corp|co|company|gmbh|sa|ag|plc|limited|llp)\\.?\\b', '', 'g'), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), '\\s+', ' ', 'g'))"


@query(f"select {_NORM.format('p_name')} as norm, min(p_partkey) as canonical, count(*) as n from part group by 1")
def normalized_name_dedupe(g: Graph) -> DataFrame:
    return g.table("part").groupBy(T.normalize_for_match(F.col("p_name")).alias("norm")).agg(F.min("p_partkey").alias("canonical"), F.count("*").alias("n"))


@query(f"""with n as (select distinct {_NORM.format('p_name')} as x from part) select a.x as a, b.x as b, levenshtein(a.x, b.x) as d from n a join n b on a.x < b.x and abs(length(a.x) - length(b.x)) <= 2 where length(a.x) >= 5 and length(b.x) >= 5 and levenshtein(a.x, b.x) <= 2""")
def fuzzy_name_pairs(g: Graph) -> DataFrame:
    return resolve.near_names(g.table("part").select(T.normalize_for_match(F.col("p_name")).alias("x")).distinct(), "x")


@query("""with n as (select distinct p_name as x, string_split_regex(lower(trim(p_name)), '[^\\p{L}\\p{N}]+') as t from part)
select a.x as a, b.x as b from n a join n b on a.t[1] = b.t[1] and a.x < b.x where a.t = b.t or (least(len(a.t), len(b.t)) >= 2 and a.t[1:least(len(a.t), len(b.t))] = b.t[1:least(len(a.t), len(b.t))])
or (len(a.t) = 2 and len(b.t) = 2 and ((length(a.t[2]) = 1 and a.t[2] = b.t[2][1]) or (length(b.t[2]) = 1 and b.t[2] = a.t[2][1])))""")
def likely_same_bridges(g: Graph) -> DataFrame:
    return paths.bridges(g.table("part").select(F.col("p_name").alias("id"), F.col("p_name").alias("display_name")).distinct())


@query(f"""with tie as (select node_id, round(score, 4) as score from {_TIE}), adj as (select source as a, target as b from {_LINKS} union select target, source from {_LINKS}),
e as (select a, b, 1 + 0.9 * (1 - coalesce(score, 0.0)) as step from adj left join tie on node_id = b),
l1 as (select b as id, min({{'c': round(step, 9), 'p': ['C1', b]}}) as x from e where a = 'C1' group by b),
l2 as (select b as id, min({{'c': round(x.c + step, 9), 'p': list_append(x.p, b)}}) as x from l1 join e on a = id where id <> 'C2' group by b),
l3 as (select b as id, min({{'c': round(x.c + step, 9), 'p': list_append(x.p, b)}}) as x from l2 join e on a = id where id <> 'C2' group by b),
l4 as (select b as id, min({{'c': round(x.c + step, 9), 'p': list_append(x.p, b)}}) as x from l3 join e on a = id where id <> 'C2' group by b)
select x.c as cost, hops, array_to_string(x.p, '>') as path from (select 1 as hops, * from l1 union all select 2, * from l2 union all select 3, * from l3 union all select 4, * from l4) where id = 'C2' order by cost, hops, path limit 1""")
def connection_path(g: Graph) -> DataFrame:
    return paths.cheapest(g.links(), ties.strength(ties.signal(g.interactions(), now()), now()), "C1", "C2", 4).select("cost", "hops", "path")


_PLACES = "(select r_name || '' as vague, n_name || ', ' || r_name as exact_ from nation join region on n_regionkey = r_regionkey)"


@query(f"select distinct a.vague as a, b.exact_ as b from {_PLACES} a join {_PLACES} b on b.exact_ like '%, ' || a.vague")
def location_specificity(g: Graph) -> DataFrame:
    place = g.table("nation").join(g.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("vague"), F.concat_ws(", ", "n_name", "r_name").alias("exact"))
    last = F.lower(F.trim(F.element_at(F.split("exact", ","), -1)))
    pair = place.select(F.col("vague").alias("a"), F.lower("vague").alias("k")).distinct().join(place.select(F.col("exact").alias("b"), last.alias("k")), "k")
    return pair.where(T.is_location_suffix(F.col("a"), F.col("b"))).select("a", "b")


@query("select o_orderkey, p_type as title, s as company, cast(year(o_orderdate) as varchar) as start, 'present' as end, true as current from (select o_orderkey, o_orderdate, o_orderpriority as p_type, o_orderstatus as s from orders)")
def role_parse(g: Graph) -> DataFrame:
    raw = F.concat(F.col("o_orderpriority"), F.lit(" at "), F.col("o_orderstatus"), F.lit(" ("), F.year("o_orderdate").cast("string"), F.lit(" to present)"))
    return g.table("orders").select("o_orderkey", V.role(raw).alias("r")).select("o_orderkey", "r.*")


@query("select o_orderkey, 'work' as category, lower(o_orderstatus) as type, strftime(o_orderdate, '%Y-%m-%d') as date, o_orderpriority as note from orders")
def life_event_parse(g: Graph) -> DataFrame:
    raw = F.concat(F.lit("Work/"), F.col("o_orderstatus"), F.lit(" | "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" | "), F.col("o_orderpriority"))
    return g.table("orders").select("o_orderkey", V.life_event(raw).alias("r")).select("o_orderkey", "r.*")


@query("select o_orderkey, case when o_orderstatus = 'O' then 'owed_by_me' else 'owed_to_me' end as direction, o_orderpriority as what, o_orderstatus = 'F' as settled from orders")
def favor_parse(g: Graph) -> DataFrame:
    way = F.when(F.col("o_orderstatus") == "O", "I owe").otherwise("owes me")
    state = F.when(F.col("o_orderstatus") == "F", "Repaid").otherwise("open")
    return g.table("orders").select("o_orderkey", V.favor(F.concat_ws(" | ", way, "o_orderpriority", state)).alias("r")).select("o_orderkey", "r.*")


@query("select o_orderkey, o_orderstatus as occasion, strftime(o_orderdate, '%Y-%m-%d') as date, o_orderpriority as gift from orders")
def gift_parse(g: Graph) -> DataFrame:
    raw = F.concat_ws(" | ", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderpriority")
    return g.table("orders").select("o_orderkey", V.gift(raw).alias("r")).select("o_orderkey", "r.*")


@query("""with n as (select distinct p_name as x, list_distinct(list_filter(string_split_regex(lower(p_name), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')) as t from part),
p as (select a.x as a, b.x as b, len(list_intersect(a.t, b.t)) as i, len(a.t) as la, len(b.t) as lb from n a join n b on a.x < b.x) select a, b from p where i >= 2 and (i = least(la, lb) or i / (la + lb - i) >= 0.6)""")
def near_duplicate_wording(g: Graph) -> DataFrame:
    return resolve.similar_pairs(g.table("part").select(F.col("p_name").alias("x")).distinct(), "x")


@query("select conv_id, turn, role as kind, text as payload from (select *, row_number() over (partition by conv_id order by turn desc) as n from conversations) where n <= 2 order by turn desc, conv_id limit 300")
def pending_top_n_per_conversation(g: Graph) -> DataFrame:
    return govern.pending_top(g.queue(), 2, 300)


@query("select role as label, count(*) as n from conversations group by 1")
def source_totals(g: Graph) -> DataFrame:
    return g.queue().groupBy(F.col("kind").alias("label")).agg(F.count("*").alias("n"))


@query(f"select distinct 'customer' as type, source, target from (select 'C' || o_custkey as source, 'S' || (l_suppkey + 1) as target from orders join lineitem on o_orderkey = l_orderkey) p where not exists (select 1 from {_BOUGHT} l where l.source = p.source and l.target = p.target)")
def create_link_idempotent(g: Graph) -> DataFrame:
    bought = g.table("orders").join(g.table("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    proposed = bought.select(F.lit("Customer ").alias("type"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("source"), F.concat(F.lit("S"), (F.col("l_suppkey") + 1).cast("string")).alias("target"))
    return govern.create_links(g.customers(), proposed)


@query(f"with p as (select p_partkey as ord, 'Product' as type, p_name as display_name, {_NORM.format('p_name')} as norm from part) select ord, type, display_name, min(ord) over (partition by type, norm) as canonical from p")
def create_node_batch(g: Graph) -> DataFrame:
    return govern.create_nodes(g.table("part").select(F.col("p_partkey").alias("ord"), F.lit("Product").alias("type"), F.col("p_name").alias("display_name")))


@query("select 'O' || o_orderkey as origin_key, 'C' || o_custkey as node_id, case when o_orderstatus = 'O' then 'owed_by_me' else 'owed_to_me' end as direction from orders where o_orderstatus <> 'F'")
def promote_life_facts(g: Graph) -> DataFrame:
    o = g.table("orders").select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("origin_key"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("node_id"), "o_orderstatus")
    parsed = o.withColumn("f", V.favor(F.concat_ws(" | ", F.when(F.col("o_orderstatus") == "O", "i owe").otherwise("owed to me"), F.lit("a sum")))).select("origin_key", "node_id", "f.direction")
    return govern.promote(parsed, o.where("o_orderstatus = 'F'"))


@query("""with p as (select o_orderkey as id, o_custkey as c, o_orderpriority as k, list_distinct(list_filter(string_split_regex(lower('send the report on ' || o_orderpriority || ' goods'), '[^\\p{L}\\p{N}]+'), lambda t: length(t) > 2)) as t from orders where o_orderstatus = 'P')
select a.id as a, b.id as b from p a join p b on a.c = b.c and a.id < b.id where least(len(a.t), len(b.t)) >= 3 and len(list_intersect(a.t, b.t)) >= 0.8 * least(len(a.t), len(b.t))""")
def promise_near_dup(g: Graph) -> DataFrame:
    p = g.table("orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("committer"), F.lit("me").alias("target"), F.concat(F.lit("send the report on "), F.col("o_orderpriority"), F.lit(" goods")).alias("description"))
    return govern.promises_alike(p)


@query("select n_name as name, cast(list_reduce(list_prepend(cast(0 as hugeint), [cast(ascii(c) as hugeint) for c in string_split(n_name, '')]), lambda h, c: (h * 31 + c) % 4294967296) % 7 as bigint) as color from nation")
def tag_color(g: Graph) -> DataFrame:
    return g.table("nation").select(F.col("n_name").alias("name"), T.name_hash(F.col("n_name"), 7).alias("color"))


@query(f"select 'C' || c_custkey as node_id, round(coalesce(score, 0), 4) as score from customer left join {_TIE} t on t.node_id = 'C' || c_custkey")
def tie_strengths_for_all(g: Graph) -> DataFrame:
    people = g.nodes().where("type = 'Person'").select(F.col("id").alias("node_id"))
    return ties.strengths_for(people, ties.strength(ties.signal(g.interactions(), now()), now())).select("node_id", "score")


@query("select node_id, name, count(distinct value) as values_ from (select 'P' || (p_partkey % 50) as node_id, 'brand' as name, p_brand as value from part) group by 1, 2 having count(distinct value) > 1")
def divergent_values(g: Graph) -> DataFrame:
    f = g.table("part").select(F.concat(F.lit("P"), (F.col("p_partkey") % 50).cast("string")).alias("node_id"), F.lit("brand").alias("name"), F.col("p_brand").alias("value"))
    return f.groupBy("node_id", "name").agg(F.count_distinct("value").alias("values_")).where("values_ > 1")


@query()
def text_merge(g: Graph) -> DataFrame:
    d = g.table("benchmark").select("item_id", "text")
    nxt = d.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return d.join(nxt, "item_id").select("item_id", T.merge_text(F.col("text"), F.col("other")).alias("merged"))


@query("""select id, 'C' || o_custkey as target, case when o_orderpriority = '1-URGENT' then 'user_to_other' else 'other_to_user' end as direction,
case when o_orderpriority = '1-URGENT' then 'Return $' || m || ': order ' || id else 'Follow up on $' || m || ' owed to you: order ' || id end as description, o_orderdate as due_at, 'open' as status, 'follow_up' as kind
from (select *, 'O' || o_orderkey as id, cast(cast(floor(o_totalprice) as bigint) as varchar) as m from orders where o_orderdate > timestamp '1998-06-01')""")
def ledger_reminders(g: Graph) -> DataFrame:
    due = g.ledger().select("id", "node_id", "kind", F.concat(F.lit("order "), F.col("id")).alias("description"), F.floor("amount").cast("double").alias("amount"), F.lit("USD").alias("currency"), "direction", "date")
    return govern.reminders(due, _at("1998-06-01 00:00:00"))


_FIRST = ["william", "bill", "w.", "Robert", "bob", "anna"]


@query("""with n as (select distinct ['william', 'bill', 'w.', 'Robert', 'bob', 'anna'][c_custkey % 6 + 1] || ' ' || c_mktsegment as name from customer),
p as (select name, string_split(replace(lower(name), '.', ''), ' ') as t from n)
select a.name as a, b.name as b, case when length(b.t[1]) > 1 and length(a.t[1]) = 1 then b.name else a.name end as fuller from p a join p b on a.name < b.name and a.t[2] = b.t[2]
where a.t[1] = b.t[1] or least(a.t[1], b.t[1]) || greatest(a.t[1], b.t[1]) in ('billwilliam', 'bobrobert') or (length(a.t[1]) = 1) <> (length(b.t[1]) = 1) and a.t[1][1] = b.t[1][1]""")
def name_variants(g: Graph) -> DataFrame:
    first = F.element_at(F.array(*map(F.lit, _FIRST)), (F.col("c_custkey") % 6 + 1).cast("int"))
    return govern.name_variants(g.table("customer").select(F.concat_ws(" ", first, "c_mktsegment").alias("name")).distinct())


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda v: "null" if v is None else f"'{v}'"
    return f"(values {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) v({names})"


@query(f"select 'C' || c_custkey as user_id, v.* from customer, {_values(seeds.NODE_TYPES, 'name, description')}")
def seed_node_types(g: Graph) -> DataFrame:
    return seeds.node_types(g.table("customer").select(key("C", "c_custkey").alias("user_id")))


@query(f"select 'C' || c_custkey as user_id, v.* from customer, {_values(seeds.LINK_TYPES, 'name, direction, inverse_name, source_type, target_type')}")
def seed_link_types(g: Graph) -> DataFrame:
    return seeds.link_types(g.table("customer").select(key("C", "c_custkey").alias("user_id")))


@query(f"select 'C' || c_custkey as user_id, v.* from customer, {_values(seeds.TAGS, 'name, color')}")
def seed_tags(g: Graph) -> DataFrame:
    return seeds.tags(g.table("customer").select(key("C", "c_custkey").alias("user_id")))
