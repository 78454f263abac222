"""The property graph read from the driver's tables: nodes, links, facts, interactions and queues as lazy DataFrames.

Column pruning and filters reach the parquet scans; nothing here is cached or collected.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: All tables end on 2024-01-30; no operator asks for the wall clock.
NOW = "2024-01-31 00:00:00"


def now() -> Column:
    return F.expr(f"timestamp_ntz'{NOW}'")


def key(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


@dataclass
class Graph:
    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def probe(self, name: str, schema: str) -> DataFrame:
        """A table that may be missing: then it is empty."""
        try:
            return self.table(name)
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    @staticmethod
    def tolerant(df: DataFrame, column: str, kind: str = "string") -> DataFrame:
        """df with a column that older tables lack."""
        return df if column in df.columns else df.withColumn(column, F.lit(None).cast(kind))

    def nodes(self) -> DataFrame:
        def of(table, prefix, k, name, kind):
            return self.table(table).select(key(prefix, k).alias("id"), F.lit(kind).alias("type"), F.col(name).alias("display_name"))

        return reduce(DataFrame.unionByName, [of("customer", "C", "c_custkey", "c_name", "Person"), of("supplier", "S", "s_suppkey", "s_name", "Organization"), of("nation", "N", "n_nationkey", "n_name", "Country"), of("region", "R", "r_regionkey", "r_name", "Region"), of("part", "P", "p_partkey", "p_name", "Product")])

    def links(self) -> DataFrame:
        """lives_in, located_in, part_of and customer (who bought from whom; each pair once)."""
        place = [
            self.table("customer").select(F.lit("lives_in").alias("type"), key("C", "c_custkey").alias("source"), key("N", "c_nationkey").alias("target")),
            self.table("supplier").select(F.lit("located_in").alias("type"), key("S", "s_suppkey").alias("source"), key("N", "s_nationkey").alias("target")),
            self.table("nation").select(F.lit("part_of").alias("type"), key("N", "n_nationkey").alias("source"), key("R", "n_regionkey").alias("target")),
        ]
        return reduce(DataFrame.unionByName, [*place, self.customers()])

    def customers(self) -> DataFrame:
        bought = self.table("orders").select("o_orderkey", "o_custkey").join(self.table("lineitem").select("l_orderkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey"))
        return bought.select("o_custkey", "l_suppkey").distinct().select(F.lit("customer").alias("type"), key("C", "o_custkey").alias("source"), key("S", "l_suppkey").alias("target"))

    def attributes(self) -> DataFrame:
        """(node_id, name, value): the facts that hold without a window."""
        c = self.table("customer").select(key("C", "c_custkey").alias("node_id"), F.explode(F.create_map(F.lit("industry"), F.col("c_mktsegment"), F.lit("balance"), F.col("c_acctbal").cast("decimal(18,2)").cast("string"))).alias("name", "value"))
        p = self.table("part").select(key("P", "p_partkey").alias("node_id"), F.explode(F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("kind"), F.col("p_type"))).alias("name", "value"))
        return c.unionByName(p)

    def priorities(self) -> DataFrame:
        """(node_id, value, valid_from): a fact that changes; of several on one day the one of the largest order counts."""
        o = self.table("orders").groupBy("o_custkey", "o_orderdate").agg(F.max_by("o_orderpriority", "o_orderkey").alias("value"))
        return o.select(key("C", "o_custkey").alias("node_id"), "value", F.col("o_orderdate").alias("valid_from"))

    def interactions(self) -> DataFrame:
        return self.table("events").select(key("C", "user_id").alias("node_id"), F.col("ts").alias("at"), "event_type", "value", F.col("event_type").isin("purchase", "signup").alias("genuine"))

    def people(self) -> DataFrame:
        """Customers of four tenants, some of them deleted or of a satellite cluster."""
        c = self.table("customer")
        gone = F.when(F.col("c_acctbal") < 0, F.expr("timestamp_ntz'2024-01-01 00:00:00'"))
        layer = F.when(F.col("c_custkey") % 10 == 0, "satellite")
        return c.select(key("C", "c_custkey").alias("id"), F.concat(F.lit("U"), (F.col("c_custkey") % 4).cast("string")).alias("user_id"), F.lit("Person").alias("type"), F.col("c_name").alias("display_name"), gone.alias("deleted_at"), layer.alias("graph_layer"))

    def contacts(self) -> dict[str, DataFrame]:
        """The sources of contact, split from the events by type: touchpoints, meetings with two attendees, counters, the last
        contact of each person, and messages; and verdicts on the touchpoints."""
        e = self.tolerant(self.probe("events", "user_id long, ts timestamp_ntz, event_type string, value double"), "value", "double")
        of = lambda kind: e.where(F.col("event_type") == kind)
        who = key("C", "user_id").alias("node_id")
        return {
            "interactions": of("purchase").select(who, F.col("ts").alias("at")),
            "calendar_events": of("signup").select(F.array(key("C", "user_id"), F.concat(F.lit("C"), (F.col("user_id") + 1).cast("string"))).alias("attendees"), F.col("ts").alias("at")),
            "source_contact_stats": of("view").groupBy(who).agg(F.count("*").alias("volume"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at")),
            "relationship_status": of("error").groupBy(who).agg(F.max("ts").alias("at")),
            "imported_messages": of("click").select(who, F.col("ts").alias("at")),
            "keep_in_touch_verdicts": of("purchase").select(who, (F.col("value") >= 50).alias("genuine")),
        }

    def ledger(self) -> DataFrame:
        o = self.table("orders")
        return o.select(key("O", "o_orderkey").alias("id"), key("C", "o_custkey").alias("node_id"), F.lit("debt").alias("kind"), F.col("o_totalprice").alias("amount"), (F.col("o_orderstatus") != "O").alias("settled"), F.col("o_orderdate").alias("date"), F.when(F.col("o_orderpriority") == "1-URGENT", "owed_by_me").otherwise("owed_to_me").alias("direction"))

    def entries(self) -> DataFrame:
        """The ledger with every column that questions about it read."""
        none = lambda kind: F.lit(None).cast(kind)
        return self.ledger().select("id", "node_id", "kind", F.concat(F.lit("order "), F.col("id")).alias("description"), F.col("amount").cast("double").alias("amount"), F.lit("USD").alias("currency"), "direction", F.col("date").cast("string").alias("date"), "settled", none("timestamp_ntz").alias("deleted_at"))

    def queue(self) -> DataFrame:
        return self.table("conversations").select("conv_id", "turn", F.col("role").alias("kind"), F.col("text").alias("payload"))

    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.concat(F.lit("E"), F.col("vec_id").cast("string")).alias("id"), "vec_id", "embedding")


def meetings(calendar: DataFrame) -> DataFrame:
    """(node_id, at): each attendee of each meeting."""
    return calendar.select(F.explode("attendees").alias("node_id"), "at").where(F.col("node_id").isNotNull())


def dated(sources: dict[str, DataFrame]) -> DataFrame:
    """(node_id, at, kind): the contacts that sources put a date on, for signals."""
    kind = lambda df, name: df.select("node_id", "at", F.lit(name).alias("kind"))
    return kind(sources["relationship_status"], "status").unionByName(kind(sources["interactions"], "touch")).unionByName(kind(meetings(sources["calendar_events"]), "meeting"))


def touches(sources: dict[str, DataFrame]) -> DataFrame:
    """(node_id, at): every source of contact, for lanes of who was active when."""
    counters = sources["source_contact_stats"].select("node_id", F.col("last_at").alias("at"))
    rest = [sources[n].select("node_id", "at") for n in ("interactions", "relationship_status", "imported_messages")]
    return reduce(DataFrame.unionByName, [*rest, meetings(sources["calendar_events"]), counters]).where(F.col("node_id").isNotNull())


def recent(sources: dict[str, DataFrame]) -> DataFrame:
    """(node_id, at): the sources that seeds of nearness come from."""
    return sources["relationship_status"].select("node_id", "at").unionByName(sources["source_contact_stats"].select("node_id", F.col("last_at").alias("at")))


def adjacency(links: DataFrame) -> DataFrame:
    """(a, b, type): every link both ways."""
    return links.select(F.col("source").alias("a"), F.col("target").alias("b"), "type").unionByName(links.select(F.col("target").alias("a"), F.col("source").alias("b"), "type"))


def windows(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Facts with valid_until: each ends where the next of its keys begins (half-open)."""
    return facts.withColumn("valid_until", F.lead("valid_from").over(Window.partitionBy(*keys).orderBy("valid_from")))
