"""Strength-weighted connection paths: layers of relaxations, one row per node and layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import keep
from ..sources.graph import adjacency

ALIAS = "likely the same"


def bridges(nodes: DataFrame) -> DataFrame:
    """(a, b): nodes whose names are likely the same: equal, one the other's beginning (two tokens at least), or first name
    and initial. Whole names are joined to the beginnings of names, and names with an initial to names of two parts with
    that initial, so that a first name that many share makes no pairs by itself."""
    t = F.filter(F.split(F.lower(F.trim("display_name")), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    n = nodes.select("id", t.alias("t")).where(F.size("t") > 0)
    whole = n.select(F.col("id").alias("a"), F.array_join("t", " ").alias("key"), (F.size("t") > 1).alias("long"))
    starts = F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size("t"))), lambda k: F.array_join(F.slice("t", 1, k), " "))
    begins = n.select(F.col("id").alias("b"), F.explode(F.when(F.size("t") > 1, F.array_distinct(starts)).otherwise(F.array(F.array_join("t", " ")))).alias("key"))
    same = whole.join(begins, "key").select("a", "b")
    two = n.where(F.size("t") == 2).select("id", F.concat_ws(" ", F.get("t", F.lit(0)), F.substring(F.get("t", F.lit(1)), 1, 1)).alias("key"), (F.length(F.get("t", F.lit(1))) == 1).alias("initial"))
    short = two.where("initial").select(F.col("id").alias("a"), "key").join(two.select(F.col("id").alias("b"), "key"), "key").select("a", "b")
    both = same.unionByName(short).where("a != b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def weighted(links: DataFrame, strengths: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(a, b, label, step): every link both ways, with the cost of going to b. Links go before aliases, then the first label."""
    edges = adjacency(links).select("a", "b", F.struct(F.lit(0).alias("o"), F.coalesce("type", F.lit("linked")).alias("label")).alias("x"))
    if aliases is not None:
        two = aliases.select("a", "b").unionByName(aliases.select(F.col("b").alias("a"), F.col("a").alias("b")))
        edges = edges.unionByName(two.select("a", "b", F.struct(F.lit(1).alias("o"), F.lit(ALIAS).alias("label")).alias("x")))
    one = edges.groupBy("a", "b").agg(F.min("x").alias("x")).select("a", "b", "x.label")
    return one.join(strengths.select(F.col("node_id").alias("b"), "score"), "b", "left").select("a", "b", "label", step_cost(F.coalesce("score", F.lit(0.0))).alias("step"))


def cheapest(links: DataFrame, strengths: DataFrame, source: str, target: str, hops: int = 6, aliases: DataFrame | None = None) -> DataFrame:
    """(cost, hops, path, labels, used_alias): the cheapest way of at most `hops` links, a step to a node costing
    1 + 0.9 * (1 - its strength). Ties go to fewer hops, then to the path first in order. No row where there is no way; cost 0
    from a node to itself. aliases(a, b) are ways too.

    The edges and each layer are tables, so they are made once. A layer loses what can't become cheaper than the way that is
    known already, as every step costs 1 at least.
    """
    spark = links.sparkSession
    layer = spark.createDataFrame([(source, 0.0, [source], [])], "id string, cost double, path array<string>, labels array<string>")
    edges = keep(weighted(links, strengths, aliases))
    reached = layer.where(F.col("id") == target).withColumn("hops", F.lit(0))
    best = 0.0 if source == target else None
    for hop in range(1, hops + 1):
        open_ = layer.where((F.col("id") != target) & (F.lit(True) if best is None else F.col("cost") + 1 < best))
        walk = open_.join(edges, F.col("id") == F.col("a"))
        to = F.struct(F.round(F.col("cost") + F.col("step"), 9).alias("cost"), F.concat("path", F.array("b")).alias("path"), F.concat("labels", F.array("label")).alias("labels"))
        layer = keep(walk.groupBy("b").agg(F.min(to).alias("x")).select(F.col("b").alias("id"), "x.cost", "x.path", "x.labels"))
        found = layer.where(F.col("id") == target)
        cost = found.select("cost").first()  # one row at most
        if cost:
            best = cost[0] if best is None else min(best, cost[0])
            reached = reached.unionByName(found.withColumn("hops", F.lit(hop)))
        if layer.isEmpty():
            break
    top = reached.orderBy("cost", "hops", "path").limit(1)
    return top.select("cost", "hops", F.array_join("path", ">").alias("path"), F.array_join("labels", ">").alias("labels"), F.array_contains("labels", ALIAS).alias("used_alias"))


def step_cost(score: Column) -> Column:
    return 1 + 0.9 * (1 - score)
