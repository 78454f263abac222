"""Ranked lanes and their fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import keep

CAP, SEEDS, RECENT_DAYS, K = 120, 25, 45, 60


def temporal(interactions: DataFrame, start: Column, end: Column, cap: int = CAP) -> DataFrame:
    """(node_id, n, latest): who was active in the half-open window, the most active first."""
    own = interactions.where((F.col("at") >= start) & (F.col("at") < end))
    return own.groupBy("node_id").agg(F.count("*").alias("n"), F.max("at").alias("latest")).orderBy(F.desc("n"), F.desc("latest"), "node_id").limit(cap)


def ranked(df: DataFrame, lane: str, *order: Column) -> DataFrame:
    """(lane, id, rank) of a bounded top list, ranks from 0."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1).select(F.lit(lane).alias("lane"), "id", "rank")


def fuse(content: list[DataFrame], boost: list[DataFrame] = (), k: int = K) -> DataFrame:
    """(id, score, lanes, appearance): reciprocal-rank sums. An id votes once a lane; boosting lanes add to ids that content
    lanes have. appearance orders ids by the first lane, and the place in it, that holds them: it breaks ties of score."""
    place = lambda i: (F.lit(i * 1_000_000_000) + F.col("rank")).cast("long")
    one = lambda df, i: df.groupBy("lane", "id").agg(F.min("rank").alias("rank")).withColumn("place", place(i))
    votes = reduce(DataFrame.unionByName, [one(df, i) for i, df in enumerate(content)])
    if boost:
        more = reduce(DataFrame.unionByName, [one(df, len(content) + i) for i, df in enumerate(boost)])
        votes = votes.unionByName(more.join(votes.select("id").distinct(), "id", "left_semi"))
    # votes are summed in order of lanes, so that equal votes give equal sums
    each = votes.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "lane", "rank"))).alias("v"))
    score = F.aggregate("v", F.lit(0.0), lambda s, x: s + 1 / (k + 1 + x["rank"]))
    lanes = F.array_join(F.array_sort(F.array_distinct(F.transform("v", lambda x: x["lane"]))), "+")
    return each.select("id", score.alias("score"), lanes.alias("lanes"), F.get("v", F.lit(0))["place"].alias("appearance"))


def proximity(interactions: DataFrame, links: DataFrame, now: Column, seeds: int = SEEDS, days: int = RECENT_DAYS, cap: int = CAP) -> DataFrame:
    """(id, hop, seed_rank): nodes within two links of whoever was met lately; the nearest hop and best seed count."""
    recent = interactions.where((F.col("at") >= now - F.expr(f"interval {days} days")) & (F.col("at") <= now))
    top = recent.groupBy("node_id").agg(F.max("at").alias("last")).orderBy(F.desc("last"), "node_id").limit(seeds)
    first = ranked(top.withColumnRenamed("node_id", "id"), "seed", F.desc("last"), F.col("id")).select("id", F.lit(0).alias("hop"), F.col("rank").alias("seed_rank"))
    found = keep(first)
    reached = found
    for hop in (1, 2):  # the frontier is one row per node: walks are never enumerated
        if found.count() >= cap:
            break  # nearer nodes come first, so farther ones can't be among the first `cap`
        step = _beside(reached, links).groupBy("id").agg(F.min("seed_rank").alias("seed_rank"))
        reached = keep(step.join(found.select("id"), "id", "left_anti").select("id", F.lit(hop).alias("hop"), "seed_rank"))
        found = found.unionByName(reached)
    return found.orderBy("hop", "seed_rank", "id").limit(cap)


def _beside(frontier: DataFrame, links: DataFrame) -> DataFrame:
    """(id, seed_rank) of the nodes linked to those of the frontier (id, seed_rank). Links are cut down to the frontier by
    semi-joins first, which reach the scans below whatever makes the links."""
    out = []
    for near, far in (("source", "target"), ("target", "source")):
        own = links.select(F.col(near).alias("near"), F.col(far).alias("far")).where("near != far")
        some = own.join(frontier.select(F.col("id").alias("near")), "near", "left_semi")
        out.append(some.join(frontier.select(F.col("id").alias("near"), "seed_rank"), "near").select(F.col("far").alias("id"), "seed_rank"))
    return out[0].unionByName(out[1])
