"""How strong a tie is, and which have gone quiet: one grouped pass over interactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def signal(interactions: DataFrame, now: Column) -> DataFrame:
    """Per node: events up to now, first, last, those of the last year, the months they fall in, and genuine contacts."""
    year_ago = now - F.expr("interval 365 days")
    late = F.col("at") >= year_ago
    return interactions.where(F.col("at") <= now).groupBy("node_id").agg(
        F.count("*").alias("events"),
        F.min("at").alias("first_at"),
        F.max("at").alias("last_at"),
        F.count_if(late).alias("events_last_year"),
        F.count_distinct(F.when(late, F.year("at") * 12 + F.month("at"))).alias("active_months"),
        F.count_if(F.col("genuine")).alias("genuine_contacts"),
        F.sum("value").alias("volume_value"),
    )


def gather(events: DataFrame, stats: DataFrame | None, verdicts: DataFrame | None, now: Column) -> DataFrame:
    """The signal of each node from events(node_id, at, kind), counters stats(node_id, volume, first_at, last_at) and
    verdicts(node_id, genuine). kind: "status" tells no first contact, "meeting" counts once it has begun; contacts that lie
    ahead still move the last one. Columns as of signal, with volume and judged_contacts."""
    year_ago = now - F.expr("interval 365 days")
    e = events.where((F.col("kind") != "meeting") | (F.col("at") <= now))
    past = F.col("at") <= now
    late = past & (F.col("at") >= year_ago)
    dated = e.groupBy("node_id").agg(
        F.count_if(past).alias("events"),
        F.min(F.when(past | (F.col("kind") != "status"), F.col("at"))).alias("first_at"),
        F.max("at").alias("last_at"),
        F.count_if(late).alias("events_last_year"),
        F.count_distinct(F.when(late, F.year("at") * 12 + F.month("at"))).alias("active_months"),
    )
    if stats is not None:
        c = stats.groupBy("node_id").agg(F.sum(F.greatest(F.lit(0), F.col("volume"))).alias("volume"), F.min("first_at").alias("f"), F.max("last_at").alias("l"))
        dated = dated.join(c, "node_id", "full").withColumn("first_at", F.least("first_at", "f")).withColumn("last_at", F.greatest("last_at", "l")).drop("f", "l")
    else:
        dated = dated.withColumn("volume", F.lit(0).cast("long"))
    if verdicts is not None:
        v = verdicts.groupBy("node_id").agg(F.count("*").alias("judged_contacts"), F.count_if("genuine").alias("genuine_contacts"))
        dated = dated.join(v, "node_id", "full")
    else:
        dated = dated.withColumn("judged_contacts", F.lit(0).cast("long")).withColumn("genuine_contacts", F.lit(0).cast("long"))
    return dated.fillna(0, ["events", "events_last_year", "active_months", "volume", "judged_contacts", "genuine_contacts"])


def days_between(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 86_400_000_000)


def strength(signals: DataFrame, now: Column) -> DataFrame:
    """Recency (half-life 60 days), frequency (log scale, 52 a year saturate) and consistency (months of twelve), blended
    .45/.35/.20 and scaled by how much of the judged contact was genuine. Without events in the last year a counter over its
    span gives the rate; without any event, half the share of a year that the counter spans gives the consistency."""
    cols = signals.columns
    volume = F.col("volume") if "volume" in cols else F.lit(0).cast("long")
    judged = F.col("judged_contacts") if "judged_contacts" in cols else F.col("events")
    first, last = F.col("first_at"), F.col("last_at")
    span = days_between(first, last)
    known = first.isNotNull() & last.isNotNull()
    rate = F.when((F.col("events_last_year") == 0) & (volume > 0) & known, F.least(volume.cast("double"), volume * 365 / F.greatest(F.lit(1.0), span))).otherwise(F.col("events_last_year").cast("double"))
    recency = F.coalesce(F.pow(F.lit(2.0), -days_between(last, now) / 60), F.lit(0.0))
    frequency = F.least(F.lit(1.0), F.log1p(rate) / F.log1p(F.lit(52.0)))
    spanned = F.when((volume > 1) & known & (last > first), F.least(F.lit(1.0), span / 365) * 0.5).otherwise(0.0)
    consistency = F.when(F.col("events") > 0, F.least(F.lit(1.0), F.col("active_months") / 12)).otherwise(spanned)
    genuine = F.when(judged > 0, F.least(F.lit(1.0), F.col("genuine_contacts") / judged))
    factor = F.coalesce(0.4 + 0.6 * genuine, F.lit(1.0))
    score = (0.45 * recency + 0.35 * frequency + 0.2 * consistency) * factor
    r = lambda c, n: F.round(c, 4).alias(n)
    return signals.select("node_id", r(score, "score"), r(recency, "recency"), r(frequency, "frequency"), r(consistency, "consistency"), r(genuine, "genuine_ratio"), "last_at", (volume + F.col("events")).alias("past_volume"))


def strengths_for(ids: DataFrame, strengths: DataFrame) -> DataFrame:
    """A row for every id asked for; those without any signal score 0."""
    return ids.select("node_id").distinct().join(strengths, "node_id", "left").fillna(0.0, ["score", "recency", "frequency", "consistency"]).fillna(0, ["past_volume"])


def dormancy(strengths: DataFrame, now: Column) -> DataFrame:
    silence = days_between(F.col("last_at"), now)
    share = F.least(F.lit(1.0), (silence - 60) / (365 - 60))
    volume = F.least(F.lit(1.0), F.log1p(F.col("past_volume").cast("double")) / F.log1p(F.lit(500.0)))
    quiet = (F.col("past_volume") >= 12) & F.col("last_at").isNotNull() & (silence >= 60)
    return strengths.select("node_id", F.when(quiet, F.round(volume * (0.25 + 0.75 * share), 4)).otherwise(F.lit(0.0)).alias("dormancy"))
