"""Who owes whom, and who gave what: entries of a ledger, written, settled, listed and asked about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import facts as V
from ..functions import text as T
from ..functions.intents import Intent

#: Fixed values.
KINDS = ["gift_given", "gift_received", "favor_owed", "favor_done", "debt"]
DIRECTIONS = ["owed_by_me", "owed_to_me", "none"]


def record(entries: DataFrame) -> DataFrame:
    """entries(id, node_id, kind, description, amount, currency, direction, date) as they are written, with `error`: null, or
    why an entry is refused. A currency needs an amount, unknown directions and dates are left out, nothing is settled yet."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    amount = F.when(~F.isnan(F.col("amount")) & (F.abs("amount") < float("inf")), F.col("amount"))
    error = F.when(text("node_id") == "", "A ledger entry needs a person (node_id).").when(~F.coalesce(F.col("kind").isin(KINDS), F.lit(False)), F.concat(F.lit("Unknown ledger kind '"), F.coalesce("kind", F.lit("")), F.lit("'."))).when(text("description") == "", "A ledger entry needs a description.")
    currency = F.when(amount.isNotNull() & (text("currency") != ""), F.substring(F.upper(text("currency")), 1, 8))
    return entries.select("id", text("node_id").alias("node_id"), "kind", text("description").alias("description"), amount.alias("amount"), currency.alias("currency"), F.when(F.col("direction").isin(DIRECTIONS), F.col("direction")).alias("direction"), V.normalize_date(F.col("date")).alias("date"), F.lit(False).alias("settled"), error.alias("error"))


def settle(ledger: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """The ledger with the entries of ids(id) settled at now."""
    mark = ids.select("id").distinct().withColumn("_s", F.lit(True))
    done = ledger.join(mark, "id", "left")
    at = F.col("settled_at") if "settled_at" in ledger.columns else F.lit(None).cast("timestamp_ntz")
    return done.withColumn("settled_at", F.when(F.col("_s"), now).otherwise(at)).withColumn("settled", F.col("_s").isNotNull() | F.col("settled")).drop("_s")


def listed(ledger: DataFrame, node_id: str, limit: int = 200) -> DataFrame:
    """A person's live entries, the newest first, settled ones among them."""
    return ledger.where((F.col("node_id") == node_id) & F.col("deleted_at").isNull()).orderBy(F.desc("created_at"), "id").limit(limit)


def recall(ledger: DataFrame, nodes: DataFrame, intent: Intent, limit: int) -> DataFrame:
    """(ord, id, display_name, type, reason): the people that answer a question about the ledger, an entry each: unsettled
    debts and favors of the direction asked for or of none, those with a price first; or gifts to or from the people named."""
    live = ledger.where(F.col("deleted_at").isNull())
    what = F.substring("description", 1, 60)
    if intent.kind in ("owed_to_me", "owed_by_me"):
        rows = live.where(F.col("kind").isin("debt", "favor_owed") & ~F.col("settled") & (F.col("direction").isNull() | (F.col("direction") == intent.kind)))
        who = "owes you" if intent.kind == "owed_to_me" else "you owe them"
        reason = F.concat(F.lit(who), F.coalesce(F.concat(F.lit(" "), T.money(F.col("amount"), F.col("currency"))), F.lit("")), F.lit(": "), what)
    else:
        rows = live.where(F.col("kind") == ("gift_given" if intent.kind == "given_to" else "gift_received"))
        who = "you gave: " if intent.kind == "given_to" else "they gave you: "
        reason = F.concat(F.lit(who), what, F.coalesce(F.concat(F.lit(" ("), F.col("date").cast("string"), F.lit(")")), F.lit("")))
    named = rows.select(F.col("id").alias("entry"), "node_id", F.col("amount").isNull().alias("bare"), reason.alias("reason"))
    found = named.join(nodes.select(F.col("id").alias("node_id"), "display_name", "type"), "node_id")
    if intent.names:
        found = found.where(T.any_word(F.col("display_name"), list(intent.names)))
    top = found.orderBy("bare", "entry").limit(limit)
    return top.select(F.struct("bare", "entry").alias("ord"), F.col("node_id").alias("id"), "display_name", F.coalesce("type", F.lit("Person")).alias("type"), "reason")


def promotable(details: DataFrame) -> DataFrame:
    """details(id, node_id, name, value, source_id) of favors and gifts as entries: origin_key, node_id, kind, description,
    direction, date, settled. Facts without a source are left out."""
    rows = details.where(F.col("name").isin("favor_owed", "gift_given", "gift_received") & F.col("source_id").isNotNull())
    favor, gift, is_favor = V.favor(F.col("value")), V.gift(F.col("value")), F.col("name") == "favor_owed"
    said = F.when(is_favor, favor["what"]).otherwise(gift["gift"])
    fallback = F.when(F.trim("value") != "", F.trim("value")).otherwise(F.when(is_favor, "favor").otherwise("gift"))
    return rows.select(F.col("id").alias("origin_key"), "node_id", F.col("name").alias("kind"), F.when(said != "", said).otherwise(fallback).alias("description"), F.when(is_favor, favor["direction"]).otherwise("none").alias("direction"), F.when(~is_favor, gift["date"]).alias("date"), F.when(is_favor, favor["settled"]).otherwise(True).alias("settled"))
