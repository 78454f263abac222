"""Answers that follow edges and typed facts: sections of one plan, in order of precedence, each person once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import facts as V
from ..functions import intents as I
from ..functions import text as T
from . import ledger as L
from .recall import attribute_search


@dataclass
class Store:
    """One user's live graph: nodes(id, type, display_name), links(type, source, target), details(node_id, name, value),
    ledger, and the id of the user's own node."""

    nodes: DataFrame
    links: DataFrame
    details: DataFrame
    ledger: DataFrame
    self_id: str | None = None

    @classmethod
    def of(cls, user: str, nodes: DataFrame, links: DataFrame, details: DataFrame, ledger: DataFrame, self_id: str | None = None) -> Store:
        """The live rows of one tenant; a user is required, so that no read goes unscoped."""
        return cls(*[scoped(df, user) for df in (nodes, links, details, ledger)], self_id)


def scoped(df: DataFrame, user: str | None, signed_in: str | None = None) -> DataFrame:
    """The live rows of a tenant: of whoever is signed in, else of the user named."""
    own = signed_in or user
    if not own:
        raise ValueError("a user is required")
    out = df.where(F.col("user_id") == own) if "user_id" in df.columns else df
    return out.where(F.col("deleted_at").isNull()) if "deleted_at" in df.columns else out


def _hit(df: DataFrame, section: int, order: list[Column], reason: Column) -> DataFrame:
    place = F.concat_ws("\t", *[o.cast("string") for o in order])
    return df.select(F.lit(section).alias("section"), place.alias("place"), "id", "display_name", F.coalesce("type", F.lit("Node")).alias("type"), reason.alias("reason"))


def neighbours(s: Store, ids: DataFrame) -> DataFrame:
    """(of, id, display_name, type, link): the other ends of the links of ids(of), whichever way they go."""
    out = [s.links.join(ids, F.col(a) == F.col("of")).select("of", F.col("type").alias("link"), F.col(b).alias("id")) for a, b in (("source", "target"), ("target", "source"))]
    return out[0].unionByName(out[1]).distinct().join(s.nodes.select("id", "display_name", "type"), "id")


def life_hits(s: Store, intent: I.Intent, today: str) -> DataFrame:
    name = {"favors": "favor_owed", "gifts": "gift_idea", "life_events": "life_event"}[intent.kind]
    rows = s.details.where(F.col("name") == name).select(F.col("node_id").alias("id"), "value").join(s.nodes.select("id", "display_name", "type"), "id")
    if intent.kind == "favors":
        f = V.favor(F.col("value"))
        rows = rows.withColumn("f", f).where(~F.col("f.settled"))
        if intent.direction:
            rows = rows.where(F.col("f.direction").isNull() | (F.col("f.direction") == intent.direction))
        who = F.when(F.col("f.direction") == "owed_by_me", "you owe them: ").when(F.col("f.direction") == "owed_to_me", "they owe you: ").otherwise("open favor: ")
        return _hit(rows, 1, [F.col("id"), F.col("value")], F.concat(who, F.substring("f.what", 1, 60)))
    if intent.kind == "gifts":
        if intent.names:
            rows = rows.where(T.any_word(F.col("display_name"), list(intent.names)))
        return _hit(rows, 1, [F.col("id"), F.col("value")], F.concat(F.lit("gift idea: "), F.substring(V.gift(F.col("value"))["gift"], 1, 60)))
    rows = rows.withColumn("e", V.life_event(F.col("value")))
    if intent.upcoming:
        rows = rows.where(F.col("e.date") >= today)
    e = F.col("e")
    typed = e["category"].isNotNull() & e["type"].isNotNull()
    label = F.when(typed, F.concat_ws("/", e["category"], e["type"])).otherwise(F.substring(F.trim("value"), 1, 40))
    when = F.coalesce(F.concat(F.lit(" on "), e["date"]), F.lit(""))
    note = F.when(e["note"].isNotNull() & e["category"].isNotNull(), F.concat(F.lit(": "), F.substring(e["note"], 1, 40))).otherwise("")
    days = F.datediff(e["date"].cast("date"), F.lit("2000-01-01").cast("date"))
    when_asked = F.lpad((F.lit(5_000_000) + (days if intent.upcoming else -days)).cast("string"), 8, "0")
    return _hit(rows, 1, [F.coalesce(when_asked, F.lit("9")), F.col("id"), F.col("value")], F.concat(F.lit("life event "), label, when, note))


def industry_hits(s: Store, industry: str) -> DataFrame:
    """People whose employer is of the industry, with their title there."""
    orgs = s.details.where((F.col("name") == "industry") & (F.lower(F.trim("value")) == industry)).select(F.col("node_id").alias("of")).distinct()
    named = orgs.join(s.nodes.where("type != 'Person'").select(F.col("id").alias("of"), F.col("display_name").alias("org")), "of")
    people = neighbours(s, named.select("of")).where("type = 'Person'").join(named, "of")
    people = people.where(F.col("id") != s.self_id) if s.self_id else people
    title = s.details.where("name = 'title'").groupBy(F.col("node_id").alias("id")).agg(F.min("value").alias("title"))
    rows = people.join(title, "id", "left")
    said = F.concat(F.coalesce(F.concat("title", F.lit(" at ")), F.lit("works at ")), F.col("org"), F.lit(f" ({industry})"))
    return _hit(rows, 2, [F.col("id"), F.col("org")], said)


def self_hits(s: Store, relations: list[str]) -> DataFrame:
    """The nodes linked to the user by one of the relations; of relations between people, people only."""
    own = s.nodes.where(F.col("id") == s.self_id).select(F.col("id").alias("of"))
    rows = neighbours(s, own).where(F.col("link").isin(relations) & (~F.col("link").isin(I.PERSON_RELATIONS) | (F.col("type") == "Person")))
    return _hit(rows, 3, [F.col("id"), F.col("link")], F.concat(F.lit("directly linked to you: "), F.replace("link", F.lit("_"), F.lit(" "))))


def member_hits(s: Store, names: list[str], relations: list[str]) -> DataFrame:
    """People linked to the organisations of those names, three of a name at most."""
    named = [s.nodes.where((F.col("type") != "Person") & (F.lower(F.trim("display_name")) == n.lower())).orderBy("id").limit(3).select(F.lit(i).alias("i"), F.col("id").alias("of"), F.col("display_name").alias("org")) for i, n in enumerate(names)]
    orgs = reduce(DataFrame.unionByName, named)
    rows = neighbours(s, orgs.select("of").distinct()).where("type = 'Person'").join(orgs, "of")
    if relations:
        rows = rows.where(F.col("link").isin(relations))
    return _hit(rows, 4, [F.col("i"), F.col("of"), F.col("id"), F.col("link")], F.concat(F.replace("link", F.lit("_"), F.lit(" ")), F.lit(" of "), F.col("org")))


def attribute_hits(s: Store, names: list[str], keys: list[str]) -> DataFrame:
    """People with an attribute of one of the names, by the whole value or, where nobody has that, by a part of it."""
    people = s.nodes.where("type = 'Person'")
    facts = s.details.join(people.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    out = []
    for i, n in enumerate(names):
        both = attribute_search(facts, keys, n, True).withColumn("tier", F.lit(0)).unionByName(attribute_search(facts, keys, n, False).withColumn("tier", F.lit(1)))
        best = both.agg(F.min("tier").alias("best"))
        out.append(both.join(F.broadcast(best), F.col("tier") == F.col("best")).withColumn("i", F.lit(i)))  # best: one row
    rows = reduce(DataFrame.unionByName, out).withColumnRenamed("node_id", "id").join(people, "id")
    said = F.concat(F.replace("name", F.lit("_"), F.lit(" ")), F.lit(" is "), F.substring("value", 1, 40))
    return _hit(rows, 5, [F.col("i"), F.col("id")], said)


SCHEMA = "section int, place string, id string, display_name string, type string, reason string"


def structured_recall(s: Store, query: str, limit: int, today: str) -> DataFrame:
    """(rank, id, display_name, type, reason), `limit` at most: what the question asks of edges and typed facts; no rows where
    it asks nothing of the kind. The ledger comes first, and alone for gifts; then life facts, which answer alone; then
    people of an industry, the user's own relations, members of organisations, and attributes."""
    spark = s.nodes.sparkSession
    relations, mine, people = I.relations(query), I.is_self(query), I.seeks_people(query)
    life, owed, industry = I.life_intent(query), I.ledger_intent(query), I.industry(query)
    parts: list[DataFrame] = []
    gifts_given = owed is not None and owed.kind in ("given_to", "received_from")
    if owed:
        hits = L.recall(s.ledger, s.nodes, owed, limit)
        place = F.concat_ws("\t", *[F.col(f"ord.{c}").cast("string") for c in ("bare", "entry")])
        parts.append(hits.select(F.lit(0).alias("section"), place.alias("place"), "id", "display_name", "type", "reason"))
    if life and not gifts_given:
        parts.append(life_hits(s, life, today))
    if not life and not gifts_given:
        if industry:
            parts.append(industry_hits(s, industry))
        if mine and relations and s.self_id:
            parts.append(self_hits(s, relations))
        names = I.entity_candidates(query)
        if people and names and (relations or mine or industry or owed):
            parts.append(member_hits(s, names, relations))
            keys = [k for r in relations or ["employee"] for k in I.ATTRIBUTES.get(r, [])]
            keys += ["location"] if I.speaks_of_place(query) else []
            if keys:
                parts.append(attribute_hits(s, names, list(dict.fromkeys(keys))))
    if not parts:
        return spark.createDataFrame([], "rank int, id string, display_name string, type string, reason string")
    every = reduce(DataFrame.unionByName, parts)
    if not gifts_given:  # there an entry each; else each person once, by the first reason
        first = every.groupBy("id").agg(F.min_by(F.struct("section", "place", "display_name", "type", "reason"), F.struct("section", "place")).alias("x"))
        every = first.select("x.section", "x.place", "id", "x.display_name", "x.type", "x.reason")
    top = every.orderBy("section", "place", "id").limit(limit)
    return top.withColumn("rank", (F.row_number().over(Window.orderBy("section", "place", "id")) - 1).cast("int")).select("rank", "id", "display_name", "type", "reason")
