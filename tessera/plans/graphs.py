"""Queries over the fixture graph: recall, expansion and batches of proposals, with the rows that the rules ask for."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import apply, dedupe, govern, ledger, paths, recall, resolve, structured
from .cases import _sql
from .catalog import QUERIES, SQL
from .fixture import NOW, frames, store

TODAY = "2024-01-31"


def expect(names: str, rows: list[tuple]):
    """Registers a query whose rows are these."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark)
        SQL[f.__name__] = _sql(rows, names.split())
        return f

    return add


def _asked(spark: SparkSession, questions: list[str], ask) -> DataFrame:
    out = None
    for q in questions:
        one = ask(q).withColumn("question", F.lit(q))
        out = one if out is None else out.unionByName(one)
    return out


@expect("question rank id reason", [
    ("gift ideas for ava", 0, "n02", "gift idea: an atlas"), ("milestones", 0, "n02", "life event family/married on 2024-05-01: in Lyon"),
    ("milestones", 1, "n03", "life event work/new_job on 2023-03-01"), ("milestones", 2, "n04", "life event retired early"),
    ("my cofounder", 0, "n02", "directly linked to you: co founder"), ("people who work at Meta", 0, "n03", "employee of Meta"),
    ("people who work at Meta", 1, "n08", "company is Meta"), ("upcoming life events", 0, "n02", "life event family/married on 2024-05-01: in Lyon"),
    ("what did I give Eva", 0, "n08", "you gave: a book"), ("what do I owe", 0, "n02", "you owe them $50: tickets"),
    ("what do I owe", 1, "n04", "you owe them: moved a sofa"), ("what do I owe", 2, "n03", "you owe them: lunch"),
    ("who do I know in VC", 0, "n04", "Partner at Rednote Venture (venture capital)"), ("who owes me money", 0, "n03", "owes you 12.50 EUR: rent"),
    ("who owes me money", 1, "n04", "owes you: moved a sofa"),
])
def structured_answers(spark: SparkSession) -> DataFrame:
    s = store(spark)
    qs = ["my cofounder", "my colleague", "people who work at Meta", "who do I know in VC", "who owes me money", "what do I owe", "what did I give Eva", "gift ideas for ava", "upcoming life events", "milestones", "who lives in Porto", "the weather"]
    return _asked(spark, qs, lambda q: structured.structured_recall(s, q, 8, TODAY).select("rank", "id", "reason")).select("question", "rank", "id", "reason")


@expect("question rank id similarity reason mode degraded", [
    ("hybrid: Lind", 0, "n04", 0.0, None, "hybrid+proximity", False), ("hybrid: Lind", 1, "n03", -0.8, None, "hybrid+proximity", False),
    ("hybrid: Lind", 2, "n08", 0.0, None, "hybrid+proximity", False), ("hybrid: blind Lind", 0, "n08", 0.0, None, "keyword", True),
    ("hybrid: last 2 weeks", 0, "n03", 0.0, 'interaction in the window "last 2 weeks"', "keyword+temporal+proximity", False),
    ("hybrid: last 2 weeks", 1, "n08", 0.0, 'interaction in the window "last 2 weeks"', "keyword+temporal+proximity", False),
    ("hybrid: my cofounder strong", 0, "n02", 1.0, "directly linked to you: co founder", "hybrid+proximity", False),
    ("hybrid: my cofounder strong", 1, "n03", 0.8557, None, "hybrid+proximity", False),
    ("hybrid: my cofounder strong", 2, "n04", 0.0995, None, "hybrid+proximity", False),
    ("hybrid: strong words", 0, "n03", 0.8557, None, "hybrid+proximity", False),
    ("hybrid: strong words", 1, "n04", 0.0995, None, "hybrid+proximity", False),
    ("hybrid: strong words", 2, "n02", 0.995, None, "hybrid+proximity", False), ("keyword: Meta", 0, "n06", 0.0, None, "keyword", False),
    ("keyword: Meta", 1, "n08", 0.0, None, "keyword", False), ("keyword: Meta", 2, "n14", 0.0, None, "keyword", False),
    ("semantic: partner", 0, "n04", 1.0, None, "semantic", False), ("semantic: partner", 1, "n03", 0.6, None, "semantic", False),
    ("semantic: partner", 2, "n02", 0.0, None, "semantic", False),
])
def recall_modes(spark: SparkSession) -> DataFrame:
    s, f = store(spark), frames(spark)
    touches = spark.createDataFrame([("n03", "2024-01-20 10:00:00"), ("n05", "2024-01-20 10:00:00"), ("n08", "2024-01-21 10:00:00"), ("n08", "2024-01-22 10:00:00")], "node_id string, at string").select("node_id", F.col("at").cast("timestamp_ntz").alias("at"))
    near = spark.createDataFrame([("n03", 0, 0), ("n04", 1, 0)], "id string, hop int, seed_rank int")
    embed = lambda q: None if "blind" in q else [0.0, 1.0] if "partner" in q else [1.0, 0.1] if "strong" in q else [-1.0, 0.0]
    asked = [("hybrid", "strong words"), ("hybrid", "Lind"), ("hybrid", "blind Lind"), ("semantic", "partner"), ("keyword", "Meta"), ("hybrid", "last 2 weeks"), ("hybrid", "  "), ("hybrid", "my cofounder strong")]
    out = None
    for mode, q in asked:
        one = recall.recall_nodes(s, q, 3, mode, vectors=f["vectors"], embed=embed, touches=touches, near=near, now=NOW)
        one = one.select(F.lit(f"{mode}: {q}").alias("question"), "rank", "id", F.round("similarity", 4).alias("similarity"), "reason", "mode", "degraded")
        out = one if out is None else out.unionByName(one)
    return out


def _expanded(spark: SparkSession, as_of: str | None) -> DataFrame:
    f = frames(spark)
    own = [f[n].where("user_id = 'u1'") for n in ("nodes", "details", "links")]
    facts = spark.createDataFrame([("l7", "since", "2020", None, None)], "link_id string, name string, value string, valid_from timestamp_ntz, valid_until timestamp_ntz")
    facts = facts.withColumn("created_at", F.lit(None).cast("timestamp_ntz")).withColumn("deleted_at", F.lit(None).cast("timestamp_ntz"))
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    x = recall.expand_node("n02", *own, facts, at("2024-01-31"), at(as_of) if as_of else None)
    text = lambda df, part, *cols: df.select(F.lit(part).alias("part"), F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in cols]).alias("row"))
    out = text(x["node"], "node", "id", "display_name", "type").unionByName(text(x["details"], "detail", "name", "value", "source", "confirmed"))
    out = out.unionByName(text(x["links"], "link", "direction", "type", "other_name", "link_details", "omitted"))
    return out.unionByName(text(x["history"], "history", "name", "value", "from", "from_known", "until")).unionByName(text(x["ended"], "ended", "ended_values"))


@expect("part row", [
    ("detail", "gift_idea|birthday | an atlas|Notes|true"), ("detail", "life_event|family/married | 2024-05-01 | in Lyon|Notes|true"),
    ("detail", "location|Porto, Portugal|Notes|true"), ("detail", "title|CEO|Chat|true"), ("ended", "2"),
    ("history", "title|CTO|2020-01-01 00:00:00|true|2023-06-01 00:00:00"), ("history", "title|Intern|2019-01-01 00:00:00|false|2020-01-01 00:00:00"),
    ("link", "in|co_founder|Self Same||0"), ("link", "out|lives_in|Porto|since=2020|0"), ("node", "n02|Ava Yu|Person"),
])
def expand_node_now(spark: SparkSession) -> DataFrame:
    return _expanded(spark, None)


@expect("part row", [
    ("detail", "gift_idea|birthday | an atlas|Notes|true"), ("detail", "life_event|family/married | 2024-05-01 | in Lyon|Notes|true"),
    ("detail", "location|Porto, Portugal|Notes|true"), ("detail", "title|CTO|Chat|true"), ("ended", "2"),
    ("history", "title|Intern|2019-01-01 00:00:00|false|2020-01-01 00:00:00"), ("link", "in|co_founder|Self Same||0"),
    ("link", "out|lives_in|Porto|since=2020|0"), ("node", "n02|Ava Yu|Person"),
])
def expand_node_as_of(spark: SparkSession) -> DataFrame:
    return _expanded(spark, "2021-01-01")


@expect("cost hops path labels used_alias", [
    (7.15, 4, "a>b>c>d>e", "friend>likely the same>friend>linked", True),
])
def path_over_aliases(spark: SparkSession) -> DataFrame:
    links = spark.createDataFrame([("friend", "a", "b"), ("friend", "c", "d"), (None, "d", "e")], "type string, source string, target string")
    nodes = spark.createDataFrame([("a", "Ann"), ("b", "1435 Capital"), ("c", "1435 Capital Management"), ("d", "Dan"), ("e", "Eve")], "id string, display_name string")
    warm = spark.createDataFrame([("d", 0.5)], "node_id string, score double")
    return paths.cheapest(links, warm, "a", "e", aliases=paths.bridges(nodes)).withColumn("cost", F.round("cost", 4))


@expect("ord node_id way", [
    (1, "n02", "id"), (10, None, None), (11, None, None), (12, None, None), (2, None, None), (3, "new:1", "batch"), (4, "new:1", "batch"),
    (5, "n01", "self"), (6, "n02", "name"), (7, "n03", "alias"), (8, "n13", "normalised"), (9, "n11", "name"),
])
def references_resolved(spark: SparkSession) -> DataFrame:
    f, s = frames(spark), store(spark)
    refs = [(1, "n02", None), (2, "n05", None), (3, "", "New Corp"), (4, None, "the new corp, inc."), (5, None, "Self"), (6, None, "ava yu"), (7, None, "Benjamin"), (8, None, "Keystone School"), (9, None, "John Doe"), (10, None, "Jay"), (11, None, "nobody"), (12, None, " ")]
    batch = spark.createDataFrame([("New Corp", "new:1")], "display_name string, id string")
    return resolve.references(spark.createDataFrame(refs, "ord long, id string, display_name string"), batch, s.nodes, f["aliases"], "n01")


@expect("ord outcome node_id", [
    (1, "reused", "n02"), (2, "created", "new:2"), (3, "same", "new:2"), (4, "failed", None), (5, "failed", None), (6, "reused", "n13"),
    (7, "reused", "n14"), (8, "reused", "n03"), (9, "reused", "n11"),
])
def create_nodes_applied(spark: SparkSession) -> DataFrame:
    f, s = frames(spark), store(spark)
    rows = [(1, "Person", "Ava  Yu"), (2, "person", "New Face"), (3, "Person", "new face."), (4, "Robot", "R2"), (5, "Person", " "), (6, "Organization", "Keystone School, Inc."), (7, "Person", "Katherine Mosss"), (8, "Person", "Benjamin"), (9, None, "John Doe")]
    types = spark.createDataFrame([("Person",), ("Organization",)], "name string")
    made = apply.create_nodes(spark.createDataFrame(rows, "ord long, type string, display_name string"), types, s.nodes, f["aliases"])
    return made.select("ord", "outcome", "node_id")


@expect("ord type source target outcome", [
    (1, "co_founder", "n01", "n02", "reused"), (2, "spoke_at", "n03", "n06", "created"), (3, "spoke_at", "n03", "n06", "same"),
    (4, "friend", None, "n02", "failed"), (5, "", "n01", "n03", "failed"), (6, "friend", "n01", "n03", "created"),
])
def create_links_applied(spark: SparkSession) -> DataFrame:
    s = store(spark)
    rows = [(1, "co_founder", "n01", "n02"), (2, "Spoke At!", "n03", "n06"), (3, "spoke at", "n03", "n06"), (4, "friend", None, "n02"), (5, "", "n01", "n03"), (6, "friend", "n01", "n03")]
    p = spark.createDataFrame(rows, "ord long, link_type string, source string, target string")
    types = spark.createDataFrame([("co_founder",), ("friend",)], "name string")
    return apply.create_links(p.select("ord", "link_type"), s.links, p.select("ord", "source", "target"), types)[0]


@expect("ord name value outcome into", [
    ("1", "location", "Porto, Portugal", "insert", None), ("10", "email", "n@f", "insert", None), ("11", "", "q", "failed", None),
    ("2", "location", "portugal", "skipped", "+1"), ("4", "bio", "Likes tea. Sails.", "merged", "2"), ("5", "education_entry", "BS, MIT", "insert", None),
    ("6", "education_entry", '{"school":"MIT","degree":"bs"}', "skipped", "+5"), ("7", "email", "A@B.C", "skipped", "4"),
    ("8", "email", "x@y.z", "insert", None), ("9", "email", "q", "failed", None), ("-", "education_entry", "MIT", "retired", "+5"),
    ("-", "location", "Portugal", "retired", "+1"),
])
def add_details_applied(spark: SparkSession) -> DataFrame:
    s = store(spark)
    held = [("1", "n02", "location", "Portugal", "a"), ("2", "n02", "bio", "Likes tea.", "a"), ("3", "n02", "education_entry", "MIT", "a"), ("4", "n02", "email", "a@b.c", "a"), ("5", "n02", "bio", "Older.", "0")]
    rows = [(1, "n02", "location", "Porto, Portugal"), (2, "n02", "location", "portugal"), (3, "n02", "bio", "Sails."), (4, "n02", "bio", "likes tea."), (5, "n02", "education_entry", "BS, MIT"), (6, "n02", "education_entry", '{"school":"MIT","degree":"bs"}'), (7, "n02", "email", "A@B.C "), (8, "n02", "email", "x@y.z"), (9, "n05", "email", "q"), (10, "new face", "email", "n@f"), (11, "n02", "", "q")]
    details = spark.createDataFrame(held, "id string, node_id string, name string, value string, updated_at string")
    p = spark.createDataFrame([(*r, "src") for r in rows], "ord long, node_id string, detail_name string, value string, source_id string")
    batch, definitions = spark.createDataFrame([("New Face", "new:2")], "display_name string, id string"), spark.createDataFrame([("bio", "append"), ("email", "multi")], "name string, merge_strategy string")
    done = apply.add_details(p, details, s.nodes, batch, definitions)
    return done.select(F.coalesce(F.col("ord").cast("string"), F.lit("-")).alias("ord"), "name", "value", "outcome", "into")


@expect("id action into confirm", [
    ("1", "tombstone", "3", False), ("2", "tombstone", "3", False), ("3", "keep", None, True), ("4", "keep", None, False), ("5", "keep", None, False),
    ("6", "keep", None, True), ("7", "tombstone", "6", False), ("8", "tombstone", "9", False), ("9", "keep", None, False),
])
def collapsed_details(spark: SparkSession) -> DataFrame:
    rows = [("1", "a", "education_entry", "MIT", "1", True), ("2", "a", "education_entry", "BS, MIT", "2", False), ("3", "a", "education_entry", '{"school":"mit","degree":"BS"}', "3", False), ("4", "a", "education_entry", "MS, MIT", "4", False), ("5", "b", "education_entry", "MIT", "5", False), ("6", "a", "past_role", "CTO at Elm (2019)", "6", False), ("7", "a", "past_role", "Elm", "7", True), ("8", "a", "honor", "Prize", "8", False), ("9", "a", "honor", "prize", "0", True)]
    return dedupe.collapse(spark.createDataFrame(rows, "id string, owner string, name string, value string, created_at string, confirmed boolean"))


@expect("owner name value valid_from valid_until", [
    ("m", "role", "x", None, "2023-01-01 00:00:00"), ("m", "role", "y", None, None), ("n", "city", "Porto", None, None),
    ("n", "lang", "en", "2024-01-31 00:00:00", None), ("n", "lang", "en", None, "2024-01-31 00:00:00"),
    ("n", "lang", "pt", None, "2024-01-31 00:00:00"), ("n", "title", "CEO", "2024-01-31 00:00:00", None),
    ("n", "title", "CTO", None, "2024-01-31 00:00:00"), ("q", "city", "Rome", None, None),
])
def edits_applied(spark: SparkSession) -> DataFrame:
    rows = [("n", "title", "CTO"), ("n", "city", "Porto"), ("n", "lang", "en"), ("n", "lang", "pt"), ("m", "role", "x"), ("m", "role", "y")]
    none = F.lit(None).cast("timestamp_ntz")
    before = spark.createDataFrame(rows, "owner string, name string, value string").select("*", none.alias("valid_from"), none.alias("valid_until"), none.alias("deleted_at"))
    changes = spark.createDataFrame([("n", "title", "VP", 1), ("n", "title", "CEO", 2), ("n", "city", "porto ", 3), ("n", "lang", "en", 4), ("q", "city", "Rome", 5)], "owner string, name string, next string, ord int")
    at = F.lit("2024-01-31").cast("timestamp_ntz")
    ends = spark.createDataFrame([("m", "role", " X ", "2023-01-01"), ("m", "none", "", None)], "owner string, name string, previous string, e string").select("owner", "name", "previous", F.col("e").cast("timestamp_ntz").alias("ended_at"))
    after = govern.end_details(govern.supersede(before, changes, at), ends, at)
    return after.select("owner", "name", "value", F.col("valid_from").cast("string").alias("valid_from"), F.col("valid_until").cast("string").alias("valid_until"))


@expect("ord committer target outcome", [
    (1, "n01", "n02", "same"), (2, "n01", "n03", "created"), (3, None, "n01", "same"), (4, "n01", "n04", "created"), (5, "n01", "n04", "created"),
    (6, "n01", "n02", "failed"), (7, "n01", "n02", "failed"), (8, "n01", "n02", "failed"), (9, "n04", "n01", "created"),
])
def promises_applied(spark: SparkSession) -> DataFrame:
    held = spark.createDataFrame([("p1", "n01", "n02", "send the report on Monday", "open"), ("p2", "n01", "n03", "send the report", "done"), ("p3", None, "n01", "call back", "expired")], "id string, committer string, target string, description string, status string")
    rows = [(1, "user_to_other", "Send report, Monday!", "n02", "s"), (2, "user_to_other", "send the report", "n03", "s"), (3, "other_to_user", "Call back.", None, "s"), (4, "mutual", "plan the summer trip", "n04", "s"), (5, "mutual", "plan summer trip north", "n04", "s"), (6, "sideways", "x", "n02", "s"), (7, "mutual", " ", "n02", "s"), (8, "mutual", "x", "n02", None), (9, "other_to_user", "plan the summer trip", "n04", "s")]
    p = spark.createDataFrame([(a, b, c, d, "2024-02-01", e) for a, b, c, d, e in rows], "ord long, direction string, description string, other string, due_at string, source_id string")
    return apply.create_promises(p, held, "n01").select("ord", "committer", "target", "outcome")


@expect("id kind currency direction date error", [
    ("1", "debt", "USD", "owed_by_me", "2024-02-01", None), ("2", "debt", None, None, None, None),
    ("3", "debt", None, None, None, "A ledger entry needs a person (node_id)."), ("4", "loan", None, None, None, "Unknown ledger kind 'loan'."),
    ("5", "debt", None, None, None, "A ledger entry needs a description."),
])
def ledger_entries(spark: SparkSession) -> DataFrame:
    rows = [("1", "n02", "debt", "rent", 5.0, " usd ", "owed_by_me", "2024-02-01T10:00"), ("2", "n02", "debt", "x", None, "USD", "sideways", "soon"), ("3", " ", "debt", "x", 1.0, None, None, None), ("4", "n02", "loan", "x", 1.0, None, None, None), ("5", "n02", "debt", " ", float("nan"), None, None, None)]
    return ledger.record(spark.createDataFrame(rows, "id string, node_id string, kind string, description string, amount double, currency string, direction string, date string")).select("id", "kind", "currency", "direction", "date", "error")


@expect("origin_key kind description direction date settled", [
    ("d1", "favor_owed", "lunch", "owed_by_me", None, True), ("d2", "gift_given", "scarf", "none", "2023-12-24", True),
    ("d6", "favor_owed", "settled", None, None, True),
])
def promoted_facts(spark: SparkSession) -> DataFrame:
    rows = [("d1", "n1", "favor_owed", "i owe | lunch | done", "s"), ("d2", "n1", "gift_given", "xmas | 2023-12-24 | scarf", "s"), ("d3", "n1", "gift_received", " wine ", "s"), ("d4", "n1", "favor_owed", "ride", None), ("d5", "n1", "note", "x", "s"), ("d6", "n1", "favor_owed", "settled", "s")]
    facts = ledger.promotable(spark.createDataFrame(rows, "id string, node_id string, name string, value string, source_id string"))
    return govern.promote(facts, spark.createDataFrame([("d3",)], "origin_key string")).select("origin_key", "kind", "description", "direction", "date", "settled")


@expect("id category title subtitle source entity entity_kind is_creation", [
    ("00", "person", "Zed", "CTO at Elm", "Your agent", "Zed", "person", True), ("01", "org", "Elm", "e@m", "Gmail", "Elm", "org", True),
    ("02", "attribute", "→ Zed", "employee", "Your agent", "Elm", "org", False), ("04", "attribute", "→ Cy", "x", "Your agent", "Meta", "org", False),
    ("05", "attribute", "bbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbb…", "bio", "Spreadsheets", "Ava Yu", "person", False),
    ("06", "attribute", "7", "title", "Spreadsheets", "Ben Ode", "person", False),
    ("08", "attribute", "v", "k", "Spreadsheets", "Details", "other", False),
    ("09", "attribute", "current company: Stripe ended 2024-01-05", "edit", "Your agent", "Ben Ode", "person", False),
    ("10", "attribute", "rename → Quin", "+2 more edits", "Your agent", "Q", "person", False),
    ("11", "attribute", "job title: (unset) → VP", "+1 more edit", "Your agent", "Ben Ode", "person", False),
    ("12", "attribute", "Same person as Ava Y", "spelling unsure - approve to combine them", "Your agent", "Ava Yu", "person", False),
    ("13", "attribute", "Same person as another entry", "approve to combine them into one", "Your agent", "T", "person", False),
    ("14", "promise", "call", None, "Your agent", "Bo", "person", False), ("16", "promise", "w", None, "Your agent", "Eva Lind", "person", False),
])
def review_items(spark: SparkSession) -> DataFrame:
    s, f = store(spark), frames(spark)
    end = {"field": "end_detail", "detail_name": "current_company", "previous": "Stripe", "ended_at": "2024-01-05T00:00"}
    rows = [
        ("create_node", {"type": "Person", "display_name": " Zed ", "details": [{"name": "title", "value": "CTO"}, {"name": "company", "value": "Elm"}]}, "MCP"), ("create_node", {"type": "Organization", "display_name": "Elm", "details": {"email": "e@m"}}, "Gmail"),
        ("create_link", {"source": {"display_name": "Elm"}, "target": {"display_name": "Zed"}, "link_type": "employee"}, None), ("create_link", {"source": {"id": "n06"}, "target": {"display_name": ""}, "link_type": "x"}, None), ("create_link", {"source": {"id": "n06"}, "target": {"display_name": "Cy"}, "link_type": "x"}, None),
        ("add_detail", {"node_id": "n02", "detail_name": "bio", "value": "b" * 95}, "csv"), ("add_link_detail", {"link_id": "l2", "detail_name": "title", "value": 7}, "csv"), ("add_detail", {"node_id": "zz", "value": " "}, "csv"), ("add_detail", {"node_id": "zz", "detail_name": "k", "value": "v"}, "csv"),
        ("edit_node", {"node_id": "n03", "edits": [end]}, "x"), ("edit_node", {"node_id": "q", "node_name": "Q", "edits": [{"field": "name", "next": "Quin"}, {"field": "detail"}, {"field": "detail"}]}, "x"), ("edit_node", {"node_id": "n03", "edits": [{"field": "detail", "detail_name": "job_title", "next": "VP"}, {"field": "name"}]}, "x"),
        ("merge_nodes", {"target_node_id": "n02", "source_name": "Ava Y", "confidence": "unsure"}, "x"), ("merge_nodes", {"target_name": "T"}, "x"), ("create_promise", {"description": "call", "target": {"display_name": "Bo"}}, "x"), ("create_promise", {"description": " "}, "x"), ("create_promise", {"description": "w", "node_id": "n08"}, "x"), ("other", {}, "x"),
    ]
    queue = spark.createDataFrame([(f"{i:02}", k, json.dumps(p), t) for i, (k, p, t) in enumerate(rows)], "id string, kind string, payload string, title string")
    return apply.review_items(queue, s.nodes, f["links"])


