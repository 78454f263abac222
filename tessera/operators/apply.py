"""Approved proposals become rows: whole batches at a time, each as new rows and a journal of what was made or reused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import facts as V
from ..functions import text as T
from . import dedupe, resolve

TAGS = 12


def create_nodes(proposed: DataFrame, types: DataFrame, nodes: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """proposed(ord, type, display_name) -> ord, type, display_name, node_id, outcome.

    reused: a node of that type is meant, by normalised name, or with aliases(id, node_id, alias_text) also by near name or
    alias. created: it is the first of its type and normalised name in the batch, and gets the id "new:<ord>"; same: a later
    one, which has the first one's id. failed: there is no such type, or no name.
    """
    known = types.select(F.lower("name").alias("_t"), F.col("name").alias("_type")).distinct()
    rows = proposed.withColumn("display_name", F.trim("display_name")).withColumn("_t", F.lower(F.coalesce("type", F.lit("Person")))).join(known, "_t", "left")
    ok = F.col("_type").isNotNull() & (F.coalesce("display_name", F.lit("")) != "")
    good = rows.where(ok).select("ord", F.col("_type").alias("type"), "display_name", T.normalize_for_match(F.col("display_name")).alias("norm"))
    if aliases is None:
        hits = good.join(resolve.confirm_cache(nodes), ["type", "norm"]).select("ord", "id")
    else:
        hits = resolve.existing(good, nodes, aliases).select("ord", "id")
    left = good.join(hits, "ord", "left")
    named = F.when(F.col("norm") != "", F.col("norm")).otherwise(F.concat(F.lit("\0"), F.col("ord").cast("string")))  # names of marks alone are each their own
    left = left.withColumn("k", named)
    first = left.where("id is null").groupBy("type", "k").agg(F.min("ord").alias("first"))
    done = left.join(first, ["type", "k"], "left")
    made = F.concat(F.lit("new:"), F.col("first").cast("string"))
    outcome = F.when(F.col("id").isNotNull(), "reused").when(F.col("ord") == F.col("first"), "created").otherwise("same")
    out = done.select("ord", "type", "display_name", F.coalesce("id", made).alias("node_id"), outcome.alias("outcome"))
    bad = rows.where(~ok).select("ord", "type", "display_name", F.lit(None).cast("string").alias("node_id"), F.lit("failed").alias("outcome"))
    return out.unionByName(bad)


def proposed_aliases(proposed: DataFrame, made: DataFrame, aliases: DataFrame) -> DataFrame:
    """(node_id, alias_text) of other spellings in proposed(ord, also_spelled) for the nodes made(ord, node_id, display_name),
    each once, without those that the node has already, whatever their case."""
    rows = made.where("node_id is not null").join(proposed.select("ord", "also_spelled"), "ord")
    each = rows.select("node_id", F.explode(T.also_spelled(F.col("also_spelled"), F.col("display_name"))).alias("alias_text"))
    return new_aliases(each, aliases)


def new_aliases(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """rows(node_id, alias_text) that aliases doesn't hold, each spelling of a node once."""
    one = rows.withColumn("k", F.lower("alias_text")).groupBy("node_id", "k").agg(F.min("alias_text").alias("alias_text"))
    return one.join(aliases.select("node_id", F.lower("alias_text").alias("k")), ["node_id", "k"], "left_anti").select("node_id", "alias_text")


def proposed_details(proposed: DataFrame, made: DataFrame) -> DataFrame:
    """(ord, owner, name, value) of the details (JSON) and notes that create proposals carry, in order, ready for add."""
    note = F.trim(F.coalesce("user_note", F.lit("")))
    entries = F.concat(V.details(F.col("details")), F.when(note != "", F.array(F.struct(F.lit("bio").alias("name"), note.alias("value")))).otherwise(F.array().cast("array<struct<name: string, value: string>>")))
    rows = made.where("node_id is not null").select("ord", "node_id").join(proposed.select("ord", "details", "user_note"), "ord")
    each = rows.select(F.col("node_id").alias("owner"), "ord", F.posexplode(entries).alias("at", "d"))
    return each.select((F.col("ord") * 10_000 + F.col("at")).cast("long").alias("ord"), "owner", "d.name", "d.value")


def minted_definitions(wanted: DataFrame, definitions: DataFrame, by: str = "user_confirmed") -> DataFrame:
    """(name, value_type, multi_value, merge_strategy, created_by_ai) for names of wanted(name) that have no definition yet.
    Values that an edit brings replace, all others are several."""
    fresh = wanted.select("name").where("name != ''").distinct().join(definitions.select("name"), "name", "left_anti")
    multi = by != "edit"
    return fresh.select("name", F.lit("text").alias("value_type"), F.lit(multi).alias("multi_value"), F.lit("multi" if multi else "replace").alias("merge_strategy"), F.lit(True).alias("created_by_ai"))


def create_links(proposed: DataFrame, links: DataFrame, ways: DataFrame, types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, types) of proposed(ord, link_type) whose ends are resolved in ways(ord, source, target): ord, type, source,
    target, outcome (created, reused, same, failed); and the types that are minted. A type that isn't known is coined as a
    slug, and a link of one type and ends is made once."""
    known = types.select(F.col("name").alias("link_type"), F.lit(True).alias("_known"))
    rows = proposed.select("ord", "link_type").join(ways, "ord", "left").join(known, "link_type", "left")
    rows = rows.withColumn("type", F.when(F.col("_known"), F.col("link_type")).otherwise(T.slug(F.coalesce("link_type", F.lit("")))))
    ok = F.col("source").isNotNull() & F.col("target").isNotNull() & (F.col("type") != "")
    good = rows.where(ok)
    have = links.select("type", "source", "target").distinct().withColumn("_have", F.lit(True))
    first = good.groupBy("type", "source", "target").agg(F.min("ord").alias("_first"))
    done = good.join(have, ["type", "source", "target"], "left").join(first, ["type", "source", "target"])
    outcome = F.when(F.col("_have"), "reused").when(F.col("ord") == F.col("_first"), "created").otherwise("same")
    out = done.select("ord", "type", "source", "target", outcome.alias("outcome"))
    bad = rows.where(~F.coalesce(ok, F.lit(False))).select("ord", "type", "source", "target", F.lit("failed").alias("outcome"))
    minted = good.join(types.select(F.col("name").alias("type")), "type", "left_anti").select("type").distinct()
    return out.unionByName(bad), minted.select(F.col("type").alias("name"), F.lit("directed").alias("direction"), F.lit(True).alias("created_by_ai"))


def add_details(proposed: DataFrame, details: DataFrame, nodes: DataFrame, batch: DataFrame, definitions: DataFrame) -> DataFrame:
    """proposed(ord, node_id, detail_name, value, source_id) -> ord, owner, name, value, outcome, into.

    failed: something is missing, or node_id is neither a live node's nor a name in batch(display_name, id). Details that
    definitions(name, merge_strategy) append are merged into the latest one, in order (merged, or skipped where they add
    nothing); of the others a value is inserted, or skipped into the one that says as much already. details(id, node_id,
    name, value, updated_at) are live; outcome `retired` names those that a better spelling replaces.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    p = proposed.select("ord", text("node_id").alias("given"), text("detail_name").alias("name"), text("value").alias("value"), "source_id")
    by_name = batch.groupBy(F.lower(F.trim("display_name")).alias("lc")).agg(F.min("id").alias("_batch"))
    p = p.join(by_name, F.lower("given") == F.col("lc"), "left").withColumn("owner", F.coalesce("_batch", "given")).drop("lc", "_batch")
    there = nodes.select(F.col("id").alias("owner")).unionByName(batch.select(F.col("id").alias("owner"))).distinct().withColumn("_is", F.lit(True))
    p = p.join(there, "owner", "left").withColumn("ok", F.col("_is").isNotNull() & (F.col("name") != "") & (F.col("value") != "") & F.col("source_id").isNotNull())
    how = definitions.select("name", "merge_strategy").dropDuplicates(["name"])
    good = p.where("ok").join(how, "name", "left").withColumn("append", F.coalesce(F.col("merge_strategy") == "append", F.lit(False)))
    latest = details.groupBy(F.col("node_id").alias("owner"), "name").agg(F.max_by("value", F.struct("updated_at", "id")).alias("old"), F.max_by("id", F.struct("updated_at", "id")).alias("into"))
    # appended texts are folded over a node's proposals in order: few, as each was approved
    each = good.where("append").groupBy("owner", "name").agg(F.array_sort(F.collect_list(F.struct("ord", "value"))).alias("v")).join(latest, ["owner", "name"], "left")
    merged = each.withColumn("text", F.aggregate("v", F.col("old"), lambda s, x: T.merge_text(s, x["value"])))
    grown = T.added_new(F.col("old"), F.col("text"))
    last = F.element_at("v", -1)["ord"]
    appended = merged.select(last.alias("ord"), "owner", "name", F.col("text").alias("value"), F.when(F.col("old").isNull(), "insert").when(grown, "merged").otherwise("skipped").alias("outcome"), F.col("into").cast("string").alias("into"))
    plan = dedupe.add(details.select("id", F.col("node_id").alias("owner"), "name", "value"), good.where("not append").select("ord", "owner", "name", "value"))
    new = plan.where("action in ('insert', 'skip')").select(F.expr("cast(substring(id, 2) as bigint)").alias("ord"), "owner", "name", "value", F.when(F.col("action") == "skip", "skipped").otherwise("insert").alias("outcome"), "into")
    old = plan.where("action = 'retire'").select(F.lit(None).cast("long").alias("ord"), "owner", "name", "value", F.lit("retired").alias("outcome"), "into")
    bad = p.where("not ok").select(F.col("ord").cast("long").alias("ord"), F.lit(None).cast("string").alias("owner"), "name", "value", F.lit("failed").alias("outcome"), F.lit(None).cast("string").alias("into"))
    return appended.withColumn("ord", F.col("ord").cast("long")).unionByName(new).unionByName(old).unionByName(bad)


def rename(nodes: DataFrame, edits: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, new aliases) after edits(ord, id, next): the last new name of each node counts; its former one is an alias."""
    last = edits.where(F.trim(F.coalesce("next", F.lit(""))) != "").groupBy("id").agg(F.max_by(F.trim("next"), "ord").alias("_next"))
    joined = nodes.join(last, "id", "left")
    moved = F.col("_next").isNotNull() & (F.col("_next") != F.col("display_name"))
    former = joined.where(moved & (F.trim("display_name") != "")).select(F.col("id").alias("node_id"), F.trim("display_name").alias("alias_text"))
    renamed = joined.withColumn("display_name", F.when(moved, F.col("_next")).otherwise(F.col("display_name"))).select(*nodes.columns)
    return renamed, new_aliases(former, aliases)


def create_promises(proposed: DataFrame, promises: DataFrame, self_id: str) -> DataFrame:
    """proposed(ord, direction, description, other, due_at, source_id) -> ord, committer, target, description, due_at, outcome.

    Whoever promises stands as committer. failed: an unknown direction, no description or no source. same: an open or expired
    one of promises(id, committer, target, description, status) of the same two says it already, or an earlier one of the
    batch does.
    """
    ok = F.col("direction").isin("user_to_other", "other_to_user", "mutual") & (F.trim(F.coalesce("description", F.lit(""))) != "") & F.col("source_id").isNotNull()
    theirs = F.col("direction") == "other_to_user"
    rows = proposed.withColumn("ok", F.coalesce(ok, F.lit(False))).withColumn("committer", F.when(theirs, F.col("other")).otherwise(F.lit(self_id))).withColumn("target", F.when(theirs, F.lit(self_id)).otherwise(F.col("other")))
    rows = rows.select("ord", "ok", "committer", "target", F.trim("description").alias("description"), F.try_to_timestamp("due_at").cast("timestamp_ntz").alias("due_at"))
    new = rows.where("ok").select("committer", "target", F.col("ord").alias("o"), F.col("description").alias("d"))
    live = promises.where(F.col("status").isin("open", "expired")).select("committer", "target", F.lit(-1).cast("long").alias("o"), F.col("description").alias("d"))
    x, y = new.select(*[F.col(c).alias(f"{c}_x") for c in new.columns]), live.unionByName(new.withColumn("o", F.col("o").cast("long"))).select(*[F.col(c).alias(f"{c}_y") for c in new.columns])
    pair = x.join(y, F.col("committer_x").eqNullSafe(F.col("committer_y")) & F.col("target_x").eqNullSafe(F.col("target_y")) & (F.col("o_y") < F.col("o_x")))
    alike = (T.promise_key(F.col("d_x")) == T.promise_key(F.col("d_y"))) | T.overlapping(F.col("d_x"), F.col("d_y"))
    known = pair.where(alike).select(F.col("o_x").alias("ord")).distinct().withColumn("_same", F.lit(True))
    outcome = F.when(~F.col("ok"), "failed").when(F.col("_same"), "same").otherwise("created")
    return rows.join(known, "ord", "left").select("ord", "committer", "target", "description", "due_at", outcome.alias("outcome"))


def apply_tags(wanted: DataFrame, tags: DataFrame, node_tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new tags, new node_tags) of wanted(node_id, names), at most TAGS of a node: a tag is found whatever its case, or made
    with a colour that its name gives; a node gets it once. tags(id, name), node_tags(node_id, tag_id)."""
    names = F.slice(F.filter(F.transform("names", lambda n: F.trim(n)), lambda n: n != ""), 1, TAGS)
    each = wanted.select("node_id", F.explode(names).alias("name")).withColumn("k", F.lower("name"))
    have = tags.groupBy(F.lower("name").alias("k")).agg(F.min("id").alias("tag_id"))
    fresh = each.join(have, "k", "left_anti").groupBy("k").agg(F.min("name").alias("name"))
    made = fresh.select(F.concat(F.lit("tag:"), "k").alias("id"), "name", T.name_hash(F.col("name"), 7).alias("color"))
    found = each.join(have, "k", "left").select("node_id", F.coalesce("tag_id", F.concat(F.lit("tag:"), "k")).alias("tag_id")).distinct()
    return made, found.join(node_tags, ["node_id", "tag_id"], "left_anti")


def ensure_conversation(conversations: DataFrame, users: DataFrame, title: str = "MCP") -> DataFrame:
    """(user_id, id, made): each user's first conversation of that title, or a new one."""
    own = conversations.where(F.col("title") == title).groupBy("user_id").agg(F.min("id").alias("id"))
    rows = users.select("user_id").distinct().join(own, "user_id", "left")
    return rows.select("user_id", F.coalesce("id", F.concat(F.lit("new:"), "user_id")).alias("id"), F.col("id").isNull().alias("made"))


PAYLOAD = """type string, display_name string, details string, detail_name string, node_id string, node_name string, value string,
description string, link_type string, link_id string, source struct<id: string, display_name: string>,
target struct<id: string, display_name: string>, edits array<struct<field: string, detail_name: string, previous: string, next: string, ended_at: string>>,
target_node_id string, target_name string, source_name string, confidence string"""


def review_items(queue: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """queue(id, kind, payload, title) of pending proposals -> id, category, title, subtitle, source, entity, entity_kind,
    is_creation: a line for each that can be shown. nodes(id, type, display_name) and links(id, source) name what they are
    about; a name that only the batch knows has the kind it is created with."""
    q = queue.select("id", "kind", F.col("title").alias("conversation"), F.from_json("payload", PAYLOAD).alias("p")).where("p is not null")
    blank = lambda c: F.coalesce(F.trim(c), F.lit(""))
    by_link = links.select(F.col("id").alias("link_id"), F.col("source").alias("link_source"))
    q = q.withColumn("link_id", F.col("p.link_id")).join(by_link, "link_id", "left")
    about = F.when(F.col("kind") == "create_link", F.col("p.source.id")).when(F.col("kind") == "merge_nodes", F.col("p.target_node_id")).otherwise(F.coalesce("p.node_id", "link_source"))
    ref = nodes.select(F.col("id").alias("ref_id"), F.col("display_name").alias("ref_name"), F.col("type").alias("ref_type"))
    q = q.withColumn("ref_id", about).join(ref, "ref_id", "left")
    created = q.where("kind = 'create_node'").select(F.lower(blank(F.col("p.display_name"))).alias("lc"), T.entity_kind(F.coalesce("p.type", F.lit("Person"))).alias("by_batch")).where("lc != ''")
    created = created.groupBy("lc").agg(F.min("by_batch").alias("by_batch"))
    source_name, target_name = blank(F.col("p.source.display_name")), blank(F.col("p.target.display_name"))
    anchor = F.coalesce("ref_name", F.when(source_name != "", source_name).otherwise(target_name))
    q = q.withColumn("lc", F.lower(anchor)).join(created, "lc", "left")
    kind = F.when(F.col("ref_type").isNotNull(), T.entity_kind(F.col("ref_type")))
    node_type = F.coalesce("p.type", F.lit("Person"))
    d = V.details(F.col("p.details"))
    job, company = V.detail(d, "title"), F.coalesce(V.detail(d, "company"), V.detail(d, "current_company"))
    value = blank(F.col("p.value"))
    e, n_edits = F.get("p.edits", F.lit(0)), F.coalesce(F.size("p.edits"), F.lit(0))
    field = F.replace(F.coalesce(e["detail_name"], F.lit("detail")), F.lit("_"), F.lit(" "))
    ended = F.concat(field, F.lit(": "), F.coalesce(F.when(e["previous"] != "", e["previous"]), F.lit("current value")), F.lit(" ended"), F.coalesce(F.concat(F.lit(" "), F.substring(e["ended_at"], 1, 10)), F.lit("")))
    change = F.concat(field, F.lit(": "), F.coalesce(e["previous"], F.lit("(unset)")), F.lit(" → "), F.coalesce(e["next"], F.lit("")))
    edit = F.when(n_edits < 1, "edit").when(e["field"] == "name", F.concat(F.lit("rename → "), F.coalesce(e["next"], F.lit("")))).when(e["field"] == "end_detail", ended).otherwise(change)
    more = F.when(n_edits > 1, F.concat(F.lit("+"), (n_edits - 1).cast("string"), F.when(n_edits > 2, " more edits").otherwise(" more edit"))).otherwise("edit")
    is_ = lambda *k: F.col("kind").isin(*k)
    detail, none = is_("add_detail", "add_link_detail"), F.lit(None).cast("string")
    title = (F.when(is_("create_node"), blank(F.col("p.display_name"))).when(is_("create_link"), F.when((source_name != "") | (target_name != ""), F.concat(F.lit("→ "), F.when(target_name != "", target_name).otherwise("?"))))
             .when(detail, F.when(value != "", T.shortened(value, 90))).when(is_("edit_node"), T.shortened(edit, 90))
             .when(is_("merge_nodes"), F.concat(F.lit("Same person as "), F.coalesce("p.source_name", F.lit("another entry")))).when(is_("create_promise"), blank(F.col("p.description"))))
    who = F.when(job.isNotNull() & company.isNotNull(), F.concat(job, F.lit(" at "), company)).otherwise(F.coalesce(job, company, V.detail(d, "email")))
    unsure = F.when(F.coalesce("p.confidence", F.lit("likely")) == "unsure", "spelling unsure - approve to combine them").otherwise("approve to combine them into one")
    subtitle = F.when(is_("create_node"), who).when(is_("create_link"), F.col("p.link_type")).when(detail, F.col("p.detail_name")).when(is_("edit_node"), more).when(is_("merge_nodes"), unsure)
    category = F.when(is_("create_node"), F.when(node_type == "Organization", "org").when(node_type == "Location", "attribute").otherwise("person")).when(is_("create_promise"), "promise").otherwise("attribute")
    entity = (F.when(is_("create_node"), blank(F.col("p.display_name"))).when(is_("create_link"), anchor).when(detail, F.coalesce("ref_name", F.lit("Details"))).when(is_("edit_node"), F.coalesce("ref_name", "p.node_name", F.lit("Edits")))
              .when(is_("merge_nodes"), F.coalesce("ref_name", "p.target_name", F.lit("this entry"))).otherwise(F.coalesce("ref_name", F.when(target_name != "", target_name), F.lit("Promises"))))
    entity_kind = F.when(is_("create_node"), T.entity_kind(node_type)).when(detail, F.coalesce(kind, F.lit("other"))).when(is_("create_link"), F.coalesce(kind, "by_batch", F.lit("person"))).otherwise(F.coalesce(kind, F.lit("person")))
    out = q.select("id", category.alias("category"), title.alias("title"), subtitle.alias("subtitle"), T.source_label(F.col("conversation")).alias("source"), entity.alias("entity"), entity_kind.alias("entity_kind"), is_("create_node").alias("is_creation"))
    return out.where("title is not null and title != ''")


