"""Governed writes as set operations: proposals queue up; applying a batch makes new rows and a journal of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import facts as V
from ..functions import names as N
from ..functions import text as T


def pending_top(queue: DataFrame, per_conversation: int = 300, total: int = 3000) -> DataFrame:
    """The newest rows of each conversation, then of all."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return queue.withColumn("n", n).where(F.col("n") <= per_conversation).orderBy(F.desc("turn"), "conv_id").limit(total).drop("n")


def create_links(existing: DataFrame, proposed: DataFrame) -> DataFrame:
    """The links (type, source, target) of a batch that are new, each once; ends must not be null."""
    fresh = proposed.where(F.col("source").isNotNull() & F.col("target").isNotNull()).select(T.slug(F.col("type")).alias("type"), "source", "target").distinct()
    return fresh.join(existing, ["type", "source", "target"], "left_anti")


def create_nodes(proposed: DataFrame) -> DataFrame:
    """proposed(ord, type, display_name) -> ord, type, display_name, canonical: the batch's first row of the same type and
    normalised name stands for all."""
    n = proposed.withColumn("norm", T.normalize_for_match(F.col("display_name")))
    first = n.groupBy("type", "norm").agg(F.min("ord").alias("canonical"))
    return n.join(first, ["type", "norm"]).select("ord", "type", "display_name", "canonical")


def _key(df: DataFrame, keys: list[str]) -> Column:
    """One value that is equal where the keys are, nulls among them."""
    return F.to_json(F.struct(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")) if k in df.columns else F.lit("\0").alias(k) for k in keys]))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """table with rows put in by key: a row of `rows` replaces those that have its key, null keys being equal too; of rows
    with one key the last by `order` counts, or else the largest."""
    at = F.struct(*([F.col(order)] if order else []), F.to_json(F.struct("*")))
    new = rows.withColumn("_k", _key(rows, keys)).withColumn("_o", at)
    last = new.groupBy("_k").agg(F.max_by(F.struct(*rows.columns), "_o").alias("_r")).select("_k", "_r.*")
    kept = table.withColumn("_k", _key(table, keys)).join(last.select("_k"), "_k", "left_anti").drop("_k")
    return kept.unionByName(last.drop("_k", *([order] if order and order not in table.columns else [])), allowMissingColumns=True)


def insert_or_ignore(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with those rows whose key it doesn't hold, one of each key."""
    new = rows.withColumn("_k", _key(rows, keys)).dropDuplicates(["_k"])
    return table.unionByName(new.join(table.select(_key(table, keys).alias("_k")), "_k", "left_anti").drop("_k"), allowMissingColumns=True)


def update_by_id(table: DataFrame, patches: DataFrame, key: str = "id") -> DataFrame:
    """table with the columns of patches(key, ...) set on the rows that they name; a null in a patch leaves the value."""
    named = patches.select(key, *[F.col(c).alias(f"_{c}") for c in patches.columns if c != key])
    joined = table.join(named, key, "left")
    return joined.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if f"_{c}" in named.columns else F.col(c) for c in table.columns])


def refusals(table: DataFrame, rows: DataFrame, required: list[str], unique: list[str], references: dict[str, DataFrame]) -> DataFrame:
    """rows with `refused`: null where the row may be written, else the first constraint that it breaks: a missing value, a
    key already there or twice in the batch, or a name of nothing. references: column -> frame (id)."""
    missing = F.coalesce(*[F.when(F.col(c).isNull(), f"not null: {c}") for c in required]) if required else F.lit(None)
    own = rows.withColumn("_k", _key(rows, unique))
    taken = table.select(_key(table, unique).alias("_k")).distinct().withColumn("_taken", F.lit(True))
    first = Window.partitionBy("_k").orderBy(F.to_json(F.struct(*rows.columns)))
    checked = own.join(taken, "_k", "left").withColumn("_n", F.row_number().over(first))
    broken = [missing, F.when(F.col("_taken") | (F.col("_n") > 1), F.lit(f"unique: {', '.join(unique)}"))]
    for c, frame in references.items():
        checked = checked.join(frame.select(F.col("id").alias(c)).distinct().withColumn(f"_has_{c}", F.lit(True)), c, "left")
        broken.append(F.when(F.col(c).isNotNull() & F.col(f"_has_{c}").isNull(), f"foreign key: {c}"))
    return checked.select(*rows.columns, F.coalesce(*broken).alias("refused"))


class WriteRefused(RuntimeError):
    """A batch that the constraints of a table don't allow."""


def must_write(table: DataFrame, rows: DataFrame, required: list[str], unique: list[str], references: dict[str, DataFrame] | None = None) -> DataFrame:
    """table with all rows appended, or WriteRefused with the first reason."""
    bad = refusals(table, rows, required, unique, references or {}).where("refused is not null").select("refused").first()
    if bad:
        raise WriteRefused(bad["refused"])
    return table.unionByName(rows, allowMissingColumns=True)


def tombstone(table: DataFrame, gone: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """table with deleted_at set where a live row's key is in gone."""
    mark = gone.select(*keys).distinct().withColumn("_gone", F.lit(True))
    return table.join(mark, keys, "left").withColumn("deleted_at", F.when(F.col("_gone") & F.col("deleted_at").isNull(), at).otherwise(F.col("deleted_at"))).drop("_gone")


def supersede(details: DataFrame, changes: DataFrame, now: Column, any_open: bool = False) -> DataFrame:
    """details(owner, name, value, valid_from, valid_until, deleted_at) after changes(owner, name, next[, ord]): open rows
    close at one instant and a new one opens there. Nothing changes where every open value equals the next (any_open: where
    one does). Of several changes of one (owner, name) the last by ord, or else by value, counts: the others would hold for
    no time."""
    open_ = F.col("valid_until").isNull() & F.col("deleted_at").isNull()
    state = details.where(open_).groupBy("owner", "name").agg(F.collect_set(F.lower(F.trim("value"))).alias("have"))
    order = [F.col("ord")] if "ord" in changes.columns else []
    last = changes.groupBy("owner", "name").agg(F.max_by("next", F.struct(*order, "next")).alias("next"))
    held = F.array_contains("have", F.lower(F.trim("next")))
    same = held if any_open else held & (F.size("have") == 1)
    todo = last.join(state, ["owner", "name"], "left").where(F.col("have").isNull() | ~same)
    joined = details.join(todo.select("owner", "name", F.lit(True).alias("hit")), ["owner", "name"], "left")
    shut = open_ & F.coalesce("hit", F.lit(False))
    patch = V.close_patch(now, F.col("valid_from"), now)
    closed = joined.withColumns({c: F.when(shut, x).otherwise(F.col(c)) for c, x in patch.items()}).select(*details.columns)
    none = F.lit(None).cast("timestamp_ntz")
    fresh = todo.select("owner", "name", F.col("next").alias("value"), F.when(F.col("have").isNotNull(), V.open_patch(now, now)["valid_from"]).alias("valid_from"), none.alias("valid_until"), none.alias("deleted_at"))
    return closed.unionByName(fresh, allowMissingColumns=True)


def end_details(details: DataFrame, ends: DataFrame, now: Column) -> DataFrame:
    """details after ends(owner, name, previous, ended_at): the open rows with that value, or all where previous is null or
    blank, end at ended_at. Of several ends of a row the earliest counts."""
    open_ = F.col("valid_until").isNull() & F.col("deleted_at").isNull()
    named = ends.select("owner", "name", F.lower(F.trim(F.coalesce("previous", F.lit("")))).alias("_p"), F.coalesce("ended_at", now).alias("_at"))
    each = named.groupBy("owner", "name").agg(F.collect_list(F.struct("_p", "_at")).alias("_e"))
    fits = F.filter("_e", lambda e: (e["_p"] == "") | (e["_p"] == F.lower(F.trim(F.col("value")))))
    at = F.array_min(F.transform(fits, lambda e: e["_at"]))
    joined = details.join(each, ["owner", "name"], "left").withColumn("_t", F.when(open_, at))
    patch = V.close_patch(F.col("_t"), F.col("valid_from"), now)
    return joined.withColumns({c: F.when(F.col("_t").isNotNull(), x).otherwise(F.col(c)) for c, x in patch.items()}).select(*details.columns)


def journal(before: DataFrame, after: DataFrame, keys: list[str], table: str) -> DataFrame:
    """(op, table, keys, previous): what a batch created and what it changed, with the former row as JSON."""
    cols = [c for c in before.columns if c not in keys]
    a = before.select(*keys, F.to_json(F.struct(*cols)).alias("previous"))
    b = after.select(*keys, F.to_json(F.struct(*cols)).alias("next"))
    op = F.when(F.col("previous").isNull(), "created").otherwise("patched")
    return b.join(a, keys, "left").where(~F.col("previous").eqNullSafe(F.col("next"))).select(op.alias("op"), F.lit(table).alias("table"), *keys, "previous")


def promises_alike(promises: DataFrame) -> DataFrame:
    """(a, b): open promises of the same pair of people that say the same, in other words or those alone; blocked on that
    pair, whose parties may be unknown."""
    x, y = (promises.select("committer", "target", F.col("id").alias(i), F.col("description").alias(f"d{i}")) for i in "ab")
    pair = x.join(y, x.committer.eqNullSafe(y.committer) & x.target.eqNullSafe(y.target) & (F.col("a") < F.col("b")))
    same = T.promise_key(F.col("da")) == T.promise_key(F.col("db"))
    return pair.where(same | T.overlapping(F.col("da"), F.col("db"))).select("a", "b")


def promote(parsed: DataFrame, ledger: DataFrame) -> DataFrame:
    """Facts not yet in the ledger, by their origin key."""
    return parsed.join(ledger.select("origin_key"), "origin_key", "left_anti")


def reminders(ledger: DataFrame, now: Column) -> DataFrame:
    """ledger(id, node_id, kind, description, amount, currency, direction, date) -> a follow-up promise for every debt or
    favor that falls due after now. Without an amount, none is named; without a direction, it counts as owed to us."""
    due = ledger.where(F.col("kind").isin("debt", "favor_owed") & (F.col("date") > now))
    money = F.when(F.col("amount").isNotNull(), F.concat(F.lit(" "), T.money(F.col("amount"), F.col("currency")))).otherwise("")
    mine = F.coalesce(F.col("direction") == "owed_by_me", F.lit(False))
    wording = F.when(mine, F.concat(F.lit("Return"), money, F.lit(": "), "description")).otherwise(F.concat(F.lit("Follow up on"), money, F.lit(" owed to you: "), "description"))
    way = F.when(mine, "user_to_other").otherwise("other_to_user")
    return due.select("id", F.col("node_id").alias("target"), way.alias("direction"), F.substring(wording, 1, 300).alias("description"), F.col("date").alias("due_at"), F.lit("open").alias("status"), F.lit("follow_up").alias("kind"))


def name_variants(names: DataFrame, pairs: list[tuple[str, str]] = N.NICKNAMES) -> DataFrame:
    """names(name), each once -> a, b, fuller: pairs that may be one person's, and the one to keep. Joined on a whole first
    or last part and an initial of the other, which any such pair shares."""
    keyed = names.select("name", F.explode(N.anchors(F.col("name"), pairs)).alias("key"))
    pair = keyed.select(F.col("name").alias("a"), "key").join(keyed.select(F.col("name").alias("b"), "key"), "key").where("a < b")
    alike = pair.where(N.name_match(F.col("a"), F.col("b"), pairs) == "variant").select("a", "b").distinct()
    return alike.withColumn("fuller", F.when(N.fullness(F.col("b")) > N.fullness(F.col("a")), F.col("b")).otherwise(F.col("a")))
