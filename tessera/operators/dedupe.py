"""Is this fact already there, written differently? Values of the same family are compared by what they say, field by field.

Coverage is transitive: what covers a value that covers a third covers the third. So greedy collapses and one-by-one
additions come out as joins: a value stays unless another covers it more richly, or an equal one comes before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import facts as V
from ..functions import text as T

#: Names of details -> how their values are compared; where a vaguer place is covered by a more exact one.
FAMILIES = {"education_entry": "education", "past_role": "role", "current_role": "role", "honor": "text"}
LOCATIONS = ["location", "locations", "city", "cities", "based_in", "address"]
FIELDS = ["degree", "end", "field", "start", "title"]  # in order of name, as keys write them


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where the value is worked out once however often `then` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def family(name: Column) -> Column:
    n = F.trim(name)
    return F.coalesce(*[F.when(n == k, v) for k, v in FAMILIES.items()])


def fields(name: Column, value: Column) -> Column:
    """struct<base, degree, end, field, start, title> of a value, folded: the school or company and what qualifies it; null
    where it can't be read. Other names have the folded value as base."""
    f, text = family(name), F.coalesce(value, F.lit(""))
    none = F.lit("")
    of = lambda base, **own: F.struct(base.alias("base"), *[own.get(k, none).alias(k) for k in FIELDS])
    ended = lambda done, end: F.when(done, "").otherwise(T.fold(end))
    school = lambda e: of(T.fold(e["school"]), degree=T.fold(e["degree"]), field=T.fold(e["field"]), start=T.fold(e["start"]), end=ended(V.is_present(e["end"]), e["end"]))
    job = lambda r: of(T.fold(r["company"]), title=T.fold(r["title"]), start=T.fold(r["start"]), end=ended(r["current"], r["end"]))
    read_school = _once(V.education(text), lambda e: F.when(e.isNotNull(), school(e)))
    read_job = _once(V.role(text), lambda r: F.when(F.coalesce(r["company"], F.lit("")) != "", job(r)))
    return F.when(f == "education", read_school).when(f == "role", read_job).otherwise(of(T.fold(text)))


def canonical_key(name: Column, value: Column) -> Column:
    """One text for all spellings of one fact: base#field=value|..., or the folded value outside the families."""
    known = lambda x: F.array_compact(F.array(*[F.when(x[k] != "", F.concat(F.lit(f"{k}="), x[k])) for k in FIELDS]))
    key = _once(fields(name, value), lambda x: F.when(x.isNotNull(), F.concat(x["base"], F.lit("#"), F.array_join(known(x), "|"))))
    return F.coalesce(F.when(family(name).isNotNull(), key), T.fold(F.coalesce(value, F.lit(""))))


def compare(name: Column, a: Column, b: Column) -> Column:
    """equal, a_covers_b, b_covers_a or different: of one base, with no field in which both say something else."""
    folded = F.when(T.fold(F.coalesce(a, F.lit(""))) == T.fold(F.coalesce(b, F.lit(""))), "equal").otherwise("different")
    both = F.struct(fields(name, a).alias("a"), fields(name, b).alias("b"))
    said = _once(both, lambda p: F.when(p["a"].isNotNull() & p["b"].isNotNull(), _compared(p["a"], p["b"])))
    return F.coalesce(F.when(family(name).isNotNull(), said), folded)


def _compared(fa: Column, fb: Column) -> Column:
    any_of = lambda tests: F.exists(F.array(*tests), lambda t: t)
    clash = any_of([(fa[k] != "") & (fb[k] != "") & (fa[k] != fb[k]) for k in FIELDS])
    more_a, more_b = (any_of([(x[k] != "") & (y[k] == "") for k in FIELDS]) for x, y in ((fa, fb), (fb, fa)))
    return F.when((fa["base"] != fb["base"]) | clash | (more_a & more_b), "different").when(more_a, "a_covers_b").when(more_b, "b_covers_a").otherwise("equal")


def richness(name: Column, value: Column) -> Column:
    """What decides between equal spellings, the larger first: fields said, a JSON object for schools, length."""
    f = family(name)
    known = f.isin("education", "role")
    said = _once(fields(name, value), lambda x: F.when(x.isNull(), -1).otherwise(F.size(F.array_compact(F.array(*[F.when(x[k] != "", 1) for k in FIELDS])))))
    counted = F.when(known, said).otherwise(0)
    json = F.when((f == "education") & F.trim(value).startswith("{"), 1).otherwise(0)
    return F.struct(counted.alias("said"), json.alias("json"), F.length(F.trim(value)).alias("length"))


def richer(name: Column, a: Column, b: Column) -> Column:
    return F.when(richness(name, b) > richness(name, a), b).otherwise(a)


def near_dupe(name: Column, a: Column, b: Column) -> Column:
    """Similar enough to ask about: no field disagrees, and the identities are similar without being equal."""
    f = family(name)
    clash = lambda fa, fb, names: F.exists(F.array(*[(fa[k] != "") & (fb[k] != "") & (fa[k] != fb[k]) for k in names]), lambda t: t)
    titles = lambda fa, fb: (fa["title"] != "") & (fb["title"] != "") & (fa["title"] != fb["title"]) & similar(fa["title"], fb["title"])
    schools = lambda fa, fb: ~clash(fa, fb, ["degree", "end", "field", "start"]) & (fa["base"] != fb["base"]) & similar(fa["base"], fb["base"])
    jobs = lambda fa, fb: ~clash(fa, fb, ["end", "start"]) & F.when(fa["base"] == fb["base"], titles(fa, fb)).otherwise((fa["title"] != "") & (fa["title"] == fb["title"]) & similar(fa["base"], fb["base"]))
    both = F.struct(fields(name, a).alias("a"), fields(name, b).alias("b"))
    read = _once(both, lambda p: F.when(p["a"].isNull() | p["b"].isNull(), F.lit(False)).when(f == "education", schools(p["a"], p["b"])).when(f == "role", jobs(p["a"], p["b"])))
    asked = F.when(f == "text", similar(a, b)).otherwise(read)
    return f.isNotNull() & (compare(name, a, b) == "different") & F.coalesce(asked, F.lit(False))


#: Words that carry no identity.
STOP_WORDS = ["the", "of", "a", "an", "and", "at", "in", "for", "de"]


def similar(a: Column, b: Column) -> Column:
    """Similar wording, but for words that carry no identity: the same words, or T.similar_wording of the rest."""
    words = lambda x: F.array_distinct(F.filter(F.split(F.regexp_replace(T.fold(x), r"[^\p{L}\p{N} ]+", " "), r"\s+"), lambda t: (t != "") & ~t.isin(STOP_WORDS)))
    ta, tb = words(a), words(b)
    both, least = F.size(F.array_intersect(ta, tb)), F.least(F.size(ta), F.size(tb))
    same = (F.size(ta) == F.size(tb)) & (both == least)
    return (least > 0) & (same | ((both >= 2) & ((both == least) | (both / F.size(F.array_union(ta, tb)) >= 0.6))))


def _covered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(id, into) of rows(id, name, value, o, *keys): each row that another covers, with the first by o that does. A row
    covers those of the same keys and base that it says all of and more, and equal ones after it."""
    x = rows.withColumn("x", fields(F.col("name"), F.col("value"))).withColumn("base", F.coalesce(F.col("x")["base"], T.fold(F.coalesce("value", F.lit("")))))
    a, b = (x.select(*keys, "base", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "name", "value", "o", "x")]) for s in "ab")
    pair = a.join(b, [*keys, "base"]).where("id_a != id_b")
    read = F.col("x_a").isNotNull() & F.col("x_b").isNotNull()
    said = F.when(read, _compared(F.col("x_a"), F.col("x_b"))).when(T.fold("value_a") == T.fold("value_b"), "equal").otherwise("different")
    covers = (said == "a_covers_b") | ((said == "equal") & (F.col("o_a") < F.col("o_b")))
    return pair.where(covers).groupBy(F.col("id_b").alias("id")).agg(F.min_by("id_a", "o_a").alias("into"))


def collapse(rows: DataFrame) -> DataFrame:
    """rows(id, owner, name, value, created_at, confirmed) -> id, action, into, confirm: keep the fullest spelling of each
    fact of an owner, the richest first, then the oldest, then by id; tombstone the others into it. A kept row that one of
    these was confirmed for is to be confirmed."""
    rich = richness(F.col("name"), F.col("value"))
    order = F.struct(*[(-rich[k]).alias(k) for k in ("said", "json", "length")], F.col("created_at"), F.col("id").alias("i"))
    o = rows.withColumn("o", order)
    gone = _covered(o, ["owner", "name"])
    gained = gone.join(rows.where("confirmed").select("id"), "id").select(F.col("into").alias("id")).distinct().withColumn("gains", F.lit(True))
    out = rows.join(gone, "id", "left").join(gained, "id", "left")
    confirm = F.col("into").isNull() & F.coalesce("gains", F.lit(False)) & ~F.coalesce("confirmed", F.lit(False))
    return out.select("id", F.when(F.col("into").isNull(), "keep").otherwise("tombstone").alias("action"), "into", confirm.alias("confirm"))


def add(details: DataFrame, incoming: DataFrame) -> DataFrame:
    """details(id, owner, name, value) live, incoming(ord, owner, name, value) -> ord, action, into; id, action, into: what
    becomes of each incoming value (insert, or skip into the value that says as much already) and which details are retired
    by a better spelling. Within the families by fields, for places by exactness, for all else by the folded value."""
    old = details.select(F.col("id").cast("string").alias("id"), "owner", "name", "value", F.lit(0).alias("new"), F.lit(0).cast("long").alias("ord"))
    new = incoming.select(F.concat(F.lit("+"), F.col("ord").cast("string")).alias("id"), "owner", "name", "value", F.lit(1).alias("new"), F.col("ord").cast("long").alias("ord"))
    rows = old.unionByName(new).withColumn("o", F.struct("new", "ord", F.col("id").alias("i")))
    gone = _covered(rows, ["owner", "name"])
    exact = rows.where(F.lower("name").isin(LOCATIONS)).withColumn("parts", F.filter(F.transform(F.split(F.lower("value"), ","), lambda s: F.trim(s)), lambda s: s != ""))
    tails = F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size("parts"))), lambda i: F.array_join(F.slice("parts", i, F.size("parts")), ","))
    finer = exact.where(F.size("parts") > 1).select("owner", "name", F.col("id").alias("into"), "o", F.explode(tails).alias("key"))
    vaguer = exact.select("owner", "name", "id", F.array_join("parts", ",").alias("key"))
    place = vaguer.join(finer, ["owner", "name", "key"]).where("id != into").groupBy("id").agg(F.min_by("into", "o").alias("into"))
    fate = rows.join(place.unionByName(gone).groupBy("id").agg(F.min("into").alias("into")), "id", "left")
    action = F.when(F.col("new") == 1, F.when(F.col("into").isNull(), "insert").otherwise("skip")).otherwise(F.when(F.col("into").isNull(), "keep").otherwise("retire"))
    return fate.select("id", "owner", "name", "value", action.alias("action"), "into")
