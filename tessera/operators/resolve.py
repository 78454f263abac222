"""Who is meant: near names, similar wording, and names resolved to nodes by tiers, each an equi-join that loses nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Edits that names may differ by, and the least length of names that may.
EDITS, LEAST = 2, 5
SELF_WORDS = ["self", "me", "myself", "you"]


def _segments(length: Column, edits: int) -> list[tuple[Column, Column]]:
    """(first letter, letters) of the edits + 1 even parts of a text of a length."""
    parts = edits + 1
    base = F.floor(length / parts).cast("int")
    short = parts - (length - base * parts)  # so many parts have `base` letters, those after them one more
    return [((i * base + F.greatest(F.lit(0), F.lit(i) - short) + 1).cast("int"), (base + (F.lit(i) >= short).cast("int")).cast("int")) for i in range(parts)]


def segment_keys(x: Column, edits: int = EDITS) -> Column:
    """Keys of a text's own parts. Of two texts within `edits` edits one part of the shorter stands in the longer whole, at
    most `edits` places aside: so they share a key of segment_keys and one of window_keys."""
    n = F.length(x)
    return F.array(*[F.concat_ws("|", n, F.lit(i), F.substring(x, at, size)) for i, (at, size) in enumerate(_segments(n, edits))])


def window_keys(x: Column, edits: int = EDITS) -> Column:
    keys = []
    for less in range(edits + 1):
        n = F.length(x) - less
        for i, (at, size) in enumerate(_segments(n, edits)):
            for aside in range(-edits, edits + 1):
                fits = (at + aside >= 1) & (at + aside + size - 1 <= F.length(x)) & (n > edits)
                keys.append(F.when(fits, F.concat_ws("|", n, F.lit(i), F.substring(x, at + aside, size))))
    return F.array_distinct(F.array_compact(F.array(*keys)))


def near_names(names: DataFrame, column: str, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """(a, b, d): different names, of `least` letters at least, within `edits` edits of each other."""
    n = names.select(F.col(column).alias("x")).where(F.length("x") >= least)
    own = n.select(F.col("x").alias("s"), F.explode(segment_keys(F.col("x"), edits)).alias("key"))
    around = n.select(F.col("x").alias("l"), F.explode(window_keys(F.col("x"), edits)).alias("key"))
    pair = own.join(around, "key").where("s != l").select(F.least("s", "l").alias("a"), F.greatest("s", "l").alias("b")).distinct()
    return pair.withColumn("d", F.levenshtein("a", "b", edits)).where("d >= 0")


def similar_pairs(texts: DataFrame, column: str) -> DataFrame:
    """(a, b): texts in similar words. Such texts share two words at least, so they are joined on pairs of words: a word that
    all of them have makes no pairs by itself."""
    n = texts.select(F.col(column).alias("x"), F.array_sort(T.tokens(F.col(column))).alias("t"))
    two = F.flatten(F.transform("t", lambda x, i: F.transform(F.slice("t", i + 2, F.size("t")), lambda y: F.concat_ws(" ", x, y))))
    keyed = n.where(F.size("t") > 1).select("x", F.explode(two).alias("key"))
    pair = keyed.select(F.col("x").alias("a"), "key").join(keyed.select(F.col("x").alias("b"), "key"), "key").where("a < b").select("a", "b").distinct()
    return pair.where(T.similar_wording(F.col("a"), F.col("b")))


def on_main_graph(nodes: DataFrame) -> DataFrame:
    """Without the nodes of satellite clusters, which names never resolve to."""
    return nodes.where(F.coalesce("graph_layer", F.lit("")) != "satellite") if "graph_layer" in nodes.columns else nodes


def confirm_cache(nodes: DataFrame) -> DataFrame:
    """(type, norm, id): of each type and normalised name the first node."""
    n = on_main_graph(nodes).withColumn("norm", T.normalize_for_match(F.col("display_name"))).where("norm != ''")
    return n.groupBy("type", "norm").agg(F.min("id").alias("id"))


def existing(wanted: DataFrame, nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """wanted(ord, type, display_name) -> ord, id, tier: the node of that type that is meant: 1 by normalised name, 2 by the
    least edit distance (2 at most), 3 by an alias, equal or near; ties go to the first id, of aliases to the first alias.
    Names that match nothing have no row. nodes(id, type, display_name), aliases(id, node_id, alias_text)."""
    main = on_main_graph(nodes)
    w = wanted.select("ord", "type", T.normalize_for_match(F.col("display_name")).alias("x")).where("x != ''")
    n = main.select("type", F.col("id"), T.normalize_for_match(F.col("display_name")).alias("y"))
    alias = aliases.join(main.select(F.col("id").alias("node_id"), "type"), "node_id")
    a = alias.select("type", F.col("id").alias("alias_id"), F.col("node_id").alias("id"), T.normalize_for_match(F.col("alias_text")).alias("y"))
    found = [
        w.join(n, ["type"]).where("x = y").select("ord", "id", F.lit(1).alias("tier"), F.lit(0).alias("d"), F.col("id").alias("o")),
        _near(w, n).select("ord", "id", F.lit(2).alias("tier"), "d", F.col("id").alias("o")),
        w.join(a, ["type"]).where("x = y").select("ord", "id", F.lit(3).alias("tier"), F.lit(0).alias("d"), F.col("alias_id").alias("o")),
        _near(w, a).select("ord", "id", F.lit(3).alias("tier"), F.lit(0).alias("d"), F.col("alias_id").alias("o")),
    ]
    best = reduce(DataFrame.unionByName, found).groupBy("ord").agg(F.min(F.struct("tier", "d", "o", "id")).alias("x"))
    return best.select("ord", "x.id", "x.tier")


def _near(w: DataFrame, n: DataFrame) -> DataFrame:
    """w(ord, type, x) with n(type, y, ...) within EDITS edits, both of LEAST letters at least."""
    w, n = w.where(F.length("x") >= LEAST), n.where(F.length("y") >= LEAST)
    keyed = w.select("*", F.explode(F.array_union(segment_keys(F.col("x")), window_keys(F.col("x")))).alias("key"))
    other = n.select("*", F.explode(F.array_union(segment_keys(F.col("y")), window_keys(F.col("y")))).alias("key"))
    pair = keyed.join(other, ["type", "key"]).drop("key").distinct()
    return pair.withColumn("d", F.levenshtein("x", "y", EDITS)).where("d >= 0")


def references(refs: DataFrame, batch: DataFrame, nodes: DataFrame, aliases: DataFrame, self_id: str | None) -> DataFrame:
    """refs(ord, id, display_name) -> ord, node_id, way: in order the id itself, a node of the batch(display_name, id) by name
    or normalised name, the asker's own node for words like "me", a node's exact name, an alias, a normalised name. Of
    several the first id, of aliases the first alias. node_id is null where nothing fits, or an id that isn't a live node."""
    main = on_main_graph(nodes)
    r = refs.select("ord", F.when(F.trim("id") != "", F.trim("id")).alias("given"), F.lower(F.trim(F.coalesce("display_name", F.lit("")))).alias("lc"))
    r = r.withColumn("norm", T.normalize_for_match(F.col("lc")))
    first = lambda df, key, o, to: df.groupBy(key.alias("k")).agg(F.min_by("id", o).alias(to))
    by_name, by_norm = F.lower(F.trim("display_name")), T.normalize_for_match(F.col("display_name"))
    live_alias = aliases.join(main.select(F.col("id").alias("node_id")), "node_id").select(F.col("id").alias("o"), F.col("node_id").alias("id"), F.lower(F.trim("alias_text")).alias("k"))
    tiers = [
        ("batch", "lc", first(batch, by_name, "id", "batch")),
        ("batch_norm", "norm", first(batch, by_norm, "id", "batch_norm")),
        ("name", "lc", first(main, by_name, "id", "name")),
        ("alias", "lc", live_alias.groupBy("k").agg(F.min_by("id", "o").alias("alias"))),
        ("norm", "norm", first(main, by_norm, "id", "norm_id").withColumnRenamed("norm_id", "normalised")),
    ]
    for _, key, frame in tiers:
        r = r.join(frame.where("k != ''"), F.col(key) == F.col("k"), "left").drop("k")
    me = F.when(F.col("lc").isin(SELF_WORDS), F.lit(self_id))
    ways = [("id", F.col("given")), ("batch", F.col("batch")), ("batch", F.col("batch_norm")), ("self", me), ("name", F.col("name")), ("alias", F.col("alias")), ("normalised", F.col("normalised"))]
    # a word for oneself never falls through to a node of that name
    stop = F.col("lc").isin(SELF_WORDS)
    chosen = F.coalesce(*[c for _, c in ways[:4]], F.when(~stop, F.coalesce(*[c for _, c in ways[4:]])))
    way = F.coalesce(*[F.when(c.isNotNull(), w) for w, c in ways[:4]], F.when(~stop, F.coalesce(*[F.when(c.isNotNull(), w) for w, c in ways[4:]])))
    out = r.select("ord", chosen.alias("node_id"), way.alias("way"))
    known = nodes.select(F.col("id").alias("node_id")).unionByName(batch.select(F.col("id").alias("node_id"))).distinct().withColumn("_is", F.lit(True))
    checked = out.join(known, "node_id", "left")
    return checked.select("ord", F.when(F.col("_is"), F.col("node_id")).alias("node_id"), F.when(F.col("_is"), F.col("way")).alias("way"))


def all_exist(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(ord, ok) of wanted(ord, ids): whether each id of the list is a live node's; an empty list is."""
    ids = wanted.select("ord", F.explode_outer(F.array_distinct("ids")).alias("id"))
    live = nodes.select("id").distinct().withColumn("_is", F.lit(1))
    return ids.join(live, "id", "left").groupBy("ord").agg((F.count("id") == F.count("_is")).alias("ok"))


def first_match(rows: DataFrame, predicate: Column, *order: Column | str) -> DataFrame:
    """The first row in order that the predicate holds for."""
    return rows.where(predicate).orderBy(*order).limit(1)


def numbered(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """rows with n, their place among those of the same keys, from 1."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
