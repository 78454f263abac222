"""Benchmark decontamination by winnowing, with DataFrame functions only.

Fingerprints: of the hashes of all K-word grams, the minimum of each W consecutive ones. Two texts that share K + W - 1
= 10 words share the W grams in them, so the minimum of that window is a fingerprint of both: no shared window is missed.
Hits are extended word by word along the diagonal on which the grams match, and what is reported is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, tune

WINDOW, K = 10, 5
#: Bytes of benchmark fingerprints (with the words of their items) up to which they are broadcast.
BROADCAST_BYTES = 32 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for null."""
    found = F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), SEPARATORS)
    return F.filter(found, lambda w: w != "")


def _grams(hashes: Column, k: int) -> Column:
    """Hashes of all runs of k words."""
    n = F.size(hashes) - k + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def _minima(grams: Column, w: int) -> Column:
    """The distinct minima of all windows of w grams."""
    if w == 1:
        return F.array_distinct(grams)
    n = F.size(grams) - w + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.least(*[F.get(grams, i + j) for j in range(w)])))).otherwise(F.array().cast("array<bigint>"))


def _families(items: DataFrame, window: int) -> list[tuple[int, int, int]]:
    """(words in a window, k, w): the common one, and one for each length of an item too short for it (under `window` values)."""
    k = min(K, window)
    short = [r[0] for r in items.where(f"n > 0 and n < {window}").select("n").distinct().collect()]
    return [(window, k, window - k + 1)] + [(n, n, 1) for n in sorted(short)]


def _fingerprints(df: DataFrame, families: list[tuple[int, int, int]]) -> DataFrame:
    """Adds gN for each family and fps: array<struct<family, fp>>; of short texts, only whole-item families count for items."""
    df = df.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    df = df.select("*", *[_grams(F.col("h"), k).alias(f"g{f}") for f, k, _ in families]).drop("h")
    named = lambda f: lambda x: F.struct(F.lit(f).alias("f"), x.alias("fp"))
    each = [F.transform(_minima(F.col(f"g{f}"), w), named(f)) for f, _, w in families]
    return df.withColumn("fps", F.concat(*each) if len(each) > 1 else each[0])


def _positions(families: list[tuple[int, int, int]]) -> Column:
    """Where the grams of the row's family equal its fp."""
    out = None
    for f, *_ in families:
        g = F.col(f"g{f}")
        at = F.filter(F.transform(g, lambda x, i: F.when(x == F.col("fp"), i)), lambda i: i.isNotNull())
        out = F.when(F.col("f") == f, at) if out is None else out.when(F.col("f") == f, at)
    return out


def _shifts(at: Column) -> Column:
    """The distinct differences between places in the document and places iq in the item. One place of the item is taken at
    a time, so that repeated words, which match everywhere, need no more room than there are differences."""
    # the places are bound to a variable first: within the inner function they would be found anew for each q
    bound = F.transform(F.array(at), lambda ps: F.aggregate("iq", F.array().cast("array<int>"), lambda have, q: F.array_union(have, F.transform(ps, lambda p: p - q))))
    return F.get(bound, F.lit(0))


def _spans(d: DataFrame) -> DataFrame:
    """Beside the words w of a document: the words iw of an item that match it when moved by d. Adds `found`: the positions
    in the document of all words in runs of at least f equal ones."""
    d = d.withColumn("lo", F.greatest("d", F.lit(0))).withColumn("len", F.greatest(F.lit(0), F.least(F.size("w"), F.col("d") + F.size("iw")) - F.col("lo")))
    same = F.zip_with(F.expr("slice(w, lo + 1, len)"), F.expr("slice(iw, lo - d + 1, len)"), lambda a, b: a == b)
    d = d.withColumn("same", same)
    breaks = F.concat(F.array(F.lit(-1)), F.filter(F.transform("same", lambda x, i: F.when(~x, i)), lambda i: i.isNotNull()), F.array(F.col("len")))
    d = d.withColumn("br", breaks)
    runs = F.zip_with(F.expr("slice(br, 1, size(br) - 1)"), F.expr("slice(br, 2, size(br) - 1)"), lambda a, b: F.when(b - a - 1 >= F.col("f"), F.sequence(F.col("lo") + a + 1, F.col("lo") + b - 1)))
    return d.withColumn("found", F.flatten(F.filter(runs, lambda r: r.isNotNull())))


def _report(found: DataFrame, keys: list[str]) -> DataFrame:
    """found: a row with n for each document, and rows with (found, item_id) for its hits, both by the same keys."""
    rows = found.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.count("n").alias("copies"),
        F.array_distinct(F.flatten(F.collect_list(F.when(F.size("found") > 0, F.col("found"))))).alias("hit"),
        F.array_sort(F.collect_set(F.when(F.size("found") > 0, F.col("item_id")))).alias("items"),
    )
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.size("hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per row of docs(doc_id, text, ...): doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is `window` consecutive words of an item of benchmark(item_id, text, ...); an item of fewer words, but not
    none, is one window. A word is hit inside any occurrence of a window. Null and empty texts have no words. An empty
    benchmark hits nothing; items_sha256 is then the hash of the empty string. Items with a null id count as item "null".
    Repeated rows give repeated results, and repeated items count once. Extra columns are ignored.
    """
    tune(docs.sparkSession)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), words(F.col("text")).alias("w")).withColumn("n", F.size("w")).where("n > 0").distinct()
    families = _families(items, window)
    # an item belongs to one family: the common one, or the one of its own length
    own = items.withColumn("own", F.when(F.col("n") >= window, window).otherwise(F.col("n")))
    marks = _fingerprints(own, families).withColumn("x", F.explode_outer("fps")).where("x.f = own").select("*", F.col("x.f").alias("f"), F.col("x.fp").alias("fp"))
    marks = marks.withColumn("iq", _positions(families)).select(F.col("f").alias("mf"), F.col("fp").alias("mfp"), "item_id", F.col("w").alias("iw"), "iq")
    marks = cut(marks)
    size = marks.agg(F.sum(F.size("iw") * 16 + F.size("iq") * 4 + 64)).first()[0] or 0

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    d = d.select("doc_id", F.xxhash64("text").alias("th"), words(F.col("text")).alias("w"))
    d = _fingerprints(d, families)
    keys = ["doc_id", "th"]
    own_row = F.array(F.struct(F.lit(0).alias("f"), F.xxhash64("doc_id", "th").alias("fp")))  # one row of its own for each document
    if size <= broadcast_bytes:
        x = d.withColumn("x", F.explode_outer(F.concat(own_row, F.col("fps")))).select("*", "x.f", "x.fp").drop("fps", "x")
        x = x.join(F.broadcast(marks), (F.col("f") == F.col("mf")) & (F.col("fp") == F.col("mfp")), "left").where("f = 0 or mf is not null")
        none = F.array().cast("array<int>")
        y = x.withColumn("f0", F.col("f") == 0)
        y = y.withColumn("iq", F.when(F.col("f0"), F.array(F.lit(0))).otherwise(F.col("iq"))).withColumn("iw", F.when(F.col("f0"), F.array().cast("array<string>")).otherwise(F.col("iw")))
        shift = F.when(F.col("f0"), F.array(F.lit(0))).otherwise(_shifts(_positions(families)))
        found = _spans(y.withColumn("d", F.explode_outer(shift)).where("d is not null"))
        found = found.select(*keys, F.when(F.col("f0"), F.size("w")).alias("n"), F.when(F.col("f0"), none).otherwise(F.col("found")).alias("found"), "item_id")
    else:
        marked = d.select(*keys, F.explode_outer("fps").alias("x")).select(*keys, "x.f", "x.fp")
        near = marked.join(marks.select(F.col("mf").alias("f"), F.col("mfp").alias("fp")).distinct(), ["f", "fp"]).groupBy(*keys).agg(F.collect_set(F.struct("f", "fp")).alias("fps"))
        near = near.select(F.col("doc_id").alias("k0"), F.col("th").alias("k1"), F.col("fps").alias("hit_fps"))
        y = d.drop("fps").join(near, F.col("doc_id").eqNullSafe(F.col("k0")) & (F.col("th") == F.col("k1"))).withColumn("x", F.explode_outer("hit_fps")).select("*", "x.f", "x.fp")
        y = y.join(marks, (F.col("f") == F.col("mf")) & (F.col("fp") == F.col("mfp")))
        shift = _shifts(_positions(families))
        hits = _spans(y.withColumn("d", F.explode_outer(shift)).where("d is not null")).select(*keys, F.lit(None).cast("int").alias("n"), "found", "item_id")
        found = hits.unionByName(d.select(*keys, F.size("w").alias("n"), F.array().cast("array<int>").alias("found"), F.lit(None).cast("string").alias("item_id")))
    return _report(found, keys)
