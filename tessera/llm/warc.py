"""Merkle fixity audit of WARC replicas.

Records hash to leaves; ordered offset ranges of a file, then ranges of ranges, then groups of files hash into trees up to
one root. Replicas are compared from the root down, and only the children of nodes that differ are looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, tune

RANGE_BYTES, FANOUT, FILE_RECORDS = 1 << 16, 16, 256


def as_records(pages: DataFrame) -> DataFrame:
    """WARC records (file, offset, length, payload) of pages(page_id, url, html): FILE_RECORDS ids to a file, in order of id.
    Null ids go to 4,096 files by the hash of their content, which grow with their number; null urls and html count as
    empty. Repeated rows are records each. An empty table gives no records; extra columns are ignored."""
    url, html = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("url", "html"))
    file = F.coalesce(F.concat(F.lit("part-"), F.floor(F.col("page_id") / FILE_RECORDS).cast("string")), F.concat(F.lit("none-"), F.substring(F.md5(F.concat(url, html)), 1, 3)))
    body = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"))
    rows = pages.select(file.alias("file"), F.col("page_id").alias("i"), url.alias("u"), body.alias("payload")).withColumn("length", F.octet_length("payload").cast("long"))
    w = Window.partitionBy("file").orderBy("i", "u", "payload").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("file", (F.sum("length").over(w) - F.col("length")).cast("long").alias("offset"), "length", "payload", "u")


def leaves(records: DataFrame) -> DataFrame:
    """(file, offset, length, digest): a leaf for each place. Records that share a place make one leaf, whatever their order."""
    d = records.select(F.coalesce(F.col("file").cast("string"), F.lit("")).alias("file"), F.coalesce(F.col("offset").cast("long"), F.lit(-1)).alias("offset"), F.coalesce(F.col("length").cast("long"), F.lit(0)).alias("length"), F.sha2(F.coalesce(F.col("payload").cast("binary"), F.lit(b"")), 256).alias("digest"))
    one = d.groupBy("file", "offset").agg(F.max("length").alias("length"), F.count("*").alias("n"), F.min("digest").alias("a"), F.max("digest").alias("b"), F.sum(F.xxhash64("digest").cast("decimal(38,0)")).alias("s"))
    many = F.sha2(F.concat_ws(",", F.col("n").cast("string"), "a", "b", F.col("s").cast("string")), 256)
    return one.select("file", "offset", "length", F.when(F.col("n") == 1, F.col("a")).otherwise(many).alias("digest"))


class Tree:
    """Levels from the leaves' ranges up; nodes are (key columns, digest). Each level is made by grouping the one below and
    written once: the descent reads nodes, not records."""

    def __init__(self, leaf: DataFrame, heights: tuple[int, int], range_bytes: int, fanout: int):
        self.leaf = leaf.withColumn("r", F.floor(F.col("offset") / range_bytes).cast("long"))
        self.levels = [self._up(self.leaf, ["file", "r"], F.struct("offset", "length", "digest"))]
        for _ in range(heights[0]):
            below = self.levels[-1]
            self.levels.append(self._up(below.select("file", F.floor(F.col("r") / fanout).cast("long").alias("r"), F.col("r").alias("c"), "digest"), ["file", "r"], F.struct("c", "digest")))
        below = self.levels[-1].select(F.pmod(F.xxhash64("file"), F.lit(fanout ** heights[1])).alias("g"), F.struct("file", "r").alias("c"), "digest")
        for _ in range(heights[1] + 1):
            self.levels.append(self._up(below, ["g"], F.struct("c", "digest")))
            below = self.levels[-1].select(F.floor(F.col("g") / fanout).cast("long").alias("g"), F.col("g").alias("c"), "digest")

    @staticmethod
    def _up(df: DataFrame, keys: list[str], child: Column) -> DataFrame:
        return cut(df.groupBy(*keys).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(child))), 256).alias("digest")))


def audit(primary: DataFrame, replica: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """file, offset, length, status, expected, found of each place where two replicas (file, offset, length, payload, ...)
    differ. status: corrupt, missing (from the replica) or extra. Equal replicas, two empty ones among them, give no rows.

    Null payloads count as empty, null files as "", null offsets as -1. A file's ranges hold range_bytes / record length
    records each, and a node `fanout` children, so no group of a tree grows with the data. Records that share a place count
    as one (see leaves), so repeated rows and ties in offset have one digest in any order. Very long payloads are hashed
    whole. Extra columns are ignored.
    """
    tune(primary.sparkSession)
    a, b = cut(leaves(primary)), cut(leaves(replica))
    both = a.select("file", "offset").unionByName(b.select("file", "offset"))
    last, files = both.agg(F.max("offset"), F.approx_count_distinct("file")).first()
    height = lambda n: max(0, math.ceil(math.log(max(1, n), fanout)))
    heights = (height((last or 0) // range_bytes + 1), height((files or 0) * 2))
    ta, tb = (Tree(x, heights, range_bytes, fanout) for x in (a, b))

    def differing(x: DataFrame, y: DataFrame, keys: list[str]) -> DataFrame:
        return x.withColumnRenamed("digest", "da").join(y.withColumnRenamed("digest", "db"), keys, "full").where(~F.col("da").eqNullSafe(F.col("db"))).select(*keys)

    # the groups of files, from the root down; then the ranges of the files found
    top = heights[0] + 1
    bad = None
    for level in range(len(ta.levels) - 1, top - 1, -1):
        x, y = ta.levels[level], tb.levels[level]
        if bad is not None:
            up = F.floor(F.col("g") / fanout).cast("long")
            near = bad.withColumnRenamed("g", "parent")
            x, y = (z.join(near, up == F.col("parent"), "left_semi") for z in (x, y))
        bad = cut(differing(x, y, ["g"]))
        if bad.isEmpty():
            return a.select("file", "offset", "length", F.lit("").alias("status"), F.col("digest").alias("expected"), F.col("digest").alias("found")).limit(0)
    group = F.pmod(F.xxhash64("file"), F.lit(fanout ** heights[1]))
    near = bad.withColumnRenamed("g", "parent")
    x, y = (t.levels[top - 1].join(near, group == F.col("parent"), "left_semi") for t in (ta, tb))
    bad = cut(differing(x, y, ["file", "r"]))
    for level in range(top - 2, -1, -1):
        near = bad.select(F.col("file").alias("f"), F.col("r").alias("parent"))
        x, y = (t.levels[level].join(near, (F.col("file") == F.col("f")) & (F.floor(F.col("r") / fanout).cast("long") == F.col("parent")), "left_semi") for t in (ta, tb))
        bad = cut(differing(x, y, ["file", "r"]))
    x, y = (t.leaf.join(bad, ["file", "r"], "left_semi").drop("r") for t in (ta, tb))
    x = x.select("file", "offset", F.col("length").alias("la"), F.col("digest").alias("expected"))
    y = y.select("file", "offset", F.col("length").alias("lb"), F.col("digest").alias("found"))
    out = x.join(y, ["file", "offset"], "full").where(~F.col("expected").eqNullSafe(F.col("found")))
    status = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "extra").otherwise("corrupt")
    return out.select("file", "offset", F.coalesce("la", "lb").alias("length"), status.alias("status"), "expected", "found")
