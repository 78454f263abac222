"""Cleaning of a training corpus in five stages, each on all that the one before has kept.

toxicity and language ID drop the documents they reject, near-dedup keeps the row of the smallest id of each group,
decontamination drops documents that hold a window of a benchmark item, packing returns the pieces of what is left. The
first four return the columns of documents. Rows are judged and dropped each for itself, also where a doc_id is null or repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, langid, neardup, packing, toxicity
from tessera.llm.common import cut, forget_but, table, written


KEY = "_row"


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of its own for each row, written so that it stays the same."""
    return cut(docs.withColumn(KEY, F.monotonically_increasing_id()))


def _named(keyed: DataFrame) -> DataFrame:
    """For operators, which name documents by their id: the key as doc_id."""
    return keyed.withColumn("doc_id", F.col(KEY)).drop(KEY)


def _without(keyed: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of keyed, without the key, but those in gone, keys which are written first so that their true number decides on the join."""
    return keyed.join(cut(gone.toDF(KEY).distinct()), KEY, "left_anti").drop(KEY)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_foreign(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _keyed(docs)
    judged = langid.identify_documents(_named(keyed), langid.fit(docs))
    return _without(keyed, judged.where("not accepted").select("doc_id"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _keyed(docs)
    found = neardup.near_duplicates(_named(keyed), percent=80).select(F.col("doc_id").alias(KEY), "component_id")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), KEY)
    # only the first of each component is named: no row needs to meet the others of its component
    first = found.join(keyed.select(KEY, place.alias("place")), KEY).groupBy("component_id").agg(F.min("place").alias("first"))
    # the fewer keys decide: texts move only where even those are too many to broadcast
    return _without(keyed, found.select(KEY).join(first.select(F.col(f"first.{KEY}").alias(KEY)), KEY, "left_anti"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _keyed(docs)
    found = decontaminate.decontaminate(_named(keyed), table(spark, sf_dir, "benchmark"))
    return _without(keyed, found.where("contaminated").select("doc_id"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("language_id", drop_foreign), ("near_dedup", drop_copies), ("decontamination", drop_contaminated), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; of the tables that a stage and those before it wrote, only its result stays."""
    docs, before = table(spark, sf_dir, "documents"), written()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
            forget_but(before, docs)
    return docs
