"""Vector search where similarities differ by less than what its SQL rounds off."""

import random

import duckdb
import pytest

from tessera.operators import recall
from tessera.plans.catalog import QUERIES, SQL


def near_copies(n):
    rng = random.Random(9)
    first = [rng.gauss(0, 1) for _ in range(64)]
    return [(i, [x + (rng.gauss(0, 1) * 1e-4 * (n - i) / n if i else 0) for x in first]) for i in range(n)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("vectors")
    spark.createDataFrame(near_copies(400), "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{at}/embeddings.parquet")
    return at


@pytest.mark.parametrize("name", ["vector_topk", "hybrid_recall"])
def test_near_copies_rank_as_in_sql(name, spark, folder):
    db = duckdb.connect()
    db.sql(f"create view embeddings as select * from '{folder}/embeddings.parquet/*.parquet'")
    if name == "hybrid_recall":
        for table, columns in (("customer", "c_custkey long, c_name string, c_mktsegment string, c_acctbal double"), ("supplier", "s_suppkey long, s_name string"), ("nation", "n_nationkey long, n_name string"), ("region", "r_regionkey long, r_name string"), ("part", "p_partkey long, p_name string, p_brand string, p_type string")):
            spark.createDataFrame([], columns).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    got = [tuple(r) for r in QUERIES[name](spark, str(folder)).collect()]
    assert sorted(got) == sorted(db.sql(SQL[name]).fetchall())


def test_cosine_has_the_bits_of_sql(spark, folder):
    db = duckdb.connect()
    table = f"'{folder}/embeddings.parquet/*.parquet'"
    want = dict(db.sql(f"select vec_id, list_cosine_similarity(embedding::double[], (select embedding::double[] from {table} where vec_id = 7)) from {table}").fetchall())
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    query = vectors.where("vec_id = 7").first().embedding
    assert {r[0]: r[1] for r in vectors.select("vec_id", recall.cosine(vectors.embedding, query)).collect()} == want
    blank = spark.createDataFrame([([0.0, 0.0],), ([float("nan"), 1.0],)], "embedding array<float>")
    assert all(r[0] != r[0] for r in blank.select(recall.cosine(blank.embedding, [1.0, 2.0])).collect())
