"""What the pipeline moves and leaves on disk."""

import random

import corpus_pipeline as pipeline
from tessera.llm import common


def words(rng, n=30):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))


def test_near_dedup_moves_no_texts_for_few_copies(spark):
    rng = random.Random(3)
    rows = [(i, words(rng), "en", "src", None) for i in range(12_000)]
    docs = spark.createDataFrame([*rows, *((20_000 + i, *rows[i][1:]) for i in range(9))], "doc_id long, text string, lang string, source string, n_chars long")
    at = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(at)
    spark.conf.set(at, "10k")  # the keys of all that is kept take more, those of what is dropped less
    try:
        found = pipeline.drop_copies(spark, docs, "")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert {r.doc_id for r in found.collect()} == {r[0] for r in rows}
    finally:
        spark.conf.set(at, old)


def test_stages_leave_their_results_only(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "one two three", "en", "src", 13)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")

    def stage(spark, docs, sf_dir):
        return common.cut(common.cut(docs)).where("doc_id > 0")

    monkeypatch.setattr(pipeline, "STAGES", [(str(i), stage) for i in range(4)])
    before = common.written()
    found = pipeline.run(spark, str(tmp_path))
    assert len(common.written() - before) == 3  # the third stage's result and the tables of the last one
    assert found.count() == 1
