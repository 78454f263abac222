"""Stages of the pipeline drop rows, not ids."""

import corpus_pipeline as pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLEAN = [f"the house number {i} by the water is other than the morning thought of it {i}" for i in range(40)]
ITEM = "ten words of a benchmark item that no document may hold at all"


def stage(spark, tmp_path, drop, rows):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(i, t, "en" if (t or "").isascii() else "ru", "src", None) for i, t in rows], SCHEMA)
    got = drop(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    return sorted(((r.doc_id, r.text) for r in got.collect()), key=repr)


def test_language_id_drops_rows(spark, tmp_path):
    clean = [*enumerate(CLEAN), (None, CLEAN[0])]
    rows = [*clean, (None, ""), (None, None), (3, ""), (4, "\u041c\u043e\u0441\u043a\u0432\u0430 " * 20)]
    assert stage(spark, tmp_path, pipeline.drop_foreign, rows) == sorted(clean, key=repr)


def test_near_dedup_drops_rows(spark, tmp_path):
    a, b, c = ("one two three four five six " + x for x in ("seven eight", "nine ten", "eleven twelve"))
    rows = [(5, a), (5, a), (2, a), (None, a), (None, b), (None, b), (7, c), (7, "quite another text than that"), (9, ""), (None, None)]
    want = [(2, a), (None, b), (7, c), (7, "quite another text than that"), (9, ""), (None, None)]
    assert stage(spark, tmp_path, pipeline.drop_copies, rows) == sorted(want, key=repr)


def test_decontamination_drops_rows(spark, tmp_path):
    clean = [(1, CLEAN[1]), (1, CLEAN[2]), (None, CLEAN[3])]
    assert stage(spark, tmp_path, pipeline.drop_contaminated, [*clean, (1, "x " + ITEM), (None, ITEM)]) == sorted(clean, key=repr)
