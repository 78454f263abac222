"""Nulls in any column, empty and very long texts, ties and repeated rows, empty tables, and extra columns whose names clash."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tessera.llm import ann, decontaminate, htmlextract, langid, licenses, neardup, packing, textkernels, toxicity, urlfilter, warc

RNG = random.Random(11)
CLASHES = "n found sig bands h1 h2 rep comp component key w words tokens host domain part parts path rule verdict score rank length file offset digest r u p x a b t0 units top shard block own dim d f fp fps iw iq lo th salt chars bad good weight _row place first low high at held_out predicted".split()


def clashing(df):
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES if c not in df.columns])


def words(n):
    return " ".join("".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 7))) for _ in range(n))


LONG = words(300_000)
#: A null id, a null text, empty and blank ones, a very long one, repeated rows, and rows that are all null.
DOCS = [(1, "the red house by the water"), (1, "the red house by the water"), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (None, "a text without an id"), (None, None), (6, "x"), (7, "the red house by the water")]
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows=DOCS):
    return clashing(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOC))


def test_words_of_a_long_text_are_those_of_its_slices(monkeypatch):
    monkeypatch.setattr(textkernels, "_AT_ONCE", 64)
    small = [words(200), None, "", "one", "x" * 1000 + " y", words(50)]
    got = textkernels.hash_words(small)
    langs = [langid.trigrams(t) for t in small]
    monkeypatch.setattr(textkernels, "_AT_ONCE", 1 << 20)
    want = textkernels.hash_words(small)
    assert all((x == y).all() for x, y in zip(got, want))
    assert all((x == langid.trigrams(t)).all() for x, t in zip(langs, small))


def test_fixity(spark):
    rows = [(1, "http://a/1", "x" * 3_000_000), (1, "http://a/1", "x"), (2, None, None), (None, None, None), (None, "u", ""), (3, "", "y"), (3, "", "y")]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    records = warc.as_records(pages)
    assert records.count() == len(rows)
    other = records.withColumn("payload", F.when(F.col("u") == "u", F.lit("z")).otherwise(F.col("payload")))
    got = warc.audit(clashing(records), clashing(other)).collect()
    assert [r.status for r in got] == ["corrupt"]
    assert warc.audit(warc.as_records(pages.limit(0)), records).count() == records.select("file", "offset").distinct().count()


def test_decontamination(spark):
    items = clashing(spark.createDataFrame([(1, "red house"), (1, "red house"), (None, "without an id"), (2, None), (3, "")], "item_id long, text string"))
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.decontaminate(docs(spark), items).collect()), key=repr)
    want = [(1, 6, 2, 1, True), (1, 6, 2, 1, True), (2, 0, 0, 0, False), (3, 0, 0, 0, False), (4, 0, 0, 0, False), (5, 300_000, 0, 0, False), (None, 5, 3, 1, True), (None, 0, 0, 0, False), (6, 1, 0, 0, False), (7, 6, 2, 1, True)]
    assert got == sorted(want, key=repr)
    assert decontaminate.decontaminate(docs(spark).limit(0), items).count() == 0


@pytest.mark.parametrize("limit", [1 << 25, 0])
def test_decontamination_of_repeated_words(spark, limit):
    d = spark.createDataFrame([(1, "x " * 3000), (2, "x " * 9)], "doc_id long, text string")
    got = decontaminate.decontaminate(d, spark.createDataFrame([(1, "x " * 400)], "item_id long, text string"), broadcast_bytes=limit)
    assert sorted((r.doc_id, r.n_words, r.n_hit) for r in got.collect()) == [(1, 3000, 3000), (2, 9, 0)]


def test_toxicity(spark):
    labels = clashing(spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, None), (99, 1)], "doc_id long, toxic int"))
    model = toxicity.fit(docs(spark), labels)
    got = toxicity.score(docs(spark), model).collect()
    assert len(got) == len(DOCS) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 7)}) == 1
    assert toxicity.keep(docs(spark), model).columns == docs(spark).columns
    assert toxicity.score(docs(spark).limit(0), model).count() == 0
    assert toxicity.score(docs(spark), toxicity.fit(docs(spark).limit(0), labels.limit(0))).count() == len(DOCS)


def test_scores_do_not_depend_on_neighbours():
    weights = np.random.default_rng(1).normal(size=1 << toxicity.BITS)
    texts = [words(RNG.randint(0, 400)) for _ in range(50)]
    assert (toxicity.scores(texts, weights, 0.1) == np.concatenate([toxicity.scores([t], weights, 0.1) for t in texts])).all()


def test_language_id(spark):
    model = langid.fit(docs(spark).withColumn("lang", F.lit("en")), per_language=3)
    got = langid.identify_documents(docs(spark), model).collect()
    assert len(got) == len(DOCS) and not any(r.accepted for r in got if r.doc_id in (2, 3, 4))
    pages = clashing(spark.createDataFrame([(i, None if i == 2 else f"http://h.example.com/{i}", t) for i, t in DOCS], "page_id long, url string, html string"))
    got = langid.identify_pages(pages, model).collect()
    assert len(got) == len(DOCS) and len({r.posterior for r in got if r.page_id == 1}) == 1
    assert langid.identify_pages(pages.limit(0), model).count() == langid.identify_documents(docs(spark).limit(0), model).count() == 0


def test_packing(spark):
    got = packing.pack(docs(spark)).collect()
    first = [r for r in got if r.piece == 0]
    assert len(first) == len(DOCS) and sum(r.length == 1 for r in first) == 3
    for r in got:
        assert 1 <= r.length <= 1024 and r.offset + r.length <= 1024
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)


def test_licenses(spark):
    rows = [*DOCS, (8, LONG + ". Released under the MIT License. " + LONG), (9, "Licensed under CC BY-SA 4.0. " * 500), (9, "Licensed under CC BY-SA 4.0. " * 500)]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, rows)).collect()}
    assert got[8].licenses == "MIT" and got[9].n_confirmed == 500 and got[2].n_blocks == got[5].n_blocks == 0
    assert licenses.scan(docs(spark, rows)).count() == len(rows) and licenses.scan(docs(spark).limit(0)).count() == 0
    assert licenses.found(docs(spark, rows)).where("confirmed").count() == 1001


def test_neighbours(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (None, [1.0, 1.0]), (4, None), (5, []), (20, [0.0, 1.0]), (40, [1.0])]
    got = ann.search(clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))).collect()
    by = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got)
    assert by == [(0, 1, 3, 2.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0), (0, 4, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0), (20, 4, 3, 0.0)]


def test_url_filter(spark):
    long = "http://h.example.com/" + "freebets" * 20_000
    rows = [(1, "http://a.example.com/en/1", None), (1, "http://a.example.com/en/1", None), (None, None, None), (2, "", ""), (3, "://", ""), (4, long, "free bets"), (5, "HTTP://A.Example.COM", "x")]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    counts = urlfilter.word_counts(pages, "html")
    got = urlfilter.judge(pages, counts).collect()
    assert sorted((r.page_id or 0, r.host, r.verdict) for r in got) == [(0, "", "allow"), (1, "a.example.com", "block"), (1, "a.example.com", "block"), (2, "", "allow"), (3, "", "allow"), (4, "h.example.com", "block"), (5, "a.example.com", "allow")]
    assert urlfilter.judge(pages.limit(0), counts.limit(0)).count() == 0
    # two rules of one length: the nearer host's; of equal ones, the first
    tree = urlfilter.rule_tree((("block", "b.c/d"), ("allow", "a.b.c"), ("allow", "b.c/d")))
    assert urlfilter.apply_rules(tree, "a.b.c", "/d") == ("allow", "a.b.c") and urlfilter.apply_rules(tree, "x.b.c", "/d") == ("block", "b.c/d")


def test_main_text(spark):
    long = "<article>" + "".join(f"<p>{words(40)}</p>" for _ in range(8000)) + "</article>"
    rows = [(1, "http://h/1", "<p>one</p>"), (1, "http://h/1", "<p>one</p>"), (2, None, None), (None, None, "<p>none"), (3, "http://h/3", ""), (4, "http://h/4", long), *((10 + i, "http://h/x", f"<main><p>text {i}</p></main>") for i in range(200))]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    for hosts in (10, 0):
        got = {r.page_id: r for r in htmlextract.extract_pages(pages, group=8, broadcast_hosts=hosts).collect()}
        assert len(got) == len({r[0] for r in rows}) and got[1].text == "one" and got[2].text == got[3].text == "" and got[None].text == "none"
        assert got[4].text == "\n".join(re.findall("<p>(.*?)</p>", long)) and got[15].text == "text 5"
    assert htmlextract.extract_pages(pages).count() == len(rows) and htmlextract.extract_pages(pages.limit(0)).count() == 0


def test_near_duplicates(spark):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs(spark)).collect()), key=repr)
    own = LONG.split()
    n = len({tuple(own[i : i + 5]) for i in range(len(own) - 4)})
    want = [(1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, n, 5, True), (None, 1, None, False), (None, 0, None, False), (6, 1, 6, True), (7, 2, 1, False)]
    assert got == sorted(want, key=repr)


STAGES = dict(pipeline.STAGES)


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_stages_keep_clean_rows_and_columns(name, spark, tmp_path):
    clashing(spark.createDataFrame([(1, "zz yy xx ww vv uu tt ss rr qq")], "item_id long, text string")).write.parquet(str(tmp_path / "benchmark.parquet"))
    clashing(spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")).write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(1, words(60), "en"), (2, words(60), None), (None, words(50), "en"), (3, words(5), "en"), (4, LONG, "en")]
    held = clashing(spark.createDataFrame([(i, t, x, None, None) for i, t, x in rows], DOC)).drop("_row")
    got = STAGES[name](spark, held, str(tmp_path))
    assert got.columns == held.columns and sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(((i, t) for i, t, _ in rows), key=repr)
    assert STAGES[name](spark, held.limit(0), str(tmp_path)).count() == 0


def test_stages_reject(spark, tmp_path):
    item = "zz yy xx ww vv uu tt ss rr qq"
    rows = [(i, f"{words(30)} idiot scum trash" if i % 4 == 0 else words(30), "en") for i in range(600)] + [(1000, None, "en"), (1001, "東京 " * 30, "ja"), (1002, f"{words(20)} {item} {words(9)}", "en"), (1003, words(40), "en")]
    rows += [(1004, rows[-1][1], "en"), (None, rows[-1][1] + " more", "en")]
    docs = spark.createDataFrame([(i, t, x, "s", None) for i, t, x in rows], DOC)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    packed = {r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect()}
    # by brute force: what holds the toxic words, no language, the item, or is another's copy goes
    want = {i for i, t, _ in rows if t and "idiot" not in t and item not in t and not t.startswith("東")} - {1004, None}
    assert packed == want


def test_a_cluster_must_name_its_shared_folder(monkeypatch):
    from tessera.llm import common

    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

        def getConf(self):
            return {}

    spark = type("Session", (), {"sparkContext": Context(), "conf": {}})()
    with pytest.raises(RuntimeError):
        common.shared_dir(spark)
