from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.functions import facts as V
from tessera.functions import text as T
from tessera.functions.intents import clamp_k, keywords, time_window
from tessera.operators import govern, lanes, paths, ties

NOW = datetime(2024, 1, 31)


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("name,want", [("The Keystone School", "keystone school"), ("Oakline, Inc.", "oakline"), ("  A  B Ltd ", "b"), ("Äpfel GmbH", "äpfel")])
def test_normalize(spark, name, want):
    assert one(spark, T.normalize_for_match(F.col("n")), n=name) == want


def test_location_and_wording(spark):
    assert one(spark, T.is_location_suffix(F.col("a"), F.col("b")), a="California", b="Fremont, California")
    assert not one(spark, T.is_location_suffix(F.col("a"), F.col("b")), a="Fremont", b="Fremont, California")
    assert one(spark, T.similar_wording(F.col("a"), F.col("b")), a="best paper award", b="Best Paper Award 2020")
    assert not one(spark, T.similar_wording(F.col("a"), F.col("b")), a="award", b="award 2020")


def test_role_and_records(spark):
    r = one(spark, V.role(F.col("v")), v="Founder at Acme at Large (Jan 2020 to Present)")
    assert (r.title, r.company, r.start, r.end, r.current) == ("Founder at Acme", "Large", "Jan 2020", "Present", True)
    e = one(spark, V.life_event(F.col("v")), v="home/moved | 2024-03-02 | to Lyon")
    assert (e.category, e.type, e.date, e.note) == ("home", "moved", "2024-03-02", "to Lyon")
    e = one(spark, V.life_event(F.col("v")), v="just text")
    assert (e.category, e.date, e.note) == (None, None, "just text")
    f = one(spark, V.favor(F.col("v")), v="owed to me | lent a drill | open")
    assert (f.direction, f.what, f.settled) == ("owed_to_me", "lent a drill", False)
    g = one(spark, V.gift(F.col("v")), v="birthday | 2024-05-01 | atlas")
    assert (g.occasion, g.date, g.gift) == ("birthday", "2024-05-01", "atlas")


@pytest.mark.parametrize("q,start,end", [("who did I meet last 2 weeks", datetime(2024, 1, 17), NOW), ("3 months ago", datetime(2023, 11, 1), datetime(2023, 12, 1)), ("yesterday", datetime(2024, 1, 30), NOW), ("last month", datetime(2023, 12, 1), datetime(2024, 1, 1)), ("june 2023", datetime(2023, 6, 1), datetime(2023, 7, 1)), ("in march", datetime(2023, 3, 1), datetime(2023, 4, 1)), ("this winter", datetime(2023, 12, 1), datetime(2024, 3, 1)), ("back then in 2015", datetime(2015, 1, 1), datetime(2016, 1, 1))])
def test_time_windows(q, start, end):
    assert time_window(q, NOW)[:2] == (start, end)


@pytest.mark.parametrize("q", ["April Chen", "March Capital", "who works at Oakline"])
def test_no_time_window(q):
    assert time_window(q, NOW) is None


def test_keywords_and_k():
    assert keywords("Who do I know at Oakline Oakline?") == ["oakline"]
    assert (clamp_k(0), clamp_k(99), clamp_k(8.9)) == (1, 32, 8)


def test_windows_are_half_open(spark):
    df = spark.createDataFrame([(1, 5), (5, None)], "s int, e int")
    assert [r.s for r in df.where(V.held_at(F.lit(5), F.col("s"), F.col("e"))).collect()] == [5]


def test_fusion_votes_once_and_boost_adds_only(spark):
    a = spark.createDataFrame([("a", "x", 0), ("a", "x", 1), ("a", "y", 2)], "lane string, id string, rank int")
    b = spark.createDataFrame([("b", "z", 0), ("b", "y", 1)], "lane string, id string, rank int")
    got = {r.id: r.score for r in lanes.fuse([a], [b]).collect()}
    assert got == {"x": pytest.approx(1 / 61), "y": pytest.approx(1 / 63 + 1 / 62)}


def test_paths(spark):
    links = spark.createDataFrame([("t", "a", "b"), ("t", "b", "c"), ("t", "a", "d"), ("t", "d", "c"), ("t", "c", "c")], "type string, source string, target string")
    strong = spark.createDataFrame([("d", 1.0)], "node_id string, score double")
    r = paths.cheapest(links, strong, "a", "c").first()
    assert (r.path, r.hops, r.cost, r.labels) == ("a>d>c", 2, pytest.approx(2.9), "t>t")
    assert paths.cheapest(links, strong, "a", "zz").count() == 0
    assert paths.cheapest(links, strong, "a", "a").first().hops == 0


def test_supersede_and_journal(spark):
    cols = "owner string, name string, value string, valid_from timestamp_ntz, valid_until timestamp_ntz, deleted_at timestamp_ntz"
    before = spark.createDataFrame([("n", "title", "CTO", None, None, None), ("n", "city", "Porto", None, None, None)], cols)
    changes = spark.createDataFrame([("n", "title", "CEO"), ("n", "city", "porto"), ("m", "city", "Lyon")], "owner string, name string, next string")
    after = govern.supersede(before, changes, F.expr("timestamp_ntz'2024-01-31 00:00:00'"))
    got = {(r.owner, r.name, r.value): (r.valid_from, r.valid_until) for r in after.collect()}
    assert got == {("n", "title", "CTO"): (None, NOW), ("n", "title", "CEO"): (NOW, None), ("n", "city", "Porto"): (None, None), ("m", "city", "Lyon"): (None, None)}
    assert sorted(r.op for r in govern.journal(before, after, ["owner", "name", "value"], "details").collect()) == ["created", "created", "patched"]


def test_batches_supersede_once_and_upsert_by_key(spark):
    cols = "owner string, name string, value string, valid_from timestamp_ntz, valid_until timestamp_ntz, deleted_at timestamp_ntz"
    before = spark.createDataFrame([("n", "title", "CTO", None, None, None)], cols)
    twice = spark.createDataFrame([("n", "title", "VP", 1), ("n", "title", "CEO", 2)], "owner string, name string, next string, ord int")
    after = govern.supersede(before, twice, F.expr("timestamp_ntz'2024-01-31 00:00:00'")).collect()
    assert sorted((r.value, r.valid_until is None) for r in after) == [("CEO", True), ("CTO", False)]
    rows = spark.createDataFrame([(None, "a"), (None, "b"), ("k", "c")], "id string, v string")
    once = govern.upsert(govern.upsert(rows.limit(0), rows, ["id"]), rows, ["id"])
    assert sorted((r.id or "", r.v) for r in once.collect()) == [("", "b"), ("k", "c")]
    with pytest.raises(govern.WriteRefused, match="not null: id"):
        govern.must_write(rows.limit(0), rows, ["id"], ["id"])


def test_sources_may_be_missing(spark, tmp_path):
    from tessera.sources.graph import Graph, touches

    assert touches(Graph(spark, str(tmp_path)).contacts()).count() == 0


def test_one_first_name_makes_no_pairs(spark):
    names = [(f"i{i}", f"anna q{i} x") for i in range(300)] + [("j", "anna q7"), ("k", "Anna Q7 X"), ("l", "bo r"), ("m", "Bo Reed")]
    got = {tuple(r) for r in paths.bridges(spark.createDataFrame(names, "id string, display_name string")).collect()}
    assert got == {("i7", "j"), ("i7", "k"), ("j", "k"), ("l", "m")}


def test_streams_count_as_tables_do(spark):
    from tessera.sources.graph import Graph
    from tessera.streaming import activity

    e = Graph(spark, "/root/testdata/sf0.001").interactions()
    assert activity.daily_activity(e).agg(F.sum("n")).first()[0] == e.count() == activity.sessions(e).agg(F.sum("n")).first()[0]


def test_no_signal_is_zero(spark):
    from tessera.sources.graph import now

    e = spark.createDataFrame([("a", NOW, True, 1.0), ("a", datetime(2025, 1, 1), True, 1.0)], "node_id string, at timestamp_ntz, genuine boolean, value double")
    s = ties.strength(ties.signal(e, now()), now())
    got = {r.node_id: r for r in ties.strengths_for(spark.createDataFrame([("a",), ("b",)], "node_id string"), s).collect()}
    assert got["a"].past_volume == 1 and got["a"].recency == 1.0 and got["b"].score == 0.0
