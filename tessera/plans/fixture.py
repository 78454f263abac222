"""A small graph with every kind of row, for queries that the driver's tables can't exercise; rows are constants."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from ..operators.structured import Store

NOW = datetime(2024, 1, 31)
NODES = [
    ("n01", "u1", "Person", "Self Same", None, None), ("n02", "u1", "Person", "Ava Yu", None, None), ("n03", "u1", "Person", "Ben Ode", None, None),
    ("n04", "u1", "Person", "Cy Dahl", None, None), ("n05", "u1", "Person", "Dee Gone", datetime(2024, 1, 1), None), ("n06", "u1", "Organization", "Meta", None, None),
    ("n07", "u1", "Organization", "Rednote Venture", None, None), ("n08", "u1", "Person", "Eva Lind", None, None), ("n09", "u1", "City", "Porto", None, None),
    ("n10", "u1", "Person", "John Doe", None, "satellite"), ("n11", "u1", "Person", "John Doe", None, None), ("n12", "u2", "Person", "Ava Yu", None, None),
    ("n13", "u1", "Organization", "The Keystone School", None, None), ("n14", "u1", "Person", "Katherine Moss", None, None),
]
LINKS = [
    ("l1", "u1", "co_founder", "n01", "n02"), ("l2", "u1", "employee", "n03", "n06"), ("l3", "u1", "employee", "n04", "n07"), ("l4", "u1", "friend", "n08", "n01"),
    ("l5", "u1", "founder", "n01", "n07"), ("l6", "u1", "colleague", "n01", "n05"), ("l7", "u1", "lives_in", "n02", "n09"), ("l8", "u2", "employee", "n12", "n06"),
    ("l9", "u1", "colleague", "n01", "n06"),
]
_D = [  # id, node, name, value, from, until, created, deleted, source, confirmed
    ("d01", "n07", "industry", "Venture Capital", None, None, "LinkedIn", True), ("d02", "n04", "title", "Partner", None, None, "LinkedIn", True),
    ("d03", "n08", "company", "Meta", None, None, "Notes", False), ("d04", "n14", "company", "Metabase", None, None, "Notes", True),
    ("d05", "n02", "location", "Porto, Portugal", None, None, "Notes", True), ("d06", "n03", "favor_owed", "i owe | lunch | open", None, None, "Notes", True),
    ("d07", "n08", "favor_owed", "owes me | a ride | settled", None, None, "Notes", True), ("d08", "n04", "favor_owed", "wrote me a letter", None, None, "Notes", True),
    ("d09", "n02", "gift_idea", "birthday | an atlas", None, None, "Notes", True), ("d10", "n08", "gift_idea", "tea", None, None, "Notes", True),
    ("d11", "n02", "life_event", "family/married | 2024-05-01 | in Lyon", None, None, "Notes", True), ("d12", "n03", "life_event", "Work/new_job | 2023-03-01", None, None, "Notes", True),
    ("d13", "n04", "life_event", "retired early", None, None, "Notes", True), ("d14", "n02", "title", "CEO", datetime(2023, 6, 1), None, "Chat", True),
    ("d15", "n02", "title", "CTO", datetime(2020, 1, 1), datetime(2023, 6, 1), "Chat", True), ("d16", "n02", "title", "Intern", None, datetime(2020, 1, 1), "Chat", True),
    ("d17", "n02", "note", "wrong", None, None, "Chat", True),
]
CREATED = datetime(2019, 1, 1)
DETAILS = [(i, "u1", n, k, v, a, b, CREATED, b if b else (datetime(2022, 1, 1) if i == "d17" else None), s, c) for i, n, k, v, a, b, s, c in _D]
LEDGER = [
    ("g1", "u1", "n02", "debt", "tickets", 50.0, "USD", "owed_by_me", "2024-02-01", False), ("g2", "u1", "n03", "debt", "rent", 12.5, "EUR", "owed_to_me", None, False),
    ("g3", "u1", "n04", "favor_owed", "moved a sofa", None, None, None, None, False), ("g4", "u1", "n08", "debt", "paid", 5.0, None, "owed_to_me", None, True),
    ("g5", "u1", "n02", "gift_given", "a scarf", None, None, "none", "2023-12-24", True), ("g6", "u1", "n08", "gift_given", "a book", None, None, "none", None, True),
    ("g7", "u1", "n04", "gift_received", "wine", None, None, "none", "2022-01-02", True), ("g8", "u2", "n12", "debt", "other", 9.0, "USD", "owed_to_me", None, False),
]
ALIASES = [("a1", "n03", "Benjamin"), ("a2", "n10", "Jay"), ("a3", "n14", "Kate")]
VECTORS = [("n02", [1.0, 0.0]), ("n03", [0.8, 0.6]), ("n04", [0.0, 1.0]), ("n05", [1.0, 0.0]), ("n12", [1.0, 0.0]), ("n08", None)]


def frames(spark: SparkSession) -> dict[str, DataFrame]:
    make = spark.createDataFrame
    return {
        "nodes": make(NODES, "id string, user_id string, type string, display_name string, deleted_at timestamp_ntz, graph_layer string"),
        "links": make(LINKS, "id string, user_id string, type string, source string, target string"),
        "details": make(DETAILS, "id string, user_id string, node_id string, name string, value string, valid_from timestamp_ntz, valid_until timestamp_ntz, created_at timestamp_ntz, deleted_at timestamp_ntz, source string, confirmed boolean"),
        "ledger": make([(*r, None) for r in LEDGER], "id string, user_id string, node_id string, kind string, description string, amount double, currency string, direction string, date string, settled boolean, deleted_at timestamp_ntz"),
        "aliases": make(ALIASES, "id string, node_id string, alias_text string"),
        "vectors": make(VECTORS, "id string, embedding array<double>"),
    }


def store(spark: SparkSession, user: str = "u1") -> Store:
    f = frames(spark)
    made = Store.of(user, f["nodes"], f["links"], f["details"], f["ledger"], "n01")
    return Store(made.nodes, made.links, made.details, f["ledger"].where(f"user_id = '{user}'"), "n01")
