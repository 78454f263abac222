"""Queries over cases: each holds inputs that take every branch of a rule, and its SQL the results that the rule asks for."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import facts as V
from ..functions import intents as I
from ..functions import text as T
from ..operators import dedupe
from .catalog import QUERIES, SQL

c = F.col


def _sql(rows: list[tuple], names: list[str]) -> str:
    texts = {i for r in rows for i, v in enumerate(r) if isinstance(v, str)}

    def cell(i, v) -> str:
        if v is None:
            return "cast(null as varchar)" if i in texts or not any(r[i] is not None for r in rows) else "null"
        return str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    listed = ", ".join("(" + ", ".join(cell(i, v) for i, v in enumerate(r)) + ")" for r in rows)
    named = ", ".join(f'"{x}"' for x in names)
    return f"select * from (values {listed}) v({named})"


def cases(name: str, inputs: str, rows: list[tuple], result: Callable | None = None) -> None:
    """Registers a query: rows hold the inputs and, last, the result; `result` is a column of the inputs, or a function on the
    driver where the rule reads a question."""
    fields = [x.split()[0] for x in inputs.split(", ")]

    def run(spark, sf_dir) -> DataFrame:
        numbered = [(i, *r[:-1]) for i, r in enumerate(rows)]
        if len(fields) == 1 and fields[0] == "question":
            return spark.createDataFrame([(i, q, result(q)) for i, q in numbered], "n long, question string, result string")
        df = spark.createDataFrame(numbered, f"n long, {inputs}")
        return df.select("n", *fields, result(*[c(f) for f in fields]).alias("result"))

    QUERIES[name] = run
    SQL[name] = _sql([(i, *r) for i, r in enumerate(rows)], ["n", *fields, "result"])


cases("merge_text_cases", "old string, new string", [
    ("Hi there!", "New one.", "Hi there! New one."), (None, "New.", "New."), ("Old", None, "Old"), ("Likes tea", "likes TEA and cake", "likes TEA and cake"), ("Likes tea and cake", "Tea", "Likes tea and cake"),
    ("She paints. She sings.", "She sings. She dances.", "She paints. She sings. She dances."), ("Knows Ben", "Met in Oslo", "Knows Ben. Met in Oslo"), ("Is it so?", "No. is it so?", "No. is it so?"), ("", "x", "x"), ("a. b.", "B. A.", "a. b."),
], T.merge_text)
cases("match_quality_cases", "name string", [
    ("Big Acme Corp", "strong"), ("acme corp", "exact"), ("The Acme, Inc.", "exact"), ("Acmeville", "weak_partial"), ("ACME CORP ", "exact"), ("Corp of Acme", "strong"), ("Acme", "exact"),
], lambda n: T.match_quality("acme corp", n))
cases("values_differ_cases", "a string, b string", [("Stripe", " stripe ", False), ("Stripe", "Square", True), (None, None, False), (None, "x", True), ("a  b", "a b", True)], T.differs)
cases("also_spelled_cases", "value string, name string", [
    ("Steven, Stephen; Stefan / Steph | Stef or Steve or S or Stu or Stevie", "Stephen", "Steven+Stefan+Steph+Stef+Steve+Stu"), ("", "x", ""), (None, "x", ""), ("Ann or ANN", "ann", ""),
], lambda v, n: F.array_join(T.also_spelled(v, n), "+"))
cases("uuid_cases", "value string", [("0b5f3a52-8d8e-4b43-9d0b-6a1f8a1e2c3d", True), ("0B5F3A52-8D8E-4B43-9D0B-6A1F8A1E2C3D", True), ("Ann", False), ("0b5f3a52-8d8e-4b43-9d0b-6a1f8a1e2c3", False), (None, False)], T.is_uuid)
cases("json_scalars", "value string", [('"Porto"', "Porto"), ("42", "42"), ("true", "true"), ('{"a":1}', '{"a":1}'), ("Porto", "Porto"), ("two words", "two words"), (None, None)], T.plain)
cases("source_labels", "title string", [
    ("Network updates: August", "Research"), ("Web enrichment: Ann", "Research"), ("MCP", "Your agent"), ("Capture · Zara | LinkedIn", "Extension"), ("web capture", "Extension"), ("Import from Dex", "Other tools"),
    ("Added by hand", "Added by hand"), ("WhatsApp chats", "WhatsApp"), ("My iMessage", "iMessage"), ("Apple Contacts", "Apple Contacts"), ("Apple Calendar", "Apple Calendar"), ("apple mail", "Apple Mail"), ("Granola notes", "Granola"),
    ("Fireflies", "Fireflies"), ("Gmail sweep", "Gmail"), ("Calendar sync", "Calendar"), ("Contacts", "Google Contacts"), ("LinkedIn import", "LinkedIn"), ("a spreadsheet", "Spreadsheets"), ("x.csv", "Spreadsheets"), ("Upload 3", "Uploads"), (None, "Your agent"), ("hello", "Your agent"),
], T.source_label)
cases("entity_kinds", "type string", [("Organization", "org"), ("Event", "event"), ("Location", "location"), ("Person", "person"), ("City", "other"), (None, "other")], T.entity_kind)
cases("shortened_titles", "value string", [("x" * 90, "x" * 90), ("y" * 91, "y" * 89 + "…"), ("", ""), (None, None)], lambda v: T.shortened(v, 90))
_STRUCT = lambda s: F.when(s.isNotNull(), F.to_json(s))
cases("education_cases", "value string", [
    ('{"school":" Stanford ","degree":"BS","start":"2012","end":"2016"}', '{"school":"Stanford","degree":"BS","field":"","start":"2012","end":"2016"}'),
    ("Stanford Online High School", '{"school":"Stanford Online High School","degree":"","field":"","start":"","end":""}'),
    ("BS, Computer Science, Stanford (2012-2016)", '{"school":"Stanford","degree":"BS, Computer Science","field":"","start":"2012","end":"2016"}'),
    ("MIT (2011 to 2015)", '{"school":"MIT","degree":"","field":"","start":"2011","end":"2015"}'), ("MIT (2015)", '{"school":"MIT","degree":"","field":"","start":"","end":"2015"}'),
    ("", None), (None, None), ("{broken", None), ('{"degree":"BS"}', None), ("BS,", None),
], lambda v: _STRUCT(V.education(v)))
cases("role_cases", "value string", [
    ("Founder at Acme at Large (Jan 2020 to Present)", "Founder at Acme|Large|Jan 2020|Present|true"), ("Meta", "|Meta|||true"), ("Lead at Oak (2012-2016)", "Lead|Oak|2012|2016|false"), ("dev at Oak (2019)", "dev|Oak|2019||true"), ("CTO AT Elm (May 2020 to now)", "CTO|Elm|May 2020|now|true"),
], lambda v: F.concat_ws("|", *[V.role(v)[k].cast("string") for k in ("title", "company", "start", "end", "current")]))
cases("role_formats", "company string, title string, start string, end string", [
    ("Acme", "Founder", "Apr 2023", "Mar 2026", "Founder at Acme (Apr 2023 to Mar 2026)"), ("Acme", None, None, None, "Acme"), ("Acme", "", "2020", " ", "Acme (2020)"), (" ", "x", "1", "2", ""), (None, "x", None, None, ""),
], V.format_role)
cases("education_formats", "school string, degree string, level string, field string, start string, end string", [
    ("MIT", "BS", None, "CS", "", "2016", '{"school":"MIT","degree":"BS","field":"CS","end":"2016"}'), (" ", "BS", None, None, None, None, ""), ("MIT", None, None, None, None, None, '{"school":"MIT"}'),
], V.format_education)
cases("education_summaries", "a string, b string, d string", [
    ("BS, MIT", "bs, mit", "Oak School", "BS MIT; Oak School"), ("MIT", "BS, MIT", "MIT", "MIT; BS MIT"),
], lambda *v: V.education_summary(F.array_compact(F.array(*[V.education(x) for x in v]))))
cases("life_event_cases", "value string", [
    ("home/moved | 2024-03-02 | to Lyon", "home|moved|2024-03-02|to Lyon"), ("just text", "-|-|-|just text"), ("Work/ | x", "work|-|-|x"), ("pets/dog | 2020-01-01 | cat", "-|-|2020-01-01|pets/dog | cat"), ("family/married | on 2021-05-06 | fun", "family|married|2021-05-06|on 2021-05-06 | fun"), ("work/a | home/b", "work|a|-|home/b"),
], lambda v: F.concat_ws("|", *[F.coalesce(V.life_event(v)[k], F.lit("-")) for k in ("category", "type", "date", "note")]))
cases("favor_cases", "value string", [
    ("owed to me | lent a drill | open", "owed_to_me|lent a drill|false"), ("I owe them | fifty | done", "owed_by_me|fifty|true"), ("free text", "-|free text|false"), ("they owe me | settled | open | x", "owed_to_me|x|false"), ("owes me", "owed_to_me|owes me|false"), ("a | b | repaid", "-|a | b|true"),
], lambda v: F.concat_ws("|", F.coalesce(V.favor(v)["direction"], F.lit("-")), V.favor(v)["what"], V.favor(v)["settled"].cast("string")))
cases("gift_cases", "value string", [
    ("birthday | 2024-05-01 | atlas", "birthday|2024-05-01|atlas"), ("tea", "-|-|tea"), ("2024-05-01 | atlas", "-|2024-05-01|atlas"), ("wedding | plates | bowls", "wedding|-|plates | bowls"), ("2020-02-02", "-|2020-02-02|2020-02-02"),
], lambda v: F.concat_ws("|", *[F.coalesce(V.gift(v)[k], F.lit("-")) for k in ("occasion", "date", "gift")]))
cases("date_cases", "value string", [("2024-05-01T10:00:00Z", "2024-05-01"), ("May 1, 2024", "2024-05-01"), ("soon", None), (None, None), ("5/1/2024", "2024-05-01"), ("1 May 2024", "2024-05-01")], V.normalize_date)
cases("normalized_details", "value string", [
    ('[{"name":"email","value":"a@b.c"},{"name":" ","value":"x"},{"name":"n","value":["a","b"]},{"name":"o","value":{"k":1}},{"name":"z","value":null}]', "email=a@b.c;n=a;n=b"), ('{"email":"a@b.c","age":42,"ok":true,"tags":["x"," y "],"deep":{"a":1},"none":null}', "email=a@b.c;age=42;ok=true;tags=x;tags=y"), ("", ""), (None, ""), ("[]", ""), ("text", ""),
], lambda v: F.array_join(F.transform(V.details(v), lambda d: F.concat_ws("=", d["name"], d["value"])), ";"))
_J = '{"school":"Stanford"}'
cases("canonical_keys", "name string, value string", [
    ("education_entry", _J, "stanford#"), ("education_entry", "Stanford", "stanford#"), ("education_entry", "BS, Stanford (2012-2016)", "stanford#degree=bs|end=2016|start=2012"), ("past_role", "CTO at Elm (2019 to Present)", "elm#start=2019|title=cto"), ("honor", " Best  Paper ", "best paper#"), ("email", " A@B.c ", "a@b.c"), ("education_entry", "{broken", "{broken"),
], dedupe.canonical_key)
_PAIRS = [
    ("education_entry", _J, "stanford", "equal"), ("education_entry", "BS, Stanford", _J, "a_covers_b"), ("education_entry", _J, "BS, Stanford", "b_covers_a"), ("education_entry", "BS, Stanford", "MS, Stanford", "different"), ("education_entry", "BS, Stanford", "Stanford (2012-2016)", "different"), ("past_role", "CTO at Elm", "Elm", "a_covers_b"),
    ("past_role", "CTO at Elm (2019 to now)", "CTO at Elm (2019)", "equal"), ("honor", "Best Paper", "best  paper", "equal"), ("email", "a@b", "A@B ", "equal"), ("email", "a@b", "a@c", "different"), ("current_role", "CTO at Elm", "CTO at Oak", "different"),
]
cases("compared_values", "name string, a string, b string", _PAIRS, dedupe.compare)
cases("richer_values", "name string, a string, b string", [
    ("education_entry", "Stanford", _J, _J), ("education_entry", "BS, Stanford", _J, "BS, Stanford"), ("past_role", "Elm", "CTO at Elm", "CTO at Elm"), ("honor", "Best Paper", "Best  Paper!", "Best  Paper!"), ("email", "aa", "bb", "aa"),
], dedupe.richer)
cases("near_dupes", "name string, a string, b string", [
    ("education_entry", "University of California", "University of California Berkeley", True), ("education_entry", "Western Ontario University", "Western Ontario University Canada", True), ("education_entry", "Harvard", "Harvard Business School", False),
    ("education_entry", "BS, North Oak College", "MS, North Oak College West", False), ("past_role", "Lead Data Engineer at Elm", "Data Engineer at Elm", True), ("past_role", "CTO at Red Oak Labs", "CTO at Red Oak Labs West", True), ("past_role", "CTO at Elm", "CEO at Elm", False),
    ("honor", "Best Paper Award", "Award for Best Paper 2020", True), ("honor", "Best Paper", "best paper", False), ("email", "a b c", "a b c d", False),
], dedupe.near_dupe)
_NOW = datetime(2024, 1, 31)


def _window(q: str) -> str | None:
    w = I.time_window(q, _NOW)
    return w and f"{w.start:%Y-%m-%d}|{w.end:%Y-%m-%d}|{w.phrase}|{str(w.open_ended).lower()}|{I.strip_time_phrase(q, w)}"


cases("time_windows", "question string", [
    ("who did I meet last 2 weeks", "2024-01-17|2024-01-31|last 2 weeks|true|who did I meet"), ("past three months", "2023-11-02|2024-01-31|past three months|true|"), ("two weeks ago with Ann", "2024-01-15|2024-01-22|two weeks ago|false|with Ann"), ("past 0 days", None), ("past 3000 years", None), ("9999999999 weeks ago", None),
    ("yesterday", "2024-01-30|2024-01-31|yesterday|false|"), ("last month", "2023-12-01|2024-01-01|last month|false|"), ("this week", "2024-01-29|2024-02-05|this week|false|"), ("June 2023 calls", "2023-06-01|2023-07-01|june 2023|false|calls"), ("met with in March", "2023-03-01|2023-04-01|in march|false|met with"),
    ("since March", "2023-03-01|2024-01-31|since march|true|"), ("last January", "2023-01-01|2023-02-01|last january|false|"), ("back in June", "2023-06-01|2023-07-01|back in june|false|"), ("this winter", "2023-12-01|2024-03-01|this winter|false|"), ("last winter", "2022-12-01|2023-03-01|last winter|false|"), ("in the fall", "2023-09-01|2023-12-01|in the fall|false|"),
    ("back then in 2015", "2015-01-01|2016-01-01|2015|false|back then"), ("April Chen", None), ("March Capital", None), ("room 2031", None),
], _window)
cases("named_entities", "question string", [
    ("people who work at Meta", "Meta"), ('who is "ann of oslo" at Red Oak Labs', "ann of oslo|Red Oak Labs"), ("Who is Ann Lee, Bob and Cy & Co", "Ann Lee|Bob|Cy"), ("who knows x", ""), ("Do People know I", "Do People"),
], lambda q: "|".join(I.entity_candidates(q)))


def _intents(q: str) -> str:
    life, owed = I.life_intent(q), I.ledger_intent(q)
    show = lambda x: "-" if x is None else ",".join([x.kind, x.direction or "", "+".join(x.names), str(x.upcoming).lower()])
    return "|".join(["+".join(I.relations(q)), I.industry(q) or "-", str(I.is_self(q)).lower(), str(I.seeks_people(q)).lower(), show(life), show(owed)])


cases("question_intents", "question string", [
    ("my cofounder", "co_founder|-|true|false|-|-"), ("people who work at Meta", "employee|-|false|true|-|-"), ("who do I know in VC", "|venture capital|true|true|-|-"), ("she said pepper", "|-|false|false|-|-"), ("who studied at MIT or advises", "student+attended+advisor|-|false|true|-|-"),
    ("gift ideas for sarah", "|-|false|false|gifts,,sarah,false|-"), ("upcoming life events", "|-|false|false|life_events,,,true|-"), ("what do I owe", "|-|true|false|favors,owed_by_me,,false|owed_by_me,,,false"), ("who owes me money", "|-|true|true|favors,owed_to_me,,false|owed_to_me,,,false"), ("in favor of him", "|-|false|false|-|-"),
    ("what did I give Sarah", "|-|true|false|-|given_to,,sarah,false"), ("what has she given to me", "|-|true|false|-|received_from,,me,false"), ("she owes her success", "|-|false|false|-|-"), ("my debts", "|-|true|false|-|owed_by_me,,,false"),
], _intents)

