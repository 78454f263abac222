"""Parsers of pipe records and role lines, and rules of validity windows, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_DATE = r"\d{4}-\d{2}-\d{2}"
#: Fixed values.
LIFE_CATEGORIES = ["work", "home", "family"]
OWED_BY_ME = ["owed_by_me", "i_owe", "i_owe_them"]
OWED_TO_ME = ["owed_to_me", "they_owe_me", "owes_me"]
SETTLED = ["settled", "done", "repaid"]
OPEN = ["open", "outstanding", "unsettled"]
PRESENT = ["", "present", "current", "now", "ongoing", "today"]


def segments(value: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), r"\|"), lambda s: F.trim(s)), lambda s: s != "")


def iso_date(parts: Column) -> Column:
    found = F.filter(F.transform(parts, lambda s: F.regexp_extract(s, ISO_DATE, 0)), lambda s: s != "")
    return F.get(found, F.lit(0))


def _plain_date(s: Column) -> Column:
    return s.rlike(rf"^\s*{ISO_DATE}\s*$")


def _joined(parts: Column) -> Column:
    return F.when(F.size(parts) > 0, F.array_join(parts, " | "))


def life_event(value: Column) -> Column:
    """struct<category, type, date, note>: the first "category/type" with a known category, the first date, the rest."""
    parts = segments(value)
    category = lambda s: F.lower(F.trim(F.split(s, "/")[0]))
    known = F.filter(parts, lambda s: s.contains("/") & category(s).isin(LIFE_CATEGORIES))
    first = F.get(known, F.lit(0))
    rest = F.filter(parts, lambda s: (first.isNull() | (s != first)) & ~_plain_date(s))
    kind = F.lower(F.trim(F.get(F.split(first, "/"), F.lit(1))))
    return F.struct(category(first).alias("category"), F.when(kind != "", kind).alias("type"), iso_date(parts).alias("date"), _joined(rest).alias("note"))


def favor(value: Column) -> Column:
    """struct<direction, what, settled>: later segments win; free text is an open favor without direction."""
    parts = segments(value)
    word = lambda s: F.regexp_replace(F.lower(s), r"\s+", "_")
    last = lambda words: F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(F.transform(parts, word), lambda s: s.isin(words))), -1)
    way, state = last([*OWED_BY_ME, *OWED_TO_ME]), last([*SETTLED, *OPEN])
    rest = F.filter(parts, lambda s: ~word(s).isin([*OWED_BY_ME, *OWED_TO_ME, *SETTLED, *OPEN]))
    return F.struct(F.when(way.isin(OWED_BY_ME), "owed_by_me").when(way.isin(OWED_TO_ME), "owed_to_me").alias("direction"), F.coalesce(_joined(rest), F.trim(value)).alias("what"), F.coalesce(state.isin(SETTLED), F.lit(False)).alias("settled"))


def gift(value: Column) -> Column:
    """struct<occasion, date, gift> of "occasion | date | gift"."""
    parts = segments(value)
    rest = F.filter(parts, lambda s: ~_plain_date(s))
    more = F.size(rest) > 1
    text = F.when(F.size(parts) <= 1, F.trim(value)).when(more, F.array_join(F.slice(rest, 2, F.greatest(F.lit(1), F.size(rest))), " | ")).otherwise(F.coalesce(F.get(rest, F.lit(0)), F.trim(value)))
    return F.struct(F.when((F.size(parts) > 1) & more, F.get(rest, F.lit(0))).alias("occasion"), iso_date(parts).alias("date"), text.alias("gift"))


SPAN = r"\s+to\s+|\s*[-\u2013\u2014]\s*"  # fixed value: what stands between a start and an end


def role(value: Column) -> Column:
    """struct<title, company, start, end, current> of "TITLE at COMPANY (START to END)"; the last " at " splits."""
    raw = F.trim(value)
    span = F.trim(F.regexp_extract(raw, r"\(([^()]*)\)\s*$", 1))
    body = F.trim(F.regexp_replace(raw, r"\s*\([^()]*\)\s*$", ""))
    cut = F.split(span, SPAN)
    end = F.when(F.size(cut) > 1, F.trim(F.array_join(F.slice(cut, 2, F.greatest(F.lit(1), F.size(cut))), " "))).otherwise("")
    has = F.lower(body).contains(" at ")
    title = F.when(has, F.trim(F.regexp_extract(body, r"(?is)^(.*) at ", 1))).otherwise("")
    company = F.when(has, F.trim(F.regexp_extract(body, r"(?is)^.* at (.*)$", 1))).otherwise(body)
    return F.struct(title.alias("title"), company.alias("company"), F.trim(F.get(cut, F.lit(0))).alias("start"), end.alias("end"), F.lower(end).isin(PRESENT).alias("current"))


def _text_or_empty(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def is_present(end: Column) -> Column:
    return F.lower(_text_or_empty(end)).isin(PRESENT)


def format_role(company: Column, title: Column, start: Column, end: Column) -> Column:
    """"TITLE at COMPANY (START to END)", without the parts that are not known; empty without a company."""
    c, t, s, e = map(_text_or_empty, (company, title, start, end))
    span = F.array_join(F.filter(F.array(s, e), lambda x: x != ""), " to ")
    out = F.concat(F.when(t != "", F.concat(t, F.lit(" at "))).otherwise(""), c, F.when(span != "", F.concat(F.lit(" ("), span, F.lit(")"))).otherwise(""))
    return F.when(c != "", out).otherwise("")


def education(value: Column) -> Column:
    """struct<school, degree, field, start, end> of a JSON object, or of "DEGREE, SCHOOL (START-END)" where the last comma
    splits; null without a school, and for JSON that can't be read."""
    raw = _text_or_empty(value)
    names = ["school", "degree", "field", "start", "end"]
    parsed = F.from_json(raw, ", ".join(f"{n} string" for n in names))
    from_json = F.struct(*[_text_or_empty(parsed[n]).alias(n) for n in names])
    years = F.trim(F.regexp_extract(raw, r"\(([^()]*)\)\s*$", 1))
    body = F.trim(F.regexp_replace(raw, r"\s*\([^()]*\)\s*$", ""))
    cut = F.split(years, SPAN)
    both = F.size(cut) > 1
    school = F.trim(F.element_at(F.split(body, ","), -1))
    degree = F.trim(F.array_join(F.slice(F.split(body, ","), 1, F.greatest(F.lit(0), F.size(F.split(body, ",")) - 1)), ","))
    end = F.when(both, F.trim(F.array_join(F.slice(cut, 2, F.greatest(F.lit(1), F.size(cut))), " "))).otherwise(years)
    from_text = F.struct(school.alias("school"), degree.alias("degree"), F.lit("").alias("field"), F.when(both, F.trim(F.get(cut, F.lit(0)))).otherwise("").alias("start"), end.alias("end"))
    found = F.when(raw.startswith("{"), from_json).otherwise(from_text)
    return F.when(found["school"] != "", found)


def format_education(school: Column, degree: Column, level: Column, field: Column, start: Column, end: Column) -> Column:
    """The canonical JSON object: keys in a fixed order, without empty ones; empty without a school."""
    known = lambda c: F.when(_text_or_empty(c) != "", _text_or_empty(c))
    names = ("school", "degree", "level", "field", "start", "end")
    out = F.to_json(F.struct(*[known(c).alias(n) for n, c in zip(names, (school, degree, level, field, start, end))]))
    return F.when(_text_or_empty(school) != "", out).otherwise("")


def education_summary(entries: Column) -> Column:
    """One line of an array of education structs: "DEGREE SCHOOL; ...", each once, whatever its case."""
    line = lambda e: F.when(e["degree"] != "", F.concat_ws(" ", e["degree"], e["school"])).otherwise(e["school"])
    lines = F.transform(F.filter(entries, lambda e: e["school"] != ""), line)
    first = F.filter(lines, lambda x, i: F.size(F.filter(F.slice(lines, 1, i), lambda y: F.lower(y) == F.lower(x))) == 0)
    return F.array_join(first, "; ")


def normalize_date(value: Column) -> Column:
    """The date at the beginning of a text, or the one that the whole of it names; else null."""
    v = F.trim(value)
    forms = ["yyyy/M/d", "M/d/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy"]
    other = F.coalesce(*[F.try_to_date(v, f) for f in forms]).cast("string")
    return F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(v, 1, 10)).otherwise(other)


def details(value: Column) -> Column:
    """array<struct<name, value>> of the details of a proposal: a JSON list of {name, value} or a map. Lists of values become
    an entry each, numbers and truth values texts; nested objects, nulls and blanks go."""
    listed = F.from_json(value, "array<struct<name: string, value: string>>")
    mapped = F.transform(F.map_entries(F.from_json(value, "map<string, string>")), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    pairs = F.coalesce(F.when(F.trim(value).startswith("["), listed).otherwise(mapped), F.array().cast("array<struct<name: string, value: string>>"))
    many = lambda v: F.when(F.trim(v).startswith("["), F.coalesce(F.from_json(v, "array<string>"), F.array(v))).otherwise(F.array(v))
    each = F.flatten(F.transform(pairs, lambda p: F.transform(many(p["value"]), lambda v: F.struct(F.trim(p["name"]).alias("name"), F.trim(v).alias("value")))))
    return F.filter(each, lambda d: (d["name"] != "") & (d["value"] != "") & ~d["value"].startswith("{"))


def detail(entries: Column, name: str) -> Column:
    """The first value of a name, or null."""
    return F.get(F.filter(entries, lambda d: d["name"] == name), F.lit(0))["value"]


def tombstoned(deleted_at: Column) -> Column:
    return deleted_at.isNotNull()


def superseded(valid_until: Column) -> Column:
    return valid_until.isNotNull()


def fact_window(valid_from: Column, created_at: Column, valid_until: Column) -> Column:
    """struct<from, from_known, until>: an unknown start falls back to when the fact was first held."""
    return F.struct(window_start(valid_from, created_at).alias("from"), valid_from.isNotNull().alias("from_known"), valid_until.alias("until"))


def normalize_start(start: Column, now: Column) -> Column:
    """A start in the future, or none, is now."""
    return F.least(F.coalesce(start, now), now)


def close_patch(end: Column, known_start: Column, now: Column) -> dict[str, Column]:
    """What ends a fact: it is no longer valid, and no longer live."""
    at = normalize_end(end, known_start, now)
    return {"valid_until": at, "deleted_at": at}


def open_patch(start: Column, now: Column) -> dict[str, Column]:
    return {"valid_from": normalize_start(start, now)}


def window_start(valid_from: Column, created_at: Column) -> Column:
    return F.coalesce(valid_from, created_at)


def retracted(deleted_at: Column, valid_until: Column) -> Column:
    return deleted_at.isNotNull() & valid_until.isNull()


def held_at(at: Column, start: Column, until: Column, deleted_at: Column | None = None) -> Column:
    """Half-open: start <= at < until; no start counts as started, no end as open, retracted facts never hold."""
    ok = (start.isNull() | (start <= at)) & (until.isNull() | (until > at))
    return ok if deleted_at is None else ok & ~retracted(deleted_at, until)


def normalize_end(end: Column, known_start: Column, now: Column) -> Column:
    """An end in the future, or none, is now; one before a known start is that start."""
    e = F.least(F.coalesce(end, now), now)
    return F.when(known_start.isNotNull(), F.greatest(e, known_start)).otherwise(e)
