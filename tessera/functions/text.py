"""Column expressions over names and free text; all of them stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is left out of names before they are compared.
ARTICLES = ["the", "a", "an"]
ORG_SUFFIXES = ["inc", "llc", "ltd", "corp", "co", "company", "gmbh", "sa", "ag", "plc", "limited", "llp"]
#: Words that keyword recall passes over.
STOPWORDS = ["the", "and", "who", "what", "where", "when", "which", "know", "knows", "any", "all", "for", "from", "with", "about", "that", "this", "they", "them", "was", "were", "are", "has", "have", "had", "can", "could", "would", "should", "did", "does", "someone", "anyone", "people", "person", "tell", "show", "find", "give", "list", "there"]


def normalize_for_match(name: Column) -> Column:
    """Names as they are compared; the patterns are fixed values."""
    x = F.regexp_replace(F.trim(F.lower(name)), rf"^({'|'.join(ARTICLES)})\s+", "")
    x = F.regexp_replace(x, rf"\b({'|'.join(ORG_SUFFIXES)})\.?\b", "")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[^\p{L}\p{N}\s]", ""), r"\s+", " "))


def fold(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(value), r"\s+", " "))


def tokens(value: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(value), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def similar_wording(a: Column, b: Column) -> Column:
    """Token sets where the smaller (of 2 at least) lies in the larger, or Jaccard >= 0.6 with 2 shared."""
    ta, tb = tokens(a), tokens(b)
    both, least = F.size(F.array_intersect(ta, tb)), F.least(F.size(ta), F.size(tb))
    return (both >= 2) & ((both == least) | (both / F.size(F.array_union(ta, tb)) >= 0.6))


def overlapping(a: Column, b: Column) -> Column:
    """Promises in other words: 0.8 of the smaller set's words longer than two letters are shared, and it has three."""
    ta, tb = (F.filter(tokens(x), lambda t: F.length(t) > 2) for x in (a, b))
    least = F.least(F.size(ta), F.size(tb))
    return (least >= 3) & (F.size(F.array_intersect(ta, tb)) >= 0.8 * least)


def is_location_suffix(a: Column, b: Column) -> Column:
    """a names a vaguer place: its comma parts are the tail of b's, and fewer."""
    pa, pb = (F.transform(F.split(F.lower(x), ","), lambda s: F.trim(s)) for x in (a, b))
    return (F.size(pa) < F.size(pb)) & (F.slice(pb, F.greatest(F.lit(1), F.size(pb) - F.size(pa) + 1), F.size(pa)) == pa)


def slug(name: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "_"), r"^_+|_+$", ""), 1, 40)


def name_hash(name: Column, of: int) -> Column:
    """The 31-hash of the code units modulo 2^32, and that modulo `of` (names in the basic plane)."""
    codes = F.transform(F.filter(F.split(name, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % (1 << 32)) % of


def merge_text(old: Column, new: Column) -> Column:
    """Additive text: the longer where one holds the other, else the old and those sentences of the new that it doesn't hold."""
    a, b = F.trim(F.coalesce(old, F.lit(""))), F.trim(F.coalesce(new, F.lit("")))
    la, lb = F.lower(a), F.lower(b)
    sentences = F.filter(F.transform(F.split(b, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")
    fresh = F.filter(sentences, lambda s: ~F.contains(la, F.lower(s)))
    joined = F.concat(a, F.when(a.rlike("[.!?]$"), " ").otherwise(". "), F.array_join(fresh, " "))
    kept = F.when((lb == "") | F.contains(la, lb), a).when((la == "") | F.contains(lb, la), b)
    return kept.otherwise(F.when(F.size(fresh) == 0, a).otherwise(joined))


def added_new(old: Column, merged: Column) -> Column:
    """Whether a merge has made the text longer."""
    return F.length(F.trim(merged)) > F.length(F.trim(F.coalesce(old, F.lit(""))))


def differs(a: Column, b: Column) -> Column:
    """Values differ in more than case and outer blanks; two nulls don't."""
    return ~F.lower(F.trim(a)).eqNullSafe(F.lower(F.trim(b)))


def match_quality(query: str, name: Column) -> Column:
    """exact: equal, or equal as normalised names; strong: every word of the query is a word of the name; else weak_partial."""
    q = query.strip().lower()
    n = F.lower(F.trim(name))
    words = F.array(*[F.lit(w) for w in q.split()]) if q.split() else F.array().cast("array<string>")
    exact = (n == q) | (normalize_for_match(name) == normalize_for_match(F.lit(query)))
    return F.when(exact, "exact").when(F.size(F.array_except(words, F.split(n, r"\s+"))) == 0, "strong").otherwise("weak_partial")


def also_spelled(value: Column, name: Column) -> Column:
    """Other spellings in a list: parts of two letters and more that aren't the name itself, six at most."""
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), r"(?i)[,;/|]| or "), lambda s: F.trim(s))
    return F.slice(F.filter(parts, lambda s: (F.length(s) > 1) & (F.lower(s) != F.lower(F.trim(name)))), 1, 6)


def is_uuid(value: Column) -> Column:
    return F.coalesce(value.rlike(r"(?i)^[0-9a-f-]{36}$"), F.lit(False))


def shortened(value: Column, most: int) -> Column:
    """The value, or its beginning with an ellipsis where it is longer."""
    return F.when(F.length(value) > most, F.concat(F.substring(value, 1, most - 1), F.lit("\u2026"))).otherwise(value)


def promise_key(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(value), r"[^a-z0-9 ]+", " "), r"\s+", " "))


def plain(value: Column) -> Column:
    """A JSON scalar as its text; objects and arrays as JSON, and what is no JSON as it is."""
    return F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v"), value)


#: Fixed values, in order of precedence: (how a conversation's title is tested, text, label).
SOURCE_LABELS = [
    ("begins", "network updates", "Research"), ("begins", "web enrichment", "Research"), ("is", "mcp", "Your agent"),
    ("begins", "capture \u00b7", "Extension"), ("begins", "web capture", "Extension"), ("begins", "import from", "Other tools"),
    ("begins", "added by hand", "Added by hand"), ("holds", "whatsapp", "WhatsApp"), ("holds", "imessage", "iMessage"),
    ("holds", "apple contacts", "Apple Contacts"), ("holds", "apple calendar", "Apple Calendar"), ("holds", "apple mail", "Apple Mail"),
    ("holds", "granola", "Granola"), ("holds", "fireflies", "Fireflies"), ("holds", "gmail", "Gmail"), ("holds", "calendar", "Calendar"),
    ("holds", "contact", "Google Contacts"), ("holds", "linkedin", "LinkedIn"), ("holds", "spreadsheet", "Spreadsheets"),
    ("holds", "csv", "Spreadsheets"), ("holds", "upload", "Uploads"), ("holds", "import", "Uploads"),
]


def source_label(title: Column) -> Column:
    t = F.lower(F.coalesce(title, F.lit("")))
    test = {"begins": t.startswith, "holds": t.contains, "is": t.__eq__}
    return F.coalesce(*[F.when(test[how](text), label) for how, text, label in SOURCE_LABELS], F.lit("Your agent"))


def entity_kind(node_type: Column) -> Column:
    kinds = {"Organization": "org", "Event": "event", "Location": "location", "Person": "person"}
    return F.coalesce(*[F.when(node_type == k, v) for k, v in kinds.items()], F.lit("other"))


def any_word(value: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(value).contains(w) for w in words], F.lit(False))


def money(amount: Column, currency: Column) -> Column:
    whole = F.when(amount == F.floor(amount), F.format_string("%d", amount.cast("long"))).otherwise(F.format_string("%.2f", amount))
    named = F.when(F.coalesce(currency, F.lit("USD")) == "USD", F.concat(F.lit("$"), whole)).otherwise(F.concat(whole, F.lit(" "), currency))
    return F.when(amount.isNotNull(), named)
