"""Whether two names may be one person's, as Column expressions: abbreviated parts, dropped middles, nicknames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A small table of common English ones to start with; callers with a larger one pass it.
_SHORT = {
    "alexander": "alex sandy", "andrew": "andy drew", "anthony": "tony", "barbara": "barb", "benjamin": "ben", "catherine": "cathy kate",
    "charles": "charlie chuck", "christopher": "chris", "daniel": "dan danny", "david": "dave", "deborah": "debbie", "donald": "don",
    "dorothy": "dot", "edward": "ed eddie ned ted", "elizabeth": "beth betty liz lizzie", "eugene": "gene", "frances": "fran",
    "frederick": "fred", "gregory": "greg", "henry": "hank harry", "jacob": "jake", "james": "jim jimmy", "jennifer": "jen jenny",
    "john": "jack johnny", "joseph": "joe", "joshua": "josh", "judith": "judy", "katherine": "kate kathy katie", "kenneth": "ken",
    "lawrence": "larry", "leonard": "len", "margaret": "maggie meg peggy", "matthew": "matt", "michael": "mick mike", "nathaniel": "nate",
    "nicholas": "nick", "pamela": "pam", "patricia": "pat patty trish", "patrick": "pat", "peter": "pete", "philip": "phil",
    "rebecca": "becky", "richard": "dick rich rick", "robert": "bob bobby rob", "ronald": "ron", "samuel": "sam", "stephen": "steve",
    "steven": "steve", "susan": "sue susie", "theodore": "ted", "thomas": "tom tommy", "timothy": "tim", "victoria": "vicky",
    "vincent": "vince", "walter": "walt", "william": "bill billy will",
}
NICKNAMES = sorted((short, full) for full, shorts in _SHORT.items() for short in shorts.split())


def parts(name: Column) -> Column:
    return F.filter(F.split(F.replace(F.lower(F.trim(name)), F.lit("."), F.lit(" ")), r"\s+"), lambda t: t != "")


def fullness(name: Column) -> Column:
    """Ten for each whole part, one for each initial, and one more for every part."""
    return F.aggregate(parts(name), F.lit(0), lambda total, t: total + F.when(F.length(t) == 1, 2).otherwise(11))


def _abbreviates(x: Column, y: Column) -> Column:
    one = (F.length(x) == 1) != (F.length(y) == 1)
    return (x == y) | (one & (F.substring(x, 1, 1) == F.substring(y, 1, 1)))


def _nicknames(x: Column, y: Column, pairs: list[tuple[str, str]]) -> Column:
    known = F.array(*[F.lit("|".join(sorted(p))) for p in pairs]) if pairs else F.array().cast("array<string>")
    return F.array_contains(known, F.concat_ws("|", F.least(x, y), F.greatest(x, y)))


def name_match(a: Column, b: Column, pairs: list[tuple[str, str]] = NICKNAMES) -> Column:
    """'exact', 'variant' or null. A variant has two parts at least, agrees in first and last ones, one of them whole and
    equal, and doesn't disagree in all middles. A nickname stands for a first or middle name, never for the whole one."""
    pa, pb = parts(a), parts(b)
    first_a, first_b, last_a, last_b = F.get(pa, F.lit(0)), F.get(pb, F.lit(0)), F.element_at(pa, -1), F.element_at(pb, -1)
    middle = lambda p: F.slice(p, 2, F.greatest(F.lit(0), F.size(p) - 2))
    like = lambda x, y: _abbreviates(x, y) | _nicknames(x, y, pairs)
    whole = lambda x, y: (x == y) & (F.length(x) > 1)
    agree = F.exists(middle(pa), lambda x: F.exists(middle(pb), lambda y: like(x, y)))
    open_ = (F.size(pa) < 3) | (F.size(pb) < 3) | agree
    variant = (F.size(pa) > 1) & (F.size(pb) > 1) & like(first_a, first_b) & _abbreviates(last_a, last_b) & (whole(first_a, first_b) | whole(last_a, last_b)) & open_
    la, lb = F.lower(F.trim(a)), F.lower(F.trim(b))
    return F.when((la != "") & (la == lb), "exact").when((la != "") & (lb != "") & variant, "variant")


def anchors(name: Column, pairs: list[tuple[str, str]] = NICKNAMES) -> Column:
    """Join keys: names that match share one. Either a whole first part is equal in both, and the last parts' initials; or a
    whole last part, and the first parts' initials, where a nickname also has the initials of what it stands for."""
    p = parts(name)
    first, last = F.get(p, F.lit(0)), F.element_at(p, -1)
    other = [F.struct(F.lit(x).alias("x"), F.substring(F.lit(y), 1, 1).alias("i")) for a, b in pairs for x, y in ((a, b), (b, a))]
    known = F.transform(F.filter(F.array(*other), lambda o: o["x"] == first), lambda o: o["i"]) if other else F.array().cast("array<string>")
    initials = F.array_distinct(F.concat(F.array(F.substring(first, 1, 1)), known))
    by_first = F.when((F.length(first) > 1) & (F.size(p) > 1), F.array(F.concat_ws("|", F.lit("f"), first, F.substring(last, 1, 1))))
    by_last = F.when((F.length(last) > 1) & (F.size(p) > 1), F.transform(initials, lambda i: F.concat_ws("|", F.lit("l"), last, i)))
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(by_first, none), F.coalesce(by_last, none))
