"""Main text of web pages by equivalence-class template deduction.

Pages of a host are taken in groups of bounded size. A page is a sequence of tokens: its tags and its blocks of text, both
told apart by the tags they stand in (a block is one token: the words of paragraphs recur by chance). Tokens that share an
occurrence vector over the group's pages form an equivalence class. A class of tokens that occur once a page is valid
where they keep one order on all its pages; valid classes nest, as their places are paths, and are the template. What is
left between the template's tokens are the slots. The main slot is found by going down the template's elements as long as
one holds more than half of the page's varying text; an article or main element around or inside it says how far it
reaches. Classes of blocks that lie in the main slot of every page, at whatever count, are template too and go.

What varies from page to page doesn't tell an article from an advert or a reader's comment. Elements whose tag or class
names them as one of the kinds to be left out are therefore no slots, wherever they stand.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, tune

#: Pages and characters of html a group holds at most, but for one page that is longer; pages that deduction takes at least.
GROUP, GROUP_CHARS, LEAST = 96, 8 << 20, 3
#: Hosts with several groups up to which their table is broadcast.
BROADCAST_HOSTS = 200_000
#: A tag by the rules of HTML: quotes count only after an equals sign, and an unclosed one is an ordinary character.
_ATTRIBUTES = r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?)*+)"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe)\b" + _ATTRIBUTES + r">.*?(?:</\1\s*+>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)" + _ATTRIBUTES + r">|<[!?][^>]*+>|[^<]++|<",
    re.S | re.I,
)
_NAMED = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_DIGITS = re.compile(r"\d+")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "dfn", "em", "font", "i", "img", "input", "ins", "del", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "wbr"}
_OUTSIDE = {"nav", "footer", "aside", "form", "head", "title", "button", "select", "menu", "dialog"}
#: Names of what is left out: menus, headers, footers, sidebars, notices, adverts, forms and reader comments.
_AWAY = re.compile(r"(?:^|[-_ ])(?:menu|nav\w*|breadcrumbs?|header|masthead|footer|sidebar|complementary|notice|cookies?|consent|banner|ad|ads|advert\w*|promo\w*|sponsor\w*|newsletter|subscribe|login|signup|comments?|replies)(?:$|[-_ ])", re.I)


class Page:
    """elements: (key, tag, parent, away) in page order, the key being the path of tags and classes; blocks: (element,
    text) in page order; tokens: (key, None) for each element and (key, text) for each block. Element 0 is the page."""

    def __init__(self, source: str | None):
        self.elements: list[tuple[str, str, int, bool]] = [("", "", -1, False)]
        self.blocks: list[tuple[int, str]] = []
        self.tokens: list[tuple[str, str | None]] = []
        stack: list[tuple[str, int]] = [("", 0)]  # (tag, element); an inline element stands for its block's, unless it is away
        held: list[str] = []

        def flush():
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                self.blocks.append((stack[-1][1], text))
                self.tokens.append((self.elements[stack[-1][1]][0], text))

        def pop_to(at: int):
            if any(self.elements[e][3] for _, e in stack[at:]) and not self.elements[stack[at - 1][1]][3]:
                flush()
            del stack[at:]

        for m in _TOKEN.finditer(source or ""):
            tag = m[4]
            if tag is None:
                if m[1]:
                    flush()
                elif m[0][0] != "<" or m[0] == "<":
                    held.append(m[0])
                continue
            tag = tag.lower()
            inline = tag in _INLINE
            if not inline:
                flush()
            if m[3]:
                at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), None)
                if at is not None and (not inline or all(s[0] in _INLINE for s in stack[at:])):
                    pop_to(at)
                continue
            if inline:
                if tag in ("br", "img", "input"):
                    held.append(" ")
                elif tag != "wbr":
                    if self._away(tag, m[5], stack[-1][1]):
                        flush()
                        self._open(tag, m[5], stack)
                    else:
                        stack.append((tag, stack[-1][1]))
                continue
            if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option"):  # end tags that may be left out
                while stack[-1][0] in _INLINE or stack[-1][0] == "p" or stack[-1][0] == tag:
                    stack.pop()
            elif tag not in ("body", "html"):
                while stack[-1][0] in ("p", *_INLINE) and any(s[0] == "p" for s in stack):
                    stack.pop()
            if tag in _VOID:
                continue
            self._open(tag, m[5], stack)
        flush()

    def _away(self, tag: str, attributes: str, parent: int) -> bool:
        names = " ".join(x for _, *g in _NAMED.findall(attributes) for x in g if x) if "=" in attributes else ""
        if self.elements[parent][3] or tag in _OUTSIDE or (names and _AWAY.search(names)):
            return True
        return tag == "header" and self.holder(parent) is None

    def _open(self, tag: str, attributes: str, stack: list[tuple[str, int]]) -> None:
        parent = stack[-1][1]
        # ids, and numbers in classes, are a page's own
        classes = " ".join(x for k, *g in _NAMED.findall(attributes) if k.lower() != "id" for x in g if x) if "=" in attributes else ""
        named = f"{tag}.{_DIGITS.sub('0', classes).lower()}" if classes else tag
        kind = "main" if "main" in classes.lower().split() else tag
        self.elements.append((f"{self.elements[parent][0]}/{named}", kind, parent, self._away(tag, attributes, parent)))
        self.tokens.append((self.elements[-1][0], None))
        stack.append((tag, len(self.elements) - 1))

    def holder(self, element: int) -> int | None:
        """The nearest article around the element, itself included, or else the nearest main element."""
        main = None
        while element > 0:
            if self.elements[element][1] == "article":
                return element
            if main is None and self.elements[element][1] == "main":
                main = element
            element = self.elements[element][2]
        return main

    def within(self, element: int, outer: int) -> bool:
        while element > outer:
            element = self.elements[element][2]
        return element == outer

    def main(self, scope: int) -> tuple[str, list[tuple[str, str]]]:
        """(what frames it, blocks as (key, text)) of the main text in an element: the article or main element that holds
        it, else those inside it, else itself, widened to what holds a heading of the first rank."""
        frame = self.holder(scope)
        if frame is None:
            kept = [(e, t) for e, t in self.blocks if not self.elements[e][3] and self.within(e, scope) and self.holder(e) is not None]
            if kept:
                return "own", [(self.elements[e][0], t) for e, t in kept]
            frame = scope
            titled = [e for e, _ in self.blocks if self.elements[e][1] == "h1" and not self.elements[e][3]]
            while titled and frame > 0 and not any(self.within(e, frame) for e in titled) and self.elements[self.elements[frame][2]][1] not in ("body", "html", ""):
                frame = self.elements[frame][2]
        return self.elements[frame][0], [(self.elements[e][0], t) for e, t in self.blocks if not self.elements[e][3] and self.within(e, frame)]


def classes(pages: list[list[tuple[str, str | None]]]) -> dict[tuple[int, ...], list[tuple[str, str | None]]]:
    """The equivalence classes of tokens by occurrence vector; tokens of fewer than LEAST pages are left out."""
    counts = [Counter(p) for p in pages]
    support = Counter(t for c in counts for t in c)
    out = defaultdict(list)
    for t, n in support.items():
        if n >= LEAST:
            out[tuple(c[t] for c in counts)].append(t)
    return out


def ordered(tokens: list[tuple[str, str]], pages: list[list[tuple[str, str | None]]]) -> set[tuple[str, str]]:
    """Of tokens that occur once on each of the pages, those that keep one order: on each page a longest run that rises in
    the order of the first page."""
    keep = set(tokens)
    place = {t: i for i, t in enumerate(t for t in pages[0] if t in keep)}
    for p in pages[1:]:
        own = [t for t in p if t in keep]
        tops, links, last = [], [], []
        for k, t in enumerate(own):
            i = place[t]
            j = bisect_left(tops, i)
            tops[j:j + 1], last[j:j + 1] = [i], [k]
            links.append(last[j - 1] if j else -1)
        run, k = set(), last[-1] if last else -1
        while k >= 0:
            run.add(own[k])
            k = links[k]
        keep = run
    return keep


def template(pages: list[Page]) -> tuple[set[str], set[tuple[str, str]]]:
    """(keys of the template's elements, blocks that more than half of the pages share) of different pages of a group."""
    tokens = [p.tokens for p in pages]
    once, shared = set(), set()
    for vector, found in classes(tokens).items():
        on = [p for p, v in zip(tokens, vector) if v]
        shared |= {t for t in found if t[1] is not None and 2 * len(on) > len(pages)}
        if max(vector) == 1:
            once |= {k for k, text in ordered(found, on) if text is None}
    return once, shared


def chain(page: Page, once: set[str], shared: set[tuple[str, str]]) -> list[int]:
    """The template's elements, outermost first, that hold more than half of the page's varying text."""
    mass = Counter()
    for e, text in page.blocks:
        if not page.elements[e][3] and (page.elements[e][0], text) not in shared:
            n = len(text.split(" "))
            while e >= 0:
                mass[e] += n
                e = page.elements[e][2]
    single = Counter(e[0] for e in page.elements)
    return [e for e, n in sorted(mass.items()) if e and 2 * n > mass[0] and page.elements[e][0] in once and single[page.elements[e][0]] == 1]


def extract(sources: list[str | None]) -> list[str]:
    """Main texts of a group's pages. Where fewer than LEAST pages differ there is no template to go by: then a page's own
    article or main elements frame its text, or nothing does. Copies of a page count once in the deduction."""
    pages = [Page(s) for s in sources]
    distinct = {tuple(p.tokens): p for p in pages if p.blocks}
    chains = {}
    if len(distinct) >= LEAST:
        once, shared = template(list(distinct.values()))
        chains = {k: chain(p, once, shared) for k, p in distinct.items()}
    support = Counter(p.elements[e][0] for k, p in distinct.items() for e in chains.get(k, ()))
    mains = {}
    for k, p in distinct.items():
        scope = 0
        for e in chains.get(k, ()):
            n = support[p.elements[e][0]]
            # an element that few of those pages have is a part of their texts, not of the template
            if n < LEAST or (scope and 4 * n < support[p.elements[scope][0]]):
                break
            scope = e
        mains[k] = p.main(scope)
    again = _repeats(list(mains.values()))
    texts = {k: "\n".join(t for at, t in blocks if (at, t) not in again.get(frame, ())) for k, (frame, blocks) in mains.items()}
    return [texts.get(tuple(p.tokens), "") for p in pages]


def _repeats(mains: list[tuple[str, list[tuple[str, str]]]]) -> dict[str, set[tuple[str, str]]]:
    """By frame, the blocks that stand in the main slot of every page: template. Equal main texts count once, and where
    nine tenths of the words are common, the pages are versions of one text and nothing is template."""
    by = defaultdict(set)
    for frame, blocks in mains:
        if blocks:
            by[frame].add(tuple(blocks))
    out = {}
    for frame, found in by.items():
        if len(found) >= LEAST:
            common = set.intersection(*map(set, found))
            size = lambda blocks: sum(len(t.split(" ")) for _, t in blocks)
            if 10 * sum(size(b for b in blocks if b in common) for blocks in found) < 9 * sum(map(size, found)):
                out[frame] = common
    return out


def extract_pages(pages: DataFrame, group: int = GROUP, group_chars: int = GROUP_CHARS, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages(page_id, url, html, ...).

    Pages of a host are dealt, by a hash of id and url, into groups of about `group` pages and `group_chars` characters;
    hosts with one group need no table, the others' is broadcast where it is small and joined by salted keys beyond. No
    host meets in one task. Null and empty html gives an empty text; a null url belongs to the host "". Very long pages
    are read whole. Repeated rows are extracted each, and pages of equal template vectors give equal results (no ties).
    An empty table gives no rows. Extra columns are ignored.
    """
    tune(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#]*)", 1)))
    size = rows.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("html"), F.lit(0))).alias("chars"))
    size = size.select("host", F.greatest(F.ceil(F.col("n") / group), F.ceil(F.col("chars") / group_chars)).alias("parts"))
    several = cut(size.where("parts > 1"))
    deal = F.xxhash64("page_id", "url")
    if several.count() <= broadcast_hosts:
        dealt = rows.join(F.broadcast(several), "host", "left")
    else:
        salts = 64
        spread = several.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        dealt = rows.withColumn("salt", F.pmod(deal, F.lit(salts)).cast("int")).join(spread, ["host", "salt"], "left")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64(deal), F.coalesce("parts", F.lit(1))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        text = extract([x if isinstance(x, str) else None for x in pdf["html"]])
        return pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": text, "n_chars": [len(t) for t in text]})

    return dealt.select("host", "part", "page_id", "url", "html").groupBy("host", "part").applyInPandas(run, "page_id long, url string, text string, n_chars long")
