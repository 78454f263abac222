"""The ten operators against brute force on small fixtures with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import ann, decontaminate, htmlextract, langid, licenses, neardup, packing, toxicity, urlfilter, warc

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 6))) for _ in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"


def text(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def corpus():
    base = [text(RNG.randint(1, 120)) for _ in range(30)]
    near = [b + " extra" for b in base[:10]] + [b.upper() for b in base[10:14]]
    docs = [None, "", "  \n", "one", "a b c d", text(6000), *base, *near, *base[:3]]
    return [(i, t, "en", "src", None, 1.0) for i, t in enumerate(docs)] + [(None, base[0], None, None, None, None), (7, docs[7], "en", "src", None, 1.0)]


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def test_near_duplicates_match_brute_force(spark):
    rows = corpus()
    got = {(r.doc_id, r.n_shingles): r for r in neardup.near_duplicates(frame(spark, rows), 85).collect()}
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in root:
        for b in root:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    for i in root:
        r = got[(i, len(sets[i]))]
        assert (r.component_id, r.kept) == (find(i), find(i) == i)
    none = got[(None, len(sets[None]))]
    assert none.component_id is None and not none.kept
    assert neardup.near_duplicates(frame(spark, [])).count() == 0


def test_rows_of_one_id_are_one_document(spark):
    a, b, c = (text(30) for _ in range(3))
    rows = [(3, a), (7, a), (7, b), (9, b), (11, c), (11, c), (12, None), (7, "")]
    got = sorted(map(tuple, neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).select("doc_id", "component_id", "kept").collect()))
    assert got == sorted([(3, 3, True), (7, 3, False), (7, 3, False), (9, 3, False), (11, 11, True), (11, 11, True), (12, 12, True), (7, 7, True)])


def test_buckets_are_searched_for_what_the_smallest_ids_miss(spark):
    # chains of versions: neighbours are alike, the ends are not
    words = [f"w{i}" for i in range(400)]
    rows = [(100 * k + i, " ".join(f"{k}{w}" for w in words[2 * i : 2 * i + 100])) for k in range(3) for i in range(40)]
    order = RNG.sample(range(1000), len(rows))
    rows = [(o, t) for o, (_, t) in zip(order, rows)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()}
    for k in range(3):
        own = order[40 * k : 40 * k + 40]
        assert {got[i] for i in own} == {min(own)}


def test_components_by_large_and_small_star(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)]
    got = {r.id: r.component for r in neardup.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


def test_components_never_end_unsettled(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        neardup.components(chain, rounds=1)
    assert neardup.components(chain, rounds=20).select("component").distinct().collect() == [(0,)]


@pytest.mark.parametrize("limit", [1 << 25, 0])
def test_decontamination_matches_brute_force(spark, limit):
    items = [(i, text(n)) for i, n in enumerate([30, 12, 10, 7, 3, 1, 25])] + [(7, None), (8, "")]
    docs = [(i, t) for i, t, *_ in corpus()] + [(900, text(20) + " " + items[0][1].upper() + "! " + text(5)), (901, items[3][1]), (902, "x " * 300)]
    docs.append((903, items[1][1].replace(" ", " -- ")))
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    windows = {}
    for i, t in items:
        w, n = word(t), min(10, len(word(t)))
        for j in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).add(str(i))
    want = []
    for i, t in docs:
        w, hit, found = word(t), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    found |= windows[tuple(w[j : j + n])]
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, f int")
    got = decontaminate.decontaminate(d, spark.createDataFrame(items, "item_id long, text string"), broadcast_bytes=limit)
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)
    clean = decontaminate.decontaminate(d, spark.createDataFrame([], "item_id long, text string"))
    assert clean.where("contaminated").count() == 0 and clean.count() == len(docs)


def test_packing_gives_whole_documents_back(spark):
    rows = [*corpus(), (800, "odd  spaces \n\n and\ttabs  <|endoftext|> ", None, None, None, None), (801, text(900), None, None, None, None)]
    got = packing.pack(frame(spark, rows), capacity=64).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, x, *_ in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        start, size, piece = 0, len(ids) % 64 or 64, 0
        while start < len(ids):
            want.append((i, piece, start, size, zlib.crc32(np.array(ids[start : start + size], dtype="<u4").tobytes())))
            start, size, piece = start + size, 64, piece + 1
    order = lambda r: (r[0] is None, r)
    assert sorted((tuple(r)[:5] for r in got if r.doc_id is not None), key=order) == sorted((w for w in want if w[0] is not None), key=order)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 64
    assert len(by) <= 1.1 * sum(w[3] for w in want) / 64 + 1
    assert packing.pack(frame(spark, [])).count() == 0


def test_both_ways_of_encoding_agree():
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.alike(path) and not packing.alike(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(4)
    points = [c for c in range(0x3100) if not 0xD800 <= c < 0xE000] + [rng.randrange(0x10000, 0x110000) for _ in range(3000)]
    texts = [f"a{chr(c)}a 1{chr(c)}1 {chr(c)}{chr(c)}\n{chr(c)}'s  {chr(c)}" for c in points]
    texts += ["", None, "<|endoftext|>", " a <|endoftext|>\n<|endoftext|> b", " " * 200_000, "x" * 20_000, "\n" * 5000 + "a", "ab " * 100_000]
    fast, plain = packing.Encoder(path, True), packing.Encoder(path, False)
    assert fast.ranked and fast.encode(texts) == plain.encode(texts)


def test_plan_pairs_large_pieces():
    segments, bins = packing.plan_bins({600: 2, 424: 2, 400: 3, 100: 2}, 1024)
    assert bins == 4 and sum(high - low for _, low, high, *_ in segments) == 9


def test_toxicity_held_out(spark):
    rows, labels = [], []
    for i in range(1500):
        bad = i % 5 == 0
        rows.append((i, text(40) + (" idiot scum trash " if bad else " ") + text(5), None, None, None, None))
        labels.append((i, int(bad)))
    rows += [(2000, None, None, None, None, None), (2001, "", None, None, None, None), (None, "x", None, None, None, None)]
    docs, marks = frame(spark, rows), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    wrong = [i for i, y in labels if got[i].held_out and got[i].predicted != y]
    assert len(got) == len(rows) and len(wrong) <= 5
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(100))
    assert 0 <= got[2000].score == got[2001].score <= 1
    kept = toxicity.keep(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in got.values())
    assert toxicity.score(docs, toxicity.fit(docs, marks.limit(0))).count() == len(rows)


def test_languages(spark):
    train = [(i, "abc abd abe " * 9, "en") for i in range(20)] + [(50 + i, "xyz xyw xyv " * 9, "de") for i in range(20)]
    model = langid.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"), ("de", "en"))
    pages = [(1, "http://a.example.com/", "<html lang=en><p>abc abd abc abe"), (2, "http://a.example.com/2", "<html lang=en><p>xyz xyw xyz xyv xyz xyw xyz"), (3, None, None), (4, "http://a.example.com/4", "<html lang=en>")] + [(i, f"http://b.example.com/{i}", "<html lang=en><p>abe abd abc") for i in range(10, 16)]
    got = {r.page_id: r for r in langid.identify_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), model, ("de", "en")).collect()}
    assert (got[1].lang, got[2].lang, got[4].lang) == ("en", "de", "en")
    assert [got[i].accepted for i in (1, 2, 3, 4)] == [True, True, False, False]


def test_evidence_is_fused_without_a_row_judging_itself(spark):
    rng, langs = random.Random(2), ("de", "en")
    rows = []
    for i in range(40):
        units = rng.choice([0, 5, 60])
        rows.append((i, rng.choice(["de", "en", "none", "other"]), rng.choice(["", "de", "com"]), rng.choice(["a.x.de", "b.x.de", "c.y.com", ""]), units, *(units * (rng.random() * 2 - 11.5) for _ in langs)))
    rows = [(*r[:4], r[4], *r[5:], ".".join(r[3].split(".")[-2:])) for r in rows]
    found = spark.createDataFrame(rows, "page_id long, declared string, suffix string, host string, units long, t0 double, t1 double, domain string")
    got = {r.page_id: r for r in langid.fuse(found, "page_id", langs).collect()}
    alike = float(np.float32(-langid.BITS * np.log(2)))
    data = [dict(zip(("id", "declared", "suffix", "host", "units", "t0", "t1", "domain"), r)) for r in rows]
    for d in data:
        d["t"] = [d["t0"], d["t1"], d["units"] * alike / (1 + d["units"] / langid.TEMPER)]
        d["top"] = max(range(3), key=lambda j: (d["t"][j], j == 2, -j)) if d["units"] else None
    for d in data:
        rest = [x for x in data if x["units"] and x is not d]
        n = lambda j, **k: sum(x["top"] == j and all(x[a] == b for a, b in k.items()) for x in rest)
        s = langid.SHRINK
        logs = []
        for j in range(3):
            base = (n(j) + 1) / (len(rest) + 3)
            known = any(x["host"] == d["host"] for x in data if x["units"])
            dom = lambda i: n(i, domain=d["domain"]) if known else 0
            by_domain = (dom(j) + s * base) / (sum(dom(i) for i in range(3)) + s)
            own = lambda i: n(i, host=d["host"])
            by_host = (own(j) + s * by_domain) / (sum(own(i) for i in range(3)) + s)
            tied = any(x["suffix"] == d["suffix"] for x in data if x["units"])
            said = any(x["declared"] == d["declared"] for x in data if x["units"])
            logs.append(d["t"][j] + math.log(by_host) + (math.log((n(j, suffix=d["suffix"]) + 1) / (n(j) + 2)) if tied else 0) + (math.log((n(j, declared=d["declared"]) + 1) / (n(j) + 4)) if said else 0))
        best = max(logs[:2])
        share = math.exp(best - max(logs)) / sum(math.exp(x - max(logs)) for x in logs)
        r = got[d["id"]]
        assert abs(r.posterior - share) < 1e-6 and r.accepted == (d["units"] > 0 and share >= 0.5)
        assert r.lang == langs[logs.index(best)] or abs(logs[0] - logs[1]) < 1e-9


def test_a_filter_on_the_verdict_is_compiled(spark):
    docs = spark.createDataFrame([(i, "the house by the water", "en", "a") for i in range(4)] + [(9, None, None, "b")], "doc_id long, text string, lang string, source string")
    spark.conf.set("spark.sql.codegen.fallback", "false")  # an error, not the slow way, where code grows too large
    try:
        judged = langid.identify_documents(docs, langid.fit(docs))
        assert [r.doc_id for r in judged.where("not accepted").select("doc_id").distinct().collect()] == [9]
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_text_in_none_of_the_languages_is_not_accepted(spark):
    words = {"en": ["the", "house", "with", "water", "think", "other", "right", "morning"], "de": ["und", "nicht", "schule", "zwischen", "gegen", "wasser", "haus", "immer"]}
    train = [(100 * k + i, " ".join(RNG.choice(words[x]) for _ in range(200)), x) for k, x in enumerate(words) for i in range(30)]
    own = [(1, "the other house with water"), (2, "nicht immer zwischen haus und schule"), (3, "water 12 + the 7 morning!")]
    rest = ["Москва является столицей России", "北京是中华人民共和国的首都", "Wszyscy ludzie rodzą się wolni i równi", "a3f09c7be2d4418f" * 9, "!@#$%^&*(){}[]<>?/|~ " * 20, "12345 67890 3.14 " * 20, "aGVsbG8gd29ybGQhIFRoaXMgaXMgYmFzZTY0Lg" * 5]
    docs = [*own, *((10 + i, t * k) for k in (1, 4) for i, t in enumerate(rest, 10 * k))]
    rows = [(i, t, "en", "src") for i, t in docs] + [(1000 + i, t, x, "src") for i, t, x in train]
    model = langid.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"), ("de", "en"))
    got = {r.doc_id: r for r in langid.identify_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), model, ("de", "en")).collect()}
    assert [(got[i].lang, got[i].accepted) for i in (1, 2, 3)] == [("en", True), ("de", True), ("en", True)]
    assert [i for i, _ in docs[3:] if got[i].accepted] == [] and all(got[1000 + i].accepted for i, *_ in train)
    bare = langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string"), ("de", "en"))
    assert langid.identify_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), bare, ("de", "en")).where("accepted").count() == 0


def notices(text):
    return [(x[0], x[2]) for x in licenses.Scanner(licenses.TEMPLATES).notices(licenses.bare(text))]


def test_licenses(spark):
    docs = [(1, "Words here. Released under the MIT License.\nMore words."), (2, "Licensed under the Apache License, Version 2.0."), (3, "A license to hunt wild geese was sold to him at the market yesterday."), (4, None), (5, "")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert (got[1].licenses, got[2].licenses, got[3].licenses, got[4].licenses) == ("MIT", "Apache-2.0", "", "")
    assert got[3].n_blocks == 1 and got[5].n_blocks == 0
    s = licenses.Scanner(licenses.TEMPLATES)
    for name, t in licenses.TEMPLATES.items():
        own = t.replace("{}", "work")
        assert s.rank(own)[0][1] == name and notices(own) == [(name, True)]
    d = spark.createDataFrame([(1, f"{licenses.TEMPLATES['MIT']} This book is licensed under the GNU General Public License, version 5.")], "doc_id long, text string")
    assert [(r.template, r.confirmed, r.lacks, r.adds) for r in licenses.found(d).collect()] == [("MIT", True, "", ""), ("GPL-2.0", False, "2", "")]  # of the two versions, alike in all else, the first by name


def test_licenses_are_confirmed_by_exact_wording():
    assert notices("This work is licensed under the GNU General Public License, version 2.") == [("GPL-2.0", True)]
    assert notices("This work is not licensed under the GNU General Public License, version 3.") == [("GPL-3.0", False)]
    for text in ("Not licensed under CC BY-NC 4.0.", "It isn't released under the MIT License.", "Released under the new MIT License.", "Licensed under the Apache License, Version 1.1."):
        assert [x[1] for x in notices(text)] == [False]
    assert notices("This is not ours. Released under the MIT Licence.") == [("MIT", True)]
    assert notices("Licensed under the Apache License, Version 2.0. Released under the MIT License.") == [("Apache-2.0", True), ("MIT", True)]
    lines = ["Permission is hereby granted, free of charge, to any person obtaining a copy", "of this software and associated documentation files (the \"Software\"), to deal", "in the Software without restriction, including"]
    for lead in ("", "# ", " * ", "// "):
        assert notices("\n".join(lead + x for x in lines)) == [("MIT-notice", True)]


def test_licenses_match_a_search_for_the_wording(spark):
    rng, docs = random.Random(8), []
    ways = {n: t.replace("{}", "page") for n, t in licenses.TEMPLATES.items()}
    for i in range(120):
        parts = []
        for _ in range(rng.randint(1, 4)):
            t = ways[rng.choice(sorted(ways))]
            w = t.split()
            kind = rng.randint(0, 4)
            if kind == 1:
                w[rng.randrange(len(w))] = "goose"
            elif kind == 2:
                w.insert(rng.randint(1, len(w) - 1), "wild")
            elif kind == 3:
                w = [x.upper() + ("\n" if rng.random() < 0.3 else "") for x in w]
            parts += [" ".join(w), text(rng.randint(0, 30)) + "."]
        docs.append((i, " ".join(parts)))
    word = lambda t: re.findall(r"[^\W_]+(?:[.\-][^\W_]+)*", t.lower())
    got = {r.doc_id: set(r.licenses.split(",")) - {""} for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    longer = {"Apache-2.0": "Apache-2.0-notice"}  # the long notice begins with the short one
    for i, t in docs:
        w = f" {' '.join(word(t))} "
        want = {n for n, x in ways.items() if re.search(" " + " ".join(r"\S+" if y == "page" and "{}" in licenses.TEMPLATES[n] else re.escape(y) for y in word(x)) + " ", w)}
        assert got[i] - set(longer) == want - set(longer) and got[i] <= want, t


def test_licenses_finds_every_notice_of_a_block(spark):
    t = {n: x.replace("{}", "work") for n, x in licenses.TEMPLATES.items()}
    six = ["MIT", "CC-BY-NC-4.0", "GPL-3.0", "BSD", "CC-BY-SA-4.0", "Apache-2.0-notice"]
    long = "the licensed geese " + text(600)
    docs = [(1, f"{t['MIT']} {t['CC-BY-NC-4.0']}"), (2, " ".join(t[n] for n in six)), (3, f"{text(40)} released under the MIT License."), (4, f"{long} {t['ISC']} and {long}")]
    docs.append((5, f"A license to hunt geese was sold. {t['MIT']} {t['MIT']}"))
    got = {r.doc_id: (r.n_blocks, r.n_confirmed, r.licenses) for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1] == (2, 2, "CC-BY-NC-4.0,MIT") and got[2] == (6, 6, ",".join(sorted(six)))
    assert got[3] == (1, 1, "MIT") and got[4] == (3, 1, "ISC") and got[5] == (3, 2, "MIT")


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16))
    x[100:160] = x[100]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(2000, None, 0), (2020, [0.0] * 16, 0), (2040, [float("nan")] * 16, 0), (2060, [None] * 16, 0), (20, x[20].tolist(), 1)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), shard=512).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(by) == set(range(0, 1500, 20))
    hit = 0
    for q, found in by.items():
        s = x @ x[q]
        best = [j for j in np.lexsort((np.arange(1500), -np.round(s, 9))) if j != q][:20]
        found = sorted(found)
        assert [r for r, *_ in found] == list(range(1, 21)) and q not in [v for _, v, _ in found]
        assert all(abs(score - s[v]) < 1e-9 for _, v, score in found)
        hit += len({v for _, v, _ in found} & set(best))
    assert hit >= 0.9 * 20 * len(by)
    few = ann.search(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in few] == [(0, 1, 1, 0.5)]
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_urls(spark):
    urls = ["https://WWW.Example.com/en/71?q=1", "http://example.com/en/9", "http://a.example.net/de/81", "http://b.example.net/de/7", "x://example.org/es/#a", None, "no scheme", "http://free-bets.example.org/fr/1", "http://freebets.example.org/", "http://tion.example.net", "http://example.com"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [(r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, {"tion": 50, "the": 90}).orderBy("page_id").collect()]
    assert got[0] == ("www.example.com", "/en/71", "example.com/en/7", "allow")
    assert got[1][2:] == ("com/en/", "block") and got[2][2:] == ("example.net/de/8", "allow") and got[3][2:] == ("net/de/", "block") and got[4] == ("example.org", "/es/", "org/es/", "block")
    assert got[5] == ("", "", None, "allow") == got[6]
    assert got[7][3] == got[8][3] == "block" and got[9][3] == "allow" and got[10][:2] == ("example.com", "")
    assert urlfilter.Segmenter({"free": 9, "bets": 9, "fre": 1}).split("freebets") == ["free", "bets"]


def test_urls_are_split_by_the_counts_of_all_words(spark):
    common = " ".join(f"{a}{b}{c}x " * 4 for a in "bcdfghjklm" for b in "aeiouyw" for c in "bcdfghjklmnpqrst")  # 1,120 words
    texts = [(i, "http://h.example.fr/", f"<p>{common.translate({120: 96 + i})}") for i in range(1, 23)]  # and 21 like it
    pages = spark.createDataFrame([*texts, (50, "http://essex.example.fr/", "<p>essex es essex sex es sex sex es sex es")], "page_id long, url string, html string")
    counts = urlfilter.word_counts(pages, "html")
    assert counts.count() > 20_000 and counts.where("w = 'essex'").first().n == 2
    got = {r.page_id: r.verdict for r in urlfilter.judge(pages, counts).collect()}
    assert got[50] == "allow" and len(got) == 23


def test_urls_with_long_names_are_split(spark):
    urls = [f"http://h.example.fr/{'freebetscasinobonus' * n}" for n in (13, 14, 2000)]
    got = urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), {"the": 90}).orderBy("page_id").collect()
    assert [r.verdict for r in got] == ["block"] * 3


def test_urls_parse_as_in_sql(spark):
    import duckdb

    at = "/root/testdata/sf0.01/pages.parquet"
    rest = "regexp_replace(url, '^.*?://', '', 's')"
    sql = f"""with p as (select page_id, case when contains(url, '://') then translate(regexp_extract({rest}, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
      case when contains(url, '://') then regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) else '' end as path from '{at}'),
    r as (select * from (values ('com', '/en/', 'com/en/', 'block'), ('example.com', '/en/7', 'example.com/en/7', 'allow'), ('net', '/de/', 'net/de/', 'block'), ('example.net', '/de/8', 'example.net/de/8', 'allow'), ('org', '/es/', 'org/es/', 'block')) t(h, s, rule, verdict))
    select page_id, host, path, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict from p left join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, s) group by all"""
    want = {r[0]: r[1:] for r in duckdb.sql(sql).fetchall()}
    pages = spark.read.parquet(at)
    got = urlfilter.judge(pages, {"the": 90}).collect()
    assert len(got) == len(want) == pages.count()
    for r in got:
        host, path, rule, verdict = want[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and (rule is None or r.verdict == verdict)


def test_urls_are_scored_by_what_rules_judge(spark):
    bad, good = ["bingo", "spin", "loot"], ["river", "stone", "field"]
    urls = [f"http://{RNG.choice(bad)}{RNG.choice(bad)}{i}.com/en/{RNG.choice(good)}" for i in range(40)] + [f"http://{RNG.choice(good)}{RNG.choice(good)}{i}.example.com/en/7" for i in range(40)]
    new = ["http://spinloot.example.fr/", "http://riverfield.example.fr/stone", "http://unseen.example.fr/"]
    pages = spark.createDataFrame(list(enumerate(urls + new)), "page_id long, url string")
    counts = {w: 50 for w in [*bad, *good, "example", "en"]}
    got = {r.page_id: r for r in urlfilter.judge(pages, counts, examples=([], []), prior=0.5).collect()}
    # brute force
    seg = urlfilter.Segmenter(counts)
    tokens = {u: [t for n in urlfilter.names_of(*urlfilter.split_url(u)) for t in seg.split(n)] for u in urls + new}
    judged = [(u, got[i].rule is not None and got[i].verdict) for i, u in enumerate(urls)]
    n = {v: {} for v in ("block", "allow")}
    for u, v in judged:
        for t in tokens[u]:
            n[v][t] = n[v].get(t, 0) + 1
    known = set(n["block"]) | set(n["allow"])
    for i, u in enumerate(urls + new):
        s = sum(math.log((n["block"].get(t, 0) + 1) / (sum(n["block"].values()) + len(known)) * (sum(n["allow"].values()) + len(known)) / (n["allow"].get(t, 0) + 1)) for t in tokens[u] if t in known)
        assert abs(got[i].score - 1 / (1 + math.exp(-s))) < 1e-6
    assert [got[80 + i].verdict for i in range(2)] == ["block", "allow"]
    held = {r.verdict: (r.n, r.agree) for r in urlfilter.held_out(pages, counts, examples=([], [])).collect()}
    assert all(agree >= 0.8 * n for n, agree in held.values()) and sum(n for n, _ in held.values()) > 5


def test_names_are_split_at_the_least_cost():
    seg = urlfilter.Segmenter({"ab": 9, "abc": 2, "cd": 5, "d": 1, "a": 3, "bcd": 4})

    def ways(x):
        return [[]] if not x else [[x[:i], *rest] for i in range(1, len(x) + 1) for rest in ways(x[i:])]

    cost = lambda ws: sum(seg.cost.get(w, seg.unknown(len(w))) for w in ws)
    for name in ("abcd", "abab", "xabcdx", "dcba", "abcabcd"):
        assert abs(cost(seg.split(name)) - min(map(cost, ways(name)))) < 1e-9


def page(i, body):
    return f"<html><head><title>T{i}</title><style>p{{}}</style></head><body><nav><a>Home</a></nav><div class='ad'>Buy {i}</div>{body}<footer>&copy; site</footer></body></html>"


def test_main_text(spark):
    bodies = [f"<article><h1>Head {i}</h1><p>First <b>bold</b> &amp; {i}.<br>on<p>Second\n line {i}</p><aside>see also</aside><div class=comments><p>me first</p></div></article>" for i in range(30)]
    rows = [(i, f"http://h.example.com/{i}", page(i, b)) for i, b in enumerate(bodies)] + [(100, None, None), (101, "x", ""), (102, "http://h.example.com/z", "plain &lt;text&gt;")]
    got = {r.page_id: r for r in htmlextract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(30):
        assert got[i].text == f"Head {i}\nFirst bold & {i}. on\nSecond line {i}" and got[i].n_chars == len(got[i].text)
    assert got[100].text == got[101].text == "" and got[102].text == "plain <text>"
    # no article tags: what all pages of the group share is the template, the slots are what is left
    plain = [page(i, f"<div><p>Welcome to our pages</p><p>Story number{i} told{i}</p></div>") for i in range(6)]
    assert htmlextract.extract(plain) == [f"Story number{i} told{i}" for i in range(6)]


def test_main_text_without_lines_that_all_articles_repeat():
    lines = ["<p>Read the other stories of the week</p>", "<ul><li>Print the page</li></ul>"]
    pages = [page(i, f"<article><p>The story {i} of the day</p>{lines[0] * (1 + i % 2)}<p>and the end of {i}</p>{lines[1]}</article>") for i in range(6)]
    assert htmlextract.extract(pages) == [f"The story {i} of the day\nand the end of {i}" for i in range(6)]
    # copies of one main text make no template of it
    copies = [page(i, "<article><p>One and the same story</p></article>") for i in range(6)]
    assert htmlextract.extract(copies) == ["One and the same story"] * 6


@pytest.mark.parametrize("n", [5, 23, 24, 60])
def test_main_text_by_one_rule_at_every_group_size(n):
    body = lambda i: f"<div>By author{i}</div><article id='post-{i}' class='post post-{i}'><p>Story {i}</p><p>Read the other stories</p></article><div>Teaser {i}</div>"
    assert htmlextract.extract([page(i, body(i)) for i in range(n)]) == [f"Story {i}" for i in range(n)]
    # nor does one page without an article change the others
    got = htmlextract.extract([*(page(i, body(i)) for i in range(n)), page(n, "<div>Notes on words</div>"), None])
    assert got == [*(f"Story {i}" for i in range(n)), "Notes on words", ""]


def site(i, n=30):
    words = " ".join(f"w{i}x{j}" for j in range(n))
    top, bottom = "<div class=top><a>Home</a><a>All</a></div>", "<div class=bottom>All rights reserved</div>"
    own = f"<div class=content><h1>Title {i}</h1><div class=body><p>{words}</p><blockquote>q{i}</blockquote><p>end {i}</p></div></div>"
    return f"<html><body>{top}<div class=wrap><div class=left><p>Hot: x{i}</p></div>{own}</div>{bottom}</body></html>", f"Title {i}\n{words}\nq{i}\nend {i}"


@pytest.mark.parametrize("n", [3, 8, 40])
def test_main_slot_without_article_tags(n):
    pages = [site(i) for i in range(n)]
    assert htmlextract.extract([p for p, _ in pages]) == [t for _, t in pages]
    # two makes of pages on one host
    other = [f"<body><div class=bar>Menu</div><section><p>{' '.join(f's{i}y{j}' for j in range(20))}</p></section><div class=end>The end</div></body>" for i in range(n)]
    got = htmlextract.extract([x for p, o in zip(pages, other) for x in (p[0], o)])
    assert got[::2] == [t for _, t in pages] and got[1::2] == [" ".join(f"s{i}y{j}" for j in range(20)) for i in range(n)]


def test_versions_of_one_text_are_no_template():
    words = lambda k: " ".join(f"p{k}w{j}" for j in range(40))
    pages = [page(i, "<article>" + "".join(f"<p>{words(k)}</p>" for k in range(9)) + f"<p>version {i}</p></article>") for i in range(8)]
    assert htmlextract.extract(pages) == ["\n".join([*(words(k) for k in range(9)), f"version {i}"]) for i in range(8)]


def test_tags_are_read_by_the_rules_of_html():
    one = lambda body: htmlextract.extract([f"<article>{body}</article>"])[0]
    assert one("<p title=it's>Hello</p><p title=it's>World</p>") == "Hello\nWorld"
    assert one('<p title="open>Hello</p><p>World</p>') == "Hello\nWorld"
    assert one('<p title="a > b" class=\'x>y\'>a &lt; b&nbsp;&#8212; c</p>') == "a < b \u2014 c"
    assert one("<div class=search-results><p>kept</p></div><div class='share'>kept too</div>") == "kept\nkept too"
    assert one("<script>if (a < b) x('</p>')</script><p>a <!-- b --> c</p><br>d 3 < 4") == "a c\nd 3 < 4"


def test_fixity(spark):
    rows = [(f"w{i % 3}", (i // 3) * 5000, 5000, f"payload {i}") for i in range(300)]
    a = spark.createDataFrame(rows, "file string, offset long, length long, payload string")
    assert warc.audit(a, a).count() == 0
    hurt = [(f, o, n, p + "x" if i == 50 else p) for i, (f, o, n, p) in enumerate(rows) if i != 77] + [("w9", 0, 5, "new")]
    got = {(r.file, r.offset, r.status) for r in warc.audit(a, spark.createDataFrame(hurt, a.schema)).collect()}
    assert got == {("w2", 80000, "corrupt"), ("w2", 125000, "missing"), ("w9", 0, "extra")}
    empty = a.limit(0)
    assert warc.audit(empty, empty).count() == 0 and warc.audit(empty, a).count() == 300
    odd = spark.createDataFrame([(None, None, None, None)], a.schema)
    assert warc.audit(odd, odd).count() == 0
