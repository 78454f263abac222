"""License scans by conditional compression.

The neighbourhood of each word that speaks of licenses is a candidate block. It is compressed with each template as
zstandard raw dictionary; templates are ranked by how much smaller that makes it. The winner is the first in rank that is
confirmed by its exact wording: the notice must hold every word and number of the template in order and none beside them,
but for words that the template leaves open; and no negation may go before it in its sentence. There is no least reduction:
in short blocks the coding of the other letters can outweigh a notice. The words after a confirmed notice are ranked
anew, so that any number of notices may stand side by side.

Wording is compared without case, punctuation and line breaks; the marks that begin lines of comments are left out first.
"""

from __future__ import annotations

import difflib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune
from .textkernels import tidy

#: Notices as they are commonly worded; fixed values. {} is any one word.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "MIT": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "GPL-2.0": "This {} is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This {} is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This {} is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
}
#: Words that turn a notice into its opposite, where they stand shortly before it.
NEGATIONS = {"not", "never", "no", "neither", "nor", "without", "cannot", "isn", "wasn", "aren", "weren", "isnt", "wasnt", "arent", "werent"}
_CANDIDATE = re.compile(r"licen[sc]|redistribut|permission\s+(?:is|to)|free\s+software|creative\s+commons|copyleft|public\s+license", re.I)
_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
_LEADER = re.compile(r"^[ \t]*(?:/\*+|\*+/?|//+|#+|--+|;+|%+|>+|<!--|\"\"\")[ \t]?", re.M)
_STOP = re.compile(r"[.;!?]\s")
#: Words before a notice in which a negation counts.
BEFORE = 4


def words_of(text: str) -> list[tuple[str, int, int]]:
    """(word, begin, end) of a text's words: without case, one spelling of licence, marks of possession left out."""
    return [(m[0].lower().replace("licence", "license"), *m.span()) for m in _WORD.finditer(text)]


def _plain(text: str) -> str:
    """As texts and templates are compressed: without case, and with lines joined."""
    return " ".join(text.lower().split())


class Scanner:
    def __init__(self, templates: dict[str, str]):
        import zstandard as z

        self.templates = {n: _plain(t.replace("{}", "work")) for n, t in templates.items()}
        self.wording = {n: [None if w == "{}" else w for w in re.findall(r"\{\}|[^\W_]+(?:[.\-][^\W_]+)*", t.lower().replace("licence", "license"))] for n, t in templates.items()}
        self.reach = 64 + 3 * max(map(len, templates.values())) // 2  # a notice with a word in it ends within this of the word
        how = z.ZstdCompressionParameters.from_level(3, source_size=4 * self.reach, write_content_size=False)
        self.plain = z.ZstdCompressor(compression_params=how)
        self.by = {n: z.ZstdCompressor(compression_params=how, dict_data=z.ZstdCompressionDict(t.encode(), dict_type=z.DICT_TYPE_RAWCONTENT)) for n, t in sorted(self.templates.items())}
        self.seen: dict[str, list] = {}

    def rank(self, block: str) -> list[tuple[float, str]]:
        """(share by which the template makes the block smaller, template), the largest first; ties by the longer template,
        then by name."""
        raw = _plain(block).encode("utf-8", "surrogatepass")
        base = len(self.plain.compress(raw))
        return sorted(((1 - len(c.compress(raw)) / base, n) for n, c in self.by.items()), key=lambda x: (-x[0], -len(self.templates[x[1]]), x[1]))

    def differences(self, name: str, words: list[str]) -> tuple[list[str], list[str]]:
        """The words that the stretch most like the template lacks, and those it has beside them."""
        a = [w or "*" for w in self.wording[name]]
        m = difflib.SequenceMatcher(None, a, words, autojunk=False).find_longest_match()
        low = max(0, m.b - m.a)
        ops = difflib.SequenceMatcher(None, a, words[low : low + len(a) + 4], autojunk=False).get_opcodes()
        same = [i for i, o in enumerate(ops) if o[0] == "equal"]
        lacks = [w for o in ops if o[0] != "equal" for w in a[o[1] : o[2]] if w != "*"]
        inner = [o for o in ops[same[0] : same[-1]] if o[0] != "equal"] if same else []
        return lacks, [w for o in inner for w in words[low + o[3] + a[o[1] : o[2]].count("*") : low + o[4]]]

    def place(self, name: str, found: list[tuple[str, int, int]], part: str, last: int) -> tuple[int, int] | None:
        """First and last word of the first notice, beginning at word `last` or before, whose wording doesn't differ from
        the template's; None: there is none."""
        want = self.wording[name]
        for i in range(min(last, len(found) - len(want)) + 1):
            if found[i][0] == want[0] and all(w is None or w == f[0] for w, f in zip(want, found[i : i + len(want)])):
                before = found[max(0, i - BEFORE) : i]
                stops = [k for k, (x, y) in enumerate(zip(before, [*before[1:], found[i]])) if _STOP.search(part, x[2], y[1])]
                if not any(f[0].split("'")[0] in NEGATIONS for f in before[stops[-1] + 1 if stops else 0 :]):
                    return i, i + len(want) - 1
        return None

    def notices(self, text: str) -> list[tuple[str, float, bool, tuple[int, int]]]:
        """(template, reduction, confirmed, span) of each notice of a text whose lines' leaders are gone, in order of place.
        A stretch that speaks of licenses without a confirmed notice counts as one, with the template of its first rank."""
        out, at, idle, until = [], 0, None, -1
        for c in _CANDIDATE.finditer(text):
            if c.start() < at:  # in a confirmed notice
                continue
            low = max(at, c.start() - self.reach)
            part = text[low : c.end() + self.reach]
            key = (part, c.start() - low)
            if key not in self.seen:
                if len(self.seen) > 20_000:
                    self.seen.clear()
                self.seen[key] = self._judge(part, c.start() - low, c.end() - low)
            name, gain, span = self.seen[key]
            if span:
                out += [idle] * (idle is not None) + [(name, gain, True, (low + span[0], low + span[1]))]
                at, idle = low + span[1], None
            else:
                if idle is not None and c.start() > until:  # too far from the last one to be the same stretch
                    out.append(idle)
                    idle = None
                new = (name, gain, False, c.span())
                idle, until = new if idle is None else max(idle, new, key=lambda x: x[1]), c.end() + self.reach
        return out + [idle] * (idle is not None)

    def _judge(self, part: str, begin: int, end: int) -> tuple[str, float, tuple[int, int] | None]:
        """(template, reduction, span) of the confirmed notice of the highest rank around a word, else of the first rank."""
        found = words_of(part)
        last = max((k for k, f in enumerate(found) if f[1] < end), default=0)
        ranked = self.rank(part)
        for gain, name in ranked:
            span = self.place(name, found, part, last)
            if span and found[span[1]][2] > begin:
                return name, gain, (found[span[0]][1], found[span[1]][2])
        return ranked[0][1], ranked[0][0], None


def bare(text: str | None) -> str:
    """The text without the marks that begin lines of comments."""
    return _LEADER.sub("", text or "")


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_blocks, n_confirmed, licenses, reduction for each row of docs(doc_id, text, ...): the confirmed templates
    in order of name, comma-joined (empty: none), and the largest reduction by a confirmed one (0: none). A block is a notice,
    or a stretch of the text that speaks of licenses without one.

    Of templates that reduce a block alike the longer one ranks first, then the first by name. Null and empty texts have no
    blocks, an empty table gives no rows. Very long texts are scanned whole, block by block. Repeated rows are scanned
    each; extra columns are ignored.
    """
    tune(docs.sparkSession)
    chosen = templates or TEMPLATES

    def run(batches):
        scanner = Scanner(chosen)
        for b in batches:
            rows = []
            for text in b.column(1):
                got = scanner.notices(bare(text.as_py()))
                sure = [x for x in got if x[2]]
                rows.append((len(got), len(sure), ",".join(sorted({x[0] for x in sure})), max((x[1] for x in sure), default=0.0)))
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.float64())], ["doc_id", "n_blocks", "n_confirmed", "licenses", "reduction"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, n_blocks long, n_confirmed long, licenses string, reduction double")


def found(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, template, reduction, confirmed, notice, lacks, adds: each block of scan with its text, and for those not
    confirmed the wording in which they differ from the template of the first rank."""
    tune(docs.sparkSession)
    chosen = templates or TEMPLATES

    def run(batches):
        scanner = Scanner(chosen)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                whole = bare(text.as_py())
                for name, gain, sure, (begin, end) in scanner.notices(whole):
                    around = whole[begin:end] if sure else whole[max(0, begin - scanner.reach) : end + scanner.reach]
                    lacks, adds = ([], []) if sure else scanner.differences(name, [w for w, *_ in words_of(around)])
                    rows.append((doc, name, gain, sure, around, " ".join(lacks), " ".join(adds)))
            cols = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.float64(), pa.bool_(), pa.string(), pa.string(), pa.string()))], ["doc_id", "template", "reduction", "confirmed", "notice", "lacks", "adds"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, template string, reduction double, confirmed boolean, notice string, lacks string, adds string")
