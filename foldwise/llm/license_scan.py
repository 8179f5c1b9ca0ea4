"""Operator 9: license scans by conditional compression.

Every license cue of a text that no confirmed notice covers yet is judged.  For every template the
words around the cue, as many on each side as a notice of that template can have, are searched for the
span around the cue that differs least in its words; line breaks are of no account.  A template is
confirmed if the wording differs little enough.  Version numbers must agree
exactly, so neighbouring versions are told apart.  The span is compressed twice with zstandard,
alone and with the template as raw dictionary; of several confirmed templates the one that saves most bytes
is taken.  Templates that lack too many words around the cue to be confirmed are not compared.

The cue filter runs before Python, so texts without a cue cost one expression.

Edge cases: null, empty and cue-free texts give no rows; of templates that tie
the first is taken; repeated rows and repeated notices each
give a row; a null id is kept; an empty table gives an empty result; other columns are
ignored.  A line with a cue but no part of a confirmed notice gives one row with ``confirmed`` false, for the
template of the largest relative reduction around its first cue.  ``line`` is where the notice starts.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import small_batches

CUES = (r"(?i)\b((un)?licen[sc]ed?|copyright(ed)?|copyleft|spdx|public domain|creative commons|all rights reserved"
        r"|permission is hereby granted|redistribution and use|free software)\b")
MAX_DIFFERENCE, LEVEL = 0.2, 19

# Short public license notices, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0"],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions:",
        "SPDX-License-Identifier: MIT"],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:",
        "SPDX-License-Identifier: BSD-3-Clause"],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-only"],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, Version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": [
        "Licensed under CC0 1.0.",
        "This work has been dedicated to the public domain under CC0 1.0 Universal."],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Released under the Unlicense."],
    "Proprietary": ["All rights reserved."],
}

TOKEN = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
PART = re.compile(r"[a-z0-9.-]+")
SCHEMA = ("line int, license string, template int, reduction double, missing_words int, inserted_words int, "
          "differences string, confirmed boolean, block string")


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


class Template:
    def __init__(self, license: str, number: int, text: str):
        self.license, self.number, self.words = license, number, tokens(text)
        self.counts = Counter(self.words)
        self.reach = int(len(self.words) * (1 + MAX_DIFFERENCE)) + 1     # words of a confirmed notice at most
        raw = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False,
                                                   write_dict_id=False, write_checksum=False)


def wording(template: list[str], block: list[str], cue: int) -> tuple[list[str], list[str], int, int]:
    """(template words that are missing, words put between the matched ones, first and end of the span)
    for the span of block words around word ``cue`` that differs least from the template."""
    n = len(block)
    cost = [[0 if j <= cue else j - cue for j in range(n + 1)]]
    for w in template:
        above, here = cost[-1], [cost[-1][0] + 1]
        for j in range(n):
            v = min(above[j + 1], here[j]) + 1
            here.append(above[j] if block[j] == w and above[j] < v else v)
        cost.append(here)
    i, j = len(template), min(range(cue + 1, n + 1), key=lambda j: (cost[-1][j], j))
    end, missing, inserted = j, [], []
    while i or (j > cue and cost[0][j]):
        if i and j and block[j - 1] == template[i - 1] and cost[i][j] == cost[i - 1][j - 1]:
            i, j = i - 1, j - 1
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            missing.append(template[i])
        else:
            j -= 1
            inserted.append(block[j])
    return missing[::-1], inserted[::-1], j, end


class Scanner:
    def __init__(self, templates: dict[str, list[str]]):
        self.cue = re.compile(CUES)
        self.templates = [Template(name, i, t) for name, texts in templates.items() for i, t in enumerate(texts)]
        self.alone = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
        self.longest = max(t.reach for t in self.templates)
        self.known: dict[tuple, tuple | None] = {}

    def around(self, low: str, at: int) -> tuple[list[tuple[int, int]], int]:
        """Places of the words around the cue at ``at``, as many on each side as a notice can have; the cue's number."""
        reach = 256
        while True:
            start = max(0, at - reach)
            if start:                          # not inside a word
                m = PART.match(low, start)
                start = m.end() if m else start
            before = [m.span() for m in TOKEN.finditer(low, start, at)] if start < at else []
            if len(before) > self.longest or reach >= at:
                break
            reach *= 2
        # a word that the cue is part of, as in a hyphenated name, starts before it
        if before and (before[-1][1] == at or before[-1][1] == at - 1 and low[at - 1] in ".-"):
            at = before.pop()[0]
        before = before[-self.longest:]
        after = [m.span() for m in islice(TOKEN.finditer(low, at), self.longest + 1)]
        return before + after, len(before)

    def judge(self, words: list[str], cue: int, text: str, places: list[tuple[int, int]]) -> tuple[dict, int, int] | None:
        """The confirmed notice around a word, with its first word and the end of its words."""
        found = []
        for order, t in enumerate(self.templates):
            far = t.reach
            first = max(0, cue - far)
            block = words[first:cue + far + 1]
            # no wording of these words can have less missing
            if sum((t.counts - Counter(block)).values()) > MAX_DIFFERENCE * len(t.words):
                continue
            missing, inserted, a, b = wording(t.words, block, cue - first)
            if len(missing) + len(inserted) <= MAX_DIFFERENCE * len(t.words) \
                    and not any(c.isdigit() for w in missing for c in w):
                span = text[places[first + a][0]:places[first + b - 1][1]]
                found.append((*self.gain(t, span), order, t, missing, inserted, first + a, first + b, span))
        if not found:
            return None
        # the template that explains most bytes
        saved, share, _, t, missing, inserted, a, b, span = min(found, key=lambda x: (-x[0], x[2]))
        return self.row(t, share, missing, inserted, True, span), a, b

    def gain(self, t: Template, block: str) -> tuple[int, float]:
        """Bytes and share of the compressed size that the template saves."""
        raw = block.encode("utf-8", "surrogatepass")
        alone = len(self.alone.compress(raw))
        saved = alone - len(t.compressor.compress(raw))
        return saved, saved / alone

    def row(self, t: Template, share: float, missing: list[str], inserted: list[str], ok: bool, block: str) -> dict:
        return {"license": t.license, "template": t.number, "reduction": share,
                "missing_words": len(missing), "inserted_words": len(inserted),
                "differences": " ".join([*("-" + w for w in missing), *("+" + w for w in inserted)]),
                "confirmed": ok, "block": block}

    def unexplained(self, words: list[str], cue: int, text: str, places: list[tuple[int, int]]) -> dict:
        """The row of a cue that no template explains: the template with the largest size reduction."""
        best = None
        for t in self.templates:
            a, b = max(0, cue - len(t.words)), min(len(places), cue + len(t.words) + 1)
            block = text[places[a][0]:places[b - 1][1]]
            share = self.gain(t, block)[1]
            if best is None or share > best[0]:
                best = share, t, a, b, block
        share, t, a, b, block = best
        missing, inserted, *_ = wording(t.words, words[a:b], cue - a)
        return self.row(t, share, missing, inserted, False, block)

    def scan(self, text: str) -> list[dict]:
        low = text.lower()
        if len(low) != len(text):              # a few letters have a longer lower form; places must agree
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        confirmed, open_cues, past = [], [], 0
        for m in self.cue.finditer(text):
            if m.start() < past:
                continue
            places, cue = self.around(low, m.start())
            if cue >= len(places):
                continue
            words = [low[a:b] for a, b in places]
            seen = (cue, text[places[0][0]:places[-1][1]])
            if len(self.known) > 20_000:
                self.known.clear()
            if seen not in self.known:
                self.known[seen] = self.judge(words, cue, text, places)
            if self.known[seen]:
                row, a, b = self.known[seen]
                confirmed.append((places[a][0], places[b - 1][1], row))
                past = places[b - 1][1]
            else:
                open_cues.append((m.start(), places, cue))
        # line numbers: all places are looked up in one pass
        breaks = [m.start() for m in re.finditer("\n", text)]
        line = lambda at: bisect_left(breaks, at)
        rows = [(a, dict(row, line=line(a))) for a, _, row in confirmed]
        told = {n for a, b, _ in confirmed for n in range(line(a), line(b - 1) + 1)}
        for at, places, cue in open_cues:      # one row per line without a notice
            if line(at) not in told:
                told.add(line(at))
                words = [low[a:b] for a, b in places]
                rows.append((at, dict(self.unexplained(words, cue, text, places), line=line(at))))
        return [row for _, row in sorted(rows, key=lambda x: x[0])]


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text",
                  templates: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per license notice found: its line, license, reduction and wording differences."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).filter(
        F.col("text").rlike(CUES))
    wanted = templates or TEMPLATES
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(wanted)
        for pdf in batches:
            found = [{"doc_id": d} | row for d, t in zip(pdf["doc_id"], pdf["text"], strict=True)
                     for row in scanner.scan(t)]
            if found:
                yield pd.DataFrame(found, columns=["doc_id", *names]).astype({"line": "int32", "template": "int32"})

    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInPandas(work, f"doc_id {kind}, {SCHEMA}").withColumnRenamed("doc_id", key)
