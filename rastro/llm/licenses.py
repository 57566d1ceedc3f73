"""License scans by conditional compression.

A text is one stream of words, over all its lines and without comment marks. Candidate blocks are the surroundings of cues, as
wide as the longest template. Each block is compressed with zstandard once plainly and once with every template as a raw
dictionary; templates that save enough are ranked by the bytes they save. The exact differences in wording of the best one, or of
several that save nearly the same, confirm it: words that the block lacks, has more, or has otherwise. What is confirmed leaves the
block, and what is left of it is tried again. Templates are a table of (name, text).
"""

from __future__ import annotations

import re
from bisect import bisect
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastro.llm.common import ddl_type, map_rows, read

#: Short license notices as they are commonly written.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
            "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
            "persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
                "either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; "
                "either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
                 "either version 2.1 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
                "https://mozilla.org/MPL/2.0/."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
            "permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("all-rights-reserved", "All rights reserved."),
    ("public-domain", "This work is dedicated to the public domain."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
            "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
            "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
            "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
            "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code "
                     "must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this "
                     "list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS "
                     "AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
                     "DISCLAIMED."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code "
                     "must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this "
                     "list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the "
                     "names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE "
                     "COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
                     "PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
             "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
             "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an "
             "acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as "
             "being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source "
                  "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)

#: A notice holds one of these, over line ends and comment marks as well.
CUES = ("licen", "copyright", "permission", "redistribut", "rights reserved", "public domain", "creative commons", "free software", "cc by", "spdx")
_CUE = re.compile("|".join(map(re.escape, CUES)))
_MAYBE = re.compile("|".join(re.escape(c).replace(r"\ ", r"[\W_]+") for c in CUES), re.IGNORECASE)
_WORD = re.compile(r"\S+")
#: Comment marks, and what else is no part of a word at its ends.
_MARKS = "/*#%!<>|-;"
_AROUND = ".,:()\"'" + _MARKS

#: Bytes a template must save of a block, in per cent of its own plainly compressed size, to be a candidate.
LEAST_SAVING = 25
#: Templates that save as many bytes but for these are told apart by their wording.
NEAR = 8
#: Words of a block; longer surroundings are cut into several that overlap.
BLOCK_WORDS = 1024
#: Words, in per cent of the template's, that may be missing, added or other in a confirmed block.
MOST_OTHER_WORDS = 20

_COST = 1 << 32  # one word missing or added; below it the place a stretch begins at


def words(text: str) -> list[str]:
    return [x for w in _WORD.findall(text) if (x := w.strip(_AROUND).lower())]


@dataclass(frozen=True)
class Template:
    name: str
    text: str
    words: tuple[str, ...]
    numbers: np.ndarray
    most_other: int


@dataclass(frozen=True)
class Stream:
    """A text's words, their (start, end) in code points, their numbers among all templates' words, and whether each belongs to a cue."""

    text: str
    words: list[str]
    places: list[tuple[int, int]]
    numbers: np.ndarray
    cues: np.ndarray

    def broken(self, i: int) -> bool:
        """Does a line end stand before word ``i``?"""
        return "\n" in self.text[self.places[i - 1][1]:self.places[i][0]]

    def closed(self, i: int) -> bool:
        """Does word ``i`` end a sentence?"""
        return self.text[self.places[i][0]:self.places[i][1]].rstrip("\"')")[-1:] in (".", "!", "?")


class Matcher:
    """Dictionaries of all templates, built once per task."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.vocabulary: dict[str, int] = {}
        self.templates = []
        for name, text in templates:
            ws = tuple(words(text))
            numbers = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws], dtype=np.int64)
            self.templates.append(Template(name, text, ws, numbers, MOST_OTHER_WORDS * len(ws) // 100))
        self.holds = [np.append(np.isin(np.arange(len(self.vocabulary)), t.numbers), False) for t in self.templates]  # the last for other words, -1
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
        self.given = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(t.text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                                               write_content_size=False, write_checksum=False, write_dict_id=False) for t in self.templates]
        self.alone = [len(self.plain.compress(t.text.lower().encode())) for t in self.templates]
        self.reach = max((len(t.words) + t.most_other for t in self.templates), default=0)

    def stream(self, text: str) -> Stream:
        found, places = [], []
        for m in _WORD.finditer(text):
            word = m[0].strip(_AROUND).lower()
            if word:
                found.append(word)
                behind = next((len(x) for x in ("*/", "-->") if m[0].endswith(x)), 0)
                places.append((m.end() - len(m[0].lstrip(_MARKS)), m.end() - behind))
        numbers = np.fromiter((self.vocabulary.get(w, -1) for w in found), dtype=np.int64, count=len(found))
        starts = np.cumsum([0] + [len(w) + 1 for w in found])
        cues = np.zeros(len(found), dtype=bool)
        for m in _CUE.finditer(" ".join(found)):
            first, last = np.searchsorted(starts, [m.start(), m.end() - 1], side="right") - 1
            cues[first:last + 1] = True
        return Stream(text, found, places, numbers, cues)

    def savings(self, block: str) -> list[int]:
        """Bytes that each template as a dictionary saves of the block; case does not count."""
        raw = block.lower().encode()
        whole = len(self.plain.compress(raw))
        return [whole - len(c.compress(raw)) for c in self.given]

    def matches(self, stream: Stream) -> list[dict]:
        """The confirmed notices of all blocks; those of overlapping blocks may overlap."""
        hits, todo = [], blocks(stream, self.reach)
        while todo:
            start, end = todo.pop()
            hit = self.best(stream, start, end)
            if hit:
                hits.append(hit)
                first, behind = hit.pop("words")
                todo += [(a, b) for a, b in ((start, first), (behind, end)) if stream.cues[a:b].any()]
        return hits

    def best(self, stream: Stream, start: int, end: int) -> dict | None:
        """The confirmed template that saves most of a block; of those that save nearly as much, the one with fewer other words, then the shorter, the earlier stretch."""
        saved = self.savings(" ".join(stream.text[a:b] for a, b in stream.places[start:end]))
        ranked = sorted((i for i, n in enumerate(saved) if n * 100 >= LEAST_SAVING * self.alone[i]), key=lambda i: -saved[i])
        while ranked:
            near = [i for i in ranked if saved[i] >= saved[ranked[0]] - NEAR]
            found = [x for i in near for x in self.confirmed(stream, start, end, i, saved[i])]
            if found:
                return min(found, key=lambda h: (h["n_other"], h["end"] - h["start"], h["start"], -h["saving"]))
            ranked = ranked[len(near):]
        return None

    def confirmed(self, stream: Stream, start: int, end: int, i: int, saved: int) -> list[dict]:
        t = self.templates[i]
        part = Stream(stream.text, stream.words[start:end], stream.places[start:end], stream.numbers[start:end], stream.cues[start:end])
        out = []
        for a, b in windows(part, t, self.holds[i]):
            found = differences(t, stream, start + a, start + b)
            if found["n_other"] <= t.most_other:
                out.append({"license": t.name, "template": i, "saving": round(100 * saved / self.alone[i], 3), **found, "start": part.places[a][0], "end": part.places[b - 1][1], "words": (start + a, start + b)})
        return out


def blocks(stream: Stream, reach: int) -> list[tuple[int, int]]:
    """Surroundings of the cues, ``reach`` words on both sides, put together where they meet and cut where they are long."""
    n, out = len(stream.words), []
    for at in np.flatnonzero(stream.cues).tolist():
        a, b = max(0, at - reach), min(n, at + reach + 1)
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], b
        else:
            out.append((a, b))
    step = max(BLOCK_WORDS - 2 * reach, reach)
    return [(a, min(a + step + 2 * reach, b)) for first, b in out for a in (range(first, max(b - 2 * reach, first + 1), step))]


def windows(stream: Stream, t: Template, holds: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (first word, word behind the last) that differ from the template by ``most_other`` words or fewer, the best of each beginning.

    Nothing is lost beforehand: such a stretch has at most ``most_other`` words more than the template, and all
    but ``most_other`` of the template's words stand in it.
    """
    n, size = len(stream.words), len(t.words)
    if not size or n < size - t.most_other:
        return []
    reach = size + t.most_other
    behind = np.minimum(np.arange(n) + reach, n)
    alike = np.concatenate(([0], np.cumsum(holds[stream.numbers])))
    cues = np.concatenate(([0], np.cumsum(stream.cues)))
    starts = np.flatnonzero((alike[behind] - alike[:-1] >= size - t.most_other) & (cues[behind] > cues[:-1]))
    if not len(starts):
        return []
    gaps = np.flatnonzero(starts[1:] > behind[starts[:-1]]) + 1
    out = []
    for part in np.split(starts, gaps):
        at, to = int(part[0]), int(behind[part[-1]])
        last = _distances(t.numbers, stream.numbers[at:to], anywhere=True)[-1]
        cost = -(-last // _COST)  # last is cost * _COST - start
        best: dict[int, tuple[int, int]] = {}
        for end in np.flatnonzero(cost <= t.most_other).tolist():
            start = int(cost[end] * _COST - last[end])
            if end > start and (start not in best or cost[end] < best[start][0]):
                best[start] = (int(cost[end]), end)
        out += [(at + start, at + end) for start, (_, end) in best.items() if stream.cues[at + start:at + end].any()]
    return out


def _distances(template: np.ndarray, block: np.ndarray, anywhere: bool) -> list[np.ndarray]:
    """Words missing and added between the template's beginning and the block's words before each place.

    All rows if the block is compared from its first word on. ``anywhere``: the last row alone, for stretches that begin at any
    word, as distance * _COST - beginning; of equal ones the latest beginning.
    """
    steps = np.arange(len(block) + 1, dtype=np.int64) * _COST
    row = -np.arange(len(block) + 1, dtype=np.int64) if anywhere else steps
    rows = [row]
    for word in template:
        new = row + _COST
        same = np.flatnonzero(block == word)
        new[same + 1] = np.minimum(new[same + 1], row[same])
        row = np.minimum.accumulate(new - steps) + steps
        if anywhere:
            rows[0] = row
        else:
            rows.append(row)
    return rows


def differences(t: Template, stream: Stream, start: int, end: int) -> dict:
    """Words missing, added or replaced between the template's first and last word in the stretch; what stands around it does not count.

    But where the template's first or last words are missing and the sentence goes on in the same line, or with a
    number in the next, the words there stand in their place.
    """
    block = stream.numbers[start:end]
    rows = _distances(t.numbers, block, anywhere=False)
    i, j = len(t.words), end - start
    missing, added, met = [], [], []
    while i or j:
        if i and j and t.numbers[i - 1] == block[j - 1] and rows[i][j] == rows[i - 1][j - 1]:
            i, j = i - 1, j - 1
            met.append(i)
        elif i and rows[i][j] == rows[i - 1][j] + _COST:
            i -= 1
            missing.append(t.words[i])
        else:
            j -= 1
            added.append(stream.words[start + j])
    missing, added = missing[::-1], added[::-1]
    for _ in range(met[-1] if met else 0):
        if start == 0 or stream.closed(start - 1) or stream.broken(start):
            break
        start -= 1
        added.insert(0, stream.words[start])
    for _ in range(len(t.words) - 1 - met[0] if met else 0):
        if end == len(stream.words) or stream.closed(end - 1) or stream.broken(end) and not re.search(r"\d", stream.words[end]):
            break
        added.append(stream.words[end])
        end += 1
    return {"n_other": len(missing) + len(added), "missing": missing, "added": added}


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``licenses``, an array of (license, template, start, end, saving, n_other, missing, added), for every row.

    Positions are code points of the notice, from its first to its last word. Null, empty and cue-less texts have none.
    Of overlapping notices the one that saves more bytes stays, then the one with fewer other words, the shorter, the
    earlier. ``saving`` is the bytes saved in per cent of the template's own compressed size. Rows are scanned one by one; the table of templates is fixed and small, and an empty one finds
    nothing.
    """
    kind = "array<struct<license:string,template:int,start:int,end:int,saving:double,n_other:int,missing:array<string>,added:array<string>>>"

    def rows(columns, matcher):
        return [columns[0], [_found(t, matcher) for t in columns[1]]]

    return map_rows(docs.select(id_col, text_col), f"`{id_col}` {ddl_type(docs, id_col)}, licenses {kind}", rows, lambda: Matcher(templates))


def _found(text: str | None, matcher: Matcher) -> list[dict]:
    if not text or not _MAYBE.search(text):
        return []
    out: list[dict] = []
    starts: list[int] = []
    for hit in sorted(matcher.matches(matcher.stream(text)), key=lambda h: (-h["saving"] * matcher.alone[h["template"]], h["n_other"], h["end"] - h["start"], h["start"])):
        at = bisect(starts, hit["start"])
        if (at == 0 or out[at - 1]["end"] <= hit["start"]) and (at == len(out) or hit["end"] <= out[at]["start"]):
            out.insert(at, hit)
            starts.insert(at, hit["start"])
    return out


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"))
    listed = F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string")))
    return found.select("doc_id", F.size("licenses").cast("bigint").alias("n_licenses"), F.array_join(F.array_sort(F.array_distinct("licenses.license")), ",").alias("licenses"),
                        F.array_join(listed, ",").alias("spans"), F.aggregate("licenses", F.lit(0).cast("bigint"), lambda n, x: n + x["n_other"]).alias("n_other_words"))


QUERIES = {"op4_license_scan": op4_license_scan}
ORACLES = {}
