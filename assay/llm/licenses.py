"""License texts in documents: winnowed fingerprints find candidates, alignment reports them.

Templates are cut into word k-grams whose hashes are winnowed: of every window of neighbouring
k-grams the smallest is kept. The kept hashes of all templates form an inverted index. A document is
winnowed alike, so a run of shared words as long as a window and a k-gram always shares a
fingerprint; what the index returns are candidate places, as diagonals of template against text. A
banded alignment around each diagonal counts the template's words that are found in order.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.texts import named, text_or_empty

#: words of a k-gram; k-grams of a window; half width of the band; share of a template's words
GRAM, WINDOW, BAND, COVERAGE = 3, 2, 8, 0.8

# Wordings of public licenses that are looked for, the short notices and the longer ones.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."),
    "BSD clauses": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer."),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version."),
    "MIT": "Released under the MIT License.",
    "MIT permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions:"),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
        "MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
}

_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_NEVER = np.uint64(2**64 - 1)


def gram_hashes(ids: np.ndarray, k: int = GRAM) -> np.ndarray:
    """Hashes of the k-grams of word numbers; one with an unknown word (-1) can match nothing."""
    if len(ids) < k:
        return np.empty(0, np.uint64)
    out, known = np.zeros(len(ids) - k + 1, np.uint64), np.ones(len(ids) - k + 1, bool)
    for i in range(k):
        part = ids[i:len(ids) - k + 1 + i]
        out = (out + part.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        known &= part >= 0
    return np.where(known, out, _NEVER)


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the k-grams kept: the smallest of each window, the last of equals."""
    if not len(hashes):
        return np.empty(0, np.int64)
    window = min(window, len(hashes))
    views = np.lib.stride_tricks.sliding_window_view(hashes[::-1], window)
    places = len(hashes) - 1 - (np.argmin(views, axis=1) + np.arange(len(views)))
    places = np.unique(places)
    return places[hashes[places] != _NEVER]


def align(template: np.ndarray, words: np.ndarray, shift: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched, first, end): the template's words found in order near the diagonal ``shift``.

    Longest common subsequence where word j of the text may stand for word i of the template if
    |j - i - shift| <= band; first and end are the places of the first match and behind the last. Of
    equally long ones the shortest stretch that starts last.
    """
    width = 2 * band + 1
    score, first = np.zeros(width + 1, np.int64), np.full(width + 1, -1, np.int64)
    last = np.full(width + 1, -1, np.int64)
    for i, word in enumerate(template):
        new = (np.zeros_like(score), np.full_like(first, -1), np.full_like(last, -1))
        low = i + shift - band
        for d in range(width):
            j = low + d
            # the row above, one cell to the right, is the same text word
            best = (score[d + 1], first[d + 1], -last[d + 1]) if d + 1 < width else (0, -1, 1)
            if d and (new[0][d - 1], new[1][d - 1], -new[2][d - 1]) > best:
                best = (new[0][d - 1], new[1][d - 1], -new[2][d - 1])
            best = max(best, (score[d], first[d], -last[d]))  # both words skipped, at the edge of the band
            if 0 <= j < len(words) and words[j] == word:
                start = first[d] if score[d] else j
                if (score[d] + 1, start, -j) > best:
                    best = (score[d] + 1, start, -j)
            new[0][d], new[1][d], new[2][d] = best[0], best[1], -best[2]
        score, first, last = new
    at = max(range(width), key=lambda d: (score[d], first[d], -last[d]))
    return int(score[at]), int(first[at]), int(last[at]) + 1


@dataclass
class _Template:
    name: str
    ids: np.ndarray


class TemplateIndex:
    """Inverted index of the templates' fingerprints."""

    def __init__(self, templates: dict[str, str], k: int = GRAM, window: int = WINDOW):
        self.k, self.window, self.vocabulary = k, window, {}
        self.templates, postings = [], defaultdict(list)
        for name, text in sorted(templates.items()):
            words = text.encode().translate(_PLAIN).split()
            if len(words) < k:
                raise ValueError(f"template {name!r} has fewer than {k} words")
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int64)
            hashes = gram_hashes(ids, k)
            for at in winnow(hashes, window):
                postings[int(hashes[at])].append((len(self.templates), int(at)))
            self.templates.append(_Template(name, ids))
        self.hashes = np.array(sorted(postings), np.uint64)
        self.postings = [postings[int(h)] for h in self.hashes]

    def candidates(self, ids: np.ndarray, band: int) -> list[tuple[int, int]]:
        """(template, diagonal) of every place that shares a fingerprint, one for each band."""
        hashes = gram_hashes(ids, self.k)
        places = winnow(hashes, self.window)
        if not len(places):
            return []
        found = np.searchsorted(self.hashes, hashes[places])
        hit = (found < len(self.hashes)) & (self.hashes[np.minimum(found, len(self.hashes) - 1)] == hashes[places])
        diagonals = defaultdict(list)
        for place, at in zip(places[hit].tolist(), found[hit].tolist()):
            for template, offset in self.postings[at]:
                diagonals[template].append(place - offset)
        out = []
        for template, shifts in diagonals.items():
            taken = None
            for shift in sorted(shifts):
                if taken is None or shift - taken > band:
                    out.append((template, shift))
                    taken = shift
        return out

    def scan(self, text: bytes, coverage: float, band: int) -> list[dict]:
        get = self.vocabulary.get
        words = text.translate(_PLAIN).split()
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        found, spans, left = [], None, {}
        for template, shift in self.candidates(ids, band):
            wanted = self.templates[template].ids
            own = left.setdefault(template, ids.copy())
            while True:  # notices that follow each other closely lie in one band
                matched, first, end = align(wanted, own, shift, band)
                if matched < coverage * len(wanted):
                    break
                own[first:end] = -1
                spans = spans or [m.span() for m in _WORD.finditer(text.decode())]
                found.append({"license": self.templates[template].name, "matched_words": matched,
                              "coverage": matched / len(wanted), "start": spans[first][0], "end": spans[end - 1][1]})
        best: list[dict] = []
        for row in sorted(found, key=lambda r: (-r["matched_words"], -r["coverage"], r["start"], r["license"])):
            if all(row["end"] <= b["start"] or b["end"] <= row["start"] for b in best):
                best.append(row)
        return sorted(best, key=lambda r: r["start"])


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id",
                    text_col: str = "text", coverage: float = COVERAGE, band: int = BAND) -> DataFrame:
    """One row for each license found in a row's text: (doc_id, license, matched_words, coverage, start, end).

    Where matches overlap the one with more matched words is reported, then the better covered, the
    first and the first by name. ``coverage`` is the share of the template's words found in order within ``band`` words of one
    diagonal; start and end are code points, end exclusive. Case and punctuation do not count. A
    template that occurs several times in a text gives several rows. Null and empty texts give
    none; repeated rows are reported as often as they occur; an empty table gives no rows; other
    columns are not read. The index is as large as the templates, which the caller passes.
    """
    index = TemplateIndex(TEMPLATES if templates is None else templates)
    rows = docs.select(named(id_col).alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))
    kind = "array<struct<license:string,matched_words:long,coverage:double,start:long,end:long>>"

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([index.scan(t.as_py(), coverage, band) for t in texts], pa.list_(pa.struct([
            ("license", pa.string()), ("matched_words", pa.int64()), ("coverage", pa.float64()),
            ("start", pa.int64()), ("end", pa.int64())])))

    return rows.select("doc_id", run("text").alias("found")).select("doc_id", F.inline("found"))
