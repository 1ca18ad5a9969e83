"""License scans: winnowed fingerprints of templates pick candidates, banded alignment gives coverage and spans."""

from __future__ import annotations

import bisect
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.llm.common import WordHashes, run_hashes, slices, small_batches, word_hashes

# Notices and license texts, as their publishers word them.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "mit-notice": "Released under the MIT License.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
}
GRAM = 3
BAND = 8
COVERAGE = 0.8
DIAGONALS = 256
_TOKEN = re.compile(r"[^\W_]+")


def gram_and_window(m: int, coverage: float) -> tuple[int, int]:
    """(words in a gram, grams in a window) by which winnowing misses no text of at least `coverage`: k words of a template of m changed, left out or
    parted by others leave m - k equal words in k + 1 runs at most, so one run has this many words, and window + gram - 1 words hold a fingerprint."""
    need = min(m, max(1, math.ceil(coverage * m - 1e-9)))
    run = -(-need // (m - need + 1))
    gram = min(GRAM, run)
    return gram, run - gram + 1


def winnowed(grams: np.ndarray, window: int) -> list[int]:
    """Positions of the fingerprints: in each window of grams the last of the smallest."""
    if not len(grams):
        return []
    out: list[int] = []
    for i in range(max(1, len(grams) - window + 1)):
        part = grams[i : i + window]
        at = i + len(part) - 1 - int(np.argmin(part[::-1]))
        if not out or out[-1] != at:
            out.append(at)
    return out


def scores(template: np.ndarray, words: np.ndarray, diagonals: np.ndarray, band: int) -> np.ndarray:
    """For each diagonal (place in words less place in template), template word i and place k of the band: the most equal words, in order, from there on."""
    m, width = len(template), 2 * band + 1
    score = np.zeros((len(diagonals), m + 1, width + 1), np.int32)
    for i in range(m - 1, -1, -1):
        places = (i + diagonals - band)[:, None] + np.arange(width)
        equal = (places >= 0) & (places < len(words))
        equal &= words[np.clip(places, 0, len(words) - 1)] == template[i]
        below = score[:, i + 1, :width]
        step = below + equal
        np.maximum(step[:, 1:], below[:, :-1], out=step[:, 1:])  # the template's word is skipped: same place is one to the left in the next row
        score[:, i, :width] = np.maximum.accumulate(step[:, ::-1], axis=1)[:, ::-1]
    return score


def span(score: np.ndarray, template: np.ndarray, words: np.ndarray, diagonal: int, band: int) -> tuple[int, int]:
    """(first, last) matched word of one of the best alignments of a diagonal: of those the one that starts last, and from there ends early."""
    m, i, k, first, last = len(template), 0, 0, -1, -1
    while i < m and score[i, k] > 0:
        place = i + diagonal - band + k
        if first < 0 and score[i, k] == score[i, k + 1]:
            k += 1
        elif 0 <= place < len(words) and words[place] == template[i] and score[i, k] == score[i + 1, k] + 1:
            first, last = (place if first < 0 else first), place
            i += 1
        elif score[i, k] == score[i, k + 1]:
            k += 1
        else:
            i, k = i + 1, max(k - 1, 0)
    return first, last


def lower_in_place(text: str) -> str:
    """text in lower case, each character in its place: one whose lower case is longer stays as it is."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


class Scanner:
    """The templates' inverted index, and the alignment of candidates."""

    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        self.cache, self.coverage = WordHashes(), coverage
        self.names = sorted(templates)
        self.words = [self.hashed(_TOKEN.findall(templates[n].lower())) for n in self.names]
        self.index: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for t, w in enumerate(self.words):
            if len(w):
                gram, window = gram_and_window(len(w), coverage)
                grams = run_hashes(w, gram)
                for at in winnowed(grams, window):
                    self.index.setdefault(gram, {}).setdefault(int(grams[at]), []).append((t, at))
        self.fingerprints = {gram: np.array(sorted(places), np.uint64) for gram, places in self.index.items()}

    def hashed(self, words: list[str]) -> np.ndarray:
        return word_hashes([w.encode() for w in words], self.cache)

    def hits(self, template: np.ndarray, words: np.ndarray, diagonals: np.ndarray) -> list[tuple[int, int, int]]:
        """(matches, first, last) of the alignments that cover the template, apart from one another: the best first, then those between them.

        A word more makes up for three foreign words in the span, and a short template is also aligned in a band that sees no copy beside it, so that
        no alignment takes its words from two copies."""
        out, todo = [], [(0, len(words), diagonals)]
        least = self.coverage * len(template) - 1e-9
        wide = max(BAND, len(template) - math.ceil(least))
        while todo:
            low, high, mine = todo.pop()
            part, found = words[low:high], []
            if len(part) < least:
                continue
            for at in range(0, len(mine), DIAGONALS):
                some = mine[at : at + DIAGONALS] - low
                for band in sorted({wide, min(wide, len(template) // 2)}, reverse=True):
                    score = scores(template, part, some, band)
                    total = score[:, 0].max(axis=1)
                    hit = np.flatnonzero((total >= least) & (total > 0))
                    for j in hit:
                        first, last = span(score[j], template, part, int(some[j]), band)
                        found.append((int(total[j]), low + first, low + last, int(some[j]) + low))
                    some = some[hit]
                    if not len(some):
                        break
            kept: list[tuple[int, int, int]] = []
            for matches, first, last, _ in sorted(found, key=lambda x: (x[2] - x[1] - 4 * x[0], -x[0], x[1])):
                at = bisect.bisect(kept, first, key=lambda x: x[1])
                if (not at or kept[at - 1][2] < first) and (at == len(kept) or last < kept[at][1]):
                    kept.insert(at, (matches, first, last))
            if kept:
                out += kept
                again = np.unique([x[3] for x in found])
                for a, b in zip([low, *(x[2] + 1 for x in kept)], [*(x[1] for x in kept), high]):
                    near = again[np.searchsorted(again, a - len(template) - wide) : np.searchsorted(again, b + wide)]
                    if len(near):
                        todo.append((a, b, near))
        return out

    def find(self, text: str) -> list[dict]:
        low = lower_in_place(text)
        words = self.hashed(_TOKEN.findall(low))
        diagonals: dict[int, set[int]] = {}
        for gram, fingerprints in self.fingerprints.items():
            grams = run_hashes(words, gram)
            near = np.minimum(np.searchsorted(fingerprints, grams), len(fingerprints) - 1)
            for at in np.flatnonzero(fingerprints[near] == grams):
                for t, own in self.index[gram][int(grams[at])]:
                    diagonals.setdefault(t, set()).add(int(at) - own)
        out, spans = [], None
        for t, mine in diagonals.items():
            for matches, first, last in self.hits(self.words[t], words, np.array(sorted(mine), np.int64)):
                if spans is None:
                    spans = [m.span() for m in _TOKEN.finditer(low)]
                out.append({"license": self.names[t], "coverage": matches / len(self.words[t]), "start": spans[first][0], "end": spans[last][1]})
        return sorted(out, key=lambda x: (x["start"], x["license"]))


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, span_start, span_end) of every template found in a text.

    Words are runs of letters and digits in lower case. A template is a candidate where one of its winnowed fingerprints occurs; it is found if an alignment within
    8 words of that diagonal (or as many as may be missing, where that is more) matches at least `coverage` of its words. Fingerprints have 3 words, or fewer where the template is so short or `coverage` so low that the words
    allowed to differ could break all of 3, and are as dense as it takes that no such text is lost. Coverage is all that is asked: a short notice that names another license
    in one word is found. Each copy gives its own row, also beside another. Spans are code points of the text, end exclusive. Other columns are not read and may have any name; texts of any length are read whole. Templates come from
    the caller (a short list) and go to each task. Null and empty texts have none; repeated rows each give theirs; an empty table, or no template, gives no rows.
    """
    small_batches(docs.sparkSession)
    templates = TEMPLATES if templates is None else templates
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("span_start", pa.int64()), ("span_end", pa.int64())])

    def run(batches):
        scanner = Scanner(templates, coverage)
        for batch in slices(batches):
            rows = [(d, x["license"], x["coverage"], x["start"], x["end"]) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for x in scanner.find(t)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows) if rows else [[]] * 5, schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, license string, coverage double, span_start long, span_end long")


def op6(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
