"""License statements in documents, found by patience alignment with templates.

Words that occur once in a stretch of text and once in the template are anchors; the longest increasing run of anchors is
kept, and the gaps between them are aligned the same way. A gap without anchors is aligned by longest common subsequence.
The share of template words that the alignment covers is the score; ``COVERED`` or more is a license.

A text can only reach that share if it holds one of the ``needed`` words of the template (their places are more than may
stay unmatched), so others are passed over by one pattern in the JVM. Around each such word a stretch of the template's
length to both sides is aligned. Null and empty texts have no license; repeated rows and null ids give a row each; ties
go to the longer template, then the name. Extra columns are not read.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COVERED = 0.8
#: Words of a stretch beside the template's own, as a multiple of its length.
REACH = 1.0

# Public license statements.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
)
_WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def longest_increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing run."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect.bisect_left(tops, v)
        tops[k : k + 1] = [v]
        at[k : k + 1] = [i]
        back[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def common_subsequence(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif table[i + 1][j] >= table[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places (in a, in b), increasing in both."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        i, i_end, j, j_end = work.pop()
        if i == i_end or j == j_end:
            continue
        in_a, in_b = Counter(a[i:i_end]), Counter(b[j:j_end])
        place = {w: k for k, w in enumerate(b[j:j_end], j) if in_b[w] == 1 and in_a.get(w) == 1}
        anchors = [(k, place[w]) for k, w in enumerate(a[i:i_end], i) if w in place]
        if not anchors:
            out += [(i + x, j + y) for x, y in common_subsequence(a[i:i_end], b[j:j_end])]
            continue
        kept = [anchors[k] for k in longest_increasing([y for _, y in anchors])]
        out += kept
        for (x, y), (x_end, y_end) in zip([(i - 1, j - 1), *kept], [*kept, (i_end, j_end)], strict=True):
            work.append((x + 1, x_end, y + 1, y_end))
    return sorted(out)


def needed(template: list[str], covered: float = COVERED) -> set[str]:
    """Words of which a text that covers the template holds at least one: the longest ones."""
    spare = int(len(template) * (1 - covered) + 1e-9)
    count, out, places = Counter(template), set(), 0
    for w in sorted(count, key=lambda w: (-len(w), w)):
        out.add(w)
        places += count[w]
        if places > spare:
            return out
    return out


def licenses_in(text: str, templates, covered: float = COVERED) -> list[tuple[str, float, int, int]]:
    """(license, coverage, first and last word) of the best stretch of every template that the text covers."""
    spans = [m.span() for m in _WORD.finditer(text)]
    tokens = [text[a:b].lower() for a, b in spans]
    places: dict[str, list[int]] = {}
    for i, w in enumerate(tokens):
        places.setdefault(w, []).append(i)
    found = []
    for name, template, keys in templates:
        n = len(template)
        reach = int(n * REACH) + 1
        best = None
        last = -1
        for at in sorted(p for w in keys for p in places.get(w, ())):
            if at < last:
                continue  # the stretch around an earlier word holds this one's
            low, high = max(0, at - reach), min(len(tokens), at + 2 * reach)
            last = at + reach // 2
            pairs = patience(tokens[low:high], template)
            # Matches far from the rest are chance: keep the densest window of the template's reach.
            pairs = densest(pairs, n + reach)
            share = len(pairs) / n
            if share >= covered and (best is None or share > best[1]):
                best = (name, share, spans[low + pairs[0][0]][0], spans[low + pairs[-1][0]][1], n)
        if best:
            found.append(best)
    found.sort(key=lambda f: (-f[1], -f[4], f[0]))
    return [f[:4] for f in found]


def densest(pairs: list[tuple[int, int]], width: int) -> list[tuple[int, int]]:
    """The most pairs whose places in the text lie within ``width`` words; the first such run on ties."""
    best, j = (0, 0), 0
    for i in range(len(pairs)):
        while pairs[i][0] - pairs[j][0] >= width:
            j += 1
        if i + 1 - j > best[1] - best[0]:
            best = (j, i + 1)
    return pairs[best[0] : best[1]]


def scan_licenses(docs: DataFrame, templates=TEMPLATES, covered: float = COVERED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, coverage, start, end, licenses): best license with its place in characters, and all by name."""
    ready = [(name, words(text), needed(words(text), covered)) for name, text in templates]
    keys = sorted({w for _, _, k in ready for w in k})
    text = F.col(f"`{text_col}`").cast("string")
    pattern = rf"(?iU)(?<![\w])(?:{'|'.join(map(re.escape, keys))})(?![\w])"
    hits = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.when(text.rlike(pattern), text).alias("text"))

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1):
                found = licenses_in(text.as_py(), ready, covered) if text.is_valid else []
                rows.append((*found[0], sorted({f[0] for f in found})) if found else (None, None, None, None, []))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "license", "coverage", "start", "end", "licenses"])

    return hits.mapInArrow(run, "doc_id long, license string, coverage double, start long, end long, licenses array<string>")
