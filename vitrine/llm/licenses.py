"""License notices in documents by patience alignment with templates.

Words that stand once in a stretch of text and once in a license template are
anchors; the longest increasing run of them (by patience sorting) is kept,
equal words beside anchors are taken along, and each gap between anchors is
aligned in the same way, where more words are unique. A gap without any such
word is aligned by its longest common subsequence.

Words of a notice that stands twice, or whose words also stand elsewhere, are
not unique in the text. So stretches are cut first: windows around a template's
rarest words of which enough other words of the template are there, in order.
What they bound is exact, so any number of notices of a text is found. Coverage
is the share of a template's words that are aligned in a stretch.

Documents are independent rows; memory follows the longest one.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Coverage from which a notice counts.
LEAST_COVERAGE = 0.8
#: Words of a stretch, at most so many for each word of the template.
MOST_SPREAD = 2.0

_WORD = re.compile(r"\w+(?:\.\d+)*")

#: Usual notices of licenses, by SPDX identifier.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, in order of the first, whose second increases: piles of patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    before: list[int] = []
    for k, (_, b) in enumerate(pairs):
        i = bisect_left(tops, b)
        before.append(piles[i - 1] if i else -1)
        if i == len(tops):
            tops.append(b)
            piles.append(k)
        else:
            tops[i], piles[i] = b, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of equal words in ``a`` (a template) and ``b`` (a stretch of text), both increasing."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        run = _increasing([(i, where[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in where])
        if not run:
            if not in_a.keys().isdisjoint(in_b):
                out += [(a0 + i, b0 + j) for i, j in _common(a[a0:a1], b[b0:b1])]
            continue
        last_a, last_b = a0, b0
        for i, j in run:
            if i < last_a or j < last_b:
                continue
            x, y = i, j  # back over equal words before the anchor
            while x > last_a and y > last_b and a[x - 1] == b[y - 1]:
                x, y = x - 1, y - 1
            work.append((last_a, x, last_b, y))
            u, v = i + 1, j + 1
            while u < a1 and v < b1 and a[u] == b[v]:
                u, v = u + 1, v + 1
            out.extend(zip(range(x, u), range(y, v), strict=True))
            last_a, last_b = u, v
        work.append((last_a, a1, last_b, b1))
    return sorted(out)


def alignment(a: list[str], b: list[str], most: int) -> list[tuple[int, int]]:
    """``aligned``; where anchors lead it astray, so that it has fewer than the ``most`` words that can be aligned, a longest common subsequence."""
    pairs = aligned(a, b)
    return pairs if len(pairs) >= most else _common(a, b)


def _places(wanted: list[str], own: list[str], counts: Counter[str], least: float) -> list[tuple[int, int, int]]:
    """How many words can be aligned in, start and end of the stretches of a template's notices, none over another.

    An alignment leaves out few of the template's words, so of one word more
    than that, the rarest in the text, one is aligned: only windows around those
    are tried. How many words each allows is exact, by bits of the template.
    """
    n = len(wanted)
    need, span, full = max(1, ceil(least * n - 1e-9)), int(MOST_SPREAD * n), (1 << n) - 1
    masks: dict[str, int] = {}
    for i, w in enumerate(wanted):
        masks[w] = masks.get(w, 0) | 1 << i
    rare = set(sorted(wanted, key=lambda w: counts[w])[: n - need + 1])
    starts: set[int] = set()
    for w in rare:
        at = -1
        for _ in range(counts[w]):
            at = own.index(w, at + 1)
            starts.update(range(max(0, at - span + 1), at + 1))
    out: list[tuple[int, int, int]] = []
    work = [(0, len(own), sorted(s for s in starts if own[s] in masks))]
    while work:
        low, high, tried = work.pop()
        found = []
        for s in tried:
            window = own[s : min(high, s + span)]
            if sum(map(masks.__contains__, window)) < need:
                continue
            free, most, end = full, 0, s
            for e, w in enumerate(window, s + 1):
                mask = masks.get(w)
                if mask:
                    both = free & mask
                    free = ((free + both) | (free - both)) & full
                    aligned_now = n - free.bit_count()
                    if aligned_now > most:
                        most, end = aligned_now, e
            if most >= need:
                found.append((most, s, end))
        if not found:
            continue
        taken = _apart(sorted(found, key=lambda f: (-f[0], f[2] - f[1], f[1])))
        out.extend(taken)
        # what reached into those that are taken may do without
        edges = [low, *(x for _, s, e in sorted(taken, key=lambda f: f[1]) for x in (s, e)), high]
        for x, y in zip(edges[::2], edges[1::2], strict=True):
            if y - x >= need:
                work.append((x, y, tried[bisect_left(tried, x) : bisect_left(tried, y)]))
    return out


def _apart(spans: list[tuple]) -> list[tuple]:
    """In order, those of ``spans`` (start and end last) that lie over none taken before."""
    starts: list[int] = []
    ends: list[int] = []
    out = []
    for one in spans:
        start, end = one[-2:]
        i = bisect_left(starts, end)
        if i == 0 or ends[i - 1] <= start:
            starts.insert(i, start)
            ends.insert(i, end)
            out.append(one)
    return out


@dataclass(frozen=True)
class Notice:
    """``start`` and ``end`` are the first aligned word of the text and one past the last; ``missing`` are the template's words that aren't there, in order."""

    license: str
    coverage: float
    start: int
    end: int
    missing: tuple[str, ...] = ()


def notices(text: str, templates: dict[str, list[str]] | None = None, least: float = LEAST_COVERAGE) -> list[Notice]:
    """All notices, none over another: that of most aligned words first (then the best covered, the first by name, the first in the text)."""
    own = words(text)
    counts = Counter(own)
    found = []
    for name in sorted(templates if templates is not None else TEMPLATES):
        for template in (templates if templates is not None else TEMPLATES)[name]:
            wanted = words(template)
            if not wanted or sum(w in counts for w in wanted) < least * len(wanted):
                continue
            for most, start, end in _places(wanted, own, counts, least):
                pairs = alignment(wanted, own[start:end], most)
                there = {i for i, _ in pairs}
                missing = tuple(w for i, w in enumerate(wanted) if i not in there)
                found.append((-len(pairs), -len(pairs) / len(wanted), name, missing, start + pairs[0][1], start + pairs[-1][1] + 1))
    return [Notice(name, -share, start, end, missing) for _, share, name, missing, start, end in _apart(sorted(found, key=lambda f: (*f[:3], *f[4:])))]


def find(text: str, templates: dict[str, list[str]] | None = None, least: float = LEAST_COVERAGE) -> tuple[str | None, float, int, int]:
    """License, coverage and span of the first of ``notices``, or no license, coverage 0 and an empty span."""
    return next(((n.license, n.coverage, n.start, n.end) for n in notices(text, templates, least)), (None, 0.0, 0, 0))


def scanned(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None, least: float = LEAST_COVERAGE) -> DataFrame:
    """``id_col``, ``license`` (null if none), ``coverage``, ``start`` and ``end`` (words) of the notice of most aligned words, and
    all ``notices`` in the order of the text (with the template's ``missing`` words), a row for each row of ``documents``.

    Null and empty texts have no license, coverage 0, an empty span and no notices. Equal
    texts have equal results; other columns are neither read nor returned.
    """
    field = documents.schema[id_col]

    names = ["license", "coverage", "start", "end"]
    kinds = [pa.string(), pa.float64(), pa.int32(), pa.int32()]
    every = pa.list_(pa.struct([*zip(names, kinds, strict=True), ("missing", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [notices(x.as_py() or "", templates, least) for x in batch.column(1)]
            first = [n[0] if n else Notice(None, 0.0, 0, 0) for n in found]
            columns = [pa.array([getattr(n, c) for n in first], k) for c, k in zip(names, kinds, strict=True)]
            listed = [[{**n.__dict__, "missing": list(n.missing)} for n in sorted(own, key=lambda n: n.start)] for own in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(listed, every)], names=[field.name, *names, "notices"])

    own = [T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]
    each = T.StructType([*own, T.StructField("missing", T.ArrayType(T.StringType()))])
    schema = T.StructType([T.StructField(field.name, field.dataType), *own, T.StructField("notices", T.ArrayType(each))])
    return documents.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, schema)
