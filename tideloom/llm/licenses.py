"""License scans by conditional compression.

Blocks of lines around license words are compressed once alone and once with each template as a raw zstandard
dictionary, which ranks the templates by bytes saved. In that order they are compared with the block word by word; the
first one of which enough words stand there in order gives the place, the templates are ranked once more on the text of
that place, and the first one confirmed there wins. Its differing words are reported, its words are taken out and the rest
is ranked and compared again until nothing is confirmed, so a block gives every license in it, and each as often as it
stands there.

Blocks are cut in an Arrow function and texts without a license word never reach it, so there is no shuffle.

Defined cases: a null or empty text has no blocks. Of templates that save as
many bytes the one with most words found less words that differ wins, then the one listed first. Wording that stands
together (fewer words added than it has) goes before wording that is scattered; the latter must save bytes, too. Repeated rows get equal results. Spans are in code points, from the first to the last word
of the license's own wording, end exclusive, in the order of the text. Other columns are not read.
"""

from __future__ import annotations

import difflib
import itertools
import re
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideloom.llm.common import arrow_function

# License notices by SPDX name; the reserved-rights notice, which has none, by a reference.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0-only", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0-or-later", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LicenseRef-All-Rights-Reserved", "All rights reserved."),
)

#: Words of which one must stand in a line to make it part of a block; lines at most REACH apart belong together.
CUE = r"(?i)licen[cs]|copyright|permission|redistribut|free software|source code form|warrant|rights\s+reserved"
REACH = 2
#: The part of a template's words that must be found in order.
COVER = 0.85
#: Words that a template has at least to be looked for scattered over a block.
LOOSE = 5

_CUE, _WORD = re.compile(CUE), re.compile(r"\w+(?:[.-]\w+)*")


def blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) of the runs of lines around license words."""
    out: list[list[int]] = []
    start, quiet = 0, REACH + 1
    for line in text.split("\n"):
        end = start + len(line)
        quiet += 1
        if _CUE.search(line):
            if out and quiet <= REACH:
                out[-1][1] = end
            else:
                out.append([start, end])
            quiet = 0
        start = end + 1
    return [tuple(x) for x in out]


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


@cache
def _primed():
    """(name, words, compressor) of each template."""
    make = lambda text: zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return [(name, words(text), zstandard.ZstdCompressor(level=3, dict_data=make(text))) for name, text in TEMPLATES]


def ranked(block: str) -> list[tuple[int, int]]:
    """(bytes saved, template number) of every template, most first."""
    data = block.encode()
    alone = len(zstandard.ZstdCompressor(level=3).compress(data))
    saved = [(alone - len(compressor.compress(data)), k) for k, (_, _, compressor) in enumerate(_primed())]
    return sorted(saved, key=lambda x: (-x[0], x[1]))


def together(wanted: list[str], own: list[str]) -> tuple[int, int, list[tuple[int, int]]] | None:
    """(words missing and added, words found, runs of ``own``) where the template stands with the fewest such words.

    An alignment whose start and end in ``own`` are free; all runs that fit equally well and do not overlap are given.
    """
    n, size = len(own), len(wanted)
    number = {w: i for i, w in enumerate(dict.fromkeys(own))}
    own_numbers = np.fromiter((number[w] for w in own), np.int64, n)
    at, unit = np.arange(n + 1), n + 2
    best = at.copy()  # differing words times unit, plus start, by end
    for word in wanted:
        step = best + unit
        hits = np.flatnonzero(own_numbers == number.get(word, -1))
        step[hits + 1] = np.minimum(step[hits + 1], best[hits])
        best = np.minimum.accumulate(step - at * unit) + at * unit
    differ, start = best // unit, best % unit
    found = (size + at - start - differ) // 2
    fits = np.flatnonzero(found >= COVER * size)
    if not len(fits):
        return None
    first = fits[np.lexsort((fits, -found[fits], differ[fits]))[0]]
    runs: list[tuple[int, int]] = []
    for end in fits[(differ[fits] == differ[first]) & (found[fits] == found[first])].tolist():
        if not runs or start[end] >= runs[-1][1]:
            runs.append((int(start[end]), end))
    return int(differ[first]), int(found[first]), runs


def common(wanted: list[str], own: list[str]) -> list[tuple[int, int]]:
    """The places (in ``wanted``, in ``own``) of a longest common subsequence."""
    if wanted == own:
        return [(i, i) for i in range(len(own))]
    best = [[0] * (len(own) + 1) for _ in range(len(wanted) + 1)]
    for i in reversed(range(len(wanted))):
        for j in reversed(range(len(own))):
            best[i][j] = best[i + 1][j + 1] + 1 if wanted[i] == own[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out = []
    while i < len(wanted) and j < len(own):
        if wanted[i] == own[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def scattered(wanted: list[str], own: list[str]) -> list[tuple[int, int]]:
    """The places (in ``wanted``, in ``own``) of words found in order, however far apart."""
    same = difflib.SequenceMatcher(None, wanted, own, autojunk=False).get_matching_blocks()
    return [(m.a + i, m.b + i) for m in same for i in range(m.size)]


def _first(own: list[str], order: list[tuple[int, int]]):
    """(template, runs of ``own``) of the first template, in ``order`` (bytes saved, most first), that the wording
    confirms. Templates that save as many bytes are told apart by fewest differing words."""
    tried = ((saved, k, together(_primed()[k][1], own)) for saved, k in order)
    for _, equals in itertools.groupby(tried, key=lambda x: x[0]):
        fits = [(fit[0] - fit[1], -fit[1], k, fit[2]) for _, k, fit in equals if fit]
        if fits:
            return min(fits)[2:]
    return None


def _winner(left: list[tuple[str, int, int]], order: list[tuple[int, int]], block: str):
    """(template, bytes saved, the places of its words for each time that it stands there), or None.

    The best ranked template that the block confirms gives a place, with room for its missing words at both ends. The templates are ranked once more on the text of that
    place alone, where other notices do not blur the sizes, and the first one confirmed there wins. Wording that is
    scattered over the block is looked for only where none stands together.
    """
    own = [w for w, _, _ in left]
    if fit := _first(own, order):
        k, ((start, end), *_) = fit
        pairs = common(_primed()[k][1], own[start:end])
        start, end = max(0, start - pairs[0][0]), min(len(own), end + len(_primed()[k][1]) - 1 - pairs[-1][0])
        able = dict((k, n) for n, k in order)
        near = [(n, k) for n, k in ranked(" ".join(block[a:b] for _, a, b in left[start:end])) if k in able]
        k, _ = _first(own[start:end], near)
        _, _, runs = together(_primed()[k][1], own)
        return k, able[k], [[(i, a + j) for i, j in common(_primed()[k][1], own[a:b])] for a, b in runs]
    for saved, k in order:
        wanted = _primed()[k][1]
        pairs = scattered(wanted, own) if saved > 0 and len(wanted) >= LOOSE else []
        if pairs and len(pairs) >= COVER * len(wanted):
            return k, saved, [pairs]
    return None


def confirmed(block: str) -> list[dict]:
    """The licenses whose wording stands in the block, with its span and the words that are missing or added."""
    left = [(m.group().lower(), m.start(), m.end()) for m in _WORD.finditer(block)]
    rest, found = block, []
    while True:
        own = [w for w, _, _ in left]
        there = Counter(own)
        able = {k for k, (_, wanted, _) in enumerate(_primed()) if (Counter(wanted) & there).total() >= COVER * len(wanted)}
        order = [(n, k) for n, k in ranked(rest) if k in able] if able else []
        fit = _winner(left, order, block)
        if not fit:
            return sorted(found, key=lambda x: (x["start"], x["end"]))
        k, saved, times = fit
        name, wanted, _ = _primed()[k]
        gone = set()
        for pairs in times:
            has, mine = {i for i, _ in pairs}, {j for _, j in pairs}
            first, last = pairs[0][1], pairs[-1][1]
            missing = [w for i, w in enumerate(wanted) if i not in has]
            added = [own[j] for j in range(first, last + 1) if j not in mine]
            found.append({"license": name, "saved": saved, "missing": missing, "added": added, "start": left[first][1], "end": left[last][2]})
            gone |= mine
        left = [x for j, x in enumerate(left) if j not in gone]
        rest = " ".join(block[start:end] for _, start, end in left)


RESULT = "array<struct<license:string,start:bigint,end:bigint,exact:boolean,saved:bigint,missing:array<string>,added:array<string>>>"
_TYPE = pa.list_(pa.struct([
    ("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("exact", pa.bool_()), ("saved", pa.int64()),
    ("missing", pa.list_(pa.string())), ("added", pa.list_(pa.string())),
]))


@arrow_function(f"struct<n_blocks:bigint,found:{RESULT}>")
def scan(texts: pa.Array) -> pa.Array:
    number, out = [], []
    for value in texts:
        text = value.as_py() or ""
        places = blocks(text) if text else []
        found = []
        for start, end in places:
            for x in confirmed(text[start:end]):
                exact = not x["missing"] and not x["added"]
                found.append(x | {"start": start + x["start"], "end": start + x["end"], "exact": exact})
        number.append(len(places))
        out.append(found)
    return pa.StructArray.from_arrays([pa.array(number, pa.int64()), pa.array(out, _TYPE)], names=["n_blocks", "found"])


def find_licenses(docs: DataFrame, text: str = "text", out: str = "licenses") -> DataFrame:
    """``docs`` with the struct column ``out``: the number of candidate blocks and the licenses confirmed in them."""
    return docs.withColumn(out, scan(F.when(F.col(text).rlike(CUE), F.col(text))))
