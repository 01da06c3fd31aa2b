"""License scans by conditional compression.

A candidate block is a line with a license word, and the neighbouring lines that read like license
text. Each block is compressed alone and with every template as zstandard raw dictionary; the
templates are ranked by how much they shorten it. All that do are confirmed by their exact wording:
the words of the template that the block lacks and those it has in excess, along the best alignment.
Few words may differ, and none that tells licenses apart: a version, "lesser", "affero", a clause of a
Creative Commons name, or a "not" before the grant. All of it is map-side; the templates are a constant.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_arrow

# License notices by SPDX identifier, as their publishers word them.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License 2.0.",
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "MIT": [
        "Licensed under the MIT License.",
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    ],
    "GPL-3.0": [
        "Licensed under the GNU General Public License v3.0.", "Licensed under the GNU General Public License, version 3.",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "Licensed under the GNU General Public License v2.0.", "Licensed under the GNU General Public License, version 2.",
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL-2.0": ["Licensed under the Mozilla Public License 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License v3.0.", "Licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL-2.1": ["Licensed under the GNU Lesser General Public License v2.1.", "Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License v3.0.", "Licensed under the GNU Lesser General Public License, version 3.", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "BSD-2-Clause": [
        "Licensed under the BSD 2-Clause License.",
        "Released under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."],
    "EUPL-1.2": ["Licensed under the EUPL, Version 1.2."],
    "Proprietary": ["All rights reserved."],
}

HINT = re.compile(r"licen[sc]|copyright|rights reserved|redistribut|permission (?:is|to)|creative commons|cc[ -]?by|cc0|spdx|public domain|unencumbered|eupl|as[ -]is\b|warrant|free software", re.I)
#: A line that names its licenses: identifiers joined by AND, OR, WITH and brackets. What follows WITH is an exception.
SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+\-() \t]+)")
_NAMED = re.compile(r"(?<![A-Za-z0-9.+-])(WITH[ \t]+)?([A-Za-z0-9][A-Za-z0-9.+-]*)")
WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
#: Words that may differ (share), but for those that tell one license from another.
DIFFERENT = 0.1
# Parts of words that only some licenses have, words that a version follows, and what turns a grant around.
TELLING = frozenset("lesser affero sharealike sa noncommercial noncommercially nc noderivatives noderivs nd".split())
VERSIONED = frozenset("version v license licence by by-sa by-nc by-nd cc0 attribution attribution-sharealike attribution-noncommercial eupl clause bsd".split())
NEGATIONS = frozenset("not never t".split())
GRANTS = frozenset("licensed released granted permitted distributed available free under".split())
_VERSION = re.compile(r"v?\d+(?:[.-][^\W_]+)*")
#: Characters of a block beyond which the surroundings of its license words are compared, on each side half as many:
#: at least four times as many as the longest template has, so that no notice is cut.
LONG = 6000
LEVEL = 3


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Scanner:
    def __init__(self, templates: dict[str, list[str]] = TEMPLATES):
        self.templates = [(name, k, words(t)) for name, texts in templates.items() for k, t in enumerate(texts)]
        self.long = max(LONG, 4 * max((len(" ".join(t)) for _, _, t in self.templates), default=0))
        self.vocabulary = {w for _, _, t in self.templates for w in t}
        self.alone = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False).compress
        self.given = []
        for _, _, t in self.templates:
            held = zstandard.ZstdCompressionDict(b" ".join(w.encode() for w in t) + b" " * 16, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            self.given.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False).compress)

    def _reads_like(self, line: str) -> bool:
        found = words(line)
        return bool(found) and 5 * sum(w in self.vocabulary for w in found) >= 3 * len(found)

    def blocks(self, text: str) -> Iterator[tuple[int, list[str]]]:
        """(first line, words) of the candidate blocks; blank lines inside a block belong to it."""
        lines = text.split("\n")
        done = -1
        for i, line in enumerate(lines):
            if i <= done or not HINT.search(line):
                continue
            first, last, at = i, i, i
            while at > max(0, done + 1) and (not lines[at - 1].strip() or self._reads_like(lines[at - 1])):
                at -= 1
                first = at if lines[at].strip() else first
            at = i
            while at + 1 < len(lines) and (not lines[at + 1].strip() or HINT.search(lines[at + 1]) or self._reads_like(lines[at + 1])):
                at += 1
                last = at if lines[at].strip() else last
            done = last
            block = "\n".join(lines[first : last + 1])
            yield first, block.lower()

    def _windows(self, block: str, starts: list[int]) -> Iterator[tuple[int, int]]:
        """Where in a block's words (that begin at starts) is looked for notices: everywhere, or in a long one about each hint."""
        if len(block) <= self.long:
            yield 0, len(starts)
            return
        end = -1
        for m in HINT.finditer(block):
            if m.start() >= end - self.long // 4:  # windows overlap by more than the longest template
                end = m.end() + self.long // 2
                yield bisect_left(starts, m.start() - self.long // 2), bisect_left(starts, end)

    @staticmethod
    def _tells(template: list[str], block: list[str], missing: list[str], extra: list[str], lo: int, hi: int) -> bool:
        """Whether what differs makes it another license, or none."""
        parts = {p for w in (*missing, *extra) for p in re.split("[.-]", w)}
        if parts & TELLING or any(w.replace("-", "") in TELLING for w in (*missing, *extra)):
            return True
        versions = {w for before, w in zip(template, template[1:]) if before in VERSIONED and _VERSION.fullmatch(w)}
        if versions & set(missing):
            return True
        bigrams = set(zip(template, template[1:]))
        return any(x in NEGATIONS and y in GRANTS and (x, y) not in bigrams for x, y in zip(block[max(0, lo - 1) : hi], block[max(0, lo - 1) + 1 : hi + 1]))

    @staticmethod
    def _lacking(block: Counter, template: list[str]) -> int:
        """Words of the template that the block hasn't anywhere: no alignment misses fewer."""
        return (Counter(template) - block).total()

    @classmethod
    def aligned(cls, block: list[str], template: list[str]) -> tuple[list[str], list[str], int, int]:
        """wording, and where in the block it begins and ends: about each place where the template can lie, the best."""
        n, found = len(template), None
        places = {0: len(block)}
        if len(block) > n:
            index: dict[str, list[int]] = {}
            for at, w in enumerate(template):
                index.setdefault(w, []).append(at)
            votes = Counter((at - x) // 8 for at, w in enumerate(block) for x in index.get(w, ()))
            places |= {max(0, 8 * v - n // 8 - 8): min(len(block), 8 * v + n + n // 8 + 16) for v, c in votes.items() if c >= (1 - DIFFERENT) * n / (DIFFERENT * n / 8 + 2)}  # a confirmed notice has so many in one of its diagonals
        for lo, hi in places.items():
            part = block[lo:hi]
            missing, extra = cls.wording(part, template)
            if found is None or len(missing) + len(extra) < len(found[0]) + len(found[1]):
                shared = [m for m in difflib.SequenceMatcher(None, template, part, autojunk=False).get_matching_blocks() if m.size]
                found = missing, extra, lo + (shared[0].b if shared else 0), lo + (shared[-1].b + shared[-1].size if shared else 0)
        return found

    @staticmethod
    def wording(block: list[str], template: list[str]) -> tuple[list[str], list[str]]:
        """The template's words that the block lacks, and what the block has between the first and last that it shares."""
        parts = difflib.SequenceMatcher(None, template, block, autojunk=False).get_opcodes()
        shared = [p for p in parts if p[0] == "equal"]
        if not shared:
            return template, []
        lo, hi = shared[0][3], shared[-1][4]
        missing = [w for tag, a, b, _, _ in parts if tag in ("delete", "replace") for w in template[a:b]]
        extra = [w for tag, _, _, a, b in parts if tag in ("insert", "replace") for w in block[max(a, lo) : min(b, hi)]]
        return missing, extra

    def scan(self, text: str) -> Iterator[dict]:
        """One row for each notice confirmed in a block, or one without a license: a notice's words are taken out and the rest is judged again.

        An SPDX line names its licenses by itself, whatever the templates.
        """
        for at, line in enumerate(text.split("\n") if "SPDX-License-Identifier" in text else ()):
            for named in SPDX.finditer(line):
                for exception, name in _NAMED.findall(named[1]):
                    if not exception and name not in ("AND", "OR"):
                        yield {"line": at, "n_words": 1, "license": name, "reduction": 0.0, "missing": [], "extra": [], "candidate": name}
        for first, block in self.blocks(SPDX.sub("", text)):
            tokens = [(m[0], m.start()) for m in WORD.finditer(block)]
            starts, breaks = [at for _, at in tokens], [i for i, c in enumerate(block) if c == "\n"]
            taken, any_found, nothing = bytearray(len(tokens)), False, None
            for low, high in self._windows(block, starts):
                left = [i for i in range(low, high) if not taken[i]]  # what another window found is not found again
                while left:
                    row, places = self._best([tokens[i][0] for i in left])
                    if not places:
                        nothing = nothing or row
                        break
                    any_found = True
                    for a, b in places:
                        yield row | {"line": first + bisect_left(breaks, starts[left[a]]), "n_words": len(tokens)}
                        for i in left[a:b]:
                            taken[i] = 1
                    left = [i for i in left if not taken[i]]
            if nothing and not any_found:
                yield nothing | {"line": first, "n_words": len(tokens)}

    def _best(self, block: list[str]) -> tuple[dict, list[tuple[int, int]]]:
        """The row of the notice that a block's words confirm best, and all places of just that wording; no place without one."""
        joined, counted = b" ".join(w.encode() for w in block), Counter(block)
        alone = len(self.alone(joined))
        gains = sorted(((alone - len(c(joined)), -i) for i, c in enumerate(self.given)), reverse=True)
        row = {"license": None, "reduction": max(0.0, gains[0][0] / alone), "missing": [], "extra": [], "candidate": self.templates[-gains[0][1]][0]}
        best = None
        for gain, i in gains:
            name, _, template = self.templates[-i]
            if gain <= 0:
                break
            if self._lacking(counted, template) > DIFFERENT * len(template):
                continue
            # The block may hold more than the notice: what lies outside the alignment doesn't count.
            missing, extra, lo, hi = self.aligned(block, template)
            rank = (len(missing) + len(extra)) / len(template)
            if rank <= DIFFERENT and (best is None or (rank, -len(template)) < best[0]) and not self._tells(template, block, missing, extra, lo, hi):
                best = (rank, -len(template)), lo, hi
                row |= {"license": name, "reduction": gain / alone, "missing": missing, "extra": extra}
        if best is None:
            return row, []
        _, lo, hi = best
        places, wording, at, size = [], block[lo:hi], 0, hi - lo
        while at + size <= len(block):
            if block[at] == wording[0] and block[at : at + size] == wording and (at == lo or at == 0 or block[at - 1] not in NEGATIONS):
                places.append((at, at + size))
                at += size
            else:
                at += 1
        return row, places if any(a == lo for a, _ in places) else [(lo, hi)]


FOUND = "blocks array<struct<line: int, n_words: int, candidate: string, license: string, reduction: double, missing: array<string>, extra: array<string>>>"
_BLOCK = pa.struct([("line", pa.int32()), ("n_words", pa.int32()), ("candidate", pa.string()), ("license", pa.string()), ("reduction", pa.float64()), ("missing", pa.list_(pa.string())), ("extra", pa.list_(pa.string()))])


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, licenses (confirmed, sorted, distinct), blocks.

    A block's row has the line of the notice (of the block without one), the block's length in words, the best template by size reduction (candidate),
    the confirmed license or null, the reduction as a share, and the exact differences in wording.
    Null and empty texts have no block; repeated rows and null ids are scanned each; an empty table
    gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            found = [list(scanner.scan(t)) if t and HINT.search(t) else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted({b["license"] for b in x if b["license"]}) for x in found], pa.list_(pa.string())), pa.array(found, pa.list_(_BLOCK))], ["doc_id", "licenses", "blocks"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, licenses array<string>, {FOUND}")
