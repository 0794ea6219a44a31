"""License scans by conditional compression.

Around each cue word of licensing, as many words as the longest template has, and some slack, are looked at. A block may start
wherever one of a template's first words stands, at a line, a sentence or within one; what precedes it doesn't count. If the
first of them are missing, the words in their places count as differences, back to the line's or sentence's start. A block is
compressed with each template that it could be, as a zstandard raw dictionary (one of whose words it lacks more than may differ can't be confirmed, and is
passed over), and the templates are ranked by the bytes that they save. In that order each is confirmed or not by the exact wording: the words of
block and template are aligned, every difference is listed, and the first template with few differences, none of them in a
word with a digit (a version), wins the block. Of blocks that overlap, the one that saved most bytes stays. Line breaks and comment
marks between words don't matter, neither to the words nor to the compression.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Sealed, mapped, single

#: Licence wordings, by SPDX identifier. Fixed values.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("LicenseRef-all-rights-reserved", "All rights reserved."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES"),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)
CUE = re.compile(r"licen[cs]|copyright|permission|redistribut|public[\W_]+domain|rights[\W_]+reserved|creative[\W_]+commons|free[\W_]+software", re.I)
WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
#: Least share of the block's size saved, and most differences as a share of the template's words.
LEAST_SAVED, MOST_DIFFERENT = 0.25, 0.12
#: What ends a sentence or line.
EDGE = re.compile(r"[\n]|[.!?]\s")
#: Words of a long text that are looked at together.
PORTION = 1 << 15
LEVEL = 6


def apart(found: list[tuple], kind: Callable[[tuple], int]) -> list[tuple]:
    """Those of some passages (.., start, end), in the order given, that no earlier one of their kind overlaps."""
    taken: dict[int, list[tuple[int, int]]] = {}
    out = []
    for x in found:
        mine = taken.setdefault(kind(x), [])
        start, end = x[-2:]
        at = bisect_left(mine, (start, end))
        if (at and mine[at - 1][1] > start) or (at < len(mine) and mine[at][0] < end):
            continue
        mine.insert(at, (start, end))
        out.append(x)
    return out


class Scanner:
    """Compressors with the templates as dictionaries, and the templates' words."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES):
        self.templates = templates
        self.words = [[w.lower() for w in WORD.findall(t)] for _, t in templates]
        self.counts = [Counter(w) for w in self.words]
        self.most = [int(max(1, MOST_DIFFERENT * len(w))) for w in self.words]
        self.lengths = [int(len(w) * 1.2) + 4 for w in self.words]  # words of a block
        self.reach = max(self.lengths, default=0)
        # where a template's wording may start: one of its first words, and how many stand before it
        self.openings: dict[str, list[tuple[int, int]]] = {}
        for k, w in enumerate(self.words):
            for j, first in enumerate(w[: self.most[k] + 1]):
                self.openings.setdefault(first, []).append((k, j))
        make = lambda **k: zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_dict_id=False, **k)
        self.plain = make()
        self.texts = [" ".join(w) for w in self.words]
        raw = lambda t: make(dict_data=zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
        self.given = [raw(t) for t in self.texts]

    def reduction(self, have: list[str], k: int) -> tuple[int, float]:
        """Bytes and share of a block's size that a template saves. The block is cut to the template's length and slack."""
        data = " ".join(have)[: int(len(self.texts[k]) * 1.1) + 8].encode()
        plain = len(self.plain.compress(data))
        given = len(self.given[k].compress(data))
        return plain - given, 1 - given / plain

    def confirmed(self, have: list[str], k: int) -> tuple[list[str], int] | None:
        """The exact wording's differences and words, if they are few."""
        found, n = self.differences(have, k)
        return None if len(found) > self.most[k] or any(re.search(r"\d", x) for x in found) else (found, n)

    def winner(self, words: list[str], start: int, templates: set[int]) -> tuple[int, int, float, list[str], int] | None:
        """(bytes saved, template, share saved, differences, words) of the first template, in order of bytes saved, whose wording is confirmed at a start."""
        block = words[start : start + self.reach]
        saved = [(*self.reduction(block[: self.lengths[k]], k), k) for k in templates if self.enough(Counter(block[: self.lengths[k]]), k)]
        for size, share, k in sorted((x for x in saved if x[1] >= LEAST_SAVED), key=lambda x: (-x[0], x[2])):
            if sure := self.confirmed(block[: self.lengths[k]], k):
                return size, k, share, *sure
        return None

    def enough(self, have: Counter, k: int) -> bool:
        """Whether words hold so many of a template's that the rest could be its allowed differences."""
        return sum(min(n, have[w]) for w, n in self.counts[k].items()) >= len(self.words[k]) - self.most[k]

    def differences(self, have: list[str], k: int) -> tuple[list[str], int]:
        """The wording differences of a block's start from a template (``-word`` lacks, ``+word`` adds), and the words that the wording has."""
        want = self.words[k]
        ops = SequenceMatcher(None, want, have, autojunk=False).get_opcodes()
        if ops and ops[-1][0] == "insert":  # what follows the wording
            ops.pop()
        elif ops and ops[-1][0] == "replace":
            _, i, j, a, b = ops.pop()
            ops.append(("replace", i, j, a, min(b, a + j - i)))
        out = [x for op, i, j, a, b in ops if op != "equal" for x in (*(f"-{w}" for w in want[i:j]), *(f"+{w}" for w in have[a:b]))]
        return out, ops[-1][4] if ops else 0

    def portions(self, text: str) -> Iterator[tuple[list[tuple[int, int]], int, int]]:
        """The places of a text's words, PORTION at a time with what a wording reaches beyond on both sides, and which of them are the portion's own."""
        held: list[tuple[int, int]] = []
        own = 0
        for m in WORD.finditer(text):
            held.append(m.span())
            if len(held) - own >= PORTION + 2 * self.reach:
                yield held, own, own + PORTION
                held = held[own + PORTION - 2 * self.reach :] if own + PORTION > 2 * self.reach else held
                own = min(own + PORTION, 2 * self.reach)
        yield held, own, len(held)

    def wordings(self, text: str) -> list[tuple[int, float, list[str], int, int]]:
        """(template, share saved, differences, start, end) of all confirmed wordings of a whole text, those that saved most bytes first."""
        cues = [m.start() for m in CUE.finditer(text)]
        out = {}
        if cues and self.reach:
            for places, low, high in self.portions(text):
                for x in self.near_cues(text, cues, places, low, high):
                    out[x[1], x[4], x[5]] = x
        # of overlapping blocks of one template that with the fewest differences stays, of others that which saved most
        each = apart(sorted(out.values(), key=lambda x: (x[1], len(x[3]), -x[0], x[4])), lambda x: x[1])
        return [x[1:] for x in sorted(each, key=lambda x: (-x[0], x[4], x[1]))]

    def near_cues(self, text: str, cues: list[int], places: list[tuple[int, int]], own: int, to: int) -> Iterator[tuple[int, int, float, list[str], int, int]]:
        """(bytes saved, template, share saved, differences, start, end) of the wordings around the cues in words ``own`` to ``to`` of some."""
        begins = [a for a, _ in places]
        some = cues[bisect_left(cues, begins[own]) if own else 0 : bisect_left(cues, begins[to]) if to < len(places) else len(cues)] if places else []
        if not some:
            return
        words = [text[a:b].lower() for a, b in places]
        regions: list[list[int]] = []
        for cue in some:
            at = bisect_right(begins, cue) - 1
            if regions and at - self.reach <= regions[-1][1]:
                regions[-1][1] = at + self.reach
            else:
                regions.append([max(0, at - self.reach), at + self.reach])
        for low, high in regions:
            starts: dict[int, set[int]] = {}
            for i in range(low, min(high, len(words))):
                for k, j in self.openings.get(words[i], ()):
                    start = i
                    while start > i - j and start > 0 and not EDGE.search(text[places[start - 1][1] : places[start][0]]):
                        start -= 1
                    starts.setdefault(start, set()).add(k)
            for start, templates in sorted(starts.items()):
                if not any(start <= bisect_right(begins, c) - 1 < start + self.reach for c in some[bisect_left(some, begins[start]) :][:1]):
                    continue  # no cue in what could be its wording
                if best := self.winner(words, start, templates):
                    size, k, share, found, n = best
                    a, b = places[start][0], places[start + n - 1][1]
                    if bisect_left(cues, a) < bisect_left(cues, b):  # it has a cue
                        yield size, k, share, found, a, b

    def match(self, block: str) -> tuple[int, float, list[str], int] | None:
        """(template, share saved, differences, end in the block) of the best wording of a block."""
        return next(((k, saved, found, end) for k, saved, found, _, end in self.wordings(block)), None)

    def scan(self, text: str | None) -> list[dict]:
        """The license passages of a whole text, in order, not overlapping."""
        found = apart([(0, *x) for x in self.wordings(text or "")], lambda _: 0)
        out = [{"license": self.templates[k][0], "start": start, "end": end, "saved": round(saved, 4), "different": different} for _, k, saved, different, start, end in found]
        return sorted(out, key=lambda x: x["start"])


FOUND = T.ArrayType(
    T.StructType([T.StructField("license", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("saved", T.DoubleType()), T.StructField("different", T.ArrayType(T.StringType()))])
)
ARROW = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("saved", pa.float64()), ("different", pa.list_(pa.string()))]))


def scan(docs: DataFrame, *, templates: tuple[tuple[str, str], ...] = TEMPLATES, text: str = "text", found: str = "_licenses") -> DataFrame:
    """``docs`` with an array column ``found``: license, start, end (characters, end exclusive), saved, different (wording).

    Whole texts are scanned. A null or empty text has none; repeated rows have the same. Without templates nothing is found.
    Other columns pass through; one named ``found`` is replaced. Templates are few and fixed; they travel with the code.
    """
    sealed = Sealed(docs, found)
    column = sealed[text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            rows = [scanner.scan(t.as_py()) for t in single(batch, column)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, ARROW)], names=[*batch.schema.names, "_found"])

    return sealed.open(mapped(sealed.df, run, T.StructType([*sealed.df.schema.fields, T.StructField("_found", FOUND)])), **{found: F.col("_found")})
