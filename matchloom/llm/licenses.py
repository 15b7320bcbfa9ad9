"""License scans by conditional compression.

In a block of lines that may be a license, the stretches that share enough runs of words with a template are compared
with it word by word. A stretch with few enough words missing or foreign is compressed alone and with the template as a
raw zstandard dictionary; of templates that claim the same words, the one that saves the most bytes wins. Stretches are
hardly longer than their template, whatever the length of the block and its lines.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from importlib.resources import files

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_cache

#: Wordings of common licenses and of the notices that name them.
NOTICES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    (
        "BSD-2-Clause",
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
    (
        "ISC",
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    ("Proprietary", "All rights reserved."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    (
        "EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    (
        "CC0-1.0",
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this software.",
    ),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", "Licensed under the ISC License."),
)
_GNU = (("GPL-2.0", "General", "2"), ("GPL-3.0", "General", "3"), ("LGPL-2.1", "Lesser General", "2.1"), ("LGPL-3.0", "Lesser General", "3"), ("AGPL-3.0", "Affero General", "3"))
_GNU_NOTICE = "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} Public License for more details."
_CREATIVE = (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
#: Licenses whose whole text is in license_texts: what states the terms, without headings, examples of use and holders.
TEXTS = ("0BSD", "Apache-2.0", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense", "Zlib")


def _derived() -> Iterator[tuple[str, str]]:
    """Wordings that differ by a name alone, SPDX tags and whole texts."""
    for name, kind, version in _GNU:
        yield name, f"This work is licensed under the GNU {kind} Public License, version {version}."
        for what in ("program", "library"):
            yield name, _GNU_NOTICE.format(what=what, kind=kind, version=version)
        for tag in ("", "-only", "-or-later"):
            yield name, f"SPDX-License-Identifier: {name}{tag}"
    for short, long in _CREATIVE:
        yield f"CC-{short}-4.0", f"Licensed under CC {short} 4.0."
        yield f"CC-{short}-4.0", f"This work is licensed under a Creative Commons {long} 4.0 International License."
        yield f"CC-{short}-4.0", f"SPDX-License-Identifier: CC-{short}-4.0"
    for name in ("0BSD", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "EPL-2.0", "ISC", "MPL-2.0", "Unlicense", "Zlib"):
        yield name, f"SPDX-License-Identifier: {name}"
    for name in TEXTS:
        yield name, files(__package__).joinpath("license_texts", f"{name}.txt").read_text("utf-8")


TEMPLATES: tuple[tuple[str, str], ...] = NOTICES + tuple(t for t in _derived() if t not in NOTICES)
#: A line with one of these may belong to a license (fixed values).
CUES = r"(?i)licen[sc]e|copyright|warrant|spdx-|permission|redistribut|rights reserved|creative commons|\bcc[ -]by\b"
#: Share of a template's words that may be missing, and of the matched stretch's words that may be foreign.
MISSING, FOREIGN = 0.10, 0.15
#: A line next to a candidate line joins its block if so much of it is in the templates' vocabulary.
KNOWN_SHARE = 0.8
LEVEL = 3
#: Words of a seed. Within MISSING and FOREIGN, a template of any length keeps a run of so many words, or is kept whole.
SEED = 3
#: Words that tell licenses apart: none may be missing or foreign. "not" and "evil" turn a permission round; the rest of
#: the second line are words of the third and fourth clauses of BSD, and of the condition that 0BSD leaves out of ISC.
TELLING = re.compile(
    r"affero|lesser|commercial|share-?alike|deriv(?:ative)?s$|^[al]?gpl|(?:^|-)(?:nc|sa|nd)(?:-|$)|^v\d"
    r"|^(?:neither|endorse|promote|advertising|acknowledge?ments?|appear|not|evil)$"
)
#: A number after one of these is a version, and tells too; elsewhere it is the label of a clause, a year or a page.
BEFORE_VERSION = re.compile(r"^(?:versions?|v|licen[cs]e|universal|[a-z]*gpl|mpl|apache|cc0|by(?:-[a-z-]+)?|.*(?:attribution|sharealike|commercial|deriv(?:ative)?s))$")
#: Names may be foreign (that of a holder may be anything), but not missing.
NAMES = frozenset("gnu apache mozilla mit bsd isc creative commons eclipse boost unlicense".split())


def license_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", text.lower())


def tells(words: list[str | None], i: int) -> bool:
    """Whether the word at i tells licenses apart."""
    word, before = words[i] or "", words[i - 1] if i else None
    if before == "gnu" and word == "library":  # the older name of the Lesser license
        return True
    return bool(TELLING.search(word) or word[:1].isdigit() and BEFORE_VERSION.search(before or ""))


class Scanner:
    def __init__(self, templates=TEMPLATES):
        self.names = [n for n, _ in templates]
        self.words = [license_words(t) for _, t in templates]
        self.vocabulary = {w for words in self.words for w in words}
        self.cue = re.compile(CUES).search
        self.seeds: dict[int, dict[tuple, list]] = defaultdict(lambda: defaultdict(list))
        for k, words in enumerate(self.words):
            n = min(SEED, len(words))
            for t in range(len(words) - n + 1):
                self.seeds[n][tuple(words[t : t + n])].append((k, t))
        self.telling = [{t for t in range(len(words)) if words[t] in NAMES or tells(words, t)} for words in self.words]
        self.alone = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.given = [
            zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for w in self.words
        ]

    def blocks(self, text: str) -> Iterator[str]:
        """Runs of lines around lines with a cue; neighbours join while they read like a license, lines without words between them too."""
        lines = text.split("\n")
        member = [bool(self.cue(line)) for line in lines]
        for step in (1, -1):
            order = range(len(lines)) if step == 1 else range(len(lines) - 1, -1, -1)
            open_ = False
            for i in order:
                if member[i]:
                    open_ = True
                elif open_:
                    words = license_words(lines[i])
                    if words:
                        open_ = sum(w in self.vocabulary for w in words) >= KNOWN_SHARE * len(words)
                    member[i] = open_ and bool(words)
        held: list[str] = []
        for line, inside in zip([*lines, "end"], [*member, False]):
            if inside:
                held.append(line)
            elif held and license_words(line):  # lines without words, rulers among them, count as blank
                yield "\n".join(held)
                held = []

    def saving(self, words: list[str], template: int) -> int:
        """Bytes that a template saves a stretch."""
        raw = " ".join(words).encode()
        return len(self.alone.compress(raw)) - len(self.given[template].compress(raw))

    def slack(self, template: int) -> tuple[int, int]:
        """The most words that may be missing and foreign."""
        return int(MISSING * len(self.words[template])), int(FOREIGN * len(self.words[template]))

    def places(self, words: list[str | None]) -> Iterator[tuple[int, int, int]]:
        """(template, begin, end) of every part of a block that may hold a template's wording.

        A seed at place p of the block and t of the template puts the template's begin at p - t; a wording within the
        limits moves its begins by no more than its slack, and loses a bounded number of seeds. So parts left out hold
        no wording within the limits.
        """
        begins = defaultdict(list)
        for n, seeds in self.seeds.items():
            for p in range(len(words) - n + 1):
                for k, t in seeds.get(tuple(words[p : p + n]), ()):
                    begins[k].append(p - t)
        for k, at in begins.items():
            at.sort()
            size, n = len(self.words[k]), min(SEED, len(self.words[k]))
            missing, foreign = self.slack(k)
            moved, least = missing + foreign, max(1, size - (n - 1) - n * missing - (n - 1) * foreign)
            i = j = 0
            while i < len(at):
                # Wordings whose first seed has its begin in at[i] .. at[i] + moved: one part for all, and one closely
                # around the begin with most seeds, which keeps copies that follow each other apart.
                first, most, best = at[i], 0, 0
                while i < len(at) and at[i] <= first + moved:
                    while j < len(at) and at[j] <= at[i] + moved:
                        j += 1
                    if j - i > most:
                        most, best = j - i, at[i]
                    i += 1
                if most >= least:
                    yield k, max(0, first - moved), min(len(words), first + 2 * moved + size)
                    if moved:
                        yield k, max(0, best), min(len(words), best + moved + size)

    def stretch(self, words: list[str | None], template: int) -> list:
        """The matching runs (a, b, size) of the stretch that differs least from the template, in order."""
        wording = self.words[template]
        runs = [m for m in SequenceMatcher(None, wording, words, autojunk=False).get_matching_blocks() if m.size]
        least, best = len(wording), (0, 0)
        for i in range(len(runs)):
            matched = 0
            for j in range(i, len(runs)):
                matched += runs[j].size
                differing = len(wording) + runs[j].b + runs[j].size - runs[i].b - 2 * matched
                if differing < least:
                    least, best = differing, (i, j + 1)
        return runs[slice(*best)]

    def differences(self, words: list[str], template: int) -> tuple[int, int]:
        """Words of the template missing from the block, and foreign words within the stretch that matches it."""
        runs = self.stretch(words, template)
        matched = sum(m.size for m in runs)
        return len(self.words[template]) - matched, runs[-1].b + runs[-1].size - runs[0].b - matched if runs else 0

    def agrees(self, words: list[str | None], template: int, runs: list) -> bool:
        """Whether few enough words differ, none of them telling."""
        size, matched = len(self.words[template]), sum(m.size for m in runs)
        inside = range(runs[0].b, runs[-1].b + runs[-1].size) if runs else range(0)
        if size - matched > MISSING * size or len(inside) - matched > FOREIGN * matched:
            return False
        met = {m.a + x for m in runs for x in range(m.size)}, {m.b + x for m in runs for x in range(m.size)}
        return self.telling[template] <= met[0] and not any(words[i] is None or tells(words, i) for i in inside if i not in met[1])

    def confirmed(self, words: list[str | None]) -> Iterator[tuple[int, int, int, int]]:
        """(bytes saved, template, begin, end) of every stretch whose wording is a template's."""
        done: dict[int, int] = {}
        for k, begin, end in self.places(words):
            if (begin + end) // 2 < done.get(k, 0):  # mostly within a stretch of that name; what is left meets the next round
                continue
            part = words[begin:end]
            runs = self.stretch(part, k)
            if self.agrees(part, k, runs):
                a, b = runs[0].b, runs[-1].b + runs[-1].size
                done[k] = begin + b
                yield self.saving(part[a:b], k), k, begin + a, begin + b

    def scan(self, text: str) -> tuple[int, list[tuple[str, int]]]:
        """Candidate blocks, and the licenses confirmed with the bytes they save; a block may name several."""
        n, found = 0, []
        for block in self.blocks(text):
            n += 1
            words: list[str | None] = list(license_words(block))
            while claims := sorted(self.confirmed(words), key=lambda c: (-c[0], -len(self.words[c[1]]), *c[1:])):
                for saved, k, begin, end in claims:
                    if None not in words[begin:end]:  # else another template has taken some of these words
                        found.append((self.names[k], saved))
                        words[begin:end] = [None] * (end - begin)
        return n, found


def scan_licenses(docs: DataFrame, templates=TEMPLATES, text: str = "text") -> DataFrame:
    """doc_id, n_blocks (candidates), n_confirmed, licenses (distinct, sorted) and bytes_saved of every row of docs.

    Texts without a cue, null and empty ones among them, have no blocks; they do not leave the JVM. Repeated rows and
    null ids stay; an empty table gives no rows. Of templates that save equally, the longer comes first.
    """
    schema = "doc_id long, n_blocks long, n_confirmed long, licenses array<string>, bytes_saved long"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = worker_cache("license_scanners")
        scanner = made.get(templates) or made.setdefault(templates, Scanner(templates))
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                n, found = scanner.scan(t) if t else (0, [])
                rows.append((n, len(found), sorted({f[0] for f in found}), sum(f[1] for f in found)))
            if rows:
                kinds = pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64()
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], [x.split()[0] for x in schema.split(", ")])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col(text).rlike(CUES), F.col(text)).alias("t"))
    return read.mapInArrow(scan, schema)
