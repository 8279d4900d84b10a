"""Operator 3: licence scans by Dice coefficient over word bigrams.

Texts and licence templates are normalised to lower-case words of letters and digits. Runs of words
of a text, wherever they begin and end, are compared with a template by the Dice coefficient of their
sets of word bigrams, 2 * common / (own + template's). Sizes bound it: with m bigrams in the template
and a threshold d, only runs with d * m / (2 - d) to (2 - d) * m / d bigrams can reach it, and a text
must hold d * m / (2 - d) of the template's bigrams at all; the best run begins and ends with one,
and doesn't hold its first one again, so that a text that repeats a template is scanned in linear time.

Versions and kinds that differ in few words are told apart by these words: a run is only of a
template if it names the same version and has the same TRAITS. Runs that overlap are of one licence,
the one with most bigrams in common.

Cases: null and empty texts have no licence; texts of any length are scanned whole; every licence of
a text is listed, in order; the one with the best coefficient is the text's, ties go to the first run
and then to the first in the alphabet, and reserved rights only win alone; repeated rows give repeated
results; an empty table gives an empty table; further columns are ignored, so their names can't clash.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

LEAST = 0.8
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_1_2 = ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_MIT_END = ' The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_END = ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_GNU = {"gpl": ("GNU General Public License", "program", ("2", "3")), "lgpl": ("GNU Lesser General Public License", "library", ("2.1", "3")), "agpl": ("GNU Affero General Public License", "program", ("3",))}
_CC = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDerivatives", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}


def _gnu():
    """Names, notices and titles of the GNU licences; without a version, where the text names none."""
    for short, (title, work, versions) in _GNU.items():
        for how in ("This work is licensed under the", "Licensed under the", "Released under the", "under the terms of the"):
            yield short, f"{how} {title}"
        for v in versions:
            name = f"{short}-{v}" if "." in v else f"{short}-{v}.0"
            for how in ("This work is licensed under the", "Licensed under the", "Released under the", "under the terms of the"):
                yield name, f"{how} {title}, version {v}."
            yield name, f"Licensed under the {short}v{v}"
            yield name, f"Licensed under the {short} version {v}"
            for thing in {"program", work}:
                yield name, f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the {title} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version."
            yield name, f"This program is free software; you can redistribute it and/or modify it under the terms of the {title} version {v} as published by the Free Software Foundation."
            day = {"2": "June 1991", "2.1": "February 1999"}.get(v, "19 November 2007" if short == "agpl" else "29 June 2007")
            yield name, f"{title} Version {v}, {day}"


def _cc():
    for kind, title in _CC.items():
        for v, where in (("4.0", "International"), ("3.0", "Unported"), ("2.0", "Generic")):
            name = f"cc-{kind}-{v}"
            yield name, f"Licensed under CC {kind.upper()} {v}."
            yield name, f"This work is licensed under CC {kind.upper()} {v}."
            yield name, f"This work is licensed under a Creative Commons {title} {v} {where} License."
            yield name, f"Licensed under the Creative Commons {title} {v} {where} License."


#: Texts and notices by which works name their licence. A name may have several.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Released under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("apache-2.0", "Apache License Version 2.0, January 2004"),
    ("bsd", _BSD),
    ("bsd", "Released under the BSD License."),
    ("bsd-2-clause", _BSD + _BSD_1_2 + _BSD_END),
    ("bsd-2-clause", "Released under the BSD 2-Clause License."),
    ("bsd-3-clause", _BSD + _BSD_1_2 + _BSD_3 + _BSD_END),
    ("bsd-3-clause", "Released under the BSD 3-Clause License."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("cc0-1.0", "Licensed under CC0 1.0."),
    ("epl-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0"),
    ("epl-2.0", "Licensed under the Eclipse Public License, Version 2.0."),
    ("isc", _ISC),
    ("isc", _ISC + _ISC_END),
    ("isc", "Released under the ISC License."),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit", _MIT),
    ("mit", _MIT + _MIT_END),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("reserved", "All rights reserved."),
    *_gnu(),
    *_cc(),
]
#: Words that tell licences apart; a word that names the same trait as another has its name.
TRAITS = {w: w for w in "affero lesser sharealike noncommercial noderivatives endorse apache eclipse mozilla mit bsd isc".split()} | {"sa": "sharealike", "nc": "noncommercial", "nd": "noderivatives", "noderivs": "noderivatives", "agpl": "affero", "lgpl": "lesser"}
_words = re.compile(r"[^\W_]+").findall


def bigrams(words: list[str]) -> list[tuple[str, str]]:
    return list(zip(words, words[1:], strict=False))


class Said:
    """What the words of a text say of versions and traits, by place."""

    def __init__(self, words: list[str]):
        self.at = [i for i, w in enumerate(words) if w in TRAITS]
        self.trait = [TRAITS[words[i]] for i in self.at]
        self.version_at, self.version = [], []
        for i, (w, after) in enumerate(zip(words, words[1:], strict=False)):
            if w in ("version", "v") and after.isdigit():
                minor = words[i + 2] if i + 2 < len(words) else ""
                found = after, minor if minor in "123456789" else ""
            elif w.isdigit() and len(w) == 1 and after in ("0", "clause"):
                found = w, ""
            else:
                continue
            self.version_at.append(i)
            self.version.append(found)

    def within(self, start: int, end: int) -> tuple:
        """First version and all traits of words[start : end + 1]."""
        k = bisect_left(self.version_at, start)
        version = self.version[k] if k < len(self.version) and self.version_at[k] < end else None
        return version, frozenset(self.trait[bisect_left(self.at, start) : bisect_right(self.at, end)])


class Templates:
    def __init__(self, templates: list[tuple[str, str]], least: float):
        every = [(name, _words(text.lower())) for name, text in templates]
        self.rows = sorted(((name, frozenset(bigrams(w)), Said(w).within(0, len(w))) for name, w in every), key=lambda r: (r[0], sorted(r[1])))
        self.known = frozenset(b for _, bs, _ in self.rows for b in bs)
        self.least = least

    def _runs(self, said: Said, pairs: list[tuple[str, str]], places: list[int], own: frozenset, says: tuple):
        """(common bigrams, coefficient, first and last bigram) of the best run from each place, if it reaches the threshold."""
        m, d = len(own), self.least
        low, high = d * m / (2 - d) - 1e-9, (2 - d) * m / d + 1e-9
        for a, start in enumerate(places):
            seen, common, done, good = set(), 0, start, []
            for k in range(a, len(places)):
                if k > a and pairs[places[k]] == pairs[start]:
                    break  # what begins there has the same bigrams of the template and no more of others
                common += pairs[places[k]] not in seen
                seen.update(pairs[done : places[k] + 1])
                if len(seen) > high:
                    break
                done = places[k] + 1
                dice = 2 * common / (len(seen) + m)
                if common >= low and dice >= d:
                    good.append((-dice, done, common))
            for dice, end, both in sorted(good):
                if said.within(start, end) == says:
                    yield both, -dice, start, end
                    break

    def every(self, text: str) -> list[tuple[str, float, int, int]]:
        """Name, coefficient, first line and number of lines of each licence, in order."""
        lines = text.split("\n")
        words, at = [], []
        for line in lines:
            at.append(len(words))
            words += _words(line.lower())
        pairs = bigrams(words)
        held = self.known.intersection(pairs)
        said, found = Said(words) if held else None, []
        for name, own, says in self.rows:
            if len(held & own) < self.least * len(own) / (2 - self.least) - 1e-9:
                continue
            places = [i for i, b in enumerate(pairs) if b in own]
            found += [(-common, -dice, a, b, name) for common, dice, a, b in self._runs(said, pairs, places, own, says)]
        taken: list[tuple[int, int, str, float]] = []
        for _, dice, a, b, name in sorted(found):
            k = bisect_left(taken, (a,))
            if (k == 0 or taken[k - 1][1] < a) and (k == len(taken) or taken[k][0] > b):
                insort(taken, (a, b, name, -dice))
        out = []
        for a, b, name, dice in taken:
            first = bisect_right(at, a) - 1
            out.append((name, dice, first, bisect_right(at, b) - first))
        return out

    def find(self, text: str) -> tuple[str, float, int, int] | None:
        """The text's licence among those of every()."""
        return _best(self.every(text))


def _best(found: list[tuple[str, float, int, int]]) -> tuple[str, float, int, int] | None:
    return min(found, key=lambda f: (f[0] == "reserved", -f[1], f[2], f[0]), default=None)


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, license, dice, first_line (from 0) and n_lines of each text, and the same of every licence in ``licenses``; all but the id are null without a licence."""
    rows = TEMPLATES if templates is None else templates
    one = pa.struct([("license", pa.string()), ("dice", pa.float64()), ("first_line", pa.int64()), ("n_lines", pa.int64())])
    names = [f.name for f in one]

    def step(batch: pa.RecordBatch):
        known = Templates(rows, least)
        every = [known.every(t) if t else [] for t in batch.column(1).to_pylist()]
        found = [_best(e) for e in every]
        columns = [pa.array([None if f is None else f[k] for f in found], one.field(k).type) for k in range(len(names))]
        listed = pa.array([[dict(zip(names, f, strict=True)) for f in e] or None for e in every], pa.list_(one))
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns, listed], names=[id_col, *names, "licenses"])

    kinds = "license string, dice double, first_line long, n_lines long"
    return map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), step, f"`{id_col}` long, {kinds}, licenses array<struct<{kinds.replace(' string', ': string').replace(' double', ': double').replace(' long', ': long')}>>")
