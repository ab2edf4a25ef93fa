"""License scans by template-markup matching.

A template is mandatory wording with regions: ``[...]`` may be left out, ``<n>`` stands for up to n words of any kind
(a name, a year), ``a|b`` for either word. Each compiles to an automaton over words, made deterministic as it is used; a text is accepted from
some word on when every mandatory word comes exactly. The base phrases are templates without regions.

MIT, BSD (2, 3 and 4 clauses), ISC and Unlicense are compiled with conditions and disclaimer; Apache 2.0, MPL 2.0 and the GNU licenses
with the whole notice that goes into files, and all as SPDX identifiers. Where only the opening of such a wording matches,
the place is labelled ``<license>-partial``. The legal code of Apache, MPL, GNU and Creative Commons licenses itself is not compiled.

Positions that could begin a template are found by comparing word hashes over whole byte buffers, and confirmed on the words.

Words: A-Z lower-cased, then runs of 0-9, a-z and non-ASCII characters; punctuation does not count.

Nulls and edge cases: null counts as empty; an empty text has no words, no places, empty labels and score 0. A place never crosses
from one text to another. Overlapping places all count. Repeated rows get equal results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, Words, byte_slices, read_table, strings

# The base phrases with their labels.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

PARTIAL = "-partial"


def _quoted(words: str) -> str:
    """Words that may stand in curly quotes, which count as letters."""
    first, *rest = words.split()
    return " ".join([f"{first}|“{first}", *rest[:-1], f"{rest[-1]}|{rest[-1]}”"]) if rest else f"{first}|“{first}”"


_AS_IS = _quoted("as is")
_MIT = (
    f"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [the {_quoted('software')}] to deal in the software without restriction",
    "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
    "subject to the following conditions the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software",
)
_NO_WARRANTY = (
    f"the software is provided {_AS_IS} without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and [non] noninfringement|infringement "
    "in no event shall <12> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_BSD_1 = "<1> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
_BSD_2 = "<1> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_ADVERT = "<1> all advertising materials mentioning features or use of this software must display the following acknowledgement|acknowledgment this product includes software developed by <16>"
_ENDORSE = "be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_NAMES = (f"<1> neither the name|names of <12> nor the names of <2> contributors may {_ENDORSE}", f"<1> the name|names of <12> may not {_ENDORSE}")
_BSD_DISCLAIMER = (
    f"this software is provided by <16> {_AS_IS} and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall <16> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
    "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_ISC = "permission to use copy modify and [or] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"
_ISC_REST = (
    f"and this permission notice appear in all copies the software is provided {_AS_IS} and <12> disclaims|disclaim all warranties with regard to this software including all implied warranties of merchantability and fitness "
    "in no event shall <12> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
    "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
)
_APACHE = f"licensed under the apache license version 2 [0] [the {_quoted('license')}] you may not use <3> file|files except in compliance with the license"
_APACHE_REST = (
    "you may obtain a copy of the license at http|https [www] apache org licenses license 2 0 [txt|html] unless required by applicable law or agreed to in writing software distributed under the license "
    f"is distributed on an {_AS_IS} basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations [under the license]"
)
_MPL = "this source code form is subject to the terms of the mozilla public license v 2 0"
_MPL_REST = "if a copy of the mpl was not distributed with this file you can obtain one at http|https [www] mozilla org mpl 2 0"
_UNLICENSE = "this is free and unencumbered software released into the public domain"
_UNLICENSE_REST = (
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means "
    "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain "
    "we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors "
    f"we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law {_NO_WARRANTY} "
    "[for more information please refer to http|https [www] unlicense org]"
)


def _gnu(label: str, name: str, version: str) -> list[tuple[str, str]]:
    """The notice of the Free Software Foundation, for a version or later ones and for that version alone, and its first sentence."""
    terms, by = "redistribute it and or modify it under the terms of", "as published by the free software foundation"
    grants = (
        f"{terms} the gnu {name} public license {by} either version {version} of the license or [at your option] any later version",
        f"{terms} the gnu {name} public license {by} version {version} of the license [only]",
        f"{terms} the gnu {name} public license version {version} [only] {by}",
        f"{terms} version {version} of the gnu {name} public license {by}",
    )
    rest = (
        "<8> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose "
        f"see the gnu {name} public license for more details [you should have received a copy of the gnu {name} public license along with <6> "
        "[if not [see http|https [www] gnu org licenses] [write to the free software foundation [inc] [<16> usa]]]]"
    )
    return [x for g in grants for x in ((label, f"{g} {rest}"), (label + PARTIAL, g))]


def _spdx(label: str, identifier: str) -> tuple[str, str]:
    """An SPDX tag whose expression has the identifier in first, second or third place."""
    return label, f"spdx license identifier [<6> or|and] [<6> or|and] {identifier}"


# Wordings of well-known licenses, with optional and replaceable regions.
TEMPLATES = (
    ("mit", " ".join([*_MIT, _NO_WARRANTY])),
    ("mit" + PARTIAL, _MIT[0]),
    ("mit", "[is] licensed under [the terms of] the mit license"),
    ("apache-2", f"{_APACHE} {_APACHE_REST}"),
    ("apache-2" + PARTIAL, _APACHE),
    ("bsd-2", f"{_BSD} {_BSD_1} {_BSD_2} {_BSD_DISCLAIMER}"),
    *(("bsd-3", f"{_BSD} {_BSD_1} {_BSD_2} {names} {_BSD_DISCLAIMER}") for names in _BSD_NAMES),
    *(("bsd-4", f"{_BSD} {_BSD_1} {_BSD_2} {_BSD_ADVERT} {names} {_BSD_DISCLAIMER}") for names in _BSD_NAMES),
    ("bsd" + PARTIAL, _BSD),
    ("bsd", "[is] licensed under the [<2>] bsd [<2>] license"),
    *((f"bsd-{n}", f"licensed under the {wording} license") for n, w in (("2", "2|two"), ("3", "3|three"), ("4", "4|four")) for wording in (f"bsd {w} clause", f"{w} clause bsd")),
    ("isc", f"{_ISC} {_ISC_REST}"),
    ("isc" + PARTIAL, _ISC),
    ("isc", "licensed under [the terms of] the isc license"),
    *_gnu("gpl-3", "general", "3 [0]"),
    *_gnu("gpl-2", "general", "2 [0]"),
    *_gnu("lgpl-2", "library|lesser general", "2 [0]"),
    *_gnu("lgpl-2.1", "lesser general", "2 1"),
    *_gnu("lgpl-3", "lesser general", "3 [0]"),
    *_gnu("agpl-3", "affero general", "3 [0]"),
    ("gpl-3", "licensed under the [terms of the] gnu general public license [as published by the free software foundation] [either] version 3"),
    ("gpl-2", "licensed under the [terms of the] gnu general public license [as published by the free software foundation] [either] version 2"),
    ("lgpl", "licensed under the [terms of the] gnu lesser general public license"),
    ("agpl-3", "licensed under the [terms of the] gnu affero general public license [version 3]"),
    ("mpl-2", f"{_MPL} {_MPL_REST}"),
    ("mpl-2" + PARTIAL, _MPL),
    ("mpl-2", "licensed under the [terms of the] mozilla public license [version|v] 2 [0]"),
    ("cc-by-nc", "licensed under [a] [the] [creative commons] [attribution noncommercial] [cc] by nc"),
    ("cc-by-sa", "licensed under [a] [the] [creative commons] [cc] by sa"),
    ("cc0", "released under [the] cc0"),
    ("unlicense", f"{_UNLICENSE} {_UNLICENSE_REST}"),
    ("unlicense" + PARTIAL, _UNLICENSE),
    ("proprietary", "copyright <8> all rights reserved"),
    _spdx("mit", "mit"),
    _spdx("apache-2", "apache 2 0"),
    *(_spdx(f"bsd-{n}", f"bsd {n} clause") for n in (2, 3, 4)),
    _spdx("isc", "isc"),
    *(_spdx(f"gpl-{n}", f"gpl {n} 0 [or later] [only]") for n in (2, 3)),
    _spdx("lgpl-2", "lgpl 2 0 [or later] [only]"),
    _spdx("lgpl-2.1", "lgpl 2 1 [or later] [only]"),
    _spdx("lgpl-3", "lgpl 3 0 [or later] [only]"),
    _spdx("agpl-3", "agpl 3 0 [or later] [only]"),
    _spdx("mpl-2", "mpl 2 0"),
    _spdx("cc-by-nc", "cc by nc"),
    _spdx("cc-by-sa", "cc by sa"),
    _spdx("cc0", "cc0 1 0"),
    _spdx("unlicense", "unlicense"),
)

OTHER = b""


class Automaton:
    """The words one template accepts, from a given word on; states are sets of positions, made as they are met."""

    def __init__(self, label: str, template: str):
        self.label = label
        parts, self.arcs, self.free, self.empty = re.findall(r"[\[\]]|<\d+>|[^\s\[\]<>]+", template), {}, {}, {}
        open_at: list[int] = []
        at = 0
        for part in parts:
            if part == "[":
                open_at.append(at)
            elif part == "]":
                self.empty.setdefault(open_at.pop(), set()).add(at)
            elif part[0] == "<":
                for _ in range(int(part[1:-1])):
                    self.free[at] = at + 1
                    self.empty.setdefault(at, set()).add(at + 1)
                    at += 1
            else:
                self.arcs[at] = (frozenset(part.encode().split(b"|")), at + 1)
                at += 1
        self.final = at
        self.alphabet = {w for either, _ in self.arcs.values() for w in either}
        self.start = self._closed({0})
        self.first = {w for s in self.start if s in self.arcs for w in self.arcs[s][0]}
        if any(s in self.free for s in self.start) or self.final in self.start:
            raise ValueError("a template begins with wording")
        self.next: dict[tuple[frozenset, bytes], frozenset] = {}

    def _closed(self, states: set[int]) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.empty.get(todo.pop(), ()):
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def step(self, state: frozenset, word: bytes) -> frozenset:
        key = (state, word if word in self.alphabet else OTHER)
        if key not in self.next:
            to = {self.arcs[s][1] for s in state if s in self.arcs and word in self.arcs[s][0]}
            to |= {self.free[s] for s in state if s in self.free}
            self.next[key] = self._closed(to) if to else frozenset()
        return self.next[key]

    def accepts(self, words: Words, at: int, stop: int) -> int:
        """End of the longest accepted run of words from ``at``, or -1."""
        state, end = self.start, -1
        while at < stop and (state := self.step(state, words.word(at))):
            at += 1
            if self.final in state:
                end = at
        return end


class Scanner:
    def __init__(self, base=BASE, templates=TEMPLATES):
        self.base = [(label, phrase.encode().split()) for label, phrase in base]
        self.automata = [Automaton(*t) for t in templates]
        begins = sorted({p[0] for _, p in self.base} | {w for a in self.automata for w in a.first})
        joined = np.frombuffer(b" ".join(begins), np.uint8)
        self.begin_hash = Words(joined, np.array([0, len(joined)]), ALNUM).hashes()
        self.begin_word = begins

    def places(self, words: Words) -> list[tuple[int, int, int, str, bool]]:
        """(text, first word, end word, label, base) in order of text and place; words count over all texts of the run."""
        h = words.hashes()
        found = []
        spot = np.flatnonzero(np.isin(h, self.begin_hash))
        doc = np.searchsorted(words.first, spot, "right") - 1
        for at, d in zip(spot.tolist(), doc.tolist(), strict=True):
            word, stop = words.word(at), int(words.first[d + 1])
            for label, phrase in self.base:
                if phrase[0] == word and at + len(phrase) <= stop and all(words.word(at + k) == w for k, w in enumerate(phrase)):
                    found.append((d, at, at + len(phrase), label, True))
            here = [(d, at, end, a.label, False) for a in self.automata if word in a.first and (end := a.accepts(words, at, stop)) >= 0]
            # the opening of a whole wording is no place of its own
            whole = [x[3] for x in here if not x[3].endswith(PARTIAL)]
            found += [x for x in here if not (x[3].endswith(PARTIAL) and any(w.startswith(x[3].removesuffix(PARTIAL)) for w in whole))]
        return found


def scan(docs: DataFrame, base=BASE, templates=TEMPLATES) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places.

    ``score`` is the share of the text's words that lie in a place of a phrase or template; ``places`` lists label:first:end in words.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, templates)
        for batch in batches:
            for i, j, data, offsets in byte_slices(strings(batch.column(1))):
                words = Words(data, offsets, ALNUM)
                n = np.diff(words.first).astype(np.int64)
                by: dict[int, list] = {}
                for d, a, b, label, plain in scanner.places(words):
                    by.setdefault(d, []).append((a - int(words.first[d]), b - int(words.first[d]), label, plain))
                rows = {c: [v] * (j - i) for c, v in (("n_base", 0), ("first", None), ("last", None), ("base", ""), ("labels", ""), ("score", 0.0), ("places", ""))}
                for d, own in by.items():
                    starts = [a for a, _, _, plain in own if plain]
                    inside = set().union(*(range(a, b) for a, b, _, _ in own))
                    rows["n_base"][d] = len(starts)
                    rows["first"][d], rows["last"][d] = (min(starts), max(starts)) if starts else (None, None)
                    rows["base"][d] = ",".join(sorted({x for _, _, x, plain in own if plain}))
                    rows["labels"][d] = ",".join(sorted({x for _, _, x, _ in own}))
                    rows["score"][d] = len(inside) / int(n[d])
                    rows["places"][d] = ",".join(f"{x}:{a}:{b}" for a, b, x in sorted({(a, b, x) for a, b, x, _ in own}))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), *(pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True))], names)

    return source.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places string")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))
