"""License scans by template markup.

The templates are the standard texts of the short licenses, whole, and the notices that stand for
the longer ones. A template is a list of words with two kinds of regions: ``[[ ... ]]`` may be left out, and
``{{n}}`` stands for any 0 to n words. It is compiled into an automaton over words; a text has the
template's label if some run of its words is accepted: every mandatory word, in order, unchanged.

Defined results: a null or empty text has no words, no places and no labels (score 0); first_word
and last_word are null without a place; labels are distinct and sorted; texts of any length are read
whole; repeated rows each keep their row; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases of the base labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: Standard texts, as words: [[ ]] may be left out, {{n}} is any 0 to n words (names, dates, numbers of lists).
_AS_IS = "software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose"
_MIT_GRANT = "permission is hereby granted free of charge to any person obtaining a copy of this software and [[associated]] documentation [[files]] {{4}} to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
_MIT_NOTICE = " subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software "
_LIABLE = " be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_MIT_END = "the " + _AS_IS + " and noninfringement in no event shall the authors or copyright holders" + _LIABLE
_NO_ADVERTISING = " except as contained in this notice the name of {{8}} shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization "
_NAME_NOT_USED = " and that the name {{8}} not be used in advertising or publicity pertaining to distribution of the software without specific written prior permission {{8}} makes no representations about the suitability [[of]] this software for any purpose it is provided as is without express or implied warranty"
_BSD_GRANT = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met {{1}} redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
_BSD_BINARY = "{{1}} redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_END = "this software is provided by {{12}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{12}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_ISC_END = "the software is provided as is and {{8}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {{8}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
_GNU_TERMS = "it under the terms of the gnu @ as published by the free software foundation"
_GNU_END = "[[or]] [[at your option]] [[any later version]] [[this]] [[program]] [[library]] [[software]] {{6}} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu @ for more details"


def _gnu(name: str, version: str) -> str:
    terms = "this {{4}} is free software you can redistribute it and or modify " + _GNU_TERMS.replace("@", name) + " [[either]] version " + version
    return terms + " [[of the license]] " + _GNU_END.replace("@", name)


#: (label, template): the texts, and the shorter notices that stand for them.
TEMPLATES = [
    ("mit", _MIT_GRANT + _MIT_NOTICE + _MIT_END),
    ("mit-0", _MIT_GRANT + " " + _MIT_END),
    ("x11", _MIT_GRANT + _MIT_NOTICE + "the " + _AS_IS + " and noninfringement in no event shall {{8}}" + _LIABLE + _NO_ADVERTISING + "from"),
    ("isc", "permission to use copy modify [[and]] [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies " + _ISC_END),
    ("0bsd", "permission to use copy modify [[and]] [[or]] distribute this software for any purpose with or without fee is hereby granted " + _ISC_END),
    ("bsd-1-clause", _BSD_GRANT + " " + _BSD_END),
    ("bsd-2-clause", _BSD_GRANT + " " + _BSD_BINARY + " " + _BSD_END),
    ("bsd-3-clause", _BSD_GRANT + " " + _BSD_BINARY + " {{1}} neither the name of {{12}} may be used to endorse or promote products derived from this software without specific prior written permission " + _BSD_END),
    ("bsd-4-clause", _BSD_GRANT + " " + _BSD_BINARY + " {{1}} all advertising materials mentioning features or use of this software must display the following acknowledgement this product includes software developed by {{16}} neither the name of {{12}} may be used to endorse or promote products derived from this software without specific prior written permission " + _BSD_END),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions {{1}} the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required {{1}} altered source versions must be plainly marked as such and must not be misrepresented as being the original software {{1}} this notice may not be removed or altered from any source distribution"),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor the " + _AS_IS + " title and non infringement in no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability whether in contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("ncsa", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files {{4}} to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions {{1}} redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers {{1}} redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimers in the documentation and or other materials provided with the distribution {{1}} neither the names of {{24}} may be used to endorse or promote products derived from this software without specific prior written permission the " + _AS_IS + " and noninfringement in no event shall the contributors or copyright holders" + _LIABLE.replace("dealings in", "dealings with")),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies in no event shall {{12}} be liable to any party for direct indirect special incidental or consequential damages including lost profits arising out of the use of this software and its documentation even if {{12}} has been advised of the possibility of such damage {{12}} specifically disclaims any warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose the software provided hereunder is on an as is basis and {{12}} has no obligations to provide maintenance support updates enhancements or modifications"),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation" + _NAME_NOT_USED + " [[{{8}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {{8}} be liable for any special indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software]]"),
    ("ntp", "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted provided that the above copyright notice appears in all copies and that both the copyright notice and this permission notice appear in supporting documentation" + _NAME_NOT_USED),
    ("curl", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the " + _AS_IS + " and noninfringement of third party rights in no event shall the authors or copyright holders" + _LIABLE + _NO_ADVERTISING + "of the copyright holder"),
    ("fair", "usage of the works is permitted provided that this instrument is retained with the works so that any entity that uses the works is notified of this instrument disclaimer the works are without warranty"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed do what the fuck you want to public license terms and conditions for copying distribution and modification 0 you just do what the fuck you want to"),
    ("beerware", "as long as you retain this notice you can do whatever you want with this stuff if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law the " + _AS_IS + " and noninfringement in no event shall the authors" + _LIABLE),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "to the extent possible under law {{20}} waived all copyright and related or neighboring rights to {{12}}"),
    ("apache-2", "licensed under the apache license version 2 [[0]] {{4}} you may not use this file except in compliance with the license you may obtain a copy of the license at {{8}} unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2", "[[the]] apache license version 2 [[0]]"),
    ("gpl-2", _gnu("general public license", "2")),
    ("gpl-3", _gnu("general public license", "3")),
    ("lgpl-2", _gnu("library general public license", "2")),
    ("lgpl-2.1", _gnu("lesser general public license", "2 1")),
    ("lgpl-3", _gnu("lesser general public license", "3")),
    ("agpl-3", _gnu("affero general public license", "3")),
    ("gpl-2", "this {{4}} is free software you can redistribute it and or modify " + _GNU_TERMS.replace("@", "general public license") + " [[either]] version 2"),
    ("gpl-3", "this {{4}} is free software you can redistribute it and or modify " + _GNU_TERMS.replace("@", "general public license") + " [[either]] version 3"),
    ("lgpl", _GNU_TERMS.replace("@", "lesser general public license")),
    ("lgpl", _GNU_TERMS.replace("@", "library general public license")),
    ("agpl", _GNU_TERMS.replace("@", "affero general public license")),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1 {{4}} you may not use this file except in compliance with the license"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license {{2}} 2 0 which is available at"),
    ("epl-1", "this program and the accompanying materials are made available under the terms of the eclipse public license v 1 0 which accompanies this distribution"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license {{4}} you may not use this file except in compliance with the license"),
    ("artistic-2", "this program is free software you can redistribute it and or modify it under the terms of the artistic license 2 0"),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1 this license is copied below and is also available with a faq at"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version {{3}} or any later version published by the free software foundation"),
    ("mit", "[[released]] [[licensed]] [[distributed]] under the [[terms of the]] mit license"),
    ("cc-by-nc", "cc by nc [[sa]] [[nd]] [[4 0]]"),
    ("cc-by-nc", "creative commons attribution noncommercial [[sharealike]] [[noderivatives]] [[noderivs]] {{2}} [[4 0]] [[3 0]] [[2 5]] [[2 0]] [[1 0]] [[international]] [[unported]] [[generic]] [[public]] license"),
    ("cc-by-sa", "creative commons attribution sharealike {{2}} [[4 0]] [[3 0]] [[2 5]] [[2 0]] [[1 0]] [[international]] [[unported]] [[generic]] [[public]] license"),
    ("cc-by-nd", "creative commons attribution noderivs {{2}} [[4 0]] [[3 0]] [[2 5]] [[2 0]] [[1 0]] [[international]] [[unported]] [[generic]] [[public]] license"),
    ("cc-by-nd", "creative commons attribution noderivatives {{2}} [[4 0]] [[3 0]] [[2 5]] [[2 0]] [[1 0]] [[international]] [[unported]] [[generic]] [[public]] license"),
    ("cc-by", "creative commons attribution [[4 0]] [[3 0]] [[2 5]] [[2 0]] [[1 0]] [[international]] [[unported]] [[generic]] [[public]] license"),
    ("proprietary", "all rights reserved {{4}} no part of this {{4}} may be reproduced"),
]

_SEPARATORS = bytes(x for x in range(128) if not (0x30 <= x <= 0x39 or 0x61 <= x <= 0x7A))
_TABLE = bytes(32 if x in _SEPARATORS else x for x in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(_TABLE).split()


@dataclass
class Automaton:
    """States are numbered; arcs[s] has (word or None for any, next state), skips[s] states reached freely."""

    arcs: list[list[tuple[bytes | None, int]]] = field(default_factory=lambda: [[]])
    skips: list[list[int]] = field(default_factory=lambda: [[]])
    accept: int = 0
    mandatory: int = 0
    anchor: bytes = b""

    def state(self) -> int:
        self.arcs.append([])
        self.skips.append([])
        return len(self.arcs) - 1

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for x in self.skips[todo.pop()]:
                if x not in states:
                    states.add(x)
                    todo.append(x)
        return states

    def ends(self, words: list[bytes], at: int) -> int | None:
        """Where the longest accepted run that begins at word `at` ends, or None."""
        now, last = self.closure({0}), None
        while True:
            if self.accept in now:
                last = at
            if at >= len(words) or not now:
                return last
            w = words[at]
            now = self.closure({t for s in now for x, t in self.arcs[s] if x is None or x == w})
            at += 1

    def first_words(self) -> set[bytes]:
        return {x for s in self.closure({0}) for x, _ in self.arcs[s] if x}


_MARK = re.compile(r"\[\[|\]\]|\{\{(\d+)\}\}|[^\s\[\]{}]+")


def compile_template(template: str) -> Automaton:
    a, at, opened, run, longest = Automaton(), 0, [], [], []
    for m in _MARK.finditer(template):
        token = m[0]
        if token == "[[":
            opened.append(at)
            run = []
        elif token == "]]":
            a.skips[opened.pop()].append(at)
            run = []
        elif m[1]:
            run, starts = [], [at]
            for _ in range(int(m[1])):
                new = a.state()
                a.arcs[at].append((None, new))
                at = new
                starts.append(at)
            for s in starts[:-1]:
                a.skips[s].append(at)
        else:
            new = a.state()
            a.arcs[at].append((token.encode(), new))
            at = new
            if not opened:
                a.mandatory += 1
                run = [*run, token]
                longest = run if len(run) > len(longest) else longest
        if not opened and token == "]]":
            run = []
    if not longest:
        raise ValueError(f"no mandatory word: {template!r}")
    a.accept, a.anchor = at, b" " + " ".join(longest).encode() + b" "
    return a


class Scanner:
    def __init__(self, phrases=PHRASES, templates=TEMPLATES):
        self.phrases = [(b" " + p.encode() + b" ", label) for p, label in phrases]
        self.automata = [(compile_template(t), label) for label, t in templates]
        self.most = max((a.mandatory for a, _ in self.automata), default=1)

    def places(self, flat: bytes) -> Iterator[tuple[int, str]]:
        for phrase, label in self.phrases:
            n, last, at = 0, 0, flat.find(phrase)
            while at >= 0:
                n, last = n + flat.count(b" ", last, at), at
                yield n, label
                at = flat.find(phrase, at + 1)

    def scan(self, text: str) -> tuple:
        words = words_of(text)
        flat = b" " + b" ".join(words) + b" "
        found = list(self.places(flat))
        base = {label for _, label in found}
        labels, most = set(base), 0
        for a, label in self.automata:
            if a.anchor in flat:  # its longest mandatory run is there: now run the automaton
                starts = a.first_words()
                if any(a.ends(words, i) is not None for i, w in enumerate(words) if w in starts):
                    labels.add(label)
                    most = max(most, a.mandatory)
        at = [x for x, _ in found]
        score = max(most / self.most, 0.5 if base else 0.0) if labels else 0.0
        return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), min(1.0, score)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_TYPES = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]


def scan_licenses(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """One row per row of docs (doc_id, text). score: the matched template's share of mandatory words among the longest template's, 0.5 at least for a base phrase."""

    def rows(batches):
        scanner = Scanner(phrases, templates)
        for batch in batches:
            found = list(zip(*(scanner.scan(x or "") for x in batch.column("text").to_pylist())))
            if found:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(found, _TYPES))], names=names)

    names = [x.split()[0] for x in SCHEMA.split(",")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, SCHEMA)
