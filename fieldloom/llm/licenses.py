"""License scans by template markup.

Templates are license texts with markup: `<<optional>>...<<end>>` may be missing as a whole (regions may nest), `<<any:N>>` stands for
up to N words of any kind (names, years, addresses), `<<any:M-N>>` for M to N. Each is compiled to an automaton over tokens whose states are
positions in the template's words; optional regions and replaceable regions are epsilon moves and bounded self-loops. A text is
accepted where all mandatory words follow each other exactly from some word on; one word changed or missing, and it isn't. Matching looks
only at texts that have every mandatory word of a template, and runs the automaton from each of its possible first words.

Words: A-Z lower-cased, runs of characters other than ASCII ones outside 0-9 and a-z. Beside the templates the three base
phrases are counted at every place where their words stand consecutively.

Score: 1 for a text with an accepted template, 0.5 for one with base phrases only, 0 else. Nulls: a null text is empty
and has no words. Ties and overlaps: a label counts once however often it is found; of matches that begin at one word the longest is
taken. Repeated rows give equal rows. An empty table gives an empty result. Very long texts are read whole. Other columns, whatever
their names, play no part.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Any ASCII character but letters and digits to a space, upper case to lower case; other bytes stay.
TABLE = bytes(b if b > 127 or chr(b).isdigit() or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

#: Public license texts, their usual file headers and short references, as words with markup.
TEMPLATES = {
    "0bsd": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is and the author disclaims all warranties with regard to this software",
    "agpl-header": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version <<any:1>> of the license or at your option any later version",
    "apache-2.0-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at <<any:8>> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "apache-2.0-reference": "licensed under the apache license <<optional>>version<<end>> 2 0 <<optional>>the license<<end>>",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<any:2>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<any:2>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution <<optional>><<any:2>> neither the name of <<any:1-12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission<<end>> this software is provided by the <<any:1-8>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the <<any:1-8>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "boost": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "cc-by-long": "licensed under <<optional>>a<<end>> <<optional>>the<<end>> creative commons attribution <<any:1-1>> 0 <<optional>>international<<end>> <<optional>>unported<<end>> <<optional>>license<<end>>",
    "cc-by-nc-long": "licensed under <<optional>>a<<end>> <<optional>>the<<end>> creative commons attribution noncommercial <<optional>>sharealike<<end>> <<optional>>noderivatives<<end>> <<optional>><<any:1-1>> 0<<end>> <<optional>>international<<end>> <<optional>>unported<<end>> <<optional>>license<<end>>",
    "cc-by-nc-reference": "licensed under <<optional>>a<<end>> <<optional>>the<<end>> cc by nc <<optional>>sa<<end>> <<optional>>nd<<end>> <<optional>><<any:1-1>> 0<<end>>",
    "cc-by-reference": "licensed under <<optional>>a<<end>> <<optional>>the<<end>> cc by <<any:1-1>> 0",
    "cc-by-sa-long": "licensed under <<optional>>a<<end>> <<optional>>the<<end>> creative commons attribution sharealike <<any:1-1>> 0 <<optional>>international<<end>> <<optional>>unported<<end>> <<optional>>license<<end>>",
    "cc-by-sa-reference": "licensed under <<optional>>a<<end>> <<optional>>the<<end>> cc by sa <<any:1-1>> 0",
    "cc0": "to the extent possible under law <<any:1-12>> has waived all copyright and related or neighboring rights to <<any:1-12>>",
    "gpl-header": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version <<any:1>> of the license or at your option any later version <<optional>>this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details<<end>>",
    "gpl-reference": "licensed under the gnu general public license <<optional>><<optional>>version<<end>> <<any:1-1>><<end>>",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies <<optional>>the software is provided as is and <<any:1-6>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<any:1-6>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software<<end>>",
    "lgpl-header": "this <<any:1-1>> is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version <<any:2>> of the license or at your option any later version",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<optional>>including the next paragraph<<end>> shall be included in all copies or substantial portions of the software <<optional>>the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the <<any:1-6>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software<<end>>",
    "mit-reference": "<<optional>>this <<any:2>> is<<end>> <<optional>>released<<end>> <<optional>>licensed<<end>> under the mit license",
    "mpl-2.0-header": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at <<any:1-6>>",
    "spdx-tag": "spdx license identifier <<any:1-1>>",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions <<any:2>> the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required <<any:2>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software <<any:2>> this notice may not be removed or altered from any source distribution",
}


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


class Automaton:
    """States are positions in a template's list of words, replaceable regions and optional regions."""

    def __init__(self, template: str):
        self.steps: list[tuple[bytes | None, int, int]] = []  # (word, 0, 0) or (None, fewest words, most words)
        self.skips: dict[int, list[int]] = {}  # where optional regions begin -> where they end
        begun: list[int] = []
        optional: set[int] = set()
        for part in re.findall(r"<<[^>]*>>|[^<\s]+", template):
            if part == "<<optional>>":
                begun.append(len(self.steps))
            elif part == "<<end>>":
                begin = begun.pop()
                self.skips.setdefault(begin, []).append(len(self.steps))
                optional.update(range(begin, len(self.steps)))
            elif part.startswith("<<any:"):
                fewest, _, most = part[6:-2].rpartition("-")
                self.steps.append((None, int(fewest or 0), int(most)))
            else:
                self.steps.append((part.encode(), 0, 0))
        if begun:
            raise ValueError("an optional region has no end")
        self.starts = {self.steps[s][0] for s, _ in self._closure({(0, 0)}) if s < len(self.steps)} - {None}
        self.needs = frozenset(w for i, (w, _, _) in enumerate(self.steps) if i not in optional) - {None}

    def _closure(self, states: set[tuple[int, int]]) -> set[tuple[int, int]]:
        todo, seen = list(states), set(states)
        while todo:
            s, used = todo.pop()
            more = [] if used else [(e, 0) for e in self.skips.get(s, ())]
            if s < len(self.steps) and self.steps[s][0] is None and used >= self.steps[s][1]:
                more.append((s + 1, 0))
            for x in more:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return seen

    def end(self, ws: list[bytes], at: int) -> int | None:
        """The largest end of an accepted run of words from `at` on, or None."""
        states, found = self._closure({(0, 0)}), None
        while states:
            if any(s == len(self.steps) for s, _ in states):
                found = at
            if at == len(ws):
                break
            after = set()
            for s, used in states:
                if s < len(self.steps):
                    word, _, most = self.steps[s]
                    if word is None:
                        if used < most:
                            after.add((s, used + 1))
                    elif word == ws[at]:
                        after.add((s + 1, 0))
            states, at = self._closure(after), at + 1
        return found


AUTOMATA = {label: Automaton(t) for label, t in TEMPLATES.items()}
PHRASES = {label: p.encode().split() for label, p in BASE.items()}


def base_places(ws: list[bytes]) -> dict[str, list[int]]:
    found: dict[str, list[int]] = {}
    for label, phrase in PHRASES.items():
        last, at = phrase[-1], 0
        places = []
        while True:
            try:
                at = ws.index(last, at)
            except ValueError:
                break
            if ws[max(0, at - len(phrase) + 1) : at + 1] == phrase:
                places.append(at - len(phrase) + 1)
            at += 1
        if places:
            found[label] = places
    return found


def template_spans(ws: list[bytes]) -> list[tuple[str, int, int]]:
    """(label, first word, word after the last), leftmost matches without overlap for each template."""
    have = set(ws)
    live = {label: a for label, a in AUTOMATA.items() if a.needs <= have}
    if not live:
        return []
    out, free = [], dict.fromkeys(live, 0)
    starts = frozenset(w for a in live.values() for w in a.starts)
    for i, w in enumerate(ws):
        if w in starts:
            for label, a in live.items():
                if w in a.starts and i >= free[label] and (end := a.end(ws, i)) is not None:
                    out.append((label, i, end))
                    free[label] = end
    return out


RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
)
KINDS = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))]


def scan(text: str | None) -> tuple:
    ws = words(text)
    base = base_places(ws)
    spans = template_spans(ws)
    places = [p for v in base.values() for p in v]
    score = 1.0 if spans else 0.5 if places else 0.0
    labels = sorted({*base, *(s[0] for s in spans)})
    rows = [{"label": a, "begin": b, "end": c} for a, b, c in spans]
    return len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(labels), score, rows


@F.arrow_udf(RESULT)
def scan_of(texts: pa.Array) -> pa.Array:
    rows = [scan(t) for t in texts.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(KINDS)], names=[f.name for f in RESULT.fields])


def license_scan(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", scan_of("text").alias("r")).select("doc_id", "r.*")
