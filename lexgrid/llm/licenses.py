"""License scans with a positional rare-token index."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrid.llm.common import map_rows, reduce_rows, texts

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notice templates of the method: label, text, key phrases that must all be there.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license"]),
    ("apache-2.0", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", ["apache license", "in compliance with the license"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", ["permission is hereby granted free of charge", "without restriction"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license", "free software"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["lesser general public license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc0", "released into the public domain under the creative commons cc0 universal dedication", ["public domain", "cc0"]),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["permission notice shall be included in all copies"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", ["permission is hereby granted free of charge", "without restriction including without limitation", "the software is provided as is"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software", ["for any purpose with or without fee is hereby granted", "the author disclaims all warranties"]),
    ("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", ["redistributions of source code must retain", "redistributions in binary form must reproduce", "this software is provided by the copyright holders"]),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["endorse or promote products derived from this software", "specific prior written permission"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", ["permission is granted to anyone to use this software for any purpose", "alter it and redistribute it freely"]),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ["free and unencumbered software released into the public domain"]),
    ("boost-1.0", "boost software license version 1 0 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ["any person or organization obtaining a copy"]),
    ("agpl", "it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu affero general public license"]),
    ("agpl", "licensed under the gnu affero general public license", ["affero general public license"]),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ["eclipse public license"]),
    ("wtfpl", "do what the fuck you want to public license everyone is permitted to copy and distribute verbatim or modified copies of this license document", ["do what the fuck you want to"]),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ["unless required by applicable law or agreed to in writing", "governing permissions and limitations under the license"]),
    ("proprietary", "all rights reserved no part of this work may be reproduced without written permission", ["all rights reserved", "without written permission"]),
]
MATCH = "label:string,start:long,end:long,base:boolean,score:double"

#: Words are 0-9, a-z and all that isn't ASCII, in UTF-8; A-Z is lower-cased, the rest parts.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class RareTokenIndex:
    """Postings (template, position) of the templates' words, weighed by corpus IDF.

    A file's words are looked up rarest first. Of each template the ``anchors`` rarest of its words that the file
    holds give postings, each a relative position (place in the file less place in the template); kept are
    the positions at which at least ``agree`` different anchors meet, within ``slip`` words of one another, and there key phrases and
    coverage are verified. A template is posted by its ``posted`` rarest words, so that altered words hide none."""

    def __init__(self, n_docs: int, df: dict[bytes, int], templates=None, base=None, anchors: int = 6, agree: int = 2, posted: int = 12, least: float = 0.7, slip: int = 2):
        self.templates = [(label, text.encode().split(), [k.encode().split() for k in keys]) for label, text, keys in (TEMPLATES if templates is None else templates)]
        self.base = [(p.encode().split(), label) for p, label in (BASE if base is None else base).items()]
        self.least, self.slip, self.anchors, self.agree = least, slip, anchors, agree
        self.idf = {w: math.log((n_docs + 1) / (df.get(w, 0) + 1)) + 1e-3 for _, ws, _ in self.templates for w in ws}
        self.postings: dict[bytes, list[tuple[int, list[int]]]] = defaultdict(list)
        self.words_needed = []
        for t, (_, ws, _) in enumerate(self.templates):
            rarest = sorted(set(ws), key=lambda w: (-self.idf[w], w))[:posted]
            self.words_needed.append(min(agree, len(rarest)))
            for w in rarest:
                self.postings[w].append((t, [i for i, x in enumerate(ws) if x == w]))
        self.last: dict[bytes, list] = {}
        for p, label in self.base:
            self.last.setdefault(p[-1], []).append((p, label))
        self.watched = frozenset(self.postings) | frozenset(self.last)

    def scan(self, words: list[bytes]) -> list[dict]:
        if self.watched.isdisjoint(words):
            return []
        at: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in self.watched:
                at[w].append(i)
        out = []
        for w in self.last.keys() & at.keys():
            for p, label in self.last[w]:
                for i in at[w]:
                    a = i - len(p) + 1
                    if a >= 0 and words[a : i + 1] == p:
                        out.append({"label": label, "start": a, "end": i + 1, "base": True, "score": 1.0})
        for t, anchors in self.lookup(at).items():
            out += self.verify(words, t, self.meet(t, anchors, at))
        return sorted(out, key=lambda m: (m["start"], m["end"], m["label"], not m["base"]))

    def lookup(self, at: dict[bytes, list[int]]) -> dict[int, list[tuple[bytes, list[int]]]]:
        """Of each template the rarest words that the file holds, with their places in the template."""
        found: dict[int, list] = defaultdict(list)
        for w in sorted(self.postings.keys() & at.keys(), key=lambda w: (-self.idf[w], w)):
            for t, places in self.postings[w]:
                if len(found[t]) < self.anchors:
                    found[t].append((w, places))
        return {t: ws for t, ws in found.items() if len(ws) >= self.words_needed[t]}

    def meet(self, t: int, anchors: list[tuple[bytes, list[int]]], at: dict[bytes, list[int]]) -> list[int]:
        """The relative positions at which enough different anchors meet, those of the most weight first."""
        by: dict[int, set[int]] = defaultdict(set)
        for k, (w, places) in enumerate(anchors):
            for i in at[w]:
                for j in places:
                    by[i - j].add(k)
        weighed = []
        for shift, own in by.items():
            near = set(own)
            for d in range(1, self.slip + 1):
                near |= by.get(shift - d, set()) | by.get(shift + d, set())
            if len(near) >= self.words_needed[t]:
                weighed.append((-sum(self.idf[anchors[k][0]] for k in near), -len(own), shift))
        return [shift for *_, shift in sorted(weighed)]

    def verify(self, words: list[bytes], t: int, shifts: list[int]) -> list[dict]:
        """The matches of a template; of positions whose spans overlap, the best one."""
        label, ws, keys = self.templates[t]
        total = sum(self.idf[w] for w in ws)
        out: list[dict] = []
        for shift in shifts:
            start, end = max(0, shift), min(len(words), shift + len(ws))
            if any(start < m["end"] and m["start"] < end for m in out):
                continue
            a, b = max(0, shift - self.slip), min(len(words), shift + len(ws) + self.slip)
            if not all(_within(words, k, a, b) for k in keys):
                continue
            same = sum(self.idf[w] for j, w in enumerate(ws) if w in words[max(a, shift + j - self.slip) : max(0, shift + j + self.slip + 1)])
            if same >= self.least * total:
                out.append({"label": label, "start": start, "end": end, "base": False, "score": min(1.0, same / total)})
        return out


def _within(words: list[bytes], phrase: list[bytes], a: int, b: int) -> bool:
    return any(words[i : i + len(phrase)] == phrase for i in range(a, b - len(phrase) + 1))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=None, base=None) -> DataFrame:
    """(id, n_words, matches) of every row; a match has a label, its first word and the
    word after its last, whether a base phrase made it, and a score from 0 to 1.

    The first pass counts, over the whole corpus, the documents that hold each template word
    (a few hundred counts); the second looks up every file's rarest template words, intersects
    their postings by relative position and verifies key phrases and coverage there.
    Null and empty texts have no words; texts of any length are read whole; repeated rows are scanned each; matches of
    different templates may overlap, of those of one template the best stays, ties to the first; an empty table gives an empty result; other columns are ignored."""
    kind = dict(docs.dtypes)[id_col]
    rows = texts(docs, id_col, text_col, binary=True)
    vocabulary = frozenset(w.encode() for _, t, _ in (TEMPLATES if templates is None else templates) for w in t.split())

    def count(batches):
        df: Counter = Counter()
        n = 0
        for (text,) in batches:
            n += len(text)
            for t in text:
                df.update(vocabulary.intersection(words_of(bytes(t))))
        return [["", *(w.decode() for w in df)], [n, *df.values()]]

    counted = reduce_rows(rows.select("_text"), "word string, n long", count).groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = {r["word"].encode(): r["n"] for r in counted}
    n_docs = df.pop(b"", 0)

    def start():
        index = RareTokenIndex(n_docs, df, templates, base)

        def step(ids, text):
            words = [words_of(bytes(t)) for t in text]
            return [ids, [len(w) for w in words], [index.scan(w) for w in words]]

        return step

    return map_rows(rows, f"`{id_col}` {kind}, n_words long, matches array<struct<{MATCH}>>", start)
