"""License notices by conditional compression.

A template's own rarer words, wherever a document has them, each propose a block of the
template's length. Every block is compressed by zstandard alone and again with each template
as a raw dictionary; block and template pairs are ranked by the bytes that the template
saves. In that order the exact differences in wording confirm a pair or not, the first
confirmed one wins its words, and what else overlaps them is compared again without. Blocks
don't grow with the document or the number of notices.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from heapq import heappop, heappush

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.llm.common import null_id, whole_id

# Wording of public license texts and notices.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0 header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1 header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "EPL-2.0 header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "CC0-1.0 notice": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "licensed under the GNU General Public License, version 3.",
    "MIT notice": "Released under the MIT License.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "All rights reserved": "All rights reserved.",
}
#: Most words that may differ, as a share of the template's words; in a notice of a few words
#: none may. What is saved ranks; the wording decides.
DIFFERENT = 0.1
LEVEL = 3
_WORD = re.compile(r"[^\W_]+")


@dataclass
class Template:
    name: str
    words: list[str]
    coder: zstandard.ZstdCompressor = field(repr=False)
    most: int = 0

    def __post_init__(self) -> None:
        self.count = Counter(self.words)
        #: Places of its words, those that texts have least often (as far as length tells) first.
        self.rare = sorted(range(len(self.words)), key=lambda p: (self.count[self.words[p]], -len(self.words[p]), p))

    def proposing(self, different: float) -> list[int]:
        """Where at most n of its words are missing, one of any n + 1 of them is there: places
        of n + 1 words, which propose every block that can be confirmed."""
        return self.rare[: int(different * len(self.words)) + 1]


def _plain() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)


def templates(texts: dict[str, str]) -> list[Template]:
    out = []
    for name, text in texts.items():
        words = _WORD.findall(text.lower())
        raw = " ".join(words).encode()
        given = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=given, write_content_size=False, write_checksum=False, write_dict_id=False)
        out.append(Template(name, words, coder, len(_plain().compress(raw)) - len(coder.compress(raw))))
    return out


def _slack(template: list[str]) -> int:
    return max(2, len(template) // 10)


def differences(template: list[str], words: list[str]) -> tuple[int, int, int, int]:
    """Where the template's wording lies in these words: begin, end, words missing, words added.

    The place is that of the longest common run of words; around it the template's length
    is compared, and what is common there is counted by the longest matching blocks.
    """
    run = SequenceMatcher(None, template, words, autojunk=False).find_longest_match()
    if not run.size:
        return 0, 0, len(template), 0
    slack = _slack(template)
    a = max(0, run.b - run.a - slack)
    b = min(len(words), run.b + len(template) - run.a + slack)
    same = [m for m in SequenceMatcher(None, template, words[a:b], autojunk=False).get_matching_blocks() if m.size]
    begin, end = a + same[0].b, a + same[-1].b + same[-1].size
    common = sum(m.size for m in same)
    return begin, end, len(template) - common, end - begin - common


def saved(block: list[str], known: list[Template]) -> list[int]:
    """Bytes by which each template as a dictionary shortens the compressed block."""
    raw = " ".join(block).encode("utf-8", "replace")
    alone = len(_plain().compress(raw))
    return [alone - len(t.coder.compress(raw)) for t in known]


def find_licenses(text: str, known: list[Template], different: float = DIFFERENT) -> list[tuple]:
    """(license, share saved, first character, end, words missing, words added) in order of place.

    The share is that of the bytes that the template saves of itself.
    """
    places = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    words = [text[a:b].lower() for a, b in places]
    most = [int(different * len(t.words)) for t in known]
    wanted: dict[str, list[tuple[int, int]]] = {}
    for i, t in enumerate(known):
        for p in t.proposing(different):
            wanted.setdefault(t.words[p], []).append((i, p))

    def possible(i: int, count: Counter) -> bool:
        """Whether a block with these words may have enough of the template's."""
        t = known[i]
        return sum(min(n, count[w]) for w, n in t.count.items()) >= len(t.words) - most[i]

    ranked: list[tuple] = []
    seen: set[tuple[int, int]] = set()

    def rank(a: int, b: int) -> None:
        """Puts a block's pairs in the queue, by what each template saves."""
        if (a, b) in seen or a >= b:
            return
        seen.add((a, b))
        count = Counter(words[a:b])
        if any(possible(i, count) for i in range(len(known))):
            for i, n in enumerate(saved(words[a:b], known)):
                heappush(ranked, (-n, i, a, b))

    for at, w in enumerate(words):
        for i, p in wanted.get(w, ()):
            n, wide = len(known[i].words), max(_slack(known[i].words), most[i])
            rank(max(0, at - p - wide), max(0, min(len(words), at - p + n + wide)))
    taken, out = [False] * len(words), []
    while ranked:
        less, i, a, b = heappop(ranked)
        if any(taken[a:b]):
            # What is left of the block is a block of its own, and ranked as such.
            free = [x for x in range(a, b) if not taken[x]]
            starts = [x for x in free if x == a or taken[x - 1]]
            ends = [x + 1 for x in free if x + 1 == b or taken[x + 1]]
            for part in zip(starts, ends, strict=True):
                rank(*part)
            continue
        if not possible(i, Counter(words[a:b])):
            continue
        # A block may cut the notice off: its wording is compared on either side, too.
        lo, hi, n = a, b, len(known[i].words)
        while lo > max(0, a - n) and not taken[lo - 1]:
            lo -= 1
        while hi < min(len(words), b + n) and not taken[hi]:
            hi += 1
        begin, end, missing, added = differences(known[i].words, words[lo:hi])
        if missing + added > most[i]:
            lo = a
            begin, end, missing, added = differences(known[i].words, words[a:b])
            if missing + added > most[i]:
                continue
        begin, end = lo + begin, lo + end
        taken[begin:end] = [True] * (end - begin)
        share = min(-less / max(known[i].most, 1), 1.0)
        out.append((known[i].name, float(share), places[begin][0], places[end - 1][1], missing, added))
        if begin >= b or end <= a:
            heappush(ranked, (less, i, a, b))
            continue
        # A block may hold more than one notice.
        rank(a, max(a, begin))
        rank(min(end, b), b)
    return sorted(out, key=lambda x: x[2:4])


def scan(docs: DataFrame, texts: dict[str, str] | None = None, different: float = DIFFERENT) -> DataFrame:
    """(doc_id, license, saved, start, length, missing, added): a row for each notice found.

    docs(doc_id, text); texts: templates by name, each of a word at least. start and length are
    in characters of the text; missing and added count the words that differ from the
    template, at most `different` of its words. Null and empty texts give no rows; repeated
    rows give theirs each. No rows give no rows; extra columns are not looked at. Of a text of
    any length the words are held by one task, and blocks of a template's length.

    Only texts with a word that proposes a block are handed to Python, so that none is left
    out that could be confirmed.
    """
    texts = texts or TEMPLATES
    words = sorted({t.words[p] for t in templates(texts) for p in t.proposing(different)})

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = templates(texts)
        for f in frames:
            found = [(i, *x) for i, t in zip(f["doc_id"], f["text"], strict=True) for x in find_licenses(t, known, different)]
            frame = pd.DataFrame(found, columns=["doc_id", "license", "saved", "start", "end", "missing", "added"])
            frame["length"] = frame["end"] - frame["start"]
            yield frame.drop(columns="end")

    proposed = F.lower("text").rlike("(?<![a-z0-9])(?:" + "|".join(words) + ")")
    rows = docs.select(whole_id(F.col("doc_id")).alias("doc_id"), "text").where(proposed)
    schema = "doc_id long, license string, saved double, start long, length long, missing long, added long"
    return rows.mapInPandas(each, schema).withColumn("doc_id", null_id(F.col("doc_id")))
