"""License scans: phrases, and license templates compiled into token automata.

A template is wording with markup: <<optional>> ... <<end>> may be left out, <<var N>> stands for up to N
words of the text's own. Compiled, it is an automaton over words; a text is accepted from a place on if its
words there run through all mandatory wording in order, with only optional and replaceable regions differing.

Short licenses (MIT, ISC, BSD, Unlicense) are templates of their whole wording, labelled NAME-text: a text that
alters or lacks one mandatory word, or has others put in, isn't accepted. Long ones (Apache, GPL, MPL and the like)
are compiled by whole_texts() from their texts, which a parameter brings along. All other labels are of notices,
titles and identifiers that name a license, and say nothing about the wording of a license text.

Defined results: a null or empty text has no words, no labels and score 0. Overlapping places all count. Rows are
scanned one by one: repeated rows give equal results, an empty table gives an empty one. Texts of any length are
scanned whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from keyloom.llm import words as W
from keyloom.llm.arrowmap import buffers, with_arrow_columns

# Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Clauses of the short licenses.
_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<var 8>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<optional>> 1 <<end>> <<optional>> a <<end>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<optional>> 2 <<end>> <<optional>> b <<end>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_ADVERTS = "<<optional>> 3 <<end>> <<optional>> c <<end>> all advertising materials mentioning features or use of this software must display the following acknowledgement this product includes software developed by <<var 12>>"
_BSD_NAMES = "<<optional>> 3 <<end>> <<optional>> 4 <<end>> <<optional>> c <<end>> <<optional>> d <<end>> neither the name of <<var 12>> nor the names of <<optional>> its <<end>> contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_AS_IS = "this software is provided by <<var 12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var 12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"

# Templates by label; wording of public licenses and of the notices that name them.
TEMPLATES = {
    "apache-2.0": [
        "licensed under the apache license version 2 0 <<optional>> the license you may not use this file except in compliance with the license <<end>>",
        "apache license version 2 0 january 2004",
        "spdx license identifier apache 2 0",
    ],
    "gpl-3.0": [
        "<<optional>> this work is <<end>> licensed under the <<optional>> terms of the <<end>> gnu general public license <<optional>> as published by the free software foundation <<end>> <<optional>> either <<end>> version 3",
        "gnu general public license version 3 29 june 2007",
        "spdx license identifier gpl 3 0 <<optional>> only <<end>> <<optional>> or later <<end>>",
    ],
    "gpl-2.0": [
        "under the terms of the gnu general public license as published by the free software foundation <<optional>> either <<end>> version 2",
        "spdx license identifier gpl 2 0 <<optional>> only <<end>> <<optional>> or later <<end>>",
    ],
    "lgpl": ["gnu <<optional>> library <<end>> <<optional>> lesser <<end>> general public license <<optional>> as published by the free software foundation <<end>> <<optional>> either <<end>> version <<var 2>> of the license"],
    "mit": [
        "released under the <<optional>> terms of the <<end>> mit license",
        "<<optional>> is <<end>> licensed under the <<optional>> terms of the <<end>> mit license",
        "spdx license identifier mit",
    ],
    "mit-text": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<optional>> including the next paragraph <<end>> shall be included in all copies or substantial portions of the software "
        + _AS_IS
    ],
    "bsd": ["spdx license identifier bsd <<var 1>> clause"],
    "bsd-2-clause-text": [f"{_BSD} {_BSD_AS_IS}"],
    "bsd-3-clause-text": [f"{_BSD} {_BSD_NAMES} {_BSD_AS_IS}"],
    "bsd-4-clause-text": [f"{_BSD} {_BSD_ADVERTS} {_BSD_NAMES} {_BSD_AS_IS}"],
    "isc": ["spdx license identifier isc"],
    "isc-text": [
        "permission to use copy modify and <<optional>> or <<end>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<var 8>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<var 8>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
    ],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "cc-by-4.0": ["licensed under <<optional>> a <<end>> <<optional>> creative commons attribution <<end>> cc by 4 0", "licensed under a creative commons attribution 4 0 international license"],
    "cc-by-nc-4.0": ["licensed under <<optional>> a <<end>> cc by nc 4 0", "licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by-sa-4.0": ["licensed under <<optional>> a <<end>> cc by sa 4 0", "licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc0-1.0": ["cc0 1 0 universal"],
    "unlicense": ["spdx license identifier unlicense"],
    "unlicense-text": [
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law "
        + _AS_IS
    ],
    "all-rights-reserved": ["<<optional>> copyright <<var 8>> <<end>> all rights reserved"],
}

IN_WORD = np.zeros(256, bool)
IN_WORD[list(range(0x30, 0x3A)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True


@dataclass(frozen=True)
class Automaton:
    """States are numbered along the wording; steps lists (word or None for any word, next state)."""

    steps: tuple[tuple[tuple[str | None, int], ...], ...]
    final: int
    skips: tuple[tuple[int, ...], ...]

    def closed(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for nxt in self.skips[todo.pop()]:
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return seen

    def beginnings(self) -> set[tuple[str, ...]]:
        """The pairs of words that accepted runs begin with; one word alone where anything may follow it."""
        out: set[tuple[str, ...]] = set()
        for word, to in (step for s in self.closed({0}) for step in self.steps[s]):
            after = self.closed({to})
            seconds = {w for s in after for w, _ in self.steps[s]}
            assert word is not None, "a template begins with wording"
            out |= {(word,)} if self.final in after or None in seconds else {(word, w) for w in seconds}
        return out

    def accepts(self, words: list[str], at: int) -> int:
        """The end of the longest accepted run of words from at on, or -1."""
        states, best = self.closed({0}), -1
        while True:
            if self.final in states:
                best = at
            if at >= len(words) or not states:
                return best
            states = self.closed({to for s in states for w, to in self.steps[s] if w is None or w == words[at]})
            at += 1


def compiled(template: str) -> Automaton:
    """The automaton of a marked-up template."""
    steps: list[list] = [[]]
    skips: list[list[int]] = [[]]
    opened: list[int] = []

    def state() -> int:
        steps.append([])
        skips.append([])
        return len(steps) - 1

    here = 0
    for mark, word in re.findall(r"<<([^>]*)>>|(\S+)", template):
        if word:
            to = state()
            steps[here].append((word, to))
            here = to
        elif mark == "optional":
            opened.append(here)
        elif mark == "end":
            skips[opened.pop()].append(here)
        else:
            begin = here
            for _ in range(int(mark.split()[1])):
                to = state()
                steps[here].append((None, to))
                skips[here].append(to)
                here = to
            assert here > begin
    assert not opened
    return Automaton(tuple(map(tuple, steps)), here, tuple(map(tuple, skips)))


def whole_texts(texts: dict[str, str]) -> dict[str, list[str]]:
    """Templates of whole license texts by label; they may hold the markup of templates, all other wording is mandatory."""
    pieces = {label: re.findall(r"<<[^>]*>>|[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text) for label, text in texts.items()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return {label: [" ".join(p if p.startswith("<<") else p.translate(lower) for p in found)] for label, found in pieces.items()}


class Scanner:
    """Compiled templates and phrases; built anew in every task from the two tables."""

    def __init__(self, templates: dict[str, list[str]], phrases: dict[str, str]):
        self.phrases = [(tuple(p.split()), label) for p, label in phrases.items()]
        self.by_word: dict[str, list[tuple[str, Automaton]]] = {}
        begins = {p[:2] for p, _ in self.phrases}
        for label, texts in templates.items():
            for t in texts:
                automaton = compiled(t)
                begins |= automaton.beginnings()
                for w in sorted({x[0] for x in automaton.beginnings()}):
                    self.by_word.setdefault(w, []).append((label, automaton))
        # Only places where the first two words fit are looked at; texts without any are passed over.
        self.single = _hashes({x[0] for x in begins if len(x) == 1})
        self.pairs = np.sort(np.array([W.windows(_hashes(x), 2)[0] for x in begins if len(x) == 2], W.U))

    def places(self, hashes: np.ndarray) -> np.ndarray:
        found = np.isin(hashes, self.single)
        if len(hashes) > 1:
            found[:-1] |= np.isin(W.windows(hashes, 2), self.pairs)
        return np.flatnonzero(found)

    def scan(self, words: list[str], candidates: list[int]) -> tuple[list[int], set[str], set[str]]:
        places, base, own = [], set(), set()
        for at in candidates:
            for phrase, label in self.phrases:
                if tuple(words[at : at + len(phrase)]) == phrase:
                    places.append(at)
                    base.add(label)
            for label, automaton in self.by_word.get(words[at], ()):
                if label not in own and automaton.accepts(words, at) >= 0:
                    own.add(label)
        return places, base, own


def _hashes(words) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([0, *map(len, raw)])
    return W.span_hashes(np.frombuffer(b"".join(raw), np.uint8), ends[:-1], ends[1:])


ADDED = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "n_base", "first_word", "last_word")] + [T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType())]
)


def license_scan(df: DataFrame, text: str = "text", templates: dict[str, list[str]] | None = None, phrases: dict[str, str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """df (or its columns in keep) with n_words, the base places, labels and a score.

    n_base counts the places of base phrases, first_word and last_word are their smallest and largest start.
    labels adds those of accepted templates. score is 1 when a template accepts, 0.5 for base phrases alone,
    else 0. An input column named like an output is replaced.
    """
    tables = (TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases)
    made: list[Scanner] = []

    def kernel(texts: pa.Array) -> list:
        if not made:
            made.append(Scanner(*tables))
        scanner = made[0]
        data, offsets = buffers(texts)
        data = W.LOWER[data]
        starts, ends = W.spans(IN_WORD[data], offsets)
        bounds = W.per_text(starts, offsets)
        hashes = W.span_hashes(data, starts, ends)
        anchors = scanner.places(hashes)
        shares = np.searchsorted(anchors, bounds)
        raw = data.tobytes()
        n = len(texts)
        n_base, first, last, base_labels, labels, score = [0] * n, [None] * n, [None] * n, [""] * n, [""] * n, [0.0] * n
        for k in np.flatnonzero(np.diff(shares)):
            a, b = int(bounds[k]), int(bounds[k + 1])
            words = [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
            places, base, own = scanner.scan(words, (anchors[shares[k] : shares[k + 1]] - a).tolist())
            if places:
                n_base[k], first[k], last[k] = len(places), min(places), max(places)
            base_labels[k], labels[k] = ",".join(sorted(base)), ",".join(sorted(base | own))
            score[k] = 1.0 if own else 0.5 if base else 0.0
        whole = lambda x: pa.array(x, pa.int64())
        return [whole(np.diff(bounds)), whole(n_base), whole(first), whole(last), pa.array(base_labels, pa.string()), pa.array(labels, pa.string()), pa.array(score, pa.float64())]

    return with_arrow_columns(df, text, ADDED, kernel, keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep=["doc_id"])
