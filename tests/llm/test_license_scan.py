"""Base places against plain Python, and templates with optional and replaceable regions."""

from __future__ import annotations

import pathlib

import re

import pytest

from keyloom.llm import license_scan as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text: str | None) -> dict:
    ws = words(text)
    places, labels = [], set()
    for phrase, label in L.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(ws)) if ws[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return {"n_words": len(ws), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None), "base_labels": ",".join(sorted(labels))}


def brute_templates(text: str | None) -> set:
    """Labels whose template, as a regular expression over words, is found."""
    joined = " " + " ".join(words(text)) + " "
    out = set()
    for label, templates in L.TEMPLATES.items():
        for t in templates:
            pattern = re.sub(r"<<var (\d+)>>", r"(?:\\S+ ){0,\1}", re.sub(r"<<optional>> ", "(?:", re.sub(r" ?<<end>>", " )?", t))).replace("<<optional>>", "(?:")
            pattern = re.sub(r"\)\? +", ")?", re.sub(r"\} \)", "})", re.sub(r"\{0,(\d+)\} ", r"{0,\1}", pattern))) + " "
            pattern = pattern.replace(" )? ", " )?").replace(")? ", ")?")
            if re.search(r"(?<=\s)" + pattern, joined):
                out.add(label)
    return out


def check(rows) -> None:
    for r in rows:
        want = brute(r.text)
        assert {k: r[k] for k in want} == want
        own = brute_templates(r.text)
        assert set(filter(None, r.labels.split(","))) == set(filter(None, want["base_labels"].split(","))) | own, r.text
        assert r.score == (1.0 if own else 0.5 if want["n_base"] else 0.0)


def test_documents_as_brute_force(documents):
    rows = L.license_scan(documents).collect()
    assert len(rows) == documents.count() and any(r.labels for r in rows)
    check(rows)


def test_awkward_rows(awkward, texts, no_docs):
    rows = L.license_scan(awkward).collect()
    assert len(rows) == len(texts)
    assert {r.n_words for r in rows if r.text is None} == {0}
    check(rows)
    assert L.license_scan(no_docs).count() == 0


@pytest.mark.parametrize(
    ("text", "label", "accepted"),
    [
        ("Released under the MIT License.", "mit", True),
        ("Released under the terms of the MIT License", "mit", True),
        ("Released under the revised MIT License", "mit", False),
        ("SPDX-License-Identifier: BSD-3-Clause", "bsd", True),
        ("SPDX-License-Identifier: BSD Clause", "bsd", True),
        ("SPDX-License-Identifier: BSD-2-x-Clause", "bsd", False),
        ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "apache-2.0", True),
        ("Licensed under the Apache License, Version 3.0", "apache-2.0", False),
        ("Copyright (c) 2019 Some One and others. All rights reserved.", "all-rights-reserved", True),
        ("This work is licensed under a Creative Commons Attribution CC BY 4.0", "cc-by-4.0", True),
    ],
)
def test_mandatory_wording_decides(spark, text, label, accepted):
    row = L.license_scan(spark.createDataFrame([(text,)], "text string"), phrases={}).first()
    assert (label in row.labels.split(",")) == accepted


def filled(template: str) -> str:
    """A text of the template: optional words left out, names put in."""
    return re.sub(r"<<var \d+>>", "the authors", re.sub(r"<<optional>> .*? <<end>> ", "", template))


def test_one_altered_clause_is_refused(spark):
    """Whole license texts are accepted; with one mandatory word changed, left out or put in they are not."""
    full = {label: filled(t[0]) for label, t in L.TEMPLATES.items() if label.endswith("-text")}
    assert sorted(full) == ["bsd-2-clause-text", "bsd-3-clause-text", "bsd-4-clause-text", "isc-text", "mit-text", "unlicense-text"]
    texts = [(label, t, label) for label, t in full.items()]
    for label, t in full.items():
        ws = t.split()
        texts += [(label, " ".join(ws[: len(ws) // 3]), ""), (label, " ".join(ws[:-1]), "")]
        for at in (len(ws) // 4, len(ws) - 12):
            texts += [(label, " ".join([*ws[:at], *put, *ws[at + 1 :]]), "") for put in ([], ["altered"], [ws[at], "not"])]
    json_license = full["mit-text"].replace("the software is provided", "the software shall be used for good not evil the software is provided")
    texts.append(("mit-text", json_license, ""))
    bsd = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
    texts.append(("bsd", bsd, ""))
    df = spark.createDataFrame([(k, t) for k, (_, t, _) in enumerate(texts)], "k int, text string")
    got = {r.k: (r.labels, r.score) for r in L.license_scan(df, phrases={}, keep=["k"]).collect()}
    assert got == {k: (want, 1.0 if want else 0.0) for k, (_, _, want) in enumerate(texts)}


def test_own_templates_and_overlaps(spark):
    df = spark.createDataFrame([("x a a a b y",), ("a c c b",), ("a c c c b",)], "text string")
    rows = {r.text: r for r in L.license_scan(df, templates={"t": ["a <<var 2>> b"]}, phrases={"a a": "aa"}).collect()}
    assert (rows["x a a a b y"].n_base, rows["x a a a b y"].first_word, rows["x a a a b y"].last_word) == (2, 1, 2)
    assert [rows[t].labels for t in ("x a a a b y", "a c c b", "a c c c b")] == ["aa,t", "t", ""]


FOLDER = pathlib.Path("/usr/share/common-licenses")


@pytest.mark.skipif(not (FOLDER / "GPL-3").exists(), reason="no license texts here")
def test_whole_texts_of_long_licenses(spark):
    """A long license is accepted by its whole wording alone, however it is wrapped; one altered word refuses it."""
    names = ["Apache-2.0", "GPL-2", "GPL-3", "MPL-2.0"]
    texts = {f"{n.lower()}-text": (FOLDER / n).read_text() for n in names}
    templates = L.whole_texts(texts) | {"marked-text": ["copyright <<var 3>> do no <<optional>> wilful <<end>> evil"]}
    rows = []
    for label, text in texts.items():
        words = text.split()
        altered = [*words[:-20], "not", *words[-19:]]
        lacking = words[: len(words) // 2] + words[len(words) // 2 + 1 :]
        rows += [(label, True, "before " + text + " after"), (label, True, " ".join(words)), (label, False, " ".join(altered)), (label, False, " ".join(lacking))]
    rows += [("marked-text", True, "Copyright A. B: do no evil!"), ("marked-text", False, "Copyright A. B: do no great evil!")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, label string, whole boolean, text string")
    got = L.license_scan(df, templates=templates).collect()
    assert [(r.k, r.label in r.labels.split(",")) for r in sorted(got, key=lambda r: r.k)] == [(k, r[1]) for k, r in enumerate(rows)]
