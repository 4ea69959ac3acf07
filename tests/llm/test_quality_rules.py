"""Counts and verdicts against a line-by-line version in plain Python."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from keyloom.llm import quality_rules as Q
from tests.llm.conftest import thue_morse

SPACES = "[\x20\x09-\x0d]+"


def split(text: str) -> list[str]:
    return [w for w in re.split(SPACES, text) if w]


def brute(text: str | None, rules: Q.Rules = Q.Rules()) -> dict:
    text = text or ""
    words = split(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    seen, dup, left = set(), 0, 0
    for line in text.split("\n"):
        inside = split(line)
        if not inside:
            continue
        again = line in seen
        seen.add(line)
        dup += again
        visible = sum(map(len, inside))
        n = len(inside)
        lone = sum(w in ("|", "<", ">", "/", "*", "-") for w in inside)
        loud = sum(c in "#*$%&|<>!" for c in line)
        echo = sum(a == b for a, b in zip(inside, inside[1:], strict=False))
        low = re.sub("[A-Z]", lambda m: m[0].lower(), line)
        bad = (
            again
            or lone / n >= rules.separators
            or loud / visible >= rules.symbols
            or (n >= rules.min_words and echo / n >= rules.stammer)
            or (n < rules.heading and not (inside[-1][-1] in ".!?:;\"')]}" or ord(inside[-1][-1]) > 127))
            or (n <= rules.boilerplate_words and any(p in low for p in Q.BOILERPLATE))
        )
        left += 0 if bad else visible
    total = sum(map(len, words))
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return {
        "n_words": len(words), "word_chars": total, "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": dup, "n_repeat_words": len(covered),
        "kept_chars": left, "base_failed": failed, "kept": not failed and left >= rules.least_kept * total,
    }


def test_documents_as_brute_force(documents):
    rows = Q.quality_rules(documents).collect()
    assert len(rows) == documents.count()
    for r in rows:
        want = brute(r.text)
        assert {k: r[k] for k in want} == want, r.doc_id


def test_awkward_rows(awkward, texts):
    rows = Q.quality_rules(awkward).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(r.text)
        assert {k: r[k] for k in want} == want
        assert r.Score.startswith("kept")


def test_clean_documents_stay(spark, sf_dir, documents):
    """Nearly all documents labelled good stay, and labels aren't an input."""
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    kept = Q.quality_rules(documents).join(good, "doc_id").select("kept").collect()
    assert sum(r.kept for r in kept) >= 0.95 * len(kept)


def test_cleaned_text_and_empty_table(spark, no_docs):
    text = "Home | About | Contact\nA proper sentence stands here, long enough to be kept.\nRead more\nA proper sentence stands here, long enough to be kept."
    row = Q.quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.cleaned == "A proper sentence stands here, long enough to be kept."
    assert Q.quality_rules(no_docs).count() == 0 and Q.keep_good(no_docs).columns == no_docs.columns


@pytest.mark.parametrize("n", [1024, 4096])
def test_structured_lines_and_words_are_told_apart(n):
    one, other = thue_morse(n)
    texts = [f"{one}\n{other}", f"{one}\n{other}\n{one}", " ".join([one] * 5 + [other] * 5 + [one] * 5)]
    got = dict(zip(Q.ADDED.names, Q.judge(pa.array(texts), Q.Rules()), strict=True))
    for i, text in enumerate(texts):
        want = brute(text)
        assert {k: got[k][i].as_py() for k in want} == want


def test_rows_whose_keys_collide_are_told_apart(monkeypatch):
    """With a hash that says nothing, equality is still that of the bytes."""
    monkeypatch.setattr(Q.W, "mix", lambda x: x & Q.W.U(0))
    texts = ["the cat sat on the mat and the cat sat on the mat\na line\na line\nother line"]
    got = dict(zip(Q.ADDED.names, Q.judge(pa.array(texts), Q.Rules()), strict=True))
    want = brute(texts[0])
    assert {k: got[k][0].as_py() for k in want} == want


def test_distinct_spans_are_told_by_bytes():
    """Spans that hashes confuse, of any length and with zeros at their ends, get the numbers that a dict gives."""
    rng = np.random.default_rng(3)
    pieces = [bytes(rng.integers(0, 2, int(n), np.uint8)) for n in rng.integers(0, 90, 600)] + [b"a" * 200, b"a" * 199 + b"b", b"", b"\0", b"\0\0"]
    ends = np.cumsum([len(p) for p in pieces])
    data, starts = np.frombuffer(b"".join(pieces), np.uint8), np.append(0, ends[:-1])
    for hashes in (Q.W.span_hashes, lambda d, a, b: (b - a).astype(Q.W.U)):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(Q.W, "span_hashes", hashes)
            index, inverse = Q.W.distinct_spans(data, starts, ends)
        assert [pieces[index[k]] for k in inverse] == pieces and len(index) == len(set(pieces))
