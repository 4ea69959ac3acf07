"""Set sizes and components against all pairs in plain Python."""

from __future__ import annotations

import random
import re

import pytest

from keyloom.llm import jaccard_join as J
from tests.llm.conftest import thue_morse


def shingles(text: str | None) -> frozenset:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", low) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows: list[tuple]) -> dict:
    """(n_shingles, component) of every doc_id."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def check(spark, rows: list[tuple]) -> None:
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.similar_components(df).collect()}
    assert got == brute(rows)


def variants(seed: int, groups: int, size: int) -> list[tuple]:
    """Chains of texts, each a little different from the one before, around the threshold."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(groups):
        text = [rng.choice(words) for _ in range(rng.choice([3, 4, 5, 6, 9, 30, 80, 200]))]
        for _ in range(size):
            rows.append((len(rows) * 7 % 9973, " ".join(text)))
            text = list(text)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                text[rng.randrange(len(text))] = rng.choice(words)
            if rng.random() < 0.3:
                text.insert(rng.randrange(len(text)), rng.choice(words))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_of_near_copies(spark, seed):
    check(spark, variants(seed, 12, 14))


@pytest.mark.parametrize(("rows", "size", "cross"), [(8, J.BLOCK_BYTES, 8), (4, 4000, 6), (1, J.BLOCK_BYTES, 1)])
def test_large_groups_in_blocks(spark, monkeypatch, rows, size, cross):
    """Groups far over a block are joined block by block, and what stays apart meets all the rest: no link is lost."""
    monkeypatch.setattr(J, "BLOCK_ROWS", rows)
    monkeypatch.setattr(J, "BLOCK_BYTES", size)
    monkeypatch.setattr(J, "CROSS_ROWS", cross)
    check(spark, variants(3, 3, 60))


def test_many_texts_of_a_shared_passage(spark, monkeypatch):
    """A shingle that over a block of rows share connects them until their whole sets are compared."""
    monkeypatch.setattr(J, "BLOCK_ROWS", 5)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(k, f"{passage} " + " ".join(f"t{k // 3}x{i}" for i in range(k % 7))) for k in range(40)]
    check(spark, rows + [(100 + k, t) for k, t in rows[:12]])


def test_joined_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(J, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(J, "BLOCK_ROWS", 8)
    check(spark, variants(5, 4, 20))


@pytest.mark.parametrize("n", [1024, 4096])
def test_structured_words_are_told_apart(spark, n):
    """Texts that differ in words on which polynomial hashes collide do not link."""
    one, other = thue_morse(n)
    rest = " ".join(f"s{i}" for i in range(8))
    check(spark, [(1, one), (2, other), (3, f"{one} {rest}"), (4, f"{other} {rest}"), (5, f"{one} {rest}")])


def test_clashing_columns_are_left_out(spark):
    rows = [(1, "a b c d e f", 9, "x"), (2, "a b c d e f", 9, "y")]
    got = J.similar_components(spark.createDataFrame(rows, "doc_id long, text string, node int, token string"))
    assert got.columns == ["doc_id", "n_shingles", "component_id"] and sorted(map(tuple, got.collect())) == [(1, 2, 1), (2, 2, 1)]


def test_exact_threshold(spark):
    """36 of 45 shingles are exactly 0.8; one less is not enough."""
    a = " ".join(f"a{i}" for i in range(44))  # 40 shingles
    at = a + " b0 b1 b2 b3 b4 b5 b6 b7 b8 b9"  # 50 shingles, 40 shared: 0.8
    below = a + " c0 c1 c2 c3 c4 c5 c6 c7 c8 c9 c10"  # 40 of 51
    check(spark, [(1, a), (2, at), (3, below)])


def test_awkward_rows(spark, texts, awkward):
    check(spark, [(i, t) for i, t in enumerate(texts) if i not in (3, 5, 6)])
    rows = J.similar_components(awkward).collect()
    assert len(rows) == len(texts)
    # Rows of doc_id 5 have different sets and are one document.
    assert {r.component_id for r in rows if r.doc_id == 5} == {5}


def test_every_row_twice(spark):
    """Repeated rows change no component: a node counts once for a shingle."""
    rows = variants(4, 12, 14)
    df = spark.createDataFrame(rows + rows, "doc_id long, text string").repartition(3)
    got = J.similar_components(df).collect()
    assert len(got) == 2 * len(rows) and {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)
    assert len(set(got)) == len(rows)


def test_rows_without_id_link(spark):
    """A row without doc_id is the only link of 8 and 9, and lone ones have no component."""
    words = [f"n{i}" for i in range(60)]
    near = [" ".join(words[:44]), " ".join(words[:50]), " ".join(words[:56])]
    alone = [" ".join(f"m{i}" for i in range(40 + k)) for k in (0, 1)]
    df = spark.createDataFrame([(9, near[0]), (None, near[1]), (8, near[2]), (None, alone[0]), (None, alone[1]), (None, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in J.similar_components(df).collect()), key=str)
    assert got == sorted([(9, 40, 8), (None, 46, 8), (8, 52, 8), (None, 36, None), (None, 37, None), (None, 0, None)], key=str)


def test_empty_tables(spark, no_docs):
    assert J.similar_components(no_docs).count() == 0
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(tuple(r) for r in J.similar_components(none).collect()) == [(1, 0, 1), (2, 0, 2)]


def test_one_of_each_keeps_columns(spark):
    text = " ".join(f"x{i}" for i in range(40))
    docs = spark.createDataFrame([(9, text, "a"), (4, text, "b"), (6, text + " more", "c"), (7, None, "d"), (8, "", "e")], "doc_id long, text string, Component_ID string")
    kept = J.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [4, 7, 8]
