"""Held items against exact containment in plain Python, and items planted in long documents."""

from __future__ import annotations

import random

import regex

from keyloom.llm import decontaminate as D


def words(text: str | None) -> list[str]:
    return regex.findall(r"[\p{L}\p{M}\p{N}]+", (text or "").lower())


def runs(ws: list[str], width: int) -> set:
    return {tuple(ws[i : i + width]) for i in range(len(ws) - width + 1)}


def brute(docs: list[tuple], items: list[tuple], least: float = 0.8) -> set:
    out = set()
    for item_id, text in items:
        ws = words(text)
        if not ws:
            continue
        width = min(5, len(ws))
        own = runs(ws, width)
        for doc_id, doc in docs:
            n = len(own & runs(words(doc), width))
            if n and n >= least * len(own) - 1e-9:
                out.add((doc_id, item_id, len(own), n))
    return out


def found(spark, docs, items, **options) -> set:
    rows = D.contained_items(spark.createDataFrame(docs, "doc_id long, text string, Item_ID string" if len(docs[0]) == 3 else "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), **options).collect()
    assert len(rows) == len({(r.doc_id, r.item_id) for r in rows})
    return {(r.doc_id, r.item_id, r.n_item, r.n_matched) for r in rows}


def test_planted_items(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 7, 12, 40, 90])))) for i in range(40)]
    docs = []
    for i in range(60):
        body = [rng.choice(vocabulary) for _ in range(rng.choice([5, 100, 4000]))]
        for _, text in rng.sample(items, rng.choice([0, 1, 2])):
            part = text.split()
            if rng.random() < 0.6 and len(part) > 6:  # a little changed: some above the threshold, some below
                for _ in range(rng.choice([1, 1, 2, 3])):
                    part[rng.randrange(len(part))] = "changed"
            at = rng.randrange(len(body))
            body[at:at] = [w.upper() + rng.choice(["", ",", "."]) for w in part]
        docs.append((i, " ".join(body)))
    want = brute(docs, items)
    assert len(want) > 20 and found(spark, docs, items) == want
    assert found(spark, docs, items, least=0.5) == brute(docs, items, 0.5)


def test_without_broadcasts(spark, monkeypatch):
    """Beyond the size bound the same comes from shuffled joins."""
    monkeypatch.setattr(D, "BROADCAST_BYTES", 0)
    items = [(1, "alpha beta gamma delta epsilon zeta"), (2, "one two")]
    docs = [(1, "x alpha beta gamma delta epsilon zeta y"), (2, "one, two"), (3, "nothing")]
    assert found(spark, docs, items) == {(1, 1, 2, 2), (2, 2, 1, 1)}


def test_awkward_rows(spark, texts, awkward, no_docs):
    docs = [(i, t) for i, t in enumerate(texts)]
    items = [(1, None), (2, ""), (3, "One two three"), (4, "Straße"), (5, "a b c d e"), (5, "a b c d e"), (None, "the cat sat on the mat and the cat"), (7, "!!!")]
    want = brute(docs, items)
    assert found(spark, docs, items) == want
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    kept = D.without_items(awkward, benchmark)
    held = {t for i, t in docs if i in {w[0] for w in want}}
    rows = kept.collect()
    assert kept.columns == awkward.columns and not held & {r.text for r in rows}
    assert None in {r.text for r in rows} and "" in {r.text for r in rows}
    assert D.contained_items(no_docs, benchmark).count() == 0
    assert D.contained_items(awkward, benchmark.limit(0)).count() == 0


def test_native_plan(spark, sf_dir, documents):
    """No Python on the main path."""
    rows = D.contained_items(documents, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "ExistingRDD"))
