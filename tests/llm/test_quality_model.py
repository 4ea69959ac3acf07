"""Held-out accuracy, calibration and what a score may depend on."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from keyloom.llm import quality_model as Q


def auc(score: np.ndarray, label: np.ndarray) -> float:
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    n1, n0 = label.sum(), (1 - label).sum()
    return float((rank[label == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * n0))


@pytest.fixture(scope="module")
def judged(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = Q.query(spark, sf_dir).toPandas()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    return rows, rows.merge(labels, on="doc_id")


def test_every_document_once(judged, spark):
    rows, _ = judged
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.3)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(rows.doc_id, rows.held_out, strict=True))


def test_held_out_accuracy(judged):
    held = judged[1][judged[1].held_out]
    assert len(held) > 30 and auc(held.score.to_numpy(), held.quality.to_numpy()) >= 0.9
    assert ((held.score >= 0.5) == held.quality).mean() >= 0.85


def test_calibration(judged):
    """Mean score and share of good documents agree on held-out rows."""
    held = judged[1][judged[1].held_out]
    assert abs(held.score.mean() - held.quality.mean()) < 0.12


def test_labels_of_held_out_rows_are_not_learnt(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * 5) for i in range(60)], "doc_id long, text string")
    labels = [(i, i % 2) for i in range(60)]
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in labels]
    nets = [Q.fit(docs, spark.createDataFrame(x, "doc_id long, quality int"))[1] for x in (labels, flipped)]
    assert np.array_equal(nets[0].w1, nets[1].w1) and nets[0].temperature == nets[1].temperature


def test_awkward_rows(spark, awkward, texts, no_docs):
    docs = awkward.drop("Score")
    for labels in ([], [(1, 1)], [(1, 1), (2, None), (None, 0)], [(1, 1), (2, 0), (2, 0), (99, 1)]):
        table = spark.createDataFrame(labels, "doc_id long, quality int")
        vectors, net = Q.fit(docs.select("doc_id", "text"), table)
        rows = Q.scored(awkward, vectors, net).collect()
        assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows)
        same = {r.score for r in rows if not r.text}
        assert len(same) == 1  # null and empty alike
    assert Q.scored(no_docs, vectors, net).count() == 0


def test_sample_is_bounded(spark, monkeypatch):
    """However often a doc_id is repeated, at most SAMPLE rows are learnt from; word vectors come from all documents."""
    monkeypatch.setattr(Q, "SAMPLE", 30)
    seen = []
    monkeypatch.setattr(Q, "trained", lambda x, y, hold: seen.append(len(y)) or "net")
    docs = spark.createDataFrame([(i % 100, f"word{i} text{i}") for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 100, i % 2) for i in range(1000)], "doc_id long, quality int")
    vectors, _ = Q.fit(docs, labels)
    assert seen[0] <= 30 and seen[0] >= 20
    whole, _ = Q.fit(docs, labels.limit(0))
    assert np.array_equal(vectors, whole)


def test_empty_tables(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    vectors, net = Q.fit(no_docs, labels)
    assert Q.scored(no_docs, vectors, net).count() == 0 and net.score(Q.features(Q.pa.array(["a", None]), vectors)).tolist() == [0.5, 0.5]
