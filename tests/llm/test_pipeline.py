"""The pipeline against its stages done one after another in plain Python."""

from __future__ import annotations

import base64
import hashlib

import public_tokenizers
import tiktoken

import corpus_pipeline
from keyloom.llm import byte_bpe
from tests.llm import test_decontaminate, test_jaccard_join, test_quality_rules, test_secret_scan


def masked(text: str | None) -> str | None:
    out, at = "", 0
    for start, _, end in test_secret_scan.brute_all(text):
        if end <= at:
            continue
        out += (text[at:start] + "[SECRET]") if start >= at else ""
        at = end
    return text if not at else out + text[at:]


def brute(docs: list, items: list[tuple], library) -> list[tuple]:
    docs = [d for d in docs if test_quality_rules.brute(d.text)["kept"]]
    components = test_jaccard_join.brute([(d.doc_id, d.text) for d in docs])
    docs = [d for d in docs if components[d.doc_id][1] == d.doc_id]
    held = {h[0] for h in test_decontaminate.brute([(d.doc_id, d.text) for d in docs], items)}
    rows = []
    for d in docs:
        if d.doc_id not in held:
            text = masked(d.text)
            rows.append((d.doc_id, d.lang, d.source, library.encode_ordinary(text), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(rows)


def test_run_as_brute_force(spark, sf_dir):
    with open(byte_bpe.vocabulary(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    got = sorted((r.doc_id, r.lang, r.source, list(r.token_ids), r.decoded_sha256) for r in rows)
    assert got == brute(docs, items, library) and 0 < len(got) < len(docs)
    assert all(r.n_tokens == len(r.token_ids) for r in rows)


def test_stages_keep_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "jaccard_join", "decontaminate", "secret_scan", "byte_bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).schema.simpleString() == docs.schema.simpleString()


def test_awkward_rows_and_empty_tables(spark, tmp_path, texts, sf_dir):
    """Nulls, empty and very long texts, ties, repeated rows and clashing columns go through every stage; nothing stays nothing."""
    words = [f"word{i}" for i in range(60)]
    plain = " ".join(words[:40]) + ". " + " ".join(words[40:]) + " is where it ends."
    rows = [(None if i == 3 else i, t, "en", "s", None if t is None else len(t), "b", i, 0.5) for i, t in enumerate(texts)]
    rows += [(50, plain, "en", "s", len(plain), "b", 1, 0.5)] * 2 + [(51, plain, "en", "s", len(plain), None, None, None), (None, plain + " More.", None, None, None, None, None, None)]
    columns = "doc_id long, text string, lang string, source string, n_chars long, blob string, n_tokens int, Score double"
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    for name, data, benchmark in (("some", rows, items), ("none", [], items), ("no-items", rows, items.limit(0))):
        path = f"{tmp_path}/{name}"
        spark.createDataFrame(data, columns).repartition(3).write.parquet(f"{path}/documents.parquet")
        benchmark.write.parquet(f"{path}/benchmark.parquet")
        docs = spark.read.parquet(f"{path}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, path)
            assert out.schema.simpleString() == docs.schema.simpleString() and (out.count() > 0) == bool(data)
        got = [r.doc_id for r in corpus_pipeline.run(spark, path).collect()]
        # Equal rows of the smallest doc_id stay both, their copy under another goes, a near copy without a doc_id stays.
        assert sorted(got, key=str) == ([50, 50, None] if data else []) or {50, None} <= set(got) and 51 not in got and got.count(50) == 2
