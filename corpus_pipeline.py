"""The training-text pipeline: stages over documents, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return docs' columns.

Defined results: a null or empty text has fewer than ten words, so the first stage rejects it; so it does an empty
table's nothing, and every stage of an empty table is empty. Rows that share a doc_id are one document to the second and
third stage (null is one id to the third; to the second, rows without an id link but all stay), so they go together;
rows that are equal have equal results in every stage. Columns besides doc_id and text are passed on, whatever their
names. Texts of any length are worked on whole. The second stage keeps the smallest doc_id of a group.

The first stage rejects documents and leaves the texts of the others whole: what the rules would cut out of a kept
document (the operator's column `cleaned`) stays, since the next stages compare and scan documents as they came.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import byte_bpe, decontaminate, jaccard_join, quality_rules, secret_scan
from keyloom.llm.shared import removed, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, their texts whole."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of documents linked by a Jaccard of 0.8 or more the one with the smallest doc_id."""
    return jaccard_join.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in their texts replaced by [SECRET]; n_chars follows the text."""
    found = secret_scan.secret_scan(docs)
    text = secret_scan.redacted(F.col("text"), F.col("spans"))
    new = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return new.select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source with token_ids, n_tokens and the digest of what the ids decode to."""
    out = byte_bpe.byte_bpe(docs, byte_bpe.vocabulary(), keep=[c for c in ("doc_id", "lang", "source") if c in docs.columns])
    return out.drop("token_ends")


STAGES = [
    ("quality_rules", quality),
    ("jaccard_join", near_duplicates),
    ("decontaminate", decontaminated),
    ("secret_scan", redacted),
    ("byte_bpe", encoded),
]

#: SQL cannot express the line rules' verdict or the tokens; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents; every stage but the last is written and read again, until the next is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        done, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        if k:
            removed(done)
    return STAGES[-1][1](spark, docs, sf_dir)
