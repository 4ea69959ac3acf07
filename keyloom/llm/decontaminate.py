"""Benchmark decontamination in DataFrame functions only: which documents hold which test items.

An item is held when at least `least` of its distinct five-word shingles occur in the document (containment).
Items are partitioned by size; each size class has a bottom-k MinHash sketch, the k smallest shingle hashes,
with k so large that an item that reaches the threshold in a document must share one of them: of n shingles
at most n - ceil(least * n) may be missing, and every class takes one more than its largest n allows. A
document is searched by all its shingles, so the search misses nothing, however long the document. Found
pairs are verified by intersecting the exact shingles.

Words are runs of letters, marks and digits, lower-cased. An item of one to four words has one shingle, of
all its words; one without words is held by nothing.

Defined results: null texts are empty; rows that share a doc_id (null is one id too) are one document as to
results, with the best containment of its rows; repeated items are items of their own. An item in many documents, or a
document with many items, is a row each. Without documents or without items nothing is found, so nothing goes. Other
columns of the inputs are left out of the result, and passed on by without_items, whatever their names. Texts of any
length are searched whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.shared import BROADCAST_BYTES, written

SHINGLE, LEAST = 5, 0.8
SEPARATOR = r"[^\p{L}\p{M}\p{N}]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATOR), "")


def shingle_hashes(words: Column, width: int) -> Column:
    """64-bit hash of every run of width words."""
    run = lambda i: F.xxhash64(F.lit(width), *[F.get(words, i + k) for k in range(width)])
    return F.when(F.size(words) >= width, F.transform(F.sequence(F.lit(0), F.size(words) - width), run)).otherwise(F.array().cast("array<bigint>"))


def shingles(words: Column, width: Column) -> Column:
    """Distinct runs of width words, spelt with single spaces."""
    run = lambda i: F.array_join(F.slice(words, i, width), " ")
    return F.when((width > 0) & (F.size(words) >= width), F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), run))).otherwise(F.array().cast("array<string>"))


def small(df: DataFrame, bytes_a_row: Column) -> bool:
    """Whether df's rows, sized by bytes_a_row, may be broadcast."""
    return (df.select(F.sum(bytes_a_row)).first()[0] or 0) <= BROADCAST_BYTES


def hinted(df: DataFrame, fits: bool) -> DataFrame:
    return F.broadcast(df) if fits else df


def sketches(items: DataFrame, least: float) -> DataFrame:
    """(item_id, hash): the bottom-k sketch of every item, k by its size class (powers of two)."""
    by_width = [F.when(F.col("width") == w, shingle_hashes(F.col("words"), w)) for w in range(1, SHINGLE + 1)]
    distinct = items.select("item_id", F.array_sort(F.array_distinct(F.coalesce(*by_width))).alias("hashes")).where(F.size("hashes") > 0)
    largest = F.pow(F.lit(2.0), F.floor(F.log2(F.size("hashes").cast("double"))) + 1) - 1
    k = (largest - F.ceil(largest * least - 1e-9) + 1).cast("int")
    return distinct.select("item_id", F.explode(F.slice("hashes", F.lit(1), F.least(k, F.size("hashes")))).alias("hash"))


def prepared(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, words, width, shingles), written once."""
    items = benchmark.select(F.col(item_id).alias("item_id"), words_of(F.col(text)).alias("words"))
    items = items.withColumn("width", F.least(F.lit(SHINGLE), F.size("words"))).where("width > 0")
    return written(items.withColumn("shingles", shingles(F.col("words"), F.col("width"))), "benchmark-items")


def contained_items(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, n_item, n_matched, containment) of every document and item it holds.

    The benchmark's tables are broadcast while they fit BROADCAST_BYTES, else joined by a shuffle.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    items = prepared(benchmark, item_id, item_text)
    widths = sorted(r[0] for r in items.select("width").distinct().collect())  # five values at most
    texts = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), docs[f"`{text}`"].alias("__text"))
    if not widths:
        return texts.join(items, F.lit(False)).select("doc_id", "item_id", *[F.lit(0).cast(k).alias(n) for n, k in (("n_item", "long"), ("n_matched", "long"), ("containment", "double"))])
    fits = small(items, F.size("shingles") * 80 + 100)

    words = texts.select("doc_id", words_of(F.col("__text")).alias("words"))
    hashes = words.select("doc_id", F.concat(*[shingle_hashes(F.col("words"), w) for w in widths]).alias("hashes"))
    # explode_outer: for explode the optimizer adds a filter on the array, which would compute it twice.
    candidates = hashes.select("doc_id", F.explode_outer("hashes").alias("hash")).join(hinted(sketches(items, least), fits), "hash").select("doc_id", "item_id").distinct()
    candidates = written(candidates, "benchmark-candidates")

    pairs = hinted(candidates.withColumnRenamed("doc_id", "__doc"), small(candidates, F.lit(48)))
    found = texts.join(pairs, F.col("doc_id").eqNullSafe(F.col("__doc"))).select("doc_id", "item_id", words_of(F.col("__text")).alias("words"))
    wanted = items.select(F.col("item_id").alias("__item"), "width", F.col("shingles").alias("__wanted"))
    found = found.join(hinted(wanted, fits), F.col("item_id").eqNullSafe(F.col("__item")))
    matched = F.size(F.array_intersect(shingles(F.col("words"), F.col("width")), F.col("__wanted")))
    rows = found.select("doc_id", "item_id", F.size("__wanted").cast("long").alias("n_item"), matched.cast("long").alias("n_matched"))
    rows = rows.where(F.col("n_matched") >= F.ceil(F.col("n_item") * least - 1e-9))
    best = rows.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("n_matched") / F.col("n_item"), "n_matched", "n_item")).alias("best"))
    return best.select("doc_id", "item_id", "best.n_item", "best.n_matched", (F.col("best.n_matched") / F.col("best.n_item")).alias("containment"))


def without_items(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """docs without the documents that hold an item; their texts aren't shuffled while the list found fits."""
    held = written(contained_items(docs, benchmark, doc_id).select(F.col("doc_id").alias("__held")).distinct(), "benchmark-held")
    return docs.join(hinted(held, small(held, F.lit(32))), docs[f"`{doc_id}`"].eqNullSafe(F.col("__held")), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contained_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '')"
ORACLE_SQL = f"""
WITH i AS (SELECT item_id, ws, least({SHINGLE}, len(ws)) AS w FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
s AS (SELECT DISTINCT item_id, w, array_to_string(ws[k:k + w - 1], ' ') AS sh FROM (SELECT item_id, ws, w, unnest(range(1, len(ws) - w + 2)) AS k FROM i)),
n AS (SELECT item_id, count(*) AS n_item FROM s GROUP BY item_id),
d AS (SELECT DISTINCT doc_id, w, array_to_string(ws[k:k + w - 1], ' ') AS sh FROM (SELECT doc_id, ws, w, unnest(range(1, len(ws) - w + 2)) AS k FROM (SELECT doc_id, {_WORDS} AS ws FROM documents), (SELECT DISTINCT w FROM i))),
m AS (SELECT doc_id, item_id, count(*) AS n_matched FROM d JOIN s ON d.w = s.w AND d.sh = s.sh GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_matched, n_matched / n_item AS containment FROM m JOIN n USING (item_id) WHERE 100 * n_matched >= 80 * n_item"""
