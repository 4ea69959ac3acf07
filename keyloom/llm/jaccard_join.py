"""N-gram Jaccard join by signature trees: components of documents whose shingle sets overlap by 0.8.

1. Every text becomes its set of distinct five-word shingles, as 64-bit hashes; equal sets (by a 128-bit
   fingerprint) are one node from then on. The same pass counts shingles in a fixed-size histogram.
2. Two sets with a Jaccard of t or more share one of the n - ceil(t*n) + 1 shingles that come first in any
   fixed order. The order here puts rare histogram bins first, so passages that many texts share hardly ever
   are among them. Shingles that only one node puts first go; of shingles with the same nodes one stays. A
   node counts once for a shingle, however many rows its doc_id has.
3. The nodes of one shingle are joined by signature trees: a tree node holds the OR of its rows' shingle
   bitmaps and their size range. Two trees are walked together from the top; a pair of nodes is dropped when
   sizes or the largest possible overlap rule every row pair out. What the leaves let through connects nodes
   into clusters, of which each shingle reports only who belongs together. A shingle of more than BLOCK_ROWS
   nodes connects them all: step 4 tells them apart.
4. All similar pairs lie inside clusters, whose whole sets are compared: the trees of a block are walked, and row
   pairs not yet connected are verified on the sets. A cluster larger than a block is cut into blocks of like
   sizes; each is joined on its own, then one row of each component found, block by block again, while that makes
   them fewer. What is then apart from its cluster's largest component meets all the cluster's rows of
   possible sizes, pairs of blocks at a time. So no pair of different sets is lost, a group of any number of near
   copies costs about as much as its rows, and output grows with the documents, not with the pairs of a group.

Two different shingles count as equal if their hashes are, a chance of about 2**-64 for a pair of texts not made
to collide.

Defined results: null and empty texts have no shingles and are their own component. Rows that share a
doc_id are one document: its component is that of any of them, the smallest. Rows without a doc_id link
like all others, under a number made from their text; components of such rows alone are null. An empty table
gives an empty one; other columns of the input are left out. Texts of any length are compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm import words as W
from keyloom.llm.arrowmap import buffers, slices
from keyloom.llm.components import components
from keyloom.llm.shared import BROADCAST_BYTES, removed, scratch, written

SHINGLE = 5
#: Similar: UNION_PARTS * intersection >= LEAST_PARTS * union.
LEAST_PARTS, UNION_PARTS = 80, 100
#: Bins of the histogram of shingles (its size does not depend on the corpus), and rows it is sent in.
BINS, BLOCKS = 1 << 20, 64
#: Rows and bytes of sets that are joined in one piece, and rows of each side where two pieces meet.
BLOCK_ROWS, BLOCK_BYTES, CROSS_ROWS = 256, 32 << 20, 1024
LEAF, FANOUT = 16, 8
#: Pairs of tree nodes looked at together.
FRONTIER = 1 << 15


def sets_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = buffers(texts)
    return W.shingle_sets(data, offsets, SHINGLE)


def bin_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)


def prefix_lengths(n: np.ndarray) -> np.ndarray:
    """How many of n shingles must be looked at: n less those that a similar set can lack, plus one."""
    return n - -(-LEAST_PARTS * n // UNION_PARTS) + 1


MEMBERS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("unnamed", T.BooleanType()), T.StructField("n_shingles", T.LongType()), T.StructField("f1", T.LongType()), T.StructField("f2", T.LongType()), T.StructField("block", T.IntegerType()), T.StructField("counts", T.BinaryType())]
)


def fingerprints(docs: DataFrame) -> DataFrame:
    """For every row its set's size and fingerprint, and for every task a histogram of shingles in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        histogram = np.zeros(BINS, np.int32)
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, bounds = sets_of(part.column(1))
                np.add.at(histogram, bin_of(hashes), 1)
                total = lambda x: np.diff(np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])[bounds]).view(np.int64)  # noqa: E731, B023
                k = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(np.diff(bounds)), pa.array(total(hashes)), pa.array(total(W.mix(hashes ^ np.uint64(0x5851F42D4C957F2D)))), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=MEMBERS.names
                )
        for block, counts in enumerate(histogram.reshape(BLOCKS, -1)):
            if counts.any():
                none = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays([none, pa.nulls(1, pa.bool_()), none, none, none, pa.array([block], pa.int32()), pa.array([counts.tobytes()], pa.binary())], names=MEMBERS.names)

    return docs.mapInArrow(run, MEMBERS)


def summed(histograms: DataFrame) -> np.ndarray:
    """The tasks' histograms added up: blocks stream through a task each, the driver gets BINS numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                more = np.frombuffer(counts.as_buffer(), np.int32)
                sums[block] = sums[block] + more if block in sums else more.astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["block", "counts"])

    out = np.zeros((BLOCKS, BINS // BLOCKS), np.int64)
    for block, counts in histograms.repartition(BLOCKS // 4, "block").mapInArrow(run, "block int, counts binary").collect():
        out[block] += np.frombuffer(counts, np.int64)
    return out.reshape(-1)


def by_node(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the rows whose doc_id is a node; nodes is broadcast while small."""
    return docs.join(hinted(nodes, 32), docs.doc_id == nodes.node, "left_semi").select(F.col("doc_id").alias("node"), "text")


def prefixes(texts: DataFrame, histogram: np.ndarray) -> DataFrame:
    """(token, node): each node's first shingles, rare bins before frequent ones."""
    shared = texts.sparkSession.sparkContext.broadcast(histogram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, bounds = sets_of(part.column(1))
                owner, n = W.owners(bounds), np.diff(bounds)
                order = np.lexsort((hashes, count[bin_of(hashes)], owner))
                rank = np.arange(len(hashes)) - bounds[:-1][owner]
                first = order[rank < prefix_lengths(n)[owner]]
                nodes = part.column(0).to_numpy(zero_copy_only=False)[owner[first]]
                yield pa.RecordBatch.from_arrays([pa.array(hashes[first].view(np.int64)), pa.array(nodes)], names=["token", "node"])

    return texts.mapInArrow(run, "token long, node long")


def signatures(texts: DataFrame, whole: bool = False) -> DataFrame:
    """(node, n, bits): set size and shingle bitmap, of the power of two that is at least twice the size.

    whole: also hashes, the set itself as bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, bounds = sets_of(part.column(1))
                bits = []
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    size = max(64, 1 << int(2 * (b - a) - 1).bit_length()) if b > a else 64
                    flags = np.zeros(size, bool)
                    flags[(hashes[a:b] & np.uint64(size - 1)).astype(np.int64)] = True
                    bits.append(np.packbits(flags, bitorder="little").tobytes())
                columns = {"node": part.column(0), "n": pa.array(np.diff(bounds)), "bits": pa.array(bits, pa.binary())}
                if whole:
                    columns["hashes"] = pa.array([hashes[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return texts.mapInArrow(run, "node long, n long, bits binary" + ", hashes binary" * whole)


class Tree:
    """A signature tree over rows that are in order: levels of OR-ed bitmaps and size ranges, leaves first."""

    def __init__(self, bits: np.ndarray, n: np.ndarray):
        excess = n - np.bitwise_count(bits).sum(1, dtype=np.int64)
        # bitmap, smallest and largest size, most shingles beyond the set bits
        self.levels = [(bits, n, n, excess)]
        width = LEAF
        while len(self.levels[-1][1]) > 1:
            b, low, high, over = self.levels[-1]
            at = np.arange(0, len(low), width)
            self.levels.append((np.bitwise_or.reduceat(b, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(over, at)))
            width = FANOUT

    def level(self, k: int) -> tuple:
        return self.levels[min(k, len(self.levels) - 1)]


def possible(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray, rows: bool) -> np.ndarray:
    """Whether node pairs (i of a, j of b) may hold a similar row pair."""
    bits, low, high, over = a
    bits2, low2, high2, over2 = b
    ok = (UNION_PARTS * high[i] >= LEAST_PARTS * low2[j]) & (UNION_PARTS * high2[j] >= LEAST_PARTS * low[i])
    at = np.flatnonzero(ok)
    i, j = i[at], j[at]
    need = -(-LEAST_PARTS * (low[i] + low2[j]) // (UNION_PARTS + LEAST_PARTS))
    x, y = bits[i], bits2[j]
    overlap = np.bitwise_count(x & y).sum(1, dtype=np.int64) + np.minimum(over[i], over2[j])
    if rows:
        overlap = np.minimum(overlap, (low[i] + low2[j] - np.bitwise_count(x ^ y).sum(1, dtype=np.int64)) // 2)
    ok[at] = overlap >= need
    return ok


def walk(a: Tree, b: Tree) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of two trees (of one with itself: each pair once) that no bound rules out."""
    same = a is b
    top = max(len(a.levels), len(b.levels)) - 1
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        k, i, j = stack.pop()
        if len(i) > FRONTIER:
            half = len(i) // 2
            stack += [(k, i[half:], j[half:]), (k, i[:half], j[:half])]
            continue
        ok = possible(a.level(k), b.level(k), i, j, k == 0)
        if same and k == 0:
            ok &= i != j  # a row isn't its own partner
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if k == 0:
            yield i, j
            continue
        width = LEAF if k == 1 else FANOUT
        grow_a = width if k < len(a.levels) else 1
        grow_b = width if k < len(b.levels) else 1
        ci = (i[:, None] * grow_a + np.arange(grow_a))[:, :, None] + np.zeros(grow_b, np.int64)
        cj = (j[:, None] * grow_b + np.arange(grow_b))[:, None, :] + np.zeros(grow_a, np.int64)[:, None]
        ci, cj = ci.reshape(-1), cj.reshape(-1)
        inside = (ci < len(a.level(k - 1)[1])) & (cj < len(b.level(k - 1)[1]))
        if same:
            inside &= ci <= cj
        stack.append((k - 1, ci[inside], cj[inside]))


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps OR-ed down to a smaller power of two of words."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def candidates(n: np.ndarray, bits: list[bytes], side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs that may be similar. Rows of sides 0 and 1 meet only across; 2 is one block.

    Similar sizes differ by less than a factor of two, so bitmaps meet at their own size or at the next.
    """
    size = np.array([len(b) // 8 for b in bits])
    trees: dict = {}

    def tree(words: int, fold: int, of: int) -> tuple[Tree, np.ndarray] | None:
        key = (words, fold, of)
        if key not in trees:
            at = np.flatnonzero((size == words) & (side == of))
            at = at[np.argsort(n[at], kind="stable")]
            rows = np.frombuffer(b"".join(bits[k] for k in at), np.uint64).reshape(len(at), words) if len(at) else None
            trees[key] = None if rows is None else (Tree(folded(rows, fold), n[at]), at)
        return trees[key]

    for words in np.unique(size).tolist():
        for x, y in [((words, words, 2), (words, words, 2)), ((words, words, 2), (2 * words, words, 2)), ((words, words, 0), (words, words, 1)), ((words, words, 0), (2 * words, words, 1)), ((words, words, 1), (2 * words, words, 0))]:
            a, b = tree(*x), tree(*y)
            if a and b:
                for i, j in walk(a[0], b[0]):
                    yield a[1][i], b[1][j]


def connect(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after the rows of pairs (i, j) are joined: each set's label is its smallest."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        parent = np.arange(len(label))
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]


def clustered(n: np.ndarray, bits: list[bytes], side: np.ndarray) -> np.ndarray:
    """Labels of rows connected by pairs that may be similar."""
    label = np.arange(len(n))
    for i, j in candidates(n, bits, side):
        label = connect(label, i, j)
    return label


def exactly_linked(n: np.ndarray, bits: list[bytes], side: np.ndarray, sets: list[np.ndarray], known: np.ndarray) -> np.ndarray:
    """Labels of rows connected by similar pairs or equal known numbers; a pair that is connected already needs no verification."""
    _, first, of = np.unique(known, return_index=True, return_inverse=True)
    label = first[of]
    words, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(n)
    marked = np.zeros(len(words), bool)
    for left, right in candidates(n, bits, side):
        order = np.argsort(left, kind="stable")
        left, right = left[order], right[order]
        at = np.flatnonzero(np.append(True, left[1:] != left[:-1]))
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(left)], strict=True):
            i = left[a]
            j = np.unique(right[a:b][label[right[a:b]] != label[i]])
            if not len(j):
                continue
            own = inverse[ends[i] - n[i] : ends[i]]
            marked[own] = True
            sizes = n[j]
            cut = np.cumsum(sizes) - sizes
            common = np.add.reduceat(marked[inverse[np.repeat(ends[j] - sizes - cut, sizes) + np.arange(sizes.sum())]], cut, dtype=np.int64)
            marked[own] = False
            similar = j[UNION_PARTS * common >= LEAST_PARTS * (n[i] + sizes - common)]
            if len(similar):
                label = connect(label, np.full(len(similar), i), similar)
    return label


LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def tree_join(rows: DataFrame, keys: list[str], exact: bool) -> DataFrame:
    """(a, b) links that connect what belongs together among the rows of equal keys, at most one a row.

    rows: keys, node, n, bits; if exact also hashes and known (rows of one such number are connected already); if there,
    side (rows of sides 0 and 1 meet only across). Rows stream in by key, so a task holds one group.
    """
    sided = "side" in rows.columns

    def joined(group: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        columns = list(zip(*group, strict=True))
        node, n = (np.array(columns[k], np.int64) for k in (0, 1))
        side = np.array(columns[-1], np.int64) if sided else np.full(len(n), 2)
        if exact:
            known = np.array(columns[4], np.int64)
            label = exactly_linked(n, columns[2], side, [np.frombuffer(h, np.int64) for h in columns[3]], known)
            _, first, of = np.unique(known, return_index=True, return_inverse=True)
            at = np.flatnonzero(label != first[of])
        else:
            label = clustered(n, columns[2], side)
            at = np.flatnonzero(label != np.arange(len(label)))
        return node[at], node[label[at]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: dict[tuple, None] = {}  # equal rows of a repeated document are one
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and row[: len(keys)] != at:
                    out.append(joined(list(group)))
                    group = {}
                at = row[: len(keys)]
                group[row[len(keys) :]] = None
            yield _links(out)
        if group:
            yield _links([joined(list(group))])

    def _links(found: list) -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=LINKS.names)

    columns = [*keys, "node", "n", "bits", *(["hashes", "known"] if exact else []), *(["side"] if sided else [])]
    return rows.select(*columns).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, LINKS)


def hinted(df: DataFrame, bytes_a_row: int) -> DataFrame:
    """df, to be broadcast while it is small."""
    return F.broadcast(df) if df.count() * bytes_a_row <= BROADCAST_BYTES else df


#: Sets of similar sizes are in the same class or in neighbouring ones.
SIZE_CLASS = f"cast(floor(ln(n) / ln({UNION_PARTS / LEAST_PARTS})) AS int)"


def dealt(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """rows (key, node, n, ...) with their block: all rows of a small key in one, else its size classes cut by a hash of the node.

    Columns added: class (-1 in a small key), block, blocks (how many its class has).
    """
    rows = rows.withColumn("class", F.expr(SIZE_CLASS))
    sizes = rows.groupBy("key", "class").agg(F.count("*").alias("rows"), F.sum(8 * F.col("n")).alias("bytes"))
    whole = sizes.groupBy("key").agg((F.sum("rows") <= most).alias("few"), (F.sum("bytes") <= BLOCK_BYTES).alias("light"))
    count = F.greatest(F.ceil(F.col("rows") / most), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    sizes = written(sizes.join(whole, "key").select("key", F.col("class").alias("__of"), (F.col("few") & F.col("light")).alias("small"), count.alias("blocks")), "sizes")
    large = hinted(sizes.where("NOT small").select(F.col("key").alias("__key"), "__of", "blocks"), 48)
    joined = rows.join(large, (F.col("key") == F.col("__key")) & (F.col("class") == F.col("__of")), "left").drop("__key", "__of")
    joined = joined.withColumn("class", F.when(F.col("blocks").isNull(), -1).otherwise(F.col("class"))).withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return joined.withColumn("block", F.pmod(F.xxhash64("node", F.lit(seed)), F.col("blocks").cast("long")).cast("int"))


def cluster_links(clusters: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) links that connect each cluster's similar sets. clusters: node, key; sets: node, n, bits, hashes."""
    block = ["key", "class", "block"]
    rows = written(clusters.join(sets, "node"), "clusters")
    ready = dealt(rows, BLOCK_ROWS, 0).withColumn("known", F.col("node"))
    small = written(tree_join(ready.where("class < 0"), block, True), "similar")
    rest = written(ready.where("class >= 0"), "large")
    if rest.isEmpty():
        removed(rows, rest)
        return small
    links = written(tree_join(rest, block, True), "similar")
    rest = rest.select("key", "node", "n", "bits", "hashes")
    # Large clusters: one row of every component so far, again and again while they get fewer.
    count, seed = rest.count(), 0
    while True:
        now = rest.join(components(links), "node", "left").withColumn("known", F.coalesce("component", "node")).drop("component")
        first = written(now.where("known = node"), "first")
        if first.groupBy("key").count().where("count > 1").isEmpty():
            return small.unionByName(links)
        fewer, seed = first.count(), seed + 1
        if 2 * fewer > count:
            break
        count = fewer
        links = written(links.unionByName(tree_join(dealt(first, BLOCK_ROWS, seed), block, True)), "similar")
        removed(first)
    # What isn't in a cluster's largest component meets all rows of the cluster.
    now = now_at = written(now, "labelled")
    parts = now.groupBy("key", "known").agg(F.count("*").alias("rows"))
    main = parts.groupBy("key").agg(F.max_by("known", F.struct("rows", "known")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("key", "main")
    now = now.join(hinted(main, 48), "key")
    strays = dealt(now.where("known <> main"), CROSS_ROWS, seed + 1).withColumn("class", F.expr(SIZE_CLASS))
    everyone = dealt(now, CROSS_ROWS, seed + 2).withColumn("class", F.expr(SIZE_CLASS))
    # Blocks of both sides by class; each row goes to the other side's blocks of its own and neighbouring classes.
    strays, everyone = written(strays, "strays"), written(everyone, "everyone")
    blocks_of = lambda df: df.groupBy("key", "class").agg(F.max("block").alias("last")).select("key", F.explode(F.sequence(F.col("class") - 1, F.col("class") + 1)).alias("class"), F.col("class").alias("their"), "last")

    def sent(df: DataFrame, others: DataFrame, side: int) -> DataFrame:
        own, theirs = ("i_class", "i"), ("j_class", "j")
        if side:
            own, theirs = theirs, own
        pairs = df.join(hinted(blocks_of(others), 48), ["key", "class"]).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("last"))))
        return pairs.select("key", F.col("class").alias(own[0]), F.col("block").alias(own[1]), F.col("their").alias(theirs[0]), F.col("__other").alias(theirs[1]), "node", "n", "bits", "hashes", "known", F.lit(side).alias("side"))

    met = sent(strays, everyone, 0).unionByName(sent(everyone, strays, 1))
    more = written(tree_join(met, ["key", "i_class", "i", "j_class", "j"], True), "similar")
    removed(rows, now_at, strays, everyone)
    return small.unionByName(links).unionByName(more)


def similar_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text)."""
    unnamed = F.col("doc_id").isNull()
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit("unnamed"), "text")).alias("doc_id"), "text", unnamed.alias("unnamed"))
    with scratch() as made:
        first, sets, labels = labelled(docs)
        labels = written(labels, "components")
        for df in (first, sets, labels):
            made.remove(df)
    members = first.where("block IS NULL").select("doc_id", "unnamed", "n_shingles", "f1", "f2")
    named = sets.join(labels, "node", "left").select("f1", "f2", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    out = members.join(named, ["f1", "f2", "n_shingles"], "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    if members.where("unnamed").isEmpty():
        return out.select("doc_id", "n_shingles", "component_id")
    # A component's name is the smallest doc_id proper in it.
    names = out.where("NOT unnamed").groupBy("component_id").agg(F.min("doc_id").alias("name"))
    return out.join(names, "component_id", "left").select(F.when(~F.col("unnamed"), F.col("doc_id")).alias("doc_id"), "n_shingles", F.col("name").alias("component_id"))


def labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of the members with the tasks' histograms, of the different sets, and of the nodes that link, with components."""
    first = written(fingerprints(docs), "members")
    members = first.where("block IS NULL").select("doc_id", "unnamed", "n_shingles", "f1", "f2")
    histogram = summed(first.where("block IS NOT NULL").select("block", "counts"))
    sets = members.where("n_shingles > 0").groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("node"))
    sets = written(sets, "sets")
    nodes = sets.select("node").distinct()

    firsts = prefixes(by_node(docs, nodes), histogram)
    if members.join(nodes, F.col("doc_id") == F.col("node"), "left_semi").count() > nodes.count():
        firsts = firsts.distinct()  # a node of several rows
    firsts = written(firsts, "firsts")
    # Counted before the shuffle as far as possible, so that no shingle is one task's work.
    counts = firsts.groupBy("token").agg(F.count("*").alias("cnt"), F.expr("bit_xor(xxhash64(node))").alias("x1"), F.expr("bit_xor(xxhash64(node, 1))").alias("x2")).where("cnt > 1")
    tokens = written(counts.groupBy("x1", "x2", "cnt").agg(F.min("token").alias("token")).select("token", "cnt"), "tokens")
    kept = written(firsts.join(hinted(tokens, 32), "token"), "kept")
    removed(firsts, tokens)
    signed = written(signatures(by_node(docs, kept.where(F.col("cnt") <= BLOCK_ROWS).select("node").distinct())), "signatures")

    together = kept.where(F.col("cnt") > BLOCK_ROWS)
    together = together.join(hinted(together.groupBy("token").agg(F.min("node").alias("b")), 32), "token").select(F.col("node").alias("a"), "b").where("a <> b")
    rows = kept.where(F.col("cnt") <= BLOCK_ROWS).join(signed.select("node", "n", "bits"), "node").withColumnRenamed("token", "key")
    near = written(tree_join(rows, ["key"], False).unionByName(together), "near")
    removed(kept, signed)
    clusters = components(near).withColumnRenamed("component", "key")
    links = cluster_links(clusters, signatures(by_node(docs, clusters.select("node")), True))

    # Rows of one doc_id are one document: its sets are linked to each other.
    twice = sets_by_id(members, sets)
    return first, sets, components(links if twice is None else links.unionByName(twice))


def sets_by_id(members: DataFrame, sets: DataFrame) -> DataFrame | None:
    """Links between the sets of doc_ids that have several; None if there is no such id."""
    several = members.where("n_shingles > 0").groupBy("doc_id").agg(F.min(F.struct("f1", "f2")).alias("low"), F.max(F.struct("f1", "f2")).alias("high")).where("low <> high").select("doc_id")
    several = written(several, "several")
    if several.isEmpty():
        return None
    nodes = members.join(several, "doc_id", "left_semi").join(sets, ["f1", "f2", "n_shingles"])
    return nodes.select(F.col("doc_id").alias("a"), F.col("node").alias("b"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with the document of the smallest doc_id of each component (and all without shingles or id)."""
    found = written(similar_components(docs), "components")
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(hinted(gone, 32), docs.doc_id == F.col("__gone"), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_SETS = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[k:k + 4], ' ') END AS sh
 FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS k FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id)"""
ORACLE_SQL = f"""{_SETS.replace("WITH d", "WITH RECURSIVE d")},
f AS (SELECT sh FROM s GROUP BY sh HAVING count(*) > 1),
o AS (SELECT s.doc_id AS a, t.doc_id AS b, count(*) AS c FROM (SELECT * FROM s SEMI JOIN f USING (sh)) s JOIN s t ON s.sh = t.sh AND s.doc_id < t.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) m ON m.id = d.doc_id"""
