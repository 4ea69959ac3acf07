"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

A slice of texts becomes one array of code-point classes. Where a piece begins depends on the classes
nearby and on whether an apostrophe opened a contraction; the latter is a four-state automaton, whose
per-character transition functions are composed by an associative scan. Pieces are cut out of the UTF-8
bytes, distinct ones merged once (side by side, a pair of each a round, and kept in a bounded cache), and every
token keeps its end offset.

Defined results: a null or empty text has no tokens and decodes to no bytes. Texts of any length are
encoded whole; a long piece is merged with a heap in n log n steps. Pieces are told apart by their bytes.
Rows are encoded one by one: repeated rows give equal results, an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from keyloom.llm import words as W
from keyloom.llm.arrowmap import buffers, with_arrow_columns

OTHER, LETTER, NUMBER, BLANK, SPACE = range(5)
# What may follow an apostrophe as a contraction.
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")
# White space in Unicode.
WHITE = (*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Distinct pieces whose tokens a Python worker keeps; beyond, the cache starts anew.
CACHED_PIECES = 100_000
#: Pieces of more bytes than this are merged with a heap.
LONG_PIECE = 48
NO_TOKEN = 1 << 40


@cache
def _classes() -> np.ndarray:
    """Class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[list(WHITE)] = BLANK
    out[0x20] = SPACE
    return out


# States before a character: in no run of others, in one, with one or two characters of a contraction to go.
FREE, RUN, ONE, TWO = range(4)


def _table(f: tuple[int, int, int, int]) -> int:
    return f[0] | f[1] << 2 | f[2] << 4 | f[3] << 6


_PLAIN = _table((FREE, FREE, FREE, ONE))  # letters, numbers, white space
_OTHER = _table((RUN, RUN, FREE, ONE))
_SHORT = _table((ONE, RUN, FREE, ONE))  # an apostrophe that would open a contraction of two characters
_LONG = _table((TWO, RUN, FREE, ONE))
_ALL = np.arange(256)
#: THEN[f, g] is the function that applies f, then g.
THEN = np.zeros((256, 256), np.uint8)
for _q in range(4):
    THEN |= ((_ALL[None, :] >> (2 * ((_ALL[:, None] >> (2 * _q)) & 3)) & 3) << (2 * _q)).astype(np.uint8)


def scan(functions: np.ndarray, width: int = 64) -> np.ndarray:
    """Inclusive composition of transition functions: blocks side by side, then the blocks' totals."""
    n = len(functions)
    if n <= width:
        out = functions.copy()
        for i in range(1, n):
            out[i] = THEN[out[i - 1], out[i]]
        return out
    rows = -(-n // width)
    block = np.full(rows * width, _table((0, 1, 2, 3)), np.uint8)
    block[:n] = functions
    block = np.ascontiguousarray(block.reshape(rows, width).T)
    for j in range(1, width):
        block[j] = THEN[block[j - 1], block[j]]
    before = np.append(np.uint8(_table((0, 1, 2, 3))), scan(block[-1], width)[:-1])
    return THEN[before[None, :], block].T.reshape(-1)[:n]


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions where pieces of the public pattern begin, over all texts of a slice."""
    lead = np.flatnonzero(~W.INNER[data])
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    kind = _classes()[points]
    n = len(points)
    if not n:
        return lead
    cut = np.zeros(n + 1, bool)
    cut[np.searchsorted(lead, offsets)] = True  # a text begins here (or all end)
    begin, end = cut[:-1], cut[1:]
    white = kind >= BLANK
    before = np.roll(kind, 1)
    before[begin] = 255
    attached = before == SPACE  # a space right before something visible belongs to it

    functions = np.where(kind == OTHER, np.uint8(_OTHER), np.uint8(_PLAIN))
    quotes = np.flatnonzero((points == 0x27) & ~attached)
    if len(quotes):
        room = np.cumsum(begin)
        near = lambda k: np.where((quotes + k < n) & (room[np.minimum(quotes + k, n - 1)] == room[quotes]), points[np.minimum(quotes + k, n - 1)], 0)
        one, two = near(1), near(2)
        for tail in CONTRACTIONS:
            hit = one == ord(tail[0]) if len(tail) == 1 else (one == ord(tail[0])) & (two == ord(tail[1]))
            functions[quotes[hit]] = _SHORT if len(tail) == 1 else _LONG
    # A text begins FREE, and an attached visible character continues what its space began.
    functions[begin] = (functions[begin] & 3) * 0b01010101
    inside = (kind == OTHER) & attached
    functions[inside] = _table((RUN, RUN, RUN, RUN))
    state = scan(functions) & 3
    was = np.roll(state, 1)
    was[begin] = FREE
    opened = (was == ONE) | (was == TWO)
    ended = np.roll(opened & (was == ONE), 1) & ~begin  # the character before closed a contraction

    start = ~white & ~attached & ~opened & np.where(kind == OTHER, was != RUN, (kind != before) | ended)
    first, last = white & ~np.isin(before, (BLANK, SPACE)), white & ~np.append(white[1:], False)
    last |= white & end
    start |= first | (last & ~end)
    start |= begin
    return lead[start]


class Merger:
    """Token ids of pieces by merge ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.vocabulary = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            self.vocabulary[i] = token
        self.names = [str(i) for i in range(len(self.vocabulary))]
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        # Every pair of tokens that together are a token, sorted by a number for the pair, and that token.
        size = len(self.vocabulary)
        pairs = {self.ranks[a] * size + self.ranks[b]: i for token, i in self.ranks.items() for k in range(1, len(token)) if (a := token[:k]) in self.ranks and (b := token[k:]) in self.ranks}
        self.pairs, self.merged = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs))
        order = np.argsort(self.pairs)
        self.pairs, self.merged = self.pairs[order], self.merged[order]
        self.cache: dict[bytes, tuple[str, tuple[int, ...]]] = {}

    def tokens(self, pieces: list[bytes]) -> list[tuple[str, tuple[int, ...]]]:
        """Each piece's ids, also as text."""
        cache, names = self.cache, self.names
        if len(cache) >= CACHED_PIECES:
            cache.clear()
        found = [cache.get(p) for p in pieces]
        fresh = [k for k, f in enumerate(found) if f is None]
        short = []
        for k in fresh:
            own = self.ranks.get(pieces[k])
            if own is not None:
                found[k] = (names[own], (own,))
            elif len(pieces[k]) > LONG_PIECE:
                ids = self._merge_long(pieces[k])
                found[k] = (" ".join(map(names.__getitem__, ids)), tuple(ids))
            else:
                short.append(k)
        for k, ids in zip(short, self._merge([pieces[k] for k in short]), strict=True):
            found[k] = (" ".join(map(names.__getitem__, ids)), tuple(ids))
        for k in fresh:
            if len(pieces[k]) <= LONG_PIECE and len(cache) < CACHED_PIECES:
                cache[pieces[k]] = found[k]
        return found

    def _together(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that two tokens make, NO_TOKEN if none."""
        wanted = left * len(self.vocabulary) + right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.merged[at], NO_TOKEN)

    def _merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of many pieces at once: every round merges the leftmost pair of the lowest rank in each piece that has one."""
        out: list[list[int]] = [[]] * len(pieces)
        if not pieces or not len(self.pairs):
            return [self.bytes[list(p)].tolist() for p in pieces]
        sizes = np.array([len(p) for p in pieces])
        ids, owner = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)], np.repeat(np.arange(len(pieces)), sizes)
        rank = np.full(len(ids), NO_TOKEN)
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inside] = self._together(ids[inside], ids[inside + 1])
        while len(ids):
            heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sizes = np.diff(np.append(heads, len(ids)))
            lowest = np.minimum.reduceat(rank, heads)
            done = lowest == NO_TOKEN
            if done.any():
                flat, ends = ids[np.repeat(done, sizes)].tolist(), np.cumsum(sizes[done]).tolist()
                for k, a, b in zip(owner[heads[done]].tolist(), [0, *ends], ends, strict=False):
                    out[k] = flat[a:b]
                stay = np.repeat(~done, sizes)
                ids, owner, rank = ids[stay], owner[stay], rank[stay]
                sizes, lowest = sizes[~done], lowest[~done]
            at = np.flatnonzero(rank == np.repeat(lowest, sizes))
            at = at[np.append(True, owner[at][1:] != owner[at][:-1])] if len(at) else at
            ids[at] = rank[at]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            place = np.cumsum(stay) - 1
            ids, owner, rank, at = ids[stay], owner[stay], rank[stay], place[at]
            rank[at] = NO_TOKEN
            for left in (at[(at + 1 < len(ids))], at[at > 0] - 1):
                left = left[owner[left] == owner[left + 1]]
                rank[left] = self._together(ids[left], ids[left + 1])
        return out

    def _merge_long(self, piece: bytes) -> list[int]:
        ranks, n = self.ranks, len(piece)
        after, before, stop = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, to = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or stop[j] != to:
                continue
            alive[j], stop[i], after[i] = False, to, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(piece[i : stop[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, stop[after[i]]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:to])) is not None:
                heapq.heappush(heap, (r, h, to))
        return [ranks[piece[i : stop[i]]] for i in range(n) if alive[i]]


@cache
def merger(path: str) -> Merger:
    return Merger(path)


def encode(texts: pa.Array, path: str) -> tuple[list[np.ndarray], list[str], list[np.ndarray]]:
    """For each text its ids, the ids as text, and each token's end as a byte offset into the text."""
    data, offsets = buffers(texts)
    bpe = merger(path)
    starts = piece_starts(data, offsets)
    ends = np.append(starts[1:], len(data))
    index, inverse = W.distinct_spans(data, starts, ends)
    raw = data.tobytes()
    found = bpe.tokens([raw[a:b] for a, b in zip(starts[index].tolist(), ends[index].tolist(), strict=True)])
    spelt, sizes = [f[0] for f in found], np.fromiter((len(f[1]) for f in found), np.int64, len(found))
    flat = np.fromiter((i for f in found for i in f[1]), np.int64, int(sizes.sum()))
    at = np.cumsum(sizes) - sizes
    bounds = W.per_text(starts, offsets)
    each = sizes[inverse]
    total = np.concatenate([[0], np.cumsum(each)])
    ids = flat[np.repeat(at[inverse] - total[:-1], each) + np.arange(total[-1])]
    lengths = _lengths(path)[ids]
    stops = np.cumsum(lengths)
    names = np.array(spelt, object)[inverse] if len(spelt) else np.zeros(0, object)
    out: tuple[list, list, list] = ([], [], [])
    for k in range(len(texts)):
        a, b = total[bounds[k]], total[bounds[k + 1]]
        out[0].append(ids[a:b])
        out[1].append(" ".join(names[bounds[k] : bounds[k + 1]]))
        out[2].append(stops[a:b] - offsets[k])
    return out


@cache
def _lengths(path: str) -> np.ndarray:
    return np.array([len(t) for t in merger(path).vocabulary], np.int64)


def decode(ids, path: str) -> bytes:
    """The bytes that the ids stand for."""
    return b"".join(map(merger(path).vocabulary.__getitem__, ids.tolist() if hasattr(ids, "tolist") else ids))


ADDED = T.StructType([T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("token_ends", T.ArrayType(T.LongType())), T.StructField("n_tokens", T.LongType()), T.StructField("decoded_sha256", T.StringType())])
DIGESTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)).cast(kind))


def byte_bpe(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df (or its columns in keep) with token_ids, token_ends (byte offsets into the text), n_tokens and
    decoded_sha256, the digest of the bytes that the ids decode to.

    path is a vocabulary of base64 tokens and ranks that every executor can open. An input column named
    like an output is replaced.
    """

    def kernel(texts: pa.Array) -> list:
        ids, _, stops = encode(texts, path)
        return [_lists(ids, pa.int32()), _lists(stops, pa.int64()), pa.array([len(i) for i in ids], pa.int64()), pa.array([hashlib.sha256(decode(i, path)).hexdigest() for i in ids], pa.string())]

    return with_arrow_columns(df, text, ADDED, kernel, keep)


def byte_bpe_digests(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """As byte_bpe, with digests of the ids and of the bytes decoded from them instead of the lists."""

    def kernel(texts: pa.Array) -> list:
        ids, spelt, _ = encode(texts, path)
        hexed = lambda b: hashlib.sha256(b).hexdigest()
        return [pa.array([len(i) for i in ids], pa.int64()), pa.array([hexed(s.encode()) for s in spelt], pa.string()), pa.array([hexed(decode(i, path)) for i in ids], pa.string())]

    return with_arrow_columns(df, text, DIGESTS, kernel, keep)


def vocabulary() -> str:
    """Default vocabulary: the public 50k byte-level ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe_digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), vocabulary(), keep=["doc_id"])
