"""Line-first cleaning: rules judge single lines, and a text that loses too much of itself is rejected.

Defined results: a null or empty text has no words and is rejected (base_failed). Rows are judged one by
one, so repeated rows and ties give equal results and an empty table gives an empty one. Words and lines are
compared by their bytes. Texts of any length are judged whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm import words as W
from keyloom.llm.arrowmap import buffers, with_arrow_columns

# Phrases of site furniture, matched in lower-cased lines.
BOILERPLATE = ("all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use cookies", "accept cookies", "enable javascript", "click here", "read more", "sign up", "log in", "subscribe to", "share this", "follow us", "lorem ipsum")
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)).encode())


@dataclass(frozen=True)
class Rules:
    """Production thresholds of the line rules and of the verdict."""

    #: A navigation line: at least this share of its words are lone separators such as |.
    separators: float = 0.25
    #: A punctuation failure: at least this share of a line's visible characters are symbols or '!'.
    symbols: float = 0.12
    #: A stammer: at least this share of a line's words repeat the word before, over min_words words or more.
    stammer: float = 0.4
    min_words: int = 8
    #: A line without closing punctuation fails if it has fewer words than this.
    heading: int = 3
    #: A boilerplate phrase fails lines up to this many words.
    boilerplate_words: int = 30
    #: The share of a text's visible characters that must remain.
    least_kept: float = 0.5


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LOUD = _SYMBOL.copy()
_LOUD[ord("!")] = True
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[list(b"|<>/*-")] = True
_CLOSING = np.zeros(256, bool)
_CLOSING[list(b".!?:;\"')]}")] = True
_CLOSING[0x80:] = True

ADDED = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "kept_chars")] + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("cleaned", T.StringType())])


def _repeat_words(kinds: np.ndarray, owner: np.ndarray, bounds: np.ndarray, size: int = 5) -> np.ndarray:
    """Words inside a window of `size` words that its text has twice or more; kinds number the words exactly."""
    cover = np.zeros(len(kinds) + 1, np.int64)
    n = len(kinds) - size + 1
    if n > 0:
        at = np.flatnonzero(owner[:n] == owner[size - 1 :])
        order, same = W.grouped(owner[at], *[kinds[at + k] for k in range(size)])
        again = same.copy()
        again[:-1] |= same[1:]
        hit = at[order[again]]
        cover[hit] += 1
        cover[hit + size] -= 1
    return W.counts(np.cumsum(cover)[:-1] > 0, bounds)


def judge(texts: pa.Array, rules: Rules) -> list:
    """The added columns of a slice of texts, in ADDED's order."""
    data, offsets = buffers(texts)
    seen = ~W.SPACE[data]
    starts, ends, bounds = W.tables_of_words(data, offsets)
    owner, kinds = W.owners(bounds), W.distinct_spans(data, starts, ends)[1]
    n_words = np.diff(bounds)
    chars = seen & ~W.INNER[data]
    word_chars = W.counts(chars, offsets)

    # Lines: between the texts' ends and their line feeds.
    feeds = np.flatnonzero(data == 10)
    texts_at, feeds_in = np.arange(len(texts)), np.searchsorted(offsets, feeds, "right") - 1
    heads, tails = np.concatenate([offsets[:-1], feeds + 1]), np.concatenate([feeds, offsets[1:]])
    line_owner = np.concatenate([texts_at, feeds_in])
    order = np.lexsort((heads, line_owner))
    at, line_owner, to = heads[order], line_owner[order], tails[np.lexsort((tails, np.concatenate([feeds_in, texts_at])))]
    words_in = np.searchsorted(starts, to) - np.searchsorted(starts, at)
    total = lambda flags: (c := np.concatenate([[0], np.cumsum(flags)]))[to] - c[at]
    filled = np.flatnonzero(words_in > 0)
    order, same = W.grouped(line_owner[filled], W.distinct_spans(data, at[filled], to[filled])[1])
    twice = np.zeros(len(at), bool)
    twice[filled[order[same]]] = True
    per_line = np.searchsorted(line_owner, np.arange(len(texts) + 1))
    n_dup = W.counts(twice, per_line)

    repeat = _repeat_words(kinds, owner, bounds)
    base_failed = (n_words < 10) | (100 * repeat > 20 * n_words)

    visible = total(chars)
    lone = (ends - starts == 1) & _SEPARATOR[data[starts]]
    by_word = lambda flags: (c := np.concatenate([[0], np.cumsum(flags)]))[np.searchsorted(starts, to)] - c[np.searchsorted(starts, at)]
    echo = np.zeros(len(kinds), bool)
    echo[1:] = (kinds[1:] == kinds[:-1]) & (owner[1:] == owner[:-1])
    last = np.searchsorted(starts, to) - 1
    closed = np.zeros(len(at), bool)
    closed[filled] = _CLOSING[data[ends[last[filled]] - 1]]
    share = lambda a, b: a / np.maximum(b, 1)
    bad = twice | (share(by_word(lone), words_in) >= rules.separators) | (share(total(_LOUD[data]), visible) >= rules.symbols)
    bad |= (words_in >= rules.min_words) & (share(by_word(echo), words_in) >= rules.stammer)
    bad |= ~closed & (words_in < rules.heading)
    low = W.LOWER[data].tobytes()
    for m in _BOILERPLATE.finditer(low):
        k = int(np.searchsorted(at, m.start(), "right")) - 1
        bad[k] |= bool(words_in[k] <= rules.boilerplate_words)
    bad &= words_in > 0
    kept_chars = np.add.reduceat(np.append(np.where(bad, 0, visible), 0), per_line[:-1]) if len(texts) else np.zeros(0, np.int64)
    kept = ~base_failed & (kept_chars >= rules.least_kept * word_chars)

    raw, cleaned = data.tobytes(), []
    dirty = W.counts(bad, per_line) > 0
    for i in range(len(texts)):
        span = range(per_line[i], per_line[i + 1])
        part = b"\n".join(raw[at[k] : to[k]] for k in span if not bad[k]) if dirty[i] else raw[offsets[i] : offsets[i + 1]]
        cleaned.append(part.decode())
    return [pa.array(x) for x in (n_words, word_chars, W.counts(_SYMBOL[data], offsets), n_dup, repeat, kept_chars, base_failed, kept)] + [pa.array(cleaned, pa.string())]


def quality_rules(df: DataFrame, text: str = "text", rules: Rules = Rules(), keep: list[str] | None = None) -> DataFrame:
    """Every row of df (or its columns in keep) with the counts, the verdict and the cleaned text.

    n_words .. n_repeat_words and base_failed are the base statistics over the whole text; kept_chars are
    the visible characters of the lines that pass every rule; cleaned is the text without failed lines.
    An input column named like an output is replaced.
    """
    return with_arrow_columns(df, text, ADDED, lambda texts: judge(texts, rules), keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_chars")


def keep_good(docs: DataFrame) -> DataFrame:
    """docs without the documents that the rules reject; texts stay whole."""
    return quality_rules(docs).where(F.col("kept")).select(*docs.columns)
