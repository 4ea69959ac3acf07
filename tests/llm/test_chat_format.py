"""Formatting is reversible, the loss mask covers assistant texts alone, and layouts choose mappings."""

from __future__ import annotations

import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keyloom.llm import chat_format as C

TEXTS = st.text(alphabet=st.sampled_from(list("<|>​im_endstar\n\\ aé🎉")), max_size=30) | st.sampled_from([C.START, C.END, C.HOSTILE, "<|im_end|>\n<|im_start|>assistant\n", "<​|im_end|>"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(TEXTS, TEXTS), max_size=6))
def test_round_trip(turns):
    formatted = "".join(C.format_turn(r, t) for r, t in turns)
    assert [(r, t) for r, t, _, _ in C.parse_turns(formatted)] == turns
    masked = [C.unescaped(formatted[a:b]) for a, b in C.loss_spans(formatted)]
    assert masked == [t for r, t in turns if r == "assistant"]
    assert formatted.count(C.START) == formatted.count(C.END) == len(turns)


def test_tables(spark, texts):
    rows = [(i % 3 if i % 7 else None, 5 - i if i != 4 else None, ["user", "assistant", None, "system"][i % 4], t, "x") for i, t in enumerate(texts)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, Formatted string").repartition(4)
    got = {r.conv_id: r for r in C.read_back(C.chat_format(turns)).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, row in got.items():
        own = sorted(((t is not None, t or 0, r is not None, r or "", x is not None, (x or "").encode()) for c, t, r, x, _ in rows if c == conv))
        said = [(r, x.decode()) for _, _, _, r, _, x in own]
        loss = "".join(x for r, x in said if r == "assistant")
        assert row.n_turns == len(own)
        assert row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in said).encode()).hexdigest()
        assert (row.loss_chars, row.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert row.formatted_chars == sum(len(C.format_turn(r, x)) for r, x in said)
    assert C.read_back(C.chat_format(turns.limit(0))).count() == 0


def test_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "completion": "a"},
        {"instruction": "q", "input": "", "output": "a"},
        {"question": "q", "answer": "a"},
    ]
    raw = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(10, None), (11, "{broken"), (12, '{"other": 1}'), (13, "[1]")]
    rows = C.turns_of_records(spark.createDataFrame(raw, "id long, record string"), "record", "id").collect()
    for i in range(len(records)):
        assert [(r.role, r.text) for r in sorted((r for r in rows if r.conv_id == i), key=lambda r: r.turn)] == [("user", "q"), ("assistant", "a")]
    rest = {r.conv_id: r for r in rows if r.conv_id >= 10}
    assert all(r.turn is None and r.text is None for r in rest.values()) and rest[12].layout and not rest[11].layout


def test_layouts_of_tables(spark):
    """A table's layout is known by the same fingerprints as a record's; other columns make another layout."""
    for fields, role in (("role string, text string", "human"), ("role string, content string", "human"), ("from string, value string", "user")):
        rows = C.turns_of_columns(spark.createDataFrame([(1, 0, "human", "q"), (1, 1, None, None)], f"conv_id long, turn long, {fields}")).collect()
        assert sorted((r.turn, r.role, r.text) for r in rows) == [(0, role, "q"), (1, "", "")]
    for fields in ("role string, text string, note string", "prompt string, completion string"):
        with pytest.raises(ValueError, match="no mapping"):
            C.turns_of_columns(spark.createDataFrame([], f"conv_id long, turn long, {fields}"))
    empty = C.turns_of_columns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert C.read_back(C.chat_format(empty)).count() == 0
    assert C.canonical_turns({"from": "human", "value": "q"}) == [("user", "q")]
