from collections import defaultdict
from hashlib import sha256

import pytest
from hypothesis import given
from hypothesis import strategies as st

from ticketflow.llm import chat, queries
from ticketflow.llm.queries import BYTE_TOKENIZER

PARTS = ["\\", "### ", "###", "</turn>", "</turn>\n", ": ", "ok", "é漢", "\n", "<", " "]


@given(st.lists(st.sampled_from(PARTS)).map("".join), st.sampled_from([chat.IN_TEXT, chat.IN_ROLE]))
def test_escapes_come_back(text, control):
    assert chat.unescape(chat.escape(text, control), control) == text


@given(st.lists(st.tuples(*[st.lists(st.sampled_from(PARTS)).map("".join)] * 2)))
def test_written_conversations_come_back(turns):
    open_, said, close = chat.MARKS
    written = "".join(open_ + chat.escape(r, chat.IN_ROLE) + said + chat.escape(t) + close for r, t in turns)
    assert chat.read_text(written) == turns


def test_long_texts_are_escaped_in_time():
    for text in ("\\" * 300_000 + "x", "\\" * 300_000, "### " * 100_000, "a" * 300_000):
        assert chat.unescape(chat.escape(text)) == text


ROWS = [
    (1, 1, "assistant", "two </turn>"), (1, 0, "user", "one ### "), (1, 2, "assistant", "\\"), (1, 2, "assistant", None), (1, 2, "assistant", "\\"),
    (2, None, None, "late"), (2, 5, "a: b", ""), (None, 0, "assistant", "no id"), (None, 1, "user", "<|endoftext|>"), (3, 0, "system", None),
    (4, 0, "assistant", "word é漢 " * 20_000),
]


def brute(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is None, turn or 0, role or "", sha256((text or "").encode()).hexdigest(), text or ""))
    out = set()
    for conv, turns in by.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for _, _, r, _, t in turns)
        loss = "".join(t for _, _, r, _, t in turns if r == "assistant")
        written = "".join(f"### {chat.escape(r, chat.IN_ROLE)}: {chat.escape(t)}</turn>\n" for _, _, r, _, t in turns)
        out.add((conv, len(turns), sha256(whole.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), len(written)))
    return out


@pytest.mark.parametrize("stored", [False, True])
def test_read_back(spark, stored, tmp_path):
    turns = spark.createDataFrame([(*r, "clash") for r in ROWS], "conv_id long, turn long, role string, text string, ids string").repartition(3)
    placed = chat.formatted(turns, BYTE_TOKENIZER)
    if stored:
        placed.write.parquet(str(tmp_path / "t"))
        placed = spark.read.parquet(str(tmp_path / "t")).repartition(4)
    got = chat.read_back(placed, BYTE_TOKENIZER, sorted_rows=not stored)
    assert {tuple(r) for r in got.collect()} == brute(ROWS)


def test_masks_and_places(spark):
    turns = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    by = defaultdict(list)
    for r in chat.formatted(turns, BYTE_TOKENIZER).collect():
        by[r.conv_id].append(r)
    base = len(chat.pieces(BYTE_TOKENIZER)) - 3
    for rows in by.values():
        rows.sort(key=lambda r: r.position)
        assert [r.position for r in rows] == list(range(len(rows)))
        assert [r.start for r in rows] == [sum(len(x.ids) for x in rows[:k]) for k in range(len(rows))]
        for r in rows:
            assert len(r.ids) == len(r.mask) and not any(m for i, m in zip(r.ids, r.mask) if i >= base)
            assert [i for i in r.ids if i >= base] == [base, base + 1, base + 2]


def test_empty_and_query(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.formatted(none, BYTE_TOKENIZER), BYTE_TOKENIZER, sorted_rows=True).count() == 0
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", queries.TRAP), (-7, 1, "assistant", queries.TRAP)]
    assert {tuple(r) for r in queries.op11_chat(spark, folder).collect()} == brute(rows)
