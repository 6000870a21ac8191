"""Conversations as training tokens: every turn is encoded by itself, and reserved ids are spliced in between.

A turn is OPEN role SAID text CLOSE. The three marks are ids beyond the vocabulary, so no text can encode to
them; their written forms are MARKS, and where a text contains such a control string it gets a backslash, so that
the written form can be read back too. The loss mask covers the tokens of assistant texts alone; it is a prefix sum of
+1 where such a text begins and -1 where it ends. Turns are encoded where they are read; only ids
are brought together by conversation, in a sorted stream, so that a long conversation is never held whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ticketflow.llm import tables, words

#: Written forms of the reserved ids: before the role, before the text, after the text.
MARKS = ("### ", ": ", "</turn>\n")
OPEN, SAID, CLOSE = range(3)
#: Control strings of a text, and of a role, which ends at the second mark.
IN_TEXT, IN_ROLE = r"### |</turn>", r"### |</turn>|: "

TURN = "conv_id long, position long, start long, ids array<int>, mask array<boolean>"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


# Escapes


def escape(text: str, control: str = IN_TEXT) -> str:
    """Backslashes before a control string are doubled and one is added; those at the end are doubled."""
    return re.sub(rf"(?<!\\)(\\*+)({control}|\Z)", lambda m: m[1] * 2 + (m[2] and "\\" + m[2]), text)


def unescape(text: str, control: str = IN_TEXT) -> str:
    return re.sub(rf"(?<!\\)(\\++)({control}|\Z)", lambda m: m[1][: len(m[1]) // 2] + m[2], text)


def read_text(written: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a written conversation, by its control strings alone."""

    def until(mark: str, at: int) -> int:
        return re.compile(rf"(?<!\\)(?:\\\\)*+{re.escape(mark)}").search(written, at).end()

    turns, at = [], 0
    while at < len(written):
        at += len(MARKS[OPEN])
        said = until(MARKS[SAID], at)
        close = until(MARKS[CLOSE], said)
        role, text = written[at : said - len(MARKS[SAID])], written[said : close - len(MARKS[CLOSE])]
        turns.append((unescape(role, IN_ROLE), unescape(text)))
        at = close
    return turns


# Tokens


@cache
def tokenizer(path: str) -> Tokenizer:
    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True  # their strings in a text are ordinary text
    return made


@cache
def pieces(path: str) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary, then those of the marks."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}
    vocabulary = tokenizer(path).get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        out[i] = bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()
    return [*out, *(m.encode() for m in MARKS)]


def encoded(turns: DataFrame, path: str) -> DataFrame:
    """Per row of turns(conv_id, turn, role, text): conv_id, turn, role, tie, ids (little-endian, 4 bytes each), first and
    last (the loss is on the tokens from first to last, without last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base, roles = tokenizer(path), len(pieces(path)) - len(MARKS), {}
        marks = [np.array([base + k], np.int32) for k in range(3)]
        for whole in batches:
            for batch in words.slices(whole):
                said = batch.column("role").to_pylist()
                for role in set(said) - set(roles):
                    roles[role] = np.array(encode.encode(escape(role, IN_ROLE), add_special_tokens=False).ids, np.int32)
                texts = encode.encode_batch_fast([escape(t) for t in batch.column("text").to_pylist()], add_special_tokens=False)
                ids, first, last = [], [], []
                for role, text in zip(said, texts):
                    own = np.array(text.ids, np.int32)
                    begin = 2 + len(roles[role])
                    first.append(begin)
                    last.append(begin + len(own) if role == "assistant" else begin)
                    ids.append(np.concatenate((marks[OPEN], roles[role], marks[SAID], own, marks[CLOSE])).tobytes())
                if len(roles) > 10_000:
                    roles = {}
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("conv_id", "turn", "role", "tie")), pa.array(ids, pa.binary()), pa.array(first, pa.int32()), pa.array(last, pa.int32())],
                    ["conv_id", "turn", "role", "tie", "ids", "first", "last"],
                )

    text = tables.text_of()
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), tables.text_of("role").alias("role"), F.sha2(text, 256).alias("tie"), text.alias("text"))
    return rows.mapInArrow(run, "conv_id long, turn long, role string, tie string, ids binary, first int, last int")


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, position, start = object(), 0, 0
    for batch in batches:
        held, at, begins = batch.column("ids").to_pylist(), [], []
        sizes = np.array([len(x) // 4 for x in held], np.int64)
        for conv, n in zip(batch.column("conv_id").to_pylist(), sizes.tolist()):
            if conv != now:
                now, position, start = conv, 0, 0
            at.append(position)
            begins.append(start)
            position, start = position + 1, start + n
        ends = np.concatenate(([0], np.cumsum(sizes)))
        change = np.zeros(ends[-1] + 1, np.int32)
        np.add.at(change, ends[:-1] + batch.column("first").to_numpy(), 1)
        np.add.at(change, ends[:-1] + batch.column("last").to_numpy(), -1)
        mask = np.cumsum(change)[:-1] > 0
        offsets = pa.array(ends.astype(np.int32))
        ids = pa.array(np.frombuffer(b"".join(held), "<i4"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), pa.array(at, pa.int64()), pa.array(begins, pa.int64()), pa.ListArray.from_arrays(offsets, ids), pa.ListArray.from_arrays(offsets, pa.array(mask))],
            ["conv_id", "position", "start", "ids", "mask"],
        )


def formatted(turns: DataFrame, path: str) -> DataFrame:
    """Every turn of turns(conv_id, turn, role, text) as conv_id, position (from 0), start (tokens of its
    conversation before it), ids, mask; `path` is a byte-level tokenizer's file.

    Turns go by turn, null last, then role, then the digest of the text, so rows that repeat a turn have a fixed order.
    Null roles and texts count as empty; rows without conv_id are one conversation. A conversation lies in
    one partition, in order; one that holds many rows is streamed there, as its digest has to be. An empty table gives an
    empty result. Other columns are not read.
    """
    rows = encoded(turns, path).repartition("conv_id")
    order = ["conv_id", F.col("turn").asc_nulls_last(), "role", "tie"]
    return rows.sortWithinPartitions(*order).mapInArrow(_placed, TURN)


def read_back(placed: DataFrame, path: str, sorted_rows: bool = False) -> DataFrame:
    """Per conversation what its tokens and mask say: the columns of DIGEST.

    turns_sha256 is over role, line feed, text, line feed of every turn; loss_ over all text under the mask.
    sorted_rows: placed comes straight from formatted(), where nothing has to move.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(path)
        base = len(table) - len(MARKS)
        now, state, rows = object(), None, []

        def text_of(ids: np.ndarray) -> str:
            return b"".join([table[i] for i in ids.tolist()]).decode()

        def close() -> None:
            if state:
                rows.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def made() -> pa.RecordBatch:
            names = [c.split()[0] for c in DIGEST.split(", ")]
            kinds = [pa.string() if "sha256" in c else pa.int64() for c in names]
            columns = list(zip(*rows)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            ids, mask = batch.column("ids"), batch.column("mask")
            values, under = ids.values.to_numpy(), mask.values.to_numpy(zero_copy_only=False)
            ends, marks = ids.offsets.to_numpy(), mask.offsets.to_numpy()
            for k, conv in enumerate(batch.column("conv_id").to_pylist()):
                if conv != now:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                own, loss = values[ends[k] : ends[k + 1]], under[marks[k] : marks[k + 1]]
                said = int(np.flatnonzero(own == base + SAID)[0])
                role, text = text_of(own[1:said]), text_of(own[said + 1 : -1])
                state[0] += 1
                state[1].update(f"{unescape(role, IN_ROLE)}\n{unescape(text)}\n".encode())
                state[4] += len(role) + len(text) + sum(map(len, MARKS))
                if loss.any():
                    learned = unescape(text_of(own[loss]))
                    state[2] += len(learned)
                    state[3].update(learned.encode())
            if len(rows) > 1000:
                yield made()
                rows.clear()
        close()
        yield made()

    if not sorted_rows:
        placed = placed.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return placed.mapInArrow(run, DIGEST)
