"""Token counts of a unigram tokenizer, without its tokens.

An Aho-Corasick automaton finds every piece of the vocabulary in a text; dynamic programming
over its places keeps the best score and the number of pieces of it. Of equal scores the
piece that began earliest wins, as in the tokenizers; the automaton gives longer matches
first, so that a later one must be strictly better.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketflow.llm import words

#: The mark of a blank, and what an unknown character scores below the worst piece.
BLANK, UNKNOWN = "▁", 10.0
#: Words whose counts a worker keeps.
CACHED = 400_000


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece file, without control, unknown and byte pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        (model.id_to_piece(i), model.get_score(i))
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]


class Counter:
    """Best score and number of tokens of texts; an unknown character counts as its UTF-8 bytes."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN
        self.known: dict[str, tuple[int, float]] = {}
        # no piece but a run of blanks has a blank after its first place: words are apart
        self.apart = not any(BLANK in p.lstrip(BLANK) or (p.lstrip(BLANK) and p.startswith(BLANK * 2)) for p, _ in pieces)
        self.line = not any("\n" in p for p, _ in pieces)

    def viterbi(self, text: str) -> tuple[int, float]:
        """Tokens and score of a text whose blanks are marks."""
        size = len(text)
        best, count = [-float("inf")] * (size + 1), [0] * (size + 1)
        best[0] = 0.0
        unknown = self.unknown
        found = self.automaton.iter(text)
        end, hit = next(found, (size, None))
        for i in range(size):
            alone = True
            while end == i:
                n, score = hit
                if n == 1:
                    alone = False
                total = best[i + 1 - n] + score
                if total > best[i + 1]:
                    best[i + 1], count[i + 1] = total, count[i + 1 - n] + 1
                end, hit = next(found, (size, None))
            if alone:
                total = best[i] + unknown
                if total > best[i + 1]:
                    best[i + 1], count[i + 1] = total, count[i] + len(text[i].encode("utf-8", "replace"))
        return count[size], best[size]

    def _word(self, word: str) -> tuple[int, float]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= CACHED:
                self.known.clear()
            found = self.known[word] = self.viterbi(word)
        return found

    def count(self, text: str) -> tuple[int, float]:
        """Tokens and score of a text; an empty one has none."""
        if not text:
            return 0, 0.0
        text = BLANK + text.replace(" ", BLANK)
        if not self.apart:
            return self.viterbi(text)
        tokens, score = 0, 0.0
        for line, mark in _lines(text) if self.line else [(text, "")]:
            if mark:
                tokens += 1
                score += self.unknown
            # every run of blanks begins a word
            parts = line.split(BLANK)
            if "" in parts[1:-1] or parts[-1] == "" and len(parts) > 1:
                parts = re.findall(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+", line)
            else:
                parts = [p for p in parts[:1] if p] + [BLANK + p for p in parts[1:]]
            for part in parts:
                n, s = self._word(part)
                tokens += n
                score += s
        return tokens, score


def _lines(text: str) -> Iterator[tuple[str, str]]:
    for i, line in enumerate(text.split("\n")):
        yield line, "\n" if i else ""


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter for each Python worker."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(vocabulary(path))
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """Per row of docs: doc_id, n_chars, n_tokens, score. Null text counts as empty, with no tokens.

    Whole texts are counted; repeated rows each; only doc_id and text are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in words.slices(whole):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                found = [counter(path).count(t) for t in texts]
                columns = [
                    batch.column("doc_id"),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array(np.array([n for n, _ in found], np.int64)),
                    pa.array(np.array([s for _, s in found], np.float64)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "n_tokens", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_chars long, n_tokens long, score double")
