"""Packing token sequences: length patterns, fitted to the histogram of lengths.

Patterns are small multisets of lengths that fill a sequence exactly. How often each is
used is the non-negative least squares fit of the patterns to the histogram, rounded down;
lengths that no pattern takes are packed by best fit, longest first. All of this sees
the histogram only, which has at most as many entries as a sequence has tokens. The plan is
then dealt out to the pieces by their rank among those of one length.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ticketflow.llm import tables, words

#: Production parameters: tokens of a sequence, id that ends a document.
LENGTH, END_ID = 4096, 1
#: Documents of a pattern; patterns tried; steps of the fit.
FEW, PATTERNS, STEPS = 6, 30_000, 300
#: Whitespace-separated words whose ids a worker keeps.
CACHED = 400_000
SEED = 42


# Token ids


class Encoder:
    """Token ids of texts, as little-endian 32-bit words, by way of their words.

    The tokenizer drops white space and no token spans it, so ids of a text are those of its words in a row.
    `tests/llm` compares both ways.
    """

    #: What Python's split() takes for white space and the tokenizer does not.
    ODD = "\x1c\x1d\x1e\x1f"

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ids: dict[str, bytes] = {}
        self.again: set[str] = set()

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _encode_letters(self, stems: list[str]) -> list[bytes]:
        """Ids of words of Latin letters, as one text: each is one word to the tokenizer, too."""
        found = self.tokenizer.encode(" ".join(stems), add_special_tokens=False)
        ids, words_ = np.array(found.ids, "<u4").tobytes(), np.array(found.word_ids, np.int64)
        ends = (4 * (np.flatnonzero(np.diff(words_)) + 1)).tolist() + [len(ids)]
        if len(ends) != len(stems):
            return self._encode(stems)
        return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def learn(self, new: set[str]) -> None:
        """Ids of words that are not known; a run of marks after letters is a token sequence of its own."""
        known, split, others = self.ids, [], []
        for word in new:
            stem = word.rstrip(punctuation)
            if stem.isalpha() and max(stem) < "\u0250" and (low := stem.lower()).isalpha():
                split.append((word, low, word[len(stem) :]))
            else:
                others.append(word)
        letters = {low for _, low, _ in split}.difference(known)
        # to the model, plain letters are their own bytes
        model = self.tokenizer.model
        plain = [w for w in letters if w.isascii()]
        known.update([(w, array("I", [t.id for t in model.tokenize(w)]).tobytes()) for w in plain])
        letters = [w for w in letters if not w.isascii()]
        for i in range(0, len(letters), 10_000):
            part = letters[i : i + 10_000]
            known.update(zip(part, self._encode_letters(part)))
        others += {marks for _, _, marks in split}.difference(known)
        known.update(zip(others, self._encode(others)))
        known.update([(word, known[low] + known[marks]) for word, low, marks in split if marks or word != low])

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [None if self._whole(t) else t.split() for t in texts]
        out, i = [], 0
        while i < len(split):
            # as many texts as the kept words suffice for
            new, j = set(), i
            while j < len(split) and (j == i or len(new) < CACHED // 4):
                if split[j] is not None:
                    new.update(split[j])
                j += 1
            missing = new.difference(self.ids)
            self.again |= new - missing
            if len(self.ids) + 2 * len(missing) > CACHED:
                self._forget()
                missing = new.difference(self.ids)
            if missing:
                self.learn(missing)
            find = self.ids.__getitem__
            for text, parts in zip(texts[i:j], split[i:j]):
                out.append(self._encode([text])[0] if parts is None else b"".join(map(find, parts)))
            i = j
        return out

    def _forget(self) -> None:
        """Keep the words that came again since the last time, unless they are too many themselves."""
        kept = self.again if len(self.again) < CACHED // 2 else set()
        self.ids = {w: self.ids[w] for w in kept}
        self.again = set()

    def _whole(self, text: str) -> bool:
        return any(c in text for c in self.ODD) or any(s in text for s in self.special)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Per piece: id, piece, start, length, crc. Only documents of more than `length` tokens are cut."""
    end = np.array([end_id], "<u4").tobytes()
    schema = "id long, piece int, start long, length long, crc long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in words.slices(whole):
                found = encoder(path).encode([t or "" for t in batch.column("text").to_pylist()])
                rows = [
                    (id_, n, n * length, len(part) // 4, zlib.crc32(part))
                    for id_, ids in zip(batch.column("id").to_pylist(), found)
                    for n, part in enumerate(_cut(ids + end, 4 * length))
                ]
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "crc"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(run, schema)


def _cut(ids: bytes, size: int) -> list[bytes]:
    return [ids[i : i + size] for i in range(0, len(ids), size)]


# The plan

#: Lengths of a sequence with how often each occurs, longest first.
Pattern = tuple[tuple[int, int], ...]


def enumerate_patterns(histogram: np.ndarray, length: int, few: int = FEW, most: int = PATTERNS) -> list[Pattern]:
    """Patterns of up to `few` lengths that add up to `length`, all from the histogram.

    Every length begins its share of them; the others but the last are drawn as the histogram has
    them, and the last is what is missing.
    """
    rng = np.random.default_rng(SEED)
    present = np.flatnonzero(histogram)
    if not len(present):
        return []
    mass = np.cumsum(histogram)
    found: dict[Pattern, None] = {}
    share = max(1, most // len(present))
    for first in present[::-1].tolist():
        for u in rng.random((share, few - 2)):
            chosen, left = [first], length - first
            for x in u.tolist():
                if not left or histogram[left]:
                    break
                upto = mass[left]
                if not upto:
                    break
                chosen.append(int(np.searchsorted(mass, x * upto, "right")))
                left -= chosen[-1]
            if left and histogram[left]:
                chosen.append(left)
                left = 0
            if not left:
                found[tuple(sorted(Counter(chosen).items(), reverse=True))] = None
    return list(found)


def fit_counts(patterns: list[Pattern], histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram|^2, by accelerated projected gradient."""
    row = np.array([n for p in patterns for n, _ in p])
    times = np.array([float(k) for p in patterns for _, k in p])
    col = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    size = len(histogram)

    def forward(x):
        return np.bincount(row, times * x[col], size)

    def back(r):
        return np.bincount(col, times * r[row], len(patterns))

    bound = np.ones(len(patterns))
    for _ in range(20):  # the largest eigenvalue of A'A
        bound = back(forward(bound))
        norm = np.linalg.norm(bound)
        bound /= norm
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(forward(y) - histogram) / (1.05 * norm))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def best_fit(histogram: np.ndarray, length: int) -> list[tuple[Pattern, int]]:
    """Best fit, longest first, over counts: sequences that hold the same are one entry."""
    open_: dict[int, Counter] = {}
    spaces: list[int] = []  # of open_, ascending
    done: list[tuple[Pattern, int]] = []

    def put(space: int, held: Pattern, n: int) -> None:
        if space not in open_:
            spaces.insert(bisect_left(spaces, space), space)
            open_[space] = Counter()
        open_[space][held] += n

    for size in np.flatnonzero(histogram)[::-1].tolist():
        left = int(histogram[size])
        while left:
            at = bisect_left(spaces, size)
            if at == len(spaces):
                each = length // size
                if left >= each:
                    put(length - each * size, ((size, each),), left // each)
                if left % each:
                    put(length - left % each * size, ((size, left % each),), 1)
                break
            space = spaces[at]
            group = open_[space]
            held, n = next(iter(group.items()))
            each = min(space // size, left)
            taken = min(n, left // each)
            if taken == n:
                del group[held]
            else:
                group[held] -= taken
            if not group:
                del open_[space]
                spaces.pop(at)
            put(space - each * size, (*held, (size, each)), taken)
            left -= taken * each
    for group in open_.values():
        done.extend(group.items())
    return done


def plan(histogram: np.ndarray, length: int = LENGTH) -> list[tuple[Pattern, int]]:
    """(pattern, repeats) that hold every length as often as the histogram has it (index: length)."""
    left = histogram.astype(np.int64).copy()
    patterns = enumerate_patterns(left, length)
    used: list[tuple[Pattern, int]] = []
    if patterns:
        fitted = fit_counts(patterns, left.astype(float))
        for i in np.argsort(-fitted, kind="stable").tolist():
            n = min([int(fitted[i] + 1e-6), *(left[size] // k for size, k in patterns[i])])
            if n:
                used.append((patterns[i], int(n)))
                for size, k in patterns[i]:
                    left[size] -= n * k
    return used + best_fit(left, length)


class Places:
    """Where the n-th piece of a length goes, from the plan."""

    SHIFT = 2**40

    def __init__(self, used: list[tuple[Pattern, int]]):
        sequence, taken, rows = 0, Counter(), []
        for pattern, n in used:
            offset = 0
            for size, k in pattern:
                rows.append((size * self.SHIFT + taken[size], sequence, k, offset))
                taken[size] += n * k
                offset += size * k
            sequence += n
        self.first, self.sequence, self.times, self.offset = np.array(sorted(rows), np.int64).reshape(-1, 4).T

    def of(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset."""
        at = np.searchsorted(self.first, size * self.SHIFT + rank, "right") - 1
        nth = size * self.SHIFT + rank - self.first[at]
        return self.sequence[at] + nth // self.times[at], self.offset[at] + nth % self.times[at] * size


def packed(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Per piece of docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone. Repeated rows are packed each; an empty table
    gives an empty result. The driver gets the histogram of lengths, at most `length` entries.
    """
    cut = tables.stored_runs(pieces(docs, path, length, end_id), "pieces")
    histogram = np.zeros(length + 1, np.int64)
    for size, n in cut.groupBy("length").agg(F.count(F.lit(1))).collect():
        histogram[size] = n
    places = Places(plan(histogram, length))
    ranked = tables.ranked(cut, "length", ["id", "piece", "crc"], "rank").select("id", "piece", "start", "length", "crc", "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = places.of(size, rank) if len(size) else (size, size)
            columns = [*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)
