"""Periodic runs of words: stretches that repeat a group of words at least twice, each found once.

Every maximal run contains a Lyndon root: the longest Lyndon word that starts at some place of it, under the order of
the words or under the reverse one. Both Lyndon arrays come from the first phase of Baier's suffix sorter, which
groups suffixes by their longest Lyndon prefix; each (place, length) is extended to both sides by the longest common
extension, and what is long enough is a run. Extensions are looked up by hashes and then compared word by word.

A word that occurs once in a stretch is in no run of that stretch, so texts are first cut at such words, again and again
while that removes much; what is left is short for ordinary prose and whole where a text is periodic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketflow.llm import words

#: Words of a run at least, besides two periods.
LEAST = 12
BASE = words.BASE

PERIODIC = "id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def lyndon(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at every place; a proper prefix is the smaller word.

    Groups of suffixes with a common prefix are taken from the largest down. A group that is taken is done: its prefix is
    the longest Lyndon one. Every member points to the nearest place before it whose group is smaller; places that get
    l pointers share l more copies of the prefix, and those of one group move together into a new one just above it.
    """
    symbols = sorted(set(ranks))
    name = {r: g for g, r in enumerate(symbols)}
    group = [name[r] for r in ranks]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    length = [1] * len(symbols)
    below = list(range(-1, len(symbols) - 1))
    above = list(range(1, len(symbols) + 1))
    done = bytearray(len(ranks))
    before, found = [-1] * len(ranks), [0] * len(ranks)
    g = len(symbols) - 1
    while g >= 0:
        size, pointed = length[g], {}
        for i in members[g]:
            if group[i] != g:
                continue
            p = i - 1
            while p >= 0 and done[p]:
                p = before[p]
            done[i], before[i], found[i] = 1, p, size
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        members[g] = []
        for times in sorted(set(pointed.values()), reverse=True):
            moved: dict[int, int] = {}
            for p, n in pointed.items():
                if n == times:
                    old = group[p]
                    new = moved.get(old)
                    if new is None:
                        new = moved[old] = len(length)
                        length.append(length[old] + times * size)
                        members.append([])
                        below.append(old)
                        above.append(above[old])
                        below[above[old]] = new  # the group taken is above all others that can move
                        above[old] = new
                    group[p] = new
                    members[new].append(p)
        g = below[g]
    return found


def _reach(sums: np.ndarray, powers: np.ndarray, i: np.ndarray, q: np.ndarray, right: bool) -> np.ndarray:
    """Words that agree from i and i + q on to the right, or before them to the left."""
    n = len(sums) - 1
    low, high = np.zeros(len(i), np.int64), (n - i - q if right else i).astype(np.int64)
    while (low < high).any():
        half = (low + high + 1) // 2
        a = i if right else i - half
        same = (sums[a + half] - sums[a]) * powers[q] == sums[a + q + half] - sums[a + q]
        low, high = np.where(same, half, low), np.where(same, high, half - 1)
    return low


def _direct(w: np.ndarray, i: int, q: int) -> tuple[int, int]:
    differs = np.flatnonzero(w[:-q] != w[q:])
    return int(differs[differs < i].max(initial=-1)) + 1, int(differs[differs >= i].min(initial=len(w) - q)) + q


def runs(w: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of all runs of a sequence of numbers, by start, then period."""
    n = len(w)
    if n < least:
        return np.zeros((0, 3), np.int64)
    ranks = w.tolist()
    q = np.concatenate([lyndon(ranks), lyndon([-r for r in ranks])]).astype(np.int64)
    i = np.concatenate([np.arange(n), np.arange(n)])
    roots = np.unique(np.stack((i, q), 1)[2 * q <= n], axis=0)
    i, q = roots[:, 0], roots[:, 1]
    powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, BASE, np.uint64))))
    values = words.mix((w.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * powers[:n], dtype=np.uint64)))
    start, end = i - _reach(sums, powers, i, q, False), i + q + _reach(sums, powers, i, q, True)
    long = end - start >= np.maximum(least, 2 * q)
    roots, spans = roots[long], np.stack((start, end, q), 1)[long]
    found, kind = np.unique(spans, axis=0, return_inverse=True)
    right = np.array([bool((w[s : e - p] == w[s + p : e]).all()) for s, e, p in found.tolist()], bool)
    if not right.all():  # hashes that agree by chance: those roots are extended word by word
        anew = [(*_direct(w, a, p), p) for a, p in roots[~right[kind.ravel()]].tolist()]
        anew = [x for x in anew if x[1] - x[0] >= max(least, 2 * x[2])]
        found = np.unique(np.concatenate((found[right], np.array(anew, np.int64).reshape(-1, 3))), axis=0)
    found = np.stack((found[:, 0], found[:, 1] - found[:, 0], found[:, 2]), 1)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def stretches(number: np.ndarray, text: np.ndarray, least: int = LEAST) -> list[np.ndarray]:
    """The places of `number` (words, as numbers), in stretches of one text (by `text`) that hold all of its runs."""
    place, part = np.arange(len(number)), text
    while len(place):
        _, kind, count = np.unique(part * (int(number.max()) + 1) + number[place], return_inverse=True, return_counts=True)
        again = count[kind] > 1
        left, part = place[again], part[again]
        new = np.concatenate(([True], (np.diff(left) > 1) | (np.diff(part) > 0)))[: len(left)]
        part = np.cumsum(new) - 1
        enough = np.bincount(part)[part] >= least if len(left) else np.zeros(0, bool)
        left, part = left[enough], part[enough]
        much = len(left) < 0.9 * len(place)
        place = left
        if not much:
            break
    return np.split(place, np.flatnonzero(np.diff(part)) + 1) if len(place) else []


def numbered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words of texts as numbers, equal for equal words of the column, and the number of words of every text."""
    data, starts, ends, counts = words.spans(column)
    if not len(starts):
        return np.zeros(0, np.int64), counts
    solid = data[~words.SPACE[data]]
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(solid)])
    return pc.dictionary_encode(whole).indices.to_numpy().astype(np.int64), counts


def _found(column: pa.Array, least: int) -> list[list[np.ndarray]]:
    """Runs of every text, as arrays of rows (start, length, period)."""
    number, counts = numbered(column)
    text = np.repeat(np.arange(len(counts)), counts)
    first = np.concatenate(([0], np.cumsum(counts)))
    out: list[list[np.ndarray]] = [[] for _ in counts]
    for places in stretches(number, text, least):
        rows = runs(number[places], least)
        if len(rows):
            of = int(text[places[0]])
            rows[:, 0] += places[0] - first[of]
            out[of].append(rows)
    return out


def periodic(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Per row of docs(doc_id, text): id, its runs (start, length, period, in words; by start, then period), and the text
    without what repeats: words of a run after its first period are left out, the others are joined by one space.

    Words are what white space (space, tab to carriage return) separates, and differ if any byte does. Null text counts as
    empty: no runs, an empty text. Repeated rows are answered each. An empty table gives an empty result. Other
    columns are not read. A text is worked on whole, in memory of some tens of bytes per word that may repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in words.slices(whole):
                spans, texts = [], []
                for t, found in zip(batch.column("text").to_pylist(), _found(batch.column("text"), least)):
                    parts = (t or "").encode().split()
                    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
                    if len(rows):
                        change = np.zeros(len(parts) + 1, np.int64)
                        np.add.at(change, rows[:, 0] + rows[:, 2], 1)
                        np.add.at(change, rows[:, 0] + rows[:, 1], -1)
                        parts = [p for p, inside in zip(parts, np.cumsum(change).tolist()) if not inside]
                    spans.append(rows)
                    texts.append(b" ".join(parts).decode())
                flat = np.concatenate(spans) if spans else np.zeros((0, 3), np.int64)
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in spans]))).astype(np.int32))
                fields = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(offsets, fields), pa.array(texts, pa.string())], ["id", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(run, PERIODIC)
