"""An interpolated modified Kneser-Ney bigram model, counted in Spark and read by memory map.

Words and bigrams are counted in tasks, sent as compressed sorted arrays, one for each shard, and
merged there. A shard is a file of sorted word hashes (or of sorted bigram keys) with
counts beside it, in the shared folder. The place of a word in the sorted hashes is its number, and a bigram's
key is the numbers of its two words, so bigrams are in the order of their first words; shards of bigrams
are cut by the tokens that the first words have, so that a frequent word spans several.
Workers map the files and look words and bigrams up by binary search, for many texts at a time.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketflow.llm import tables, words
from ticketflow.llm.quality import remainder
from ticketflow.session import shared_folder

#: Shards of words, and of bigrams, at least; a power of two.
SHARDS = 64
#: Distinct keys that a task holds before it sends them.
HELD = 4_000_000
#: Hash of the token that ends a text: no word has it, since a word has at least one byte.
END = np.uint64(0x454E44)
#: Largest number of words that a key has room for.
MOST_WORDS = 2**32 - 2


def mounted(path: str) -> str:
    """A folder as workers open it. The model is mapped, so it must be on a mounted file system."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"{path} can't be mapped into memory: name a mounted folder as `folder`")
    return url.path


# Sorted arrays with counts


def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and counts, compressed: the bytes of equal weight of the gaps between keys together."""
    gaps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    planes = [x.view(np.uint8).reshape(len(keys), -1).T.tobytes() for x in (gaps, counts.astype("<u8"))]
    return zstandard.ZstdCompressor(level=1).compress(len(keys).to_bytes(8, "little") + b"".join(planes))


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(raw, np.uint8, offset=8)
    gaps = np.ascontiguousarray(planes[: 8 * n].reshape(8, n).T).view("<u8").ravel()
    counts = np.ascontiguousarray(planes[8 * n :].reshape(8, n).T).view("<u8").ravel()
    return np.cumsum(gaps, dtype=np.uint64), counts.astype(np.int64)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    keys = np.concatenate([k for k, _ in parts]) if parts else np.zeros(0, np.uint64)
    counts = np.concatenate([c for _, c in parts]) if parts else np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def counted(keys_of: Callable[[pa.Array], np.ndarray], shard_of: Callable[[np.ndarray], np.ndarray]):
    """A task that counts keys_of its texts and sends (shard, data) rows."""

    def send(parts) -> Iterator[pa.RecordBatch]:
        keys, counts = summed(parts)
        shards = shard_of(keys)
        cuts = np.flatnonzero(np.diff(shards)) + 1
        ranges = list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)])) if len(keys) else []
        for a, b in ranges:
            data = packed(keys[a:b], counts[a:b])
            yield pa.RecordBatch.from_arrays([pa.array([shards[a]], pa.int32()), pa.array([data], pa.binary())], ["shard", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for whole in batches:
            for batch in words.slices(whole):
                keys, n = np.unique(keys_of(batch.column("text")), return_counts=True)
                parts.append((keys, n))
                held += len(keys)
                if held > HELD:
                    parts = [summed(parts)]
                    held = len(parts[0][0])
                    if held > HELD // 2:
                        yield from send(parts)
                        parts, held = [], 0
        yield from send(parts)

    return run


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each text ended by END; and the place of each end."""
    data, starts, ends, counts = words.spans(column)
    last = np.cumsum(counts + 1) - 1
    out = np.full(len(starts) + len(counts), END, np.uint64)
    inner = np.ones(len(out), bool)
    inner[last] = False
    out[inner] = words.hashes(data, starts, ends)
    return out, last


# The model


@dataclass
class Model:
    """Where the files are, and the figures that all of them share."""

    folder: str
    shards: int
    sizes: list[int]
    begun: list[int] = field(default_factory=list)  # number of the first word of each shard
    words: int = 0
    tokens: int = 0
    texts: int = 0
    pairs: list[int] = field(default_factory=list)  # bigrams of each shard
    cuts: list[int] = field(default_factory=list)  # first key of each shard of bigrams
    discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    lower: tuple[float, float, float] = (0.0, 0.0, 0.0)
    rest: float = 1.0  # of the words' distribution, what the uniform one gets
    distinct: int = 0

    def file(self, kind: str, shard: int) -> str:
        return f"{self.folder}/{kind}-{shard:05d}"

    def array(self, kind: str, shard: int, n: int, dtype) -> np.ndarray:
        if not n:
            return np.zeros(0, dtype)
        key = (self.folder, kind, shard)
        if key not in _MAPPED:
            _MAPPED[key] = np.memmap(self.file(kind, shard), dtype, "r", shape=(n,))
        return _MAPPED[key]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each of sorted distinct hashes, -1 if it is not known."""
        out = np.full(len(hashes), -1, np.int64)
        bits = np.uint64(64 - self.shards.bit_length() + 1)
        for shard, a, b in _runs((hashes >> bits).astype(np.int64) if self.shards > 1 else np.zeros(len(hashes), np.int64)):
            known = self.array("hash", shard, self.sizes[shard], np.uint64)
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes[a:b]), len(known) - 1)
                out[a:b] = np.where(known[at] == hashes[a:b], self.begun[shard] + at, -1)
        return out

    def of_words(self, kind: str, numbers: np.ndarray, dtype=np.int64) -> np.ndarray:
        """A figure for each of sorted word numbers, none of them -1; number `words` is the begin of a text."""
        out = np.zeros(len(numbers), dtype)
        last = len(self.sizes) - 1
        shards = np.minimum(np.searchsorted(np.array(self.begun), numbers, "right") - 1, last)
        for shard, a, b in _runs(shards):
            n = self.sizes[shard] + (shard == last)
            out[a:b] = self.array(kind, shard, n, dtype)[numbers[a:b] - self.begun[shard]]
        return out

    def counts_of(self, keys: np.ndarray) -> np.ndarray:
        """Count of each of sorted distinct bigram keys, 0 if it is not known."""
        out = np.zeros(len(keys), np.int64)
        shards = np.maximum(np.searchsorted(np.array(self.cuts, np.uint64), keys, "right") - 1, 0)
        for shard, a, b in _runs(shards):
            known = self.array("key", shard, self.pairs[shard], np.uint64)
            if len(known):
                at = np.minimum(np.searchsorted(known, keys[a:b]), len(known) - 1)
                wide = os.path.getsize(self.file("times", shard)) > 4 * self.pairs[shard]
                n = self.array("times", shard, self.pairs[shard], np.uint64 if wide else np.uint32)[at]
                out[a:b] = np.where(known[at] == keys[a:b], n, 0)
        return out

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text: tokens, known tokens, base score, score (log10)."""
        hashes, last = tokens(column)
        kinds, which = np.unique(hashes, return_inverse=True)
        number = self.numbers(kinds)
        known = np.flatnonzero(number >= 0)
        figures = {k: np.zeros(len(kinds), np.int64) for k in ("count", "before", "one", "two", "more")}
        for kind in figures:
            figures[kind][known] = self.of_words(kind, number[known])
        base = np.log10((figures["count"] + 1) / (self.tokens + self.words + 1))[which]
        distinct = max(1, self.distinct)
        own = np.maximum(figures["before"] - discount(figures["before"], self.lower), 0) / distinct
        p = (own + self.rest / (self.words + 1))[which]
        # the context of a token: its number, how often it stood, and what its discounts left
        first = np.concatenate(([0], last[:-1] + 1))
        total, left = figures["count"], np.zeros(len(kinds))
        for kind, d in zip(("one", "two", "more"), self.discounts):
            left += d * figures[kind]
        begin = np.array([self.words])
        begin_left = sum(d * self.of_words(k, begin)[0] for k, d in zip(("one", "two", "more"), self.discounts))
        word, context = number[which], np.roll(number[which], 1)
        stood, spare = np.roll(total[which], 1), np.roll(left[which], 1)
        context[first], stood[first], spare[first] = self.words, self.texts, begin_left
        both = (word >= 0) & (context >= 0)
        keys, of = np.unique((context[both].astype(np.uint64) << np.uint64(32)) | word[both].astype(np.uint64), return_inverse=True)
        times = np.zeros(len(word), np.int64)
        times[both] = self.counts_of(keys)[of]
        seen = (context >= 0) & (stood > 0)
        own = np.maximum(times - discount(times, self.discounts), 0)
        p = np.where(seen, (own + spare * p) / np.maximum(stood, 1), p)
        add = lambda x: np.add.reduceat(x, first) if len(first) else x[:0]
        return last - first + 1, add((word >= 0).astype(np.int64)), add(base), add(np.log10(p))


_MAPPED: dict[tuple, np.ndarray] = {}


def _runs(shards: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(shard, from, to) of ascending shards."""
    if len(shards):
        cuts = (np.flatnonzero(np.diff(shards)) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(shards)]):
            yield int(shards[a]), a, b


def discount(counts: np.ndarray, by: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *by])[np.minimum(counts, 3)]


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts from how many counts are 1, 2, 3, 4; where a class is empty, half of its count."""
    if not n1 or not n2:
        return (0.5, 1.0, 1.5)
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(found, 1))


def _write(path: str, array: np.ndarray) -> None:
    """Whole or not at all: a task that runs twice leaves one file."""
    mine = f"{path}.{os.getpid()}.{os.urandom(4).hex()}"
    array.tofile(mine)
    os.replace(mine, path)


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in 4 bytes each where all of them fit, else in 8."""
    return counts.astype(np.uint32 if counts.max(initial=0) < 2**32 else np.uint64)


def training(docs: DataFrame) -> DataFrame:
    """Texts whose crc32(doc_id as text) mod 7 is not 2; a row without id is one of them."""
    return docs.filter(F.coalesce(remainder(7), F.lit(0)) != 2).select("text")


def fit(train: DataFrame, folder: str | None = None, shards: int | None = None) -> Model:
    """The model of train(text), all of it; null texts count as empty. No text gives the uniform model.

    folder: where to keep the model, a mounted folder that all workers share; below
    spark.checkpoint.dir unless given. Refuses more than 2**32 - 2 distinct words.
    """
    spark = train.sparkSession
    folder = mounted(folder or f"{shared_folder(spark)}/model")
    os.makedirs(folder, exist_ok=True)
    shards = shards or max(SHARDS, 1 << (tables.shuffle_partitions(spark) - 1).bit_length())
    model = Model(folder, shards, [0] * shards)
    _fit_words(train, model)
    _fit_pairs(train, model)
    return model


def _fit_words(train: DataFrame, model: Model) -> None:
    bits = np.uint64(64 - model.shards.bit_length() + 1)

    def shard_of(keys: np.ndarray) -> np.ndarray:
        return (keys >> bits).astype(np.int64) if model.shards > 1 else np.zeros(len(keys), np.int64)

    def merge(key, table):
        shard = key[0].as_py()
        keys, counts = summed([unpacked(x.as_py()) for x in table.column("data")])
        _write(model.file("hash", shard), keys)
        _write(model.file("own", shard), counts)
        ends = int(counts[keys == END].sum())
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": [len(keys)], "total": [int(counts.sum())], "ends": [ends]})

    parts = train.mapInArrow(counted(lambda c: tokens(c)[0], shard_of), "shard int, data binary")
    found = parts.groupBy("shard").applyInArrow(merge, "shard int, n long, total long, ends long").collect()
    for r in found:
        model.sizes[r.shard] = r.n
    model.begun = np.concatenate(([0], np.cumsum(model.sizes)[:-1])).tolist()
    model.words, model.tokens, model.texts = (sum(r[k] for r in found) for k in ("n", "total", "ends"))
    if model.words > MOST_WORDS:
        raise ValueError(f"{model.words} distinct words; a bigram key has room for {MOST_WORDS}")
    # tokens of all words before each shard's first, for cutting the bigrams evenly
    totals = np.zeros(model.shards, np.int64)
    for r in found:
        totals[r.shard] = r.total
    before = np.cumsum(totals) - totals

    def extend(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for shard in batch.column("shard").to_pylist():
                n, last = model.sizes[shard], shard == model.shards - 1
                own = np.fromfile(model.file("own", shard), np.int64) if n else np.zeros(0, np.int64)
                count = np.concatenate((own, [model.texts])) if last else own
                _write(model.file("count", shard), count)
                _write(model.file("mass", shard), before[shard] + np.cumsum(count) - count)
            yield batch

    each = train.sparkSession.range(0, model.shards, 1, min(model.shards, 64)).select(F.col("id").cast("int").alias("shard"))
    each.mapInArrow(extend, "shard int").count()


def _fit_pairs(train: DataFrame, model: Model) -> None:
    mass = model.tokens + model.texts

    def keys_of(column: pa.Array) -> np.ndarray:
        hashes, last = tokens(column)
        kinds, which = np.unique(hashes, return_inverse=True)
        number = model.numbers(kinds)[which]
        context = np.roll(number, 1)
        context[np.concatenate(([0], last[:-1] + 1)) if len(last) else []] = model.words
        return (context.astype(np.uint64) << np.uint64(32)) | number.astype(np.uint64)

    def shard_of(keys: np.ndarray) -> np.ndarray:
        """By the tokens before the key's first word and the share of its own that come before the second."""
        if not len(keys):
            return np.zeros(0, np.int64)
        first = (keys >> np.uint64(32)).astype(np.int64)
        share = (keys & np.uint64(2**32 - 1)).astype(np.float64) / (model.words + 1)
        at = model.of_words("mass", first) + model.of_words("count", first) * share
        return np.minimum((at / max(1, mass) * model.shards).astype(np.int64), model.shards - 1)

    def merge(key, table):
        shard = key[0].as_py()
        keys, counts = summed([unpacked(x.as_py()) for x in table.column("data")])
        _write(model.file("key", shard), keys)
        _write(model.file("times", shard), narrow(counts))
        rows = [("shape", -1, packed(np.arange(6, dtype=np.uint64), np.array([len(keys), *((counts == k).sum() for k in (1, 2, 3, 4)), 0])))]
        rows.append(("cut", -1, int(keys[0]).to_bytes(8, "little")))
        second, before = np.unique(keys & np.uint64(2**32 - 1), return_counts=True)
        rows += _by_word("before", second, before)
        first = keys >> np.uint64(32)
        for kind, chosen in (("one", counts == 1), ("two", counts == 2), ("more", counts > 2)):
            rows += _by_word(kind, *np.unique(first[chosen], return_counts=True))
        kinds, of, data = zip(*rows)
        n = len(rows)
        return pa.table({"made": pa.array([shard] * n, pa.int32()), "kind": list(kinds), "shard": pa.array(of, pa.int32()), "data": pa.array(data, pa.binary())})

    begun = np.array(model.begun)

    def _by_word(kind: str, numbers: np.ndarray, counts: np.ndarray) -> list[tuple]:
        shards = np.minimum(np.searchsorted(begun, numbers.astype(np.int64), "right") - 1, model.shards - 1)
        return [(kind, s, packed(numbers[a:b], counts[a:b])) for s, a, b in _runs(shards)]

    parts = train.mapInArrow(counted(keys_of, shard_of), "shard int, data binary")
    made = parts.groupBy("shard").applyInArrow(merge, "made int, kind string, shard int, data binary")
    made = tables.stored(made, "bigrams")
    model.pairs, model.cuts = [0] * model.shards, [0] * model.shards
    shape, cut = np.zeros(5, np.int64), {}
    for r in made.filter("shard = -1").select("made", "kind", "data").collect():
        if r.kind == "cut":
            cut[r.made] = int.from_bytes(r.data, "little")
        else:
            figures = unpacked(bytes(r.data))[1]
            model.pairs[r.made] = int(figures[0])
            shape += figures[:5]
    following = 2**64 - 1
    for shard in reversed(range(model.shards)):  # an empty shard begins where the next one does
        following = model.cuts[shard] = cut.get(shard, following)
    model.discounts, model.distinct = discounts(*shape[1:].tolist()), int(shape[0])

    def dense(key, table):
        shard = key[0].as_py()
        n = model.sizes[shard] + (shard == model.shards - 1)
        out = np.zeros(5, np.int64)
        for kind in ("before", "one", "two", "more"):
            values = np.zeros(n, np.int64)
            chosen = [unpacked(d.as_py()) for k, d in zip(table.column("kind").to_pylist(), table.column("data")) if k == kind]
            numbers, counts = summed(chosen)
            values[numbers.astype(np.int64) - model.begun[shard]] = counts
            _write(model.file(kind, shard), values)
            if kind == "before":
                out = np.array([shard, *((values == k).sum() for k in (1, 2, 3, 4))])
                more = int((values > 2).sum())
        names = ["shard", "n1", "n2", "n3", "n4", "more"]
        return pa.table({k: pa.array([int(v)], pa.int64()) for k, v in zip(names, [*out, more])})

    # shards without words still have a row, so that their files are made
    empty = made.sparkSession.range(model.shards).select(
        F.lit("none").alias("kind"), F.col("id").cast("int").alias("shard"), F.lit(b"").alias("data")
    )
    by_word = made.filter("shard >= 0").select("kind", "shard", "data").unionByName(empty)
    found = by_word.groupBy("shard").applyInArrow(dense, "shard long, n1 long, n2 long, n3 long, n4 long, more long").collect()
    t1, t2, t3, t4, more = (sum(r[k] for r in found) for k in ("n1", "n2", "n3", "n4", "more"))
    model.lower = discounts(t1, t2, t3, t4)
    kept = model.lower[0] * t1 + model.lower[1] * t2 + model.lower[2] * more
    model.rest = kept / model.distinct if model.distinct else 1.0


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null text counts as empty: its one token is the end. A row without id is not held out. Repeated rows are scored each; an empty table
    gives an empty result. Columns other than doc_id and text are not read.
    """
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in words.slices(whole):
                n, known, base, score = model.score(batch.column("text"))
                total = np.full(len(n), model.tokens)
                columns = [batch.column("doc_id"), batch.column("held_out"), *map(pa.array, (n, known, total, base, score))]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    held = F.coalesce(remainder(7) == 2, F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held).mapInArrow(run, schema)
