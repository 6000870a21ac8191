"""Quality from compression: which dictionary, of good or of bad texts, suits a text better.

A text is cut into chunks, and all of them are compressed with either dictionary. The
difference of the two sizes, over their sum and over the text's own, goes through a logistic
curve fitted on rows that no dictionary was made from; that is the score. The curve also sees how far the
text shrinks at all: a text of one repeated word shrinks to so few bytes that their difference says nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketflow.llm import tables, words

#: Bounds of the fit: labelled rows of either label, and bytes of their texts on the driver, half of them for either label.
FIT_ROWS, FIT_BYTES = 2_000, 32_000_000
#: A longer text is an example by its first bytes, this part of its label's.
EXAMPLE = 16
#: Bytes of a dictionary and of a chunk; level of compression.
DICTIONARY_BYTES, CHUNK_BYTES, LEVEL = 65_536, 2_048, 3
#: Weight of the curve's squared slopes.
RIDGE = 0.1


def remainder(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def chunks(text: bytes) -> list[bytes]:
    return [text[i : i + CHUNK_BYTES] for i in range(0, len(text), CHUNK_BYTES)]


@dataclass
class Model:
    """Two dictionaries, as bytes, and the curve: score = 1 / (1 + exp(-(shift + slopes . x)))."""

    good: bytes
    bad: bytes
    shift: float = 0.0
    slopes: tuple[float, ...] = (0.0, 0.0, 0.0)

    def measure(self, texts: list[bytes]) -> np.ndarray:
        """Three figures of each text, 0 for an empty one: size with the bad dictionary less size with
        the good one, over both; the logarithm of the mean size over the text's own, 0 at most; the
        difference over twice the text's own size."""
        out = np.zeros((len(texts), 3))
        if not self.good or not self.bad:
            return out
        good, bad = (
            zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(d), write_content_size=False, write_dict_id=False)
            for d in (self.good, self.bad)
        )
        for i, text in enumerate(texts):
            if not text:
                continue
            a = b = 0
            for chunk in chunks(text):
                a += len(good.compress(chunk))
                b += len(bad.compress(chunk))
            own = 2 * len(text)
            out[i] = (b - a) / (a + b), min(0.0, math.log((a + b) / own)), (b - a) / own
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.shift + self.measure(texts) @ np.array(self.slopes), -500, 500)))


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    made = zstandard.ZstdCompressionDict(data)
    made.precompute_compress(level=LEVEL)
    return made


def _train(texts: list[bytes], size: int) -> bytes:
    samples = [c for t in texts for c in chunks(t)]
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few samples for entropy tables: their bytes alone
        return b"".join(samples)[-size:]


def _even(texts: list[bytes], size: int) -> list[bytes]:
    """The first texts of about `size` bytes together."""
    kept, total = [], 0
    for text in texts:
        if total >= size:
            break
        kept.append(text)
        total += len(text)
    return kept


def fit_texts(texts: list[bytes], labels: list[int], counts: tuple[int, int] | None = None) -> Model:
    """A model from texts and labels: every second text of a label is for the dictionaries,
    the others for the curve. One label alone gives a constant score. counts: of how many rows
    with label 0 and 1 the texts are a sample; if not given, they are all rows."""
    by = {k: [t for t, y in zip(texts, labels) if y == k and t] for k in (0, 1)}
    bad, good = counts or (len(labels) - sum(labels), sum(labels))
    prior = math.log((good + 1) / (bad + 1))
    first = {k: v[::2] for k, v in by.items()}
    second = {k: v[1::2] for k, v in by.items()}
    if not all(first.values()) or not all(second.values()):
        return Model(b"", b"", prior)
    size = min(sum(map(len, v)) for v in first.values())
    model = Model(*(_train(_even(first[k], size), DICTIONARY_BYTES) for k in (1, 0)))
    x = np.concatenate([model.measure(second[k]) for k in (0, 1)])
    y = np.repeat([0.0, 1.0], [len(second[0]), len(second[1])])
    # labels of the curve weigh as much as they do in all the rows, whatever the sample took of either
    weight = np.repeat([n / (bad + good) * len(y) / len(second[k]) for k, n in enumerate((bad, good))], [len(second[0]), len(second[1])])
    model.shift, model.slopes = _logistic(x, y, weight)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, tuple[float, ...]]:
    """Shift and slopes by Newton's method, on weighted rows and the columns of x in units of their spread, with a small ridge."""
    mean, unit = x.mean(axis=0), x.std(axis=0)
    unit[unit == 0] = 1.0
    design = np.column_stack([np.ones(len(x)), (x - mean) / unit])
    ridge = RIDGE * np.diag([0.0] + [1.0] * x.shape[1]) + 1e-9 * np.eye(x.shape[1] + 1)
    weights = np.zeros(design.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        slope = design.T @ (weight * (y - p)) - ridge @ weights
        curve = design.T @ (design * (weight * p * (1 - p))[:, None]) + ridge
        step = np.linalg.solve(curve, slope)
        weights += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    slopes = weights[1:] / unit
    return float(weights[0] - slopes @ mean), tuple(slopes.tolist())


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, size: int = FIT_BYTES) -> Model:
    """A model from a bounded sample of the labelled rows that are not held out.

    Of each label the `rows` ids with the smallest hashes, and of these, in that order, all whose examples fit in
    half of `size` bytes together; one that does not fit is passed over. An example is the text, or the first bytes
    of a long one. Both labels weigh as in all usable rows. A doc_id that is null, or has two labels, is no example;
    nor is a label other than 0 and 1, or a text of more than `size` bytes. Of rows that repeat an id, the one
    with the smallest text is taken.
    """
    known = labels.filter("quality in (0, 1) and doc_id is not null").filter(remainder(3) != 1)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
    known = known.filter("quality = other").select(F.col("doc_id").alias("id"), "quality", F.xxhash64("doc_id").alias("nth"))
    texts = docs.select(F.col("doc_id").alias("doc"), tables.text_of().alias("text")).filter(F.octet_length("text") <= size)
    known = tables.stored(known.join(texts.select("doc").distinct(), F.col("id") == F.col("doc"), "left_semi"), "usable")
    counts = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    ids = [known.filter(F.col("quality") == q).orderBy("nth", "id").limit(rows) for q in (0, 1)]
    some = F.broadcast(ids[0].unionByName(ids[1]))  # 2 * rows ids
    most = size // 2
    found = texts.join(some, F.col("doc") == F.col("id")).groupBy("quality", "nth", "id").agg(F.min("text").alias("text"))
    part = F.substring(F.encode("text", "utf-8"), 1, max(1, most // EXAMPLE)).alias("example")
    found = tables.stored(found.select("quality", "nth", "id", part), "examples")
    left, fits = {0: most, 1: most}, []
    for q, nth, id_, n in sorted(found.select("quality", "nth", "id", F.octet_length("example")).collect(), key=lambda r: r[1:3]):
        if n <= left[q]:
            left[q] -= n
            fits.append((id_,))
    if not fits:
        return fit_texts([], [])
    fits = found.sparkSession.createDataFrame(fits, found.select("id").schema)
    read = found.join(F.broadcast(fits), "id").orderBy("nth", "id").collect()
    return fit_texts([bytes(r.example) for r in read], [r.quality for r in read], (counts.get(0, 0), counts.get(1, 0)))


def _scored(df: DataFrame, model: Model) -> DataFrame:
    """df(id, text) to (id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in words.slices(whole):
                texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.score(texts))], ["id", "score"])

    return df.mapInArrow(run, "id long, score double")


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of docs: id, score. Null text counts as empty; only doc_id and text are read."""
    return _scored(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), model)


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs that score `least` or more, in all their columns, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in words.slices(whole):
                texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
                yield batch.filter(pa.array(model.score(texts) >= least))

    return docs.mapInArrow(run, docs.schema)
