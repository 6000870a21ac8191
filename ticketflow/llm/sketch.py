"""Bottom-k sketches of the word shingles of texts.

A sketch is the k smallest hashes of the distinct shingles, ascending. Sketches
merge: the k smallest of the union are the sketch of the joined parts. The share of
the k smallest of a union that both have estimates resemblance; the k-th value, how
many distinct shingles there are.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import sha256
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketflow.llm import tables, words

#: Production parameters: words of a shingle, hashes kept.
SHINGLE, KEPT = 5, 64


def _shingles(hashes: np.ndarray, shingle: int) -> np.ndarray:
    """Hashes of the shingles of a text from those of its words; fewer words are one shingle."""
    width = min(shingle, len(hashes))
    if not width:
        return hashes
    n = len(hashes) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = words.mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n])
    return out


def sketches(texts: list[str], shingle: int = SHINGLE, kept: int = KEPT) -> list[np.ndarray]:
    """The sketch of every text; that of a text without words is empty."""
    data, starts, ends, counts = words.spans(pa.array(texts, pa.large_string()))
    hashes = words.hashes(data, starts, ends)
    out, first = [], 0
    for n in counts.tolist():
        found = _shingles(hashes[first : first + n], shingle)
        if len(found) > 8 * kept:  # the smallest, with some to spare for repeats
            found = _smallest(found, kept)
        out.append(np.unique(found)[:kept])
        first += n
    return out


def _smallest(found: np.ndarray, kept: int) -> np.ndarray:
    n = 4 * kept
    while n < len(found):
        part = np.partition(found, n)[:n]
        if len(np.unique(part)) > kept:
            return part
        n *= 4
    return found


def merge(a: np.ndarray, b: np.ndarray, kept: int = KEPT) -> np.ndarray:
    """The sketch of two parts together."""
    return np.union1d(a, b)[:kept]


def distinct(sketch: np.ndarray, kept: int = KEPT) -> float:
    """How many distinct shingles: exact below k of them."""
    if len(sketch) < kept:
        return float(len(sketch))
    return (kept - 1) / (float(sketch[kept - 1]) / 2.0**64)


def resemblance(a: np.ndarray, b: np.ndarray, kept: int = KEPT) -> float:
    """Estimated share of common shingles, 0 to 1; 1 if neither has any."""
    union = merge(a, b, kept)
    if not len(union):
        return 1.0
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).mean())


def containment(a: np.ndarray, b: np.ndarray, kept: int = KEPT) -> float:
    """Estimated share of a's shingles that b has, 0 to 1; 1 if a has none."""
    if not len(a):
        return 1.0
    common = resemblance(a, b, kept) * distinct(merge(a, b, kept), kept)
    return min(1.0, common / distinct(a, kept))


def to_text(sketch: np.ndarray) -> str:
    """16 hex digits for every hash."""
    return sketch.astype(">u8").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


# Each document beside the next one

#: Keys that are sampled for each part, to place its bounds: they decide how even the parts are, not the result.
SAMPLED = 20
KEY = "n boolean, i long, h long, r int"


def _bounds(keys: DataFrame, parts: int, total: int) -> list:
    """Up to parts - 1 keys that cut `total` keys evenly, ascending; the driver gets about SAMPLED keys a part."""
    share = min(1.0, SAMPLED * parts / max(total, 1))
    found = sorted(tuple(r.key) for r in keys.sample(share, seed=1).collect())
    return [found[i * len(found) // parts] for i in range(1, parts)] if found else []


def _part(key: Column, bounds: list) -> Column:
    """How many of the bounds lie at or below the key: found among every step-th, then among the step that follow."""
    if not bounds:
        return F.lit(0)
    step = isqrt(len(bounds)) + 1

    def listed(these: list) -> Column:
        rows = [dict(zip("nihr", b)) for b in these]
        return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{KEY}>>")

    coarse = F.size(F.filter(listed(bounds[step - 1 :: step]), lambda b: b <= key)) if len(bounds) >= step else F.lit(0)
    fine = F.filter(F.slice(listed(bounds), coarse * step + 1, step), lambda b: b <= key)
    return coarse * step + F.size(fine)


def beside_next(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (part, tail, id, text), each part in descending order of id, ended by the row after its last.

    Rows of one id stand in the order of a hash of their texts. The last row, marked as tail, is a copy of the first row of the next part; after the last part comes the
    first. Texts are dealt out once, a part to a task. An id that fills a part by itself is cut into several by that hash, and a text that still does by the
    input partition that holds the row, which is the same when a lost task runs again.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), tables.text_of().alias("text"))
    rows = rows.select("id", "text", F.xxhash64("text").alias("h"), F.spark_partition_id().alias("run"))
    last, place = F.col("id").isNull().alias("n"), F.coalesce(F.bitwise_not("id"), F.lit(0)).alias("i")
    by_id = F.struct(last, place, F.lit(0).cast("long").alias("h"), F.lit(0).alias("r"))
    total = docs.count()
    key, bounds = by_id, _bounds(rows.select(by_id.alias("key")), parts, total)
    if len(set(bounds)) < len(bounds) and total > SAMPLED * parts:  # an id of more than a part
        key = F.struct(last, place, F.col("h").alias("h"), F.col("run").alias("r"))
        bounds = _bounds(rows.select(key.alias("key")), parts, total)
    dealt = rows.withColumn("key", key).withColumn("part", _part(F.col("key"), sorted(set(bounds))))
    # one row per part: as many as the shuffle has partitions
    firsts = dealt.groupBy("part").agg(F.min("key").alias("key")).orderBy("part").collect()
    order = [r.part for r in firsts]
    heads = [(r.part, order[i - 1], r.key) for i, r in enumerate(firsts)]
    heads = docs.sparkSession.createDataFrame(heads, f"part int, to int, first struct<{KEY}>")
    dealt = dealt.join(F.broadcast(heads), "part", "left")
    here = F.struct(F.col("part"), F.lit(False).alias("tail"))
    copy = F.struct(F.col("to").alias("part"), F.lit(True).alias("tail"))
    copies = F.when(F.col("key") == F.col("first"), F.array(here, copy)).otherwise(F.array(here))
    return (
        dealt.withColumn("copy", F.explode(copies))
        .select("copy.part", "copy.tail", "id", "text", "h")
        .repartitionById(parts, "part")
        .sortWithinPartitions("part", "tail", F.desc_nulls_last("id"), "h", "text")
        .drop("h")
    )


def compared(docs: DataFrame, shingle: int = SHINGLE, kept: int = KEPT, parts: int | None = None) -> DataFrame:
    """Per row of docs: its sketch, that of its edited text, and their likeness.

    The edited text has the last third of its code points replaced by as many from the start of the next
    document, in descending doc_id; null text is empty, a null id comes last, rows of one
    id stand in the order of a hash of their texts, and after the last row comes the first. One row is
    its own next. Columns other than doc_id and text are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row that waits for the next one
        for whole in batches:
            for batch in words.slices(whole):
                rows = list(zip(*(batch.column(c).to_pylist() for c in ("part", "tail", "id", "text"))))
                rows = [last, *rows] if last else rows
                done = [(a, b) for a, b in zip(rows, rows[1:]) if a[0] == b[0] and not a[1]]
                last = rows[-1]
                if done:
                    yield _row_batch(done, shingle, kept)

    dealt = beside_next(docs, parts or tables.shuffle_partitions(docs.sparkSession))
    return dealt.mapInArrow(run, SCHEMA)


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, contained_edited double, distinct_shingles double"
)


def _row_batch(done: list, shingle: int, kept: int) -> pa.RecordBatch:
    own, next_ = [a[3] for a, _ in done], [b[3] for _, b in done]
    edited = [t[: len(t) - len(t) // 3] + n[: len(t) // 3] for t, n in zip(own, next_)]
    # rows follow each other: the next sketch is the next row's own, but for the last
    mine = sketches([*own, next_[-1]], shingle, kept)
    after = mine[1:]
    for i, (a, b) in enumerate(zip(next_, [*own[1:], next_[-1]])):
        if a is not b:
            after[i] = sketches([a], shingle, kept)[0]
    changed = sketches(edited, shingle, kept)
    mine = mine[:-1]
    columns = [
        pa.array([a[2] for a, _ in done], pa.int64()),
        pa.array([len(t) for t in own], pa.int64()),
        pa.array([sha256(t.encode()).hexdigest() for t in edited]),
        pa.array([to_text(s) for s in mine]),
        pa.array([to_text(s) for s in changed]),
        pa.array([resemblance(a, b, kept) for a, b in zip(mine, changed)], pa.float64()),
        pa.array([resemblance(a, b, kept) for a, b in zip(mine, after)], pa.float64()),
        pa.array([containment(a, b, kept) for a, b in zip(mine, changed)], pa.float64()),
        pa.array([distinct(s, kept) for s in mine], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])
