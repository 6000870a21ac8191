"""SimHash near-duplicates: pairs by vantage-point trees, groups by connected components.

Distinct fingerprints are dealt to the leaves of a tree whose inner nodes ask for
the Hamming distance to a vantage fingerprint. A fingerprint lives in one leaf, and
is sent as a query to each later leaf that can hold a fingerprint within the
radius: by the triangle inequality those whose side of every threshold is met
within the radius. A leaf searches its own part by more such nodes, and returns
links that span the groups it found instead of all pairs. Where the shared tree would have more
leaves than its sample can cut, its leaves are dealt again, each by a tree of its own sample, until they are small.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketflow.llm import tables, words

#: Production parameters: words of a shingle, differing bits of a link.
SHINGLE, RADIUS = 3, 2
#: Fingerprints wanted in a leaf, the largest sample that the shared tree is grown from,
#: and how many of a leaf are compared directly.
LEAF, SAMPLE, DIRECT = 8_192, 16_384, 256
#: Into how many leaves one that is too large is dealt at most, and how many times LEAF is too large.
AGAIN, LARGE = 64, 4
SEED = 42


# Fingerprints


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit i is 1 if it is set in over half of the XXH64 of the shingles of the words."""
    parts = text.lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    hash_of = xxhash.xxh64_intdigest
    if len(parts) <= shingle:
        found = [hash_of(line, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        starts = [0, *ends[:-1].tolist()]
        stops = (ends[shingle - 1 :] - 1).tolist()
        found = [hash_of(line[a:b], SEED) for a, b in zip(starts, stops)]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(found), 65_536):
        block = np.array(found[i : i + 65_536], np.dtype("<u8"))
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, digest: bool = False) -> DataFrame:
    """Per row: id, fp (the fingerprint as a signed long), and on request the digest of the text.

    Null text counts as empty."""
    kept = ["id", "digest"] if digest else ["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in words.slices(whole):
                found = [fingerprint((t or "").encode(), shingle) for t in batch.column("text").to_pylist()]
                signed = np.array(found, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(signed)], [*kept, "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), *([tables.digest_of().alias("digest")] if digest else []), "text")
    return rows.mapInArrow(run, "id long, digest binary, fp long" if digest else "id long, fp long")


# The tree


def distance(fps: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(fps ^ vantage)


def choose(fps: np.ndarray, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """A vantage and threshold that split fps most evenly, of some candidates; None if none splits."""
    best, at = len(fps), None
    for vantage in rng.choice(fps, min(8, len(fps)), replace=False):
        far = distance(fps, vantage)
        threshold = int(np.median(far))
        for t in (threshold - 1, threshold):
            near = int((far <= t).sum())
            if 0 < near < len(fps) and max(near, len(fps) - near) < best:
                best, at = max(near, len(fps) - near), (vantage, t)
    return at


def grow(sample: np.ndarray, leaves: int, rng: np.random.Generator):
    """A tree of about so many leaves: (vantage, threshold, near side, far side), a leaf is None."""
    if leaves < 2 or len(sample) < 4 or (node := choose(sample, rng)) is None:
        return None
    near = distance(sample, node[0]) <= node[1]
    half = leaves // 2
    return (*node, grow(sample[near], leaves - half, rng), grow(sample[~near], half, rng))


def route(tree, fps: np.ndarray, radius: int, here: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, leaf, home) of every leaf that a fingerprint lives in or must be asked in.

    here: which of fps live in the tree at all; the others are asked in every leaf that they can reach."""
    found, count = [], 0

    def walk(node, rows, home):
        nonlocal count
        if node is None:
            found.append((rows, np.full(len(rows), count), home))
            count += 1
            return
        vantage, threshold, near, far = node
        d = distance(fps[rows], vantage).astype(np.int64)
        to_near, to_far = d <= threshold + radius, d > threshold - radius
        walk(near, rows[to_near], home[to_near] & (d <= threshold)[to_near])
        walk(far, rows[to_far], home[to_far] & (d > threshold)[to_far])

    walk(tree, np.arange(len(fps)), np.ones(len(fps), bool) if here is None else here)
    rows, leaf, home = (np.concatenate(x) for x in zip(*found))
    lives = np.full(len(fps), -1, np.int64)
    lives[rows[home]] = leaf[home]
    later = home | (leaf > lives[rows])  # of two leaves, the earlier one's fingerprints are sent
    return rows[later], leaf[later], home[later]


def pairs(here: np.ndarray, asked: np.ndarray, radius: int, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (a of asked, b of here) within the radius, in blocks."""
    if not len(here) or not len(asked):
        return
    node = choose(here, rng) if len(here) > DIRECT else None
    if node is not None:
        d, q = distance(here, node[0]).astype(np.int64), distance(asked, node[0]).astype(np.int64)
        near = d <= node[1]
        if max(near.sum(), (~near).sum()) < 0.9 * len(here):
            yield from pairs(here[near], asked[q <= node[1] + radius], radius, rng)
            yield from pairs(here[~near], asked[q > node[1] - radius], radius, rng)
            return
    step = max(1, 1_000_000 // len(here))
    for i in range(0, len(asked), step):
        a, b = np.nonzero(np.bitwise_count(asked[i : i + step, None] ^ here[None, :]) <= radius)
        yield asked[i + a], here[b]


class Forest:
    """Groups of values, joined pair by pair; keeps for each the smallest value of its group."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.parent = np.arange(len(self.values))

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = np.searchsorted(self.values, a), np.searchsorted(self.values, b)
        while True:
            x, y = self.parent[a], self.parent[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.parent[self.parent]
                if (up == self.parent).all():
                    break
                self.parent = up

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        child = np.flatnonzero(self.parent != np.arange(len(self.parent)))
        return self.values[child], self.values[self.parent[child]]


def dealt_again(dealt: DataFrame, radius: int, leaf: int, sample: int) -> DataFrame:
    """dealt(leaf, home, fp) with every leaf of more than LARGE times `leaf` fingerprints cut into up to AGAIN leaves.

    A round gives each large leaf a tree grown from a sample of its own, of about `sample` fingerprints, in one task of
    that size; the tree travels with the rows of its leaf. A leaf has the number of its parent times AGAIN plus its place, so numbers
    of one round are its own, and small leaves keep theirs apart by the round. Rounds end when no leaf is too large, or none of the large can be cut.
    """
    numbers = "round int, leaf long, home boolean, fp long"

    def grown(key, table):
        fps = table.column("fp").to_numpy().view(np.uint64)
        wanted = min(AGAIN, -(-table.column("n")[0].as_py() // leaf))
        tree = grow(np.sort(fps), wanted, np.random.default_rng(SEED))
        return pa.table({"leaf": pa.array([key[0].as_py()], pa.int64()), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves, at = np.unique(batch.column("leaf").to_numpy(), return_inverse=True)
            fps, home = batch.column("fp").to_numpy(), batch.column("home").to_numpy(zero_copy_only=False)
            number = batch.column("round").to_numpy()
            for i, parent in enumerate(leaves.tolist()):
                mine = np.flatnonzero(at == i)
                tree = pickle.loads(batch.column("tree")[int(mine[0])].as_py())
                rows, child, lives = route(tree, fps[mine].view(np.uint64), radius, home[mine])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number[mine[rows]] + np.int32(1)), pa.array(parent * AGAIN + child), pa.array(lives), pa.array(fps[mine[rows]])],
                    ["round", "leaf", "home", "fp"],
                )

    done, now, before = [], dealt.withColumn("round", F.lit(0)).select("round", "leaf", "home", "fp"), None
    while True:
        now = tables.stored(now, "dealt")
        sizes = now.filter("home").groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LARGE * leaf)
        sizes = tables.stored(sizes, "large")
        largest = sizes.agg(F.count(F.lit(1)), F.max("n"), F.sum("n")).first()
        if not largest[0] or largest == before:
            return reduce(DataFrame.unionByName, done, now)
        before = largest
        some = now.filter("home").join(sizes, "leaf").filter(F.pmod(F.xxhash64("fp"), F.col("n")) < sample)
        trees = tables.stored(some.groupBy("leaf").applyInArrow(grown, "leaf long, tree binary"), "trees")
        done.append(now.join(sizes, "leaf", "left_anti").select("round", "leaf", "home", "fp"))
        now = now.join(trees, "leaf").select("round", "leaf", "home", "fp", "tree").mapInArrow(deal, numbers)


def links(fps: DataFrame, radius: int = RADIUS, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """fps(fp), distinct, to links (a, b) whose components are those of all pairs within the radius.

    The driver sees a sample of at most `sample` fingerprints, for the vantages of the shared tree. Every
    fingerprint is searched, and the result does not depend on the samples.
    """
    total = fps.count()
    some = fps.orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()
    seen = np.array([r.fp for r in some], np.int64).view(np.uint64)
    wanted, most = -(-total // leaf), max(1, sample // 8)
    tree = grow(seen, min(wanted, most), np.random.default_rng(SEED))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("fp").to_numpy()
            if len(values):
                rows, at, home = route(tree, values.view(np.uint64), radius)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(home), pa.array(values[rows])], ["leaf", "home", "fp"])

    def search(key, table):
        values = table.column("fp").to_numpy().view(np.uint64)
        here = table.column("home").to_numpy(zero_copy_only=False)
        forest = Forest(values)
        for a, b in pairs(values[here], values, radius, np.random.default_rng(SEED)):
            forest.join(a, b)
        a, b = forest.links()
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = fps.select("fp").mapInArrow(deal, "leaf long, home boolean, fp long")
    if wanted > most:
        return dealt_again(dealt, radius, leaf, sample).groupBy("round", "leaf").applyInArrow(search, "a long, b long")
    return dealt.groupBy("leaf").applyInArrow(search, "a long, b long")


# Components


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) to (node, root), root the smallest node reachable; only nodes with a link.

    Large-star and small-star rounds until nothing changes; every round is a written table.
    """

    def figures(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = tables.stored(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = figures(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = tables.stored(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = tables.stored(small.select("e.*").filter("a != b").distinct(), "links")
        after = figures(now)
        if after == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after


def rooted(rows: DataFrame, radius: int = RADIUS, leaf: int = LEAF) -> DataFrame:
    """rows(id, fp) to one row per distinct fingerprint: fp, first (its smallest id), root (equal for those that links connect)."""
    firsts = tables.stored(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    roots = components(links(firsts.select("fp"), radius, leaf))
    joined = firsts.join(roots, firsts["fp"] == roots["node"], "left")
    return tables.stored(joined.select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")


def near_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, leaf: int = LEAF) -> DataFrame:
    """Per row of docs: id, fp, component (the smallest doc_id reachable by links, its own included).

    Null and empty texts have fingerprint zero and are linked like any other. A null doc_id is
    larger than all; a component of null ids has a null id. Equal
    fingerprints count as linked. An empty table gives an empty result.
    """
    rows = tables.stored(fingerprints(docs, shingle), "fingerprints")
    joined = rooted(rows, radius, leaf)
    least = joined.groupBy("root").agg(F.min("first").alias("component"))
    named = joined.join(least, "root").select("fp", "component")
    return rows.join(named, "fp").select("id", "fp", "component")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each group, the one with the smallest doc_id, in all its columns.

    A null id is larger than all; of rows with one id, the text with the smallest digest stays,
    and of rows that repeat both, one. Null and empty texts are one group. An empty table gives an empty result.
    """
    rows = tables.stored(fingerprints(docs, shingle, digest=True), "fingerprints")
    roots = rooted(rows, radius).select("fp", "root")
    return tables.keep_first(docs, rows.join(roots, "fp").select("id", "digest", "root"))
