import random
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ticketflow.llm import exact, simhash


def test_exact_groups(odd):
    by = defaultdict(list)
    for r in odd.collect():
        by[sha256((r.text or "").encode()).hexdigest()].append(r.doc_id)
    got = exact.exact_groups(odd.repartition(8), fan=2).collect()
    assert len(got) == sum(map(len, by.values()))
    for r in got:
        same = by[r.text_sha256]
        assert r.group_size == len(same)
        assert r.keep_id == max((i for i in same if i is not None), default=None)
    kept = defaultdict(int)
    for r in got:
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


def test_smallest_id_and_any_number_of_runs(documents):
    results = []
    for runs, fan in ((1, 2), (7, 3), (9, 2), (40, 16)):
        got = exact.exact_groups(documents.repartition(runs), fan, largest=False).collect()
        results.append(sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got))
        assert all(r.keep_id <= r.doc_id for r in got)
    assert all(r == results[0] for r in results)


def test_runs_are_what_tasks_wrote_in_order(documents):
    """Each file holds one run, sorted by digest; rounds of two runs end in one record per text."""
    rows = exact.sorted_runs(documents.repartition(9))
    files = defaultdict(list)
    for path, run, digest in rows.select(F.input_file_name(), "run", "digest").collect():
        files[path].append((run, bytes(digest)))
    assert len(files) == 9 == len({run for f in files.values() for run, _ in f})
    assert all(f == sorted(f) and f[0][0] == f[-1][0] for f in files.values())
    merged = exact.merge_runs(rows, fan=2)
    assert merged.count() == documents.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert merged.agg(F.sum("n")).first()[0] == documents.count()


def test_drop_copies(odd, none):
    left = exact.drop_copies(odd)
    assert left.columns == odd.columns
    texts = [r.text or "" for r in left.collect()]
    assert len(texts) == len(set(texts)) == len({r.text or "" for r in odd.collect()})
    assert exact.drop_copies(none).count() == exact.exact_groups(none).count() == 0


def test_drop_copies_of_one_row_many_times(spark):
    docs = spark.range(9_000).selectExpr("if(id % 3 = 0, 7, id) AS doc_id", "if(id % 3 = 0, 'same', concat('t', id)) AS text", "id AS row")
    left = exact.drop_copies(docs)
    assert left.columns == docs.columns
    assert left.count() == 6_001 and left.filter("text = 'same'").count() == 1


def naive(text, shingle=3):
    words = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = [w for w in words.encode().split()]
    if not words:
        return 0
    parts = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(rows, radius):
    """Brute force: smallest id reachable, over (id, fingerprint)."""
    ids, fps = [i for i, _ in rows], np.array([f for _, f in rows], np.uint64)
    near = [np.flatnonzero(np.bitwise_count(fps ^ f) <= radius).tolist() for f in fps]
    out = [None] * len(ids)
    for i in range(len(ids)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = min((ids[j] for j in seen if ids[j] is not None), default=None)
    return out


def test_near_groups(odd, none):
    found = simhash.near_groups(odd).collect()
    texts = sorted(naive(r.text) for r in odd.collect())
    assert sorted(r.fp % 2**64 for r in found) == texts
    assert [r.component for r in found] == groups([(r.id, r.fp % 2**64) for r in found], 2)
    assert simhash.near_groups(none).count() == 0


def test_one_of_each(odd, none, spark):
    left = simhash.one_of_each(odd)
    assert left.columns == odd.columns
    rows = odd.collect()
    fps = [naive(r.text) for r in rows]
    names = groups(list(enumerate(fps)), 2)
    by = defaultdict(list)
    for r, name in zip(rows, names):
        by[name].append((r.doc_id is None, r.doc_id or 0, sha256((r.text or "").encode()).digest()))
    got = [(r.doc_id is None, r.doc_id or 0, sha256((r.text or "").encode()).digest()) for r in left.collect()]
    assert sorted(got) == sorted(min(x) for x in by.values())
    assert simhash.one_of_each(none).count() == 0
    # one id, null too, with unlike texts: each of its own group stays, near copies go
    texts = ["a b c d", "A b c d", "other words are here", "e f g h i", "E F g h i"]
    docs = spark.createDataFrame([(None if i < 3 else 7, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert simhash.one_of_each(docs).count() == 3


def test_links_span_all_pairs(spark):
    """Random fingerprints, chains and one dense group, in small leaves."""
    rng = random.Random(1)
    values = [rng.getrandbits(64) for _ in range(600)]
    for v in values[:80]:
        for _ in range(rng.randrange(4)):
            v ^= 1 << rng.randrange(64)
            values.append(v)
    values += [values[0] ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)]
    values = sorted(set(values))
    signed = [(v - 2**64 if v >= 2**63 else v,) for v in values]
    fps = spark.createDataFrame(signed, "fp long")
    edges = simhash.links(fps, 2, leaf=50)
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    want = groups([(s[0], v) for s, v in zip(signed, values)], 2)
    assert [roots.get(s[0], s[0]) for s in signed] == want


@pytest.mark.parametrize("again", [4, 64])
def test_large_leaves_are_dealt_again(spark, monkeypatch, again):
    """A shared tree of 2 leaves, then trees of their own: the same links as brute force, and no leaf is left too large."""
    monkeypatch.setattr(simhash, "AGAIN", again)
    rng = random.Random(2)
    values = [rng.getrandbits(64) for _ in range(2_000)]
    values += [v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in values[:500]]
    values += [values[0] ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)]
    values = sorted(set(values))
    signed = [(v - 2**64 if v >= 2**63 else v,) for v in values]
    fps = spark.createDataFrame(signed, "fp long").repartition(5)
    roots = {r.node: r.root for r in simhash.components(simhash.links(fps, 2, leaf=20, sample=16)).collect()}
    assert [roots.get(s[0], s[0]) for s in signed] == groups([(s[0], v) for s, v in zip(signed, values)], 2)
    one = fps.select(F.lit(0).cast("long").alias("leaf"), F.lit(True).alias("home"), "fp")
    cut = simhash.dealt_again(one, 2, 20, 64)
    sizes = [r.n for r in cut.filter("home").groupBy("round", "leaf").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == len(values) and max(sizes) <= 80 and len(sizes) > 40


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 200)]
    got = simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 200)}


def test_equal_texts_share_a_component(documents):
    got = simhash.near_groups(documents).join(documents.select(F.col("doc_id").alias("id"), "text"), "id")
    assert got.groupBy("text").agg(F.countDistinct("component").alias("n")).filter("n > 1").count() == 0
