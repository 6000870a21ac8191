import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest

from ticketflow.llm import periods, queries


def longest_lyndon(w, key):
    """By definition: a word is Lyndon if it is smaller than all its proper suffixes."""
    w = [key(x) for x in w]
    return [max(n for n in range(1, len(w) - i + 1) if all(w[i : i + n] < w[i + k : i + n] for k in range(1, n))) for i in range(len(w))]


def brute(w, least):
    """All runs, by looking at every period and every stretch that keeps it."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                out.setdefault((i, j + q), q)  # the smallest period comes first
            i = max(j, i) + 1
    # a stretch with a smaller period p keeps q too only if p divides q, and then both are the same stretch
    return sorted((s, e - s, q) for (s, e), q in out.items())


WORDS = [
    "", "a", "aaaa", "abab", "abaababaabaab", "ab" * 20 + "c" + "ab" * 20, "a" * 50, "abc" * 9 + "ab", "aab" * 8 + "aac" * 8,
    "abcabcabcabc" * 3, "a" * 13 + "b" + "a" * 13, "abaababaabaababaababa" * 3,
]


@pytest.mark.parametrize("seed", range(6))
def test_lyndon_arrays_and_runs(seed):
    rng = random.Random(seed)
    made = ["".join(rng.choices("abc"[: 1 + seed % 3], k=rng.randrange(60))) for _ in range(25)]
    made += ["".join(rng.choices(["ab", "aab", "abc"], k=12)) * rng.randrange(1, 4) for _ in range(15)] + WORDS
    for text in made:
        w = [ord(c) for c in text]
        assert periods.lyndon(w) == longest_lyndon(w, lambda x: x)
        assert periods.lyndon([-x for x in w]) == longest_lyndon(w, lambda x: -x)
        for least in (2, 12):
            assert [tuple(r) for r in periods.runs(np.array(w, np.int64), least).tolist()] == brute(w, least)


def test_wrong_hashes_are_noticed(monkeypatch):
    monkeypatch.setattr(periods.words, "mix", lambda x: x * np.uint64(0))  # all words look alike
    for text in WORDS:
        w = [ord(c) for c in text]
        assert [tuple(r) for r in periods.runs(np.array(w, np.int64), 4).tolist()] == brute(w, 4)


def expected(doc_id, text):
    parts = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and parts:
        n, g = len(parts), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        parts = [parts[i] if i < a else parts[a + (i - a) % p] for i in range(n)]
    found = brute(parts, 12)
    drop = {i for s, m, q in found for i in range(s + q, s + m)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    kept = " ".join(x for i, x in enumerate(parts) if i not in drop)
    return (doc_id, len(found), *figures, sha256(lines.encode()).hexdigest(), sha256(kept.encode()).hexdigest())


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in rows if len((r.text or "").split()) < 1500]
    got = {r.doc_id: tuple(r) for r in queries.op12_periods(spark, folder).collect()}
    assert len(got) == len(rows) and len(short) > 100
    assert [got[r.doc_id] for r in short] == [expected(*r) for r in short]
    assert sum(r[1] > 0 for r in got.values()) > 10


def test_odd_rows(odd, none, spark):
    long = ["x y z " * 5_000, "    " * 40, "a b\n" * 6, " ".join(map(str, range(3000))) + " 1 2" * 6]
    docs = odd.select("doc_id", "text", "id", "row").unionByName(spark.createDataFrame([(100 + i, t, "", "") for i, t in enumerate(long)], "doc_id long, text string, id string, row string"))
    got = sorted((str(r.id), r.collapsed, [tuple(x) for x in r.runs]) for r in periods.periodic(docs).collect())
    want = []
    for r in docs.collect():
        parts = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        found = brute(parts, 12) if len(parts) < 5_000 else []
        if len(parts) >= 5_000:
            q = 1 if len(set(parts)) == 1 else 3
            found = [(0, len(parts), q)]
        drop = {i for s, m, q in found for i in range(s + q, s + m)}
        want.append((str(r.doc_id), " ".join(x for i, x in enumerate(parts) if i not in drop), found))
    assert got == sorted(want)
    assert periods.periodic(none).count() == 0
