import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from ticketflow.llm import queries, variants


def edits(word):
    """Keys that two words share if, and not only if, one edit makes one of the other."""
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    by = defaultdict(set)
    for w in counts:
        for key in edits(w):
            by[key].add(w)
    out = set()
    forms = {}
    for w, n in counts.items():
        others = [o for o in set().union(*(by[k] for k in edits(w))) if near(w, o)]
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        forms[w] = (best if best is not None and counts[best] >= 2 * n else None, len(others))
    for w, n in counts.items():
        root = w
        while forms[root][0] is not None:
            root = forms[root][0]
        form = forms[w][0]
        out.add((w, form, root, n, forms[w][1], counts[form] if form is not None else None))
    return out


def vocabulary(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in queries.op13_variants(spark, folder).collect()]
    want = brute(vocabulary(rows))
    assert len(got) == len(want) > 1000 and set(got) == want


def test_neighbourhoods_are_full():
    """Every edit of a reduced word has its hash among the neighbours."""
    column = pa.array(["plane", "étéÀßz", "aaaaa", "q" * 40])
    reduced = variants.Reduced(column)
    symbol, ends = variants.symbols(column)
    found = defaultdict(set)
    for word, code in reduced.neighbours():
        for w, c in zip(word.tolist(), code.tolist()):
            found[w].add(c)

    def code(s):
        return sum(int(variants.SYMBOL[x]) * pow(int(variants.BASE), k, 2**64) for k, x in enumerate(s)) % 2**64

    for w in range(4):
        s = symbol[ends[w] : ends[w + 1]].tolist()
        made = {code(s)}
        for i in range(len(s) + 1):
            for x in range(variants.SYMBOLS):
                made.add(code([*s[:i], x, *s[i:]]))
                if i < len(s):
                    made |= {code([*s[:i], x, *s[i + 1 :]]), code([*s[:i], *s[i + 1 :]])}
        assert found[w] == made


def test_chains_ties_and_dense_groups(spark):
    rng = random.Random(3)
    counts = {"chain" + "a" * k: 3 * 2**k for k in range(8)}
    counts |= {"tieab": 3, "tieac": 9, "tiead": 9, "tieéb": 9, "alone": 3, "w" * 5000: 3, "w" * 5001: 8}
    counts |= {"".join(rng.choices("abc", k=6)): rng.randrange(3, 40) for _ in range(300)}
    vocab = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = [tuple(r) for r in variants.grouped(vocab).collect()]
    assert len(got) == len(counts) and set(got) == brute(counts)
    assert {r[2] for r in got if r[0].startswith("chain")} == {"chain" + "a" * 7}


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = {tuple(r) for r in variants.grouped(variants.vocabulary(queries.misspelt(variants.letter_runs(odd)))).collect()}
    assert got == brute(vocabulary(rows)) and got
    assert variants.grouped(variants.vocabulary(variants.letter_runs(none))).count() == 0


def test_filter_lets_all_known_codes_through(spark):
    vocab = spark.createDataFrame([(f"word{i}", 3) for i in range(500)], "word string, n long")
    known = variants.coded(vocab)
    flags = variants.reduced_filter(known.select("code"))
    bits = variants._bit(np.array([r.code for r in known.collect()], np.int64))
    assert ((flags[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1).all() and np.unpackbits(flags).sum() <= 500


def test_no_join_is_broadcast_by_estimate(spark, monkeypatch):
    """Spark takes the asked codes, some 20 times as many rows as words, for smaller than the words."""
    frames, stored = [], variants.tables.stored
    monkeypatch.setattr(variants.tables, "stored", lambda df, name: frames.append(df) or stored(df, name))
    vocab = spark.createDataFrame([("chain" + "a" * k, 3 * 2**k) for k in range(8)], "word string, n long")
    out = variants.grouped(vocab)
    plans = [df._jdf.queryExecution().sparkPlan().toString() for df in [*frames, out]]
    assert sum(p.count("SortMergeJoin") for p in plans) >= 5 and not any("Broadcast" in p for p in plans)
    assert {r.root for r in out.collect()} == {"chain" + "a" * 7}
