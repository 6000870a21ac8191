import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ticketflow.operators import audits


def scored(spark, n=300, seed=5):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), rng.choice("ab"), rng.choice([rng.random(), 0.8, 1.0, None])) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "truth string, prediction string, confidence double")


def test_threshold_sweep(spark):
    rows, df = scored(spark)
    for r in audits.threshold_sweep(df, [0.8, 0.2, 1.0]).collect():
        auto = [x for x in rows if x[2] is not None and x[2] > r.threshold]
        right, hits = sum(t == p for t, p, _ in rows), sum(t == p for t, p, _ in auto)
        assert r.automatic == len(auto) and r.coverage == pytest.approx(len(auto) / len(rows))
        assert r.recall == pytest.approx(hits / right)
        assert r.precision == (pytest.approx(hits / len(auto)) if auto else None)


def test_reliability(spark):
    rows, df = scored(spark)
    bins = defaultdict(list)
    for t, p, c in rows:
        if c is not None:
            bins[min(9, int(c * 10))].append((t == p, c))
    table = audits.reliability_bins(df)
    got = {r.bin: r for r in table.collect()}
    assert set(got) == set(bins)
    ece = 0.0
    for b, values in bins.items():
        acc, conf = sum(v[0] for v in values) / len(values), sum(v[1] for v in values) / len(values)
        assert got[b].n == len(values) and got[b].gap == pytest.approx(abs(acc - conf))
        ece += len(values) * abs(acc - conf)
    assert audits.calibration_error(table).first().ece == pytest.approx(ece / sum(map(len, bins.values())))


def texts(spark):
    """A third of the rows are copies of one text; some differ in case only."""
    rng = random.Random(3)
    rows = []
    for i in range(600):
        text = "Same  TEXT" if i % 3 == 0 else f"text {rng.randrange(300)}"
        rows.append((i, text, rng.choice(["train", "train", "validation", "test"]), rng.choice("xyz")))
    rows += [(1000, "only held", "test", "x"), (1001, None, "test", "x"), (1002, " same text", "train", "x")]
    return rows, spark.createDataFrame(rows, "id long, text string, split string, category string")


def norm(text):
    return " ".join((text or "").lower().split())


def test_leakage_with_a_hot_text(spark):
    rows, df = texts(spark)
    seen = {norm(t) for _, t, s, _ in rows if s == "train"}
    expected = sorted(i for i, t, s, _ in rows if s != "train" and norm(t) in seen)
    assert sorted(r.id for r in audits.leaked_rows(df).collect()) == expected
    for r in audits.split_leakage(df).collect():
        mine = [norm(t) for _, t, s, _ in rows if s == r.split]
        leaked = [t for t in mine if t in seen]
        assert (r.n, r.leaked, r.leaked_texts) == (len(mine), len(leaked), len(set(leaked)))
    plan = audits.leaked_rows(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 1 and plan.count("LogicalRDD") == 2


def test_items_in_documents(spark):
    items = [(1, "one two three four five six"), (2, "Two three"), (3, "five six seven"), (4, ""), (5, None), (6, "ne two"), (7, "x one two three four five")]
    docs = [(1, "zero ONE two, three four five six."), (2, "one two three four five seven"), (3, None), (4, "two three " * 500)]
    got = audits.contained_items(
        spark.createDataFrame(items, "item_id int, text string"), spark.createDataFrame(docs, "doc_id int, text string")
    )
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 1), (2, 2), (2, 4)]


def test_conflicting_labels(spark):
    rows, df = texts(spark)
    groups = defaultdict(Counter)
    for _, t, _, c in rows:
        groups[norm(t)][c] += 1
    expected = sorted((sum(c.values()), len(c)) for c in groups.values() if len(c) > 1)
    got = sorted((r.n_rows, r.n_labels) for r in audits.conflicting_labels(df).collect())
    assert got == expected
