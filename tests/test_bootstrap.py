import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ticketflow.fixed_values import SEED
from ticketflow.operators import bootstrap, fit, metrics, suspects

SCHEMA = "id long, method string, truth string, prediction string"


def rows(n=600):
    rng = random.Random(2)
    out = []
    for i in range(n):
        truth = rng.choice("aab")
        out += [(i, m, truth, truth if rng.random() < p else rng.choice("ab")) for m, p in (("good", 0.9), ("bad", 0.6))]
    return out


def weight(key, replicate):
    """The rule in plain Python."""
    block, at = divmod(replicate, bootstrap.DRAWS)
    h = hashlib.md5(f"{SEED}:bootstrap{block}:{key}".encode()).hexdigest()
    half, j = divmod(at, bootstrap.DRAWS // 2)
    u = int(h[15 * half : 15 * half + 15], 16) >> bootstrap.DRAW_BITS * j & 2**bootstrap.DRAW_BITS - 1
    total, n = 0.0, 0
    while n < 7 and u >= math.floor(2**bootstrap.DRAW_BITS * (total := total + math.exp(-1) / math.factorial(n)) + 0.5):
        n += 1
    return n


def test_replicates_by_hand(spark):
    data = rows()
    counts = bootstrap.replicate_counts(spark.createDataFrame(data, SCHEMA).repartition(5), "id", 20, by=("method",))
    want = Counter()
    for i, m, t, p in data:
        want[m, -1, t, p] += 1
        for r in range(20):
            want[m, r, t, p] += weight(i, r)
    assert Counter({tuple(r)[:4]: r.n for r in counts.collect()}) == +want
    mean = sum(n for (_, r, _, _), n in want.items() if r >= 0) / 20 / len(data)
    assert abs(mean - 1) < 0.05


def test_intervals(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    counts = bootstrap.replicate_counts(df, "id", 60, by=("method",))
    got = {(r.method, r.metric): r for r in bootstrap.intervals(counts, by=("method",)).collect()}
    for m in ("good", "bad"):
        true = metrics.macro_metrics(metrics.confusion(df.filter(F.col("method") == m))).first()
        for name in bootstrap.METRICS:
            line = got[m, name]
            assert line.value == pytest.approx(true[name]) and line.low < line.value < line.high < line.low + 0.15
    apart = {r.metric: r for r in bootstrap.difference_intervals(counts, "method", "good", "bad").collect()}
    assert apart["accuracy"].differs and apart["accuracy"].low > 0.1
    same = {r.metric: r for r in bootstrap.difference_intervals(counts.filter("method = 'good'").unionByName(counts.filter("method = 'good'").withColumn("method", F.lit("again"))), "method", "good", "again").collect()}
    assert same["f1_macro"].low == same["f1_macro"].high == 0 and not same["f1_macro"].differs


def test_confident_joint_by_hand(spark):
    data = [(1, "a", [0.9, 0.1]), (2, "a", [0.8, 0.2]), (3, "a", [0.1, 0.9]), (4, "b", [0.3, 0.7]), (5, "b", [0.45, 0.55]), (6, None, [0.9, 0.1]), (7, "z", [0.2, 0.8])]
    scored = spark.createDataFrame(data, "id long, category string, probs array<double>")
    found = {r.id: r for r in suspects.judged(scored, ["a", "b"]).collect()}
    # thresholds: a 0.6, b 0.625
    assert [found[i].confident for i in range(1, 8)] == ["a", "a", "b", "b", None, "a", "b"]
    assert [i for i in found if found[i].suspect] == [3] and found[3].margin == pytest.approx(0.8)
    joint = {(r.label, r.confident): r.n for r in suspects.confident_joint(suspects.judged(scored, ["a", "b"])).collect()}
    assert joint == {("a", "a"): 2, ("a", "b"): 1, ("b", "b"): 1, ("z", "b"): 1}


def test_folds_keep_copies_together(spark):
    df = spark.createDataFrame([(i, f"Text  {i % 40}" if i % 2 else f"text {i % 40}") for i in range(400)], "id long, text string")
    folds = suspects.with_fold(df, 4)
    assert folds.groupBy(F.lower(F.regexp_replace("text", " +", " "))).agg(F.countDistinct("_fold").alias("n")).filter("n > 1").count() == 0
    assert {r._fold for r in folds.select("_fold").distinct().collect()} == {0, 1, 2, 3}
    with pytest.raises(ValueError):
        suspects.out_of_fold(df, fit.FitConfig(), folds=1)
