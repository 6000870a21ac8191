import random

import numpy as np

from ticketflow.llm import quality


def labelled(spark, good, bad, seed=5):
    """Texts of two kinds that overlap, many good and few bad ones, with their labels."""
    rng = random.Random(seed)
    words = [[f"{c}{i}{c * (i % 5)}" for i in range(400)] for c in "ab"]
    rows = []
    for i in range(good + bad):
        q = int(i % (good + bad) < good)
        share = rng.gauss(0.56 if q else 0.44, 0.1)
        rows.append((i, " ".join(rng.choice(words[rng.random() > share]) for _ in range(40)), q))
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(2).cache()
    return table.select("doc_id", "text"), table.select("doc_id", "quality")


def test_a_small_sample_means_the_same_as_a_large_one(spark):
    docs, labels = labelled(spark, 3_000, 300)
    means = [np.mean([r.score for r in quality.scores(docs, quality.fit(docs, labels, rows=n)).collect()]) for n in (180, 5_000)]
    assert abs(means[0] - means[1]) < 0.04 and abs(means[1] - 10 / 11) < 0.04


def test_a_text_that_does_not_fit_is_passed_over(spark):
    """Long good texts all over the order: the bad ones and the short good ones are still learnt from."""
    docs, labels = labelled(spark, 60, 60)
    long = docs.selectExpr("doc_id", "if(doc_id < 50, repeat(text, 200), text) AS text")
    assert long.selectExpr("max(octet_length(text)) AS n").first().n < 80_000
    model = quality.fit(long, labels, size=80_000)
    assert model.good and model.bad
