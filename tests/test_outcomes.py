import math
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from ticketflow.operators import drift
from ticketflow.streaming import outcomes
from ticketflow.streaming import tickets as streams

START = datetime(2024, 1, 1)
DECISION, LABEL = "id long, ts timestamp, prediction string", "id long, label_ts timestamp, truth string"


def hours(n):
    return START + timedelta(hours=n)


DECISIONS = [(1, hours(0), "a"), (2, hours(1), "a"), (3, hours(2), "b"), (4, hours(3), "b"), (5, hours(4), None)]
LABELS = [(1, hours(10), "a"), (1, hours(11), "b"), (2, hours(60), "a"), (3, hours(50), "a"), (4, hours(2), "b"), (9, hours(9), "a"), (5, hours(5), "a")]
WANT = Counter({
    (1, "OK"): 1, (1, "ERROR"): 1, (2, "UNLABELLED"): 1, (2, "STRAY"): 1, (3, "ERROR"): 1, (4, "UNLABELLED"): 1, (4, "STRAY"): 1, (9, "STRAY"): 1, (5, "ERROR"): 1,
})


def test_batch_outcomes_and_windows(spark):
    found = outcomes.outcomes(spark.createDataFrame(DECISIONS, DECISION), spark.createDataFrame(LABELS, LABEL))
    assert Counter((r.id, r.status) for r in found.collect()) == WANT
    day = outcomes.error_windows(found).collect()
    assert [(r.window_start, r.decided, r.labelled, r.errors) for r in day] == [(START, 6, 4, 3)]
    assert outcomes.error_windows(found.filter("status = 'UNLABELLED'")).first().error_rate is None


def test_stream_equals_batch_drops_late_rows_and_forgets(spark, tmp_path):
    where = {n: str(tmp_path / n) for n in ("d", "t", "out", "ck")}

    def deliver(decisions, labels):
        for name, rows, kind in (("d", decisions, DECISION), ("t", labels, LABEL)):
            spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(where[name])

    def run():
        sides = [streams.read_stream(spark, where[n], schema=spark.read.schema(k).parquet(where[n]).schema, files_per_batch=1) for n, k in (("d", DECISION), ("t", LABEL))]
        query = streams.write_stream(outcomes.outcomes(*sides), where["out"], where["ck"])
        query.awaitTermination()
        return query

    deliver(list(reversed(DECISIONS)), list(reversed(LABELS)))  # out of order
    deliver([(-1, hours(2000), "x")], [(-2, hours(2000), "x")])
    run()
    deliver([(7, hours(3), "late")], [(7, hours(4), "late")])  # long after their watermark
    query = run()
    got = Counter((r.id, r.status) for r in spark.read.parquet(where["out"]).collect() if r.id > 0)
    assert got == WANT
    assert outcomes.dropped_rows(query) >= 2
    assert outcomes.state_rows(query)[-1] <= 2  # the two closing rows; all others are forgotten


def test_sketches_merge_and_bound_quantiles(spark):
    rng = random.Random(5)
    rows = [(i, START + timedelta(hours=rng.randrange(72)), rng.choice("ab"), rng.random() ** (1 + i % 3)) for i in range(3000)]
    rows += [(-1, START, "a", None), (-2, START, None, float("nan")), (-3, START, "a", 1.7), (-4, START, "a", -1.0), (-5, None, "a", 0.5)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, prediction string, confidence double")
    whole = drift.sketch(df)
    parts = drift.merged(*[drift.sketch(df.filter(f"pmod(id, 3) = {k}")) for k in range(3)])
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.collect()))
    for at in (0.1, 0.5, 0.9):
        got = {r.window_start: r.quantile_cell for r in drift.quantile_cells(whole, at).collect()}
        for k in range(3):
            day = sorted(min(1, max(0, c)) for _, ts, _, c in rows if ts and c is not None and c == c and (ts - START).days == k)
            true = day[math.ceil(at * len(day)) - 1]
            assert 0 <= true - got[START + timedelta(days=k)] / drift.CELLS <= 1 / drift.CELLS


def test_drift_grows_with_the_shift(spark):
    rng = random.Random(6)
    rows = []
    for day, power in enumerate((1, 1, 1.5, 4)):
        rows += [(START + timedelta(days=day), "a" if rng.random() < 0.5 + day * 0.1 else "b", rng.random() ** power) for _ in range(2000)]
    rows.append((START + timedelta(days=4), "new", 0.5))
    df = spark.createDataFrame(rows, "ts timestamp, prediction string, confidence double")
    got = drift.drift_scores(drift.sketch(df)).orderBy("window_start").collect()
    assert got[0].psi_confidence == got[0].js_confidence == got[0].psi_class == 0
    assert got[1].psi_confidence < 0.02 < got[2].psi_confidence < got[3].psi_confidence and got[3].psi_confidence > 0.5
    assert got[0].js_class < got[1].js_class < got[2].js_class < got[3].js_class <= 1
    # one class by hand
    p, q = [0.5 + x for x in Counter(r[1] for r in rows[2000:4000]).values()], Counter(r[1] for r in rows[:2000])
    names = list(Counter(r[1] for r in rows[2000:4000]))
    p, q = [*p, 0.5], [*[0.5 + q[n] for n in names], 0.5]
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    assert got[1].psi_class == pytest.approx(sum((a - b) * math.log(a / b) for a, b in zip(p, q)))
    last = drift.drift_scores(drift.sketch(df), reference=drift.F.col("window_start") == drift.F.lit(START + timedelta(days=3))).orderBy("window_start").collect()
    assert last[3].psi_confidence == 0 and last[0].psi_confidence > 0.5
